"""Text rules in plain Python, for use inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata

# Marks that vanish, signs that are words of their own.
MARKS = ".,!?;:'\"‘’“”"
SIGNS = "+-*/=()<>%"

_DROP = str.maketrans("", "", MARKS)
_SIGN = re.compile("([" + re.escape(SIGNS) + "])")
_ALNUM = re.compile(r"[^\W_]+")


def reading_words(text: str) -> list[str]:
    """The words by which two texts read the same: NFKC, lower case, marks gone, signs alone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _SIGN.sub(r" \1 ", text.lower().translate(_DROP)).split()


def reading_text(text: str) -> str:
    return " ".join(reading_words(text))


def alnum_words(text: str) -> list[str]:
    """Runs of letters and digits after NFKC and lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _ALNUM.findall(text.lower())


def storable(text: str) -> str:
    """The text with lone surrogates replaced, so that it can be written as UTF-8."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
