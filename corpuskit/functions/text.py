"""Text functions as columns: built-in expressions, with one Arrow function for what Spark has no built-in for (NFKC)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

from corpuskit.functions import types as Y
from corpuskit.functions.binding import let
from corpuskit.functions.pytext import MARKS, SIGNS

#: White space as Python sees it: Unicode white space and the four separators at \x1c.
SPACE = r"(?U)[\s\x1c-\x1f]"

# Words that ranking ignores.
STOP_WORDS = (
    "a an the of to in on at for with and or is are was were be been being this that these those it its as by from into "
    "your you i my me we our what which who whom how do does did can could should would will"
).split()
# Marks around a word that don't belong to it.
WORD_MARKS = ".,!?;:\"'()[]{}“”‘’…-"


@F.pandas_udf(Y.STRING)
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Only texts with non-ASCII characters travel to Python; the others are sent as nulls."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, rf"^(?:{SPACE})+|(?:{SPACE})+$", "")


def squash(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def words(text: Column) -> Column:
    """The words of a text, white space apart; none of a blank text."""
    return let(squash(text), _words)


def _words(clean: Column) -> Column:
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]\\^-\"'" else c for c in chars) + "]"


def normalize_text(text: Column) -> Column:
    """The form in which texts are compared: NFKC, lower case, marks gone, each sign a word, single spaces."""
    bare = F.regexp_replace(F.lower(nfkc(text)), _class(MARKS), "")
    return squash(F.regexp_replace(bare, "(" + _class(SIGNS) + ")", " $1 "))


def grams(items: Column, n: int, sep: str = " ") -> Column:
    """All runs of ``n`` neighbours of an array of strings, joined; none when there are fewer than ``n``."""

    def runs(w: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), sep))
        return F.when(F.size(w) >= n, all_).otherwise(F.array().cast("array<string>"))

    return let(items, runs)


def ngrams(plain: Column, n: int) -> Column:
    """The set of word n-grams of a normalised text (a column of its own: no Arrow function may stand in a lambda)."""
    return F.array_distinct(grams(words(plain), n))


def gram_hashes(items: Column, n: int) -> Column:
    """128-bit hashes (a, b) of all runs of ``n`` neighbours of an array of strings, none when there are fewer."""

    def runs(w: Column) -> Column:
        pair = lambda g: F.struct(F.xxhash64(F.lit(0), g).alias("a"), F.xxhash64(F.lit(1), g).alias("b"))
        all_ = F.transform(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.slice(w, i, n)), pair)
        return F.when(F.size(w) >= n, all_).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))

    return let(items, runs)


def plain_words(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def plain_text(text: Column) -> Column:
    return F.array_join(plain_words(text), " ")


def shingles(text: Column, size: int = 3) -> Column:
    """The set of word shingles of the plain text; a shorter text is one shingle, one without words has none."""
    return let(plain_words(text), lambda w: _shingles(w, size))


def _shingles(w: Column, size: int) -> Column:
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < size, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(grams(w, size)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are equal."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))))


def repetition(text: Column, n: int = 6) -> Column:
    """The share of character n-grams that repeat an earlier one; 0 for texts below n + 6 characters."""

    def share(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(F.length(t) < n + 6, F.lit(0.0)).otherwise(let(runs, lambda r: 1.0 - F.size(F.array_distinct(r)) / F.size(r)))

    return let(strip(text), share)


def distinct_n(items: Column, n: int) -> Column:
    """Distinct n-grams by all n-grams; with fewer than n items 1 if there is any and else 0."""

    def share(w: Column) -> Column:
        return F.when(F.size(w) < n, F.when(F.size(w) > 0, F.lit(1.0)).otherwise(0.0)).otherwise(let(grams(w, n, "\x1f"), lambda g: F.size(F.array_distinct(g)).cast("double") / F.size(g)))

    return let(items, share)


def record_id(source: Column, text: Column) -> Column:
    return F.concat(source, F.lit("-"), F.substring(F.sha2(text, 256), 1, 16))


def content_key(text: Column) -> Column:
    """16 hex digits that equal texts share, whatever their formatting."""
    return F.substring(F.sha2(normalize_text(text), 256), 1, 16)


def heldout(salt: str, value: Column, mod: int = 5) -> Column:
    """Whether a hash puts the value into the held-out fraction of 1 / ``mod``."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), value.cast("string")), 256), 1, 8), 16, 10).cast("bigint") % mod == 0


def redact_url(url: Column) -> Column:
    """An http(s) address without user, query and fragment, its scheme and host in lower case; others unchanged."""
    rest = r"(?i)^(https?)://(?:[^/?#]*@)?([^/?#]*)([^?#]*).*$"
    redacted = F.concat(F.lower(F.regexp_extract(url, rest, 1)), F.lit("://"), F.lower(F.regexp_extract(url, rest, 2)), F.regexp_extract(url, rest, 3))
    return F.when(url.rlike(rest), redacted).otherwise(url)


def trim_marks(token: Column) -> Column:
    c = _class(WORD_MARKS)
    return F.regexp_replace(token, f"^{c}+|{c}+$", "")


def is_word(token: Column) -> Column:
    """Letters only, once marks around and apostrophes and hyphens within are gone."""
    return F.regexp_replace(trim_marks(token), r"['’\-]", "").rlike(r"^\p{L}+$")


def normalize_word(token: Column) -> Column:
    return F.lower(F.regexp_replace(trim_marks(token), "’", "'"))


def looks_like_call(text: Column) -> Column:
    t = strip(text)
    return (t.startswith("{") & t.contains('"name"')) | t.startswith('[{"name"')


def split_sentences(text: Column) -> Column:
    return F.split(text, r"(?U)(?<=[.!?])[\s\x1c-\x1f]+")


def ranking_terms(text: Column) -> Column:
    """Plain words without stop words, repeats kept."""
    return F.filter(plain_words(text), lambda w: ~w.isin(*STOP_WORDS))


def paragraphs(text: Column) -> Column:
    """Paragraphs: blank-line blocks with hard-wrapped lines joined where a blank line occurs, else one for each line."""
    lines = F.split(text, "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]", -1)
    blocks = F.transform(F.split(text, r"\n(?:(?U)[\s\x1c-\x1f])*\n", -1), squash_lines)
    blank = text.rlike(r"\n(?U)[\s\x1c-\x1f]*\n")
    return F.filter(F.when(blank, blocks).otherwise(F.transform(lines, strip)), lambda p: p != "")


def squash_lines(block: Column) -> Column:
    """The lines of a block, each without outer white space, joined by a space; empty lines vanish."""
    lines = F.transform(F.split(block, "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]", -1), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def table_hash(row_hash: Column) -> Column:
    """An aggregate: one hash of a multiset of rows from their sha256 hashes: the count and the sums of four 60-bit
    parts. They add up in any order and never hold rows, so a table of any size has its hash."""
    parts = [F.sum(F.conv(F.substring(row_hash, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *parts), 256)
