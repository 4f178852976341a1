"""A pushdown scanner over the lexemes of JSON: whether a text is JSON, the beginning of it or neither, and what is open.

A value is read by a grammar of four places: where a value may stand, after a value, where a name may stand and after a
name. Lexemes are whole numbers, strings, words and marks; only a string or a word may be cut off at the end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_CHARS = r'(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*'
_LEXEME = re.compile(
    rf"""[ \t\n\r]*(?:(?P<mark>[{{}}\[\],:])
    |(?P<string>"{_CHARS}")
    |(?P<cut>"{_CHARS}\\?\Z)
    |(?P<word>-?Infinity|NaN|true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)
    |(?P<part>[a-z]+\Z)
    |(?P<end>\Z))""",
    re.X,
)
_CLOSER = {"{": "}", "[": "]"}


@dataclass
class Scan:
    """``state``: complete, extendable or broken. ``open``: the marks that would close what is open, innermost last.
    ``loose``: places of commas that stand right before a closing mark. ``cut``: the text ends within a string."""

    state: str = "extendable"
    open: list[str] = field(default_factory=list)
    loose: list[int] = field(default_factory=list)
    cut: bool = False


def scan(text: str, forgive: bool = False) -> Scan:
    """Read ``text`` as far as it goes; ``forgive`` lets a comma stand before a closing mark (and notes its place)."""
    out, at, place, comma = Scan(), 0, "value", -1
    while True:
        found = _LEXEME.match(text, at)
        kind = found.lastgroup if found else None
        if kind is None:
            out.state = "broken"
            return out
        lexeme, begin, at = found[kind], found.start(kind), found.end()
        if kind == "end":
            out.state = "complete" if place == "after" and not out.open else "extendable"
            return out
        if kind in ("cut", "part"):
            word = kind == "part" and place in ("value", "first") and any(w.startswith(lexeme) for w in ("true", "false", "null"))
            string = kind == "cut" and place in ("value", "first", "name", "first name")
            out.cut, out.state = string, "extendable" if word or string else "broken"
            return out
        closes = out.open and lexeme == out.open[-1]
        loose = closes and comma >= 0 and place in ("value", "name")
        if closes and (place in ("after", "first", "first name") or loose and forgive):
            if loose:
                out.loose.append(comma)
            out.open.pop()
            place = "after"
        elif kind == "string" and place in ("name", "first name"):
            place = "colon"
        elif lexeme == ":" and place == "colon":
            place = "value"
        elif lexeme == "," and place == "after" and out.open:
            comma, place = begin, "name" if out.open[-1] == "}" else "value"
            continue
        elif lexeme in _CLOSER and kind == "mark" and place in ("value", "first"):
            out.open.append(_CLOSER[lexeme])
            place = "first name" if lexeme == "{" else "first"
        elif kind in ("string", "word") and place in ("value", "first"):
            place = "after"
        else:
            out.state = "broken"
            return out
        comma = -1


def mended(text: str) -> str | None:
    """``text`` without commas before closing marks and with what is open closed; null where that makes no JSON."""
    clean = text.strip()
    seen = scan(clean, forgive=True)
    if seen.state == "broken" or seen.cut:
        return None
    for place in reversed(seen.loose):
        clean = clean[:place] + clean[place + 1 :].lstrip()
    clean += "".join(reversed(seen.open))
    return clean if scan(clean).state == "complete" else None
