"""SQL spellings of the text rules, for DuckDB. Its ``\\s`` is ASCII and it has no NFKC, so the compatibility characters
that the tables contain are translated by name."""

from __future__ import annotations

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_NARROW = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")


def folded(x: str) -> str:
    """NFKC for the characters at hand: full-width forms, fixed and wide spaces, a lone diaeresis, ordinal a."""
    return f"translate(replace(replace({x}, '¨', ' ̈'), 'ª', 'a'), '{_WIDE}\u00a0\u2003', '{_NARROW}  ')"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def normal(x: str) -> str:
    bare = f"regexp_replace(lower({folded(x)}), '[.,!?;:''\"‘’“”]', '', 'g')"
    return squash(rf"regexp_replace({bare}, '([+\-*/=()<>%])', ' \1 ', 'g')")


def words(x: str) -> str:
    """The words of a squashed text."""
    return f"CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({x}, ' ') END"


def grams(w: str, n: int) -> str:
    return f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


def plain_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def looks_like_call(x: str) -> str:
    t = strip(x)
    return f"(starts_with({t}, '{{') AND contains({t}, '\"name\"') OR starts_with({t}, '[{{\"name\"'))"
