"""Whether the arguments of a call stand in the text they are said to come from, in plain Python for Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime
from typing import Any

_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
SHORT = 32  #: characters up to which a text must be grounded in balanced mode
# The ways in which a date may be written as an argument, and in the source.
READ_AS = ("%Y-%m-%d", "%m/%d/%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y")
WRITTEN_AS = ("%Y-%m-%d", "%B %d, %Y", "%b %d, %Y", "%m/%d/%Y", "%Y")
MODES = ("strict", "balanced", "permissive")


def _date(text: str) -> date | None:
    for form in READ_AS:
        try:
            return datetime.strptime(text, form).date()
        except ValueError:
            pass
    return None


def _candidates(field: str, value: Any) -> Iterator[tuple[str, str, str | None]]:
    """(text, where to look for it, what was changed), the plainest first; nothing for values that are never grounded."""
    if isinstance(value, bool):
        yield field, "any case", None  # only the talk of it can be found, not its truth
    elif isinstance(value, (int, float)):
        yield str(value), "numbers", None
        if isinstance(value, float) and value.is_integer():
            yield str(int(value)), "numbers", "number_normalized"
    elif isinstance(value, str):
        yield value, "text", None
        yield value, "any case", "case_insensitive"
        if day := _date(value):
            yield from ((day.strftime(form), "any case", "date_normalized") for form in WRITTEN_AS)


def grounded_fields(arguments: dict[str, Any], source: str) -> list[tuple[str, bool, str | None, str | None]]:
    """(field, grounded, what stands in the source, what was changed) of each argument; nested ones are never grounded."""
    low, numbers = source.lower(), set(_NUMBER.findall(source))
    stands = {"text": lambda t: t in source, "any case": lambda t: t.lower() in low, "numbers": lambda t: t in numbers}
    out = []
    for field, value in arguments.items():
        hit = next(((text, how) for text, where, how in _candidates(field, value) if stands[where](text)), None)
        out.append((field, hit is not None, *(hit or (None, None))))
    return out


def blocks(arguments: dict[str, Any], found: list[tuple[str, bool, str | None, str | None]], mode: str) -> bool:
    """Whether ungrounded arguments keep a call from being run: never, any, or any that isn't a long text."""
    loose = [arguments[field] for field, grounded, *_ in found if not grounded]
    return {"permissive": False, "strict": bool(loose), "balanced": any(not isinstance(v, str) or len(v) <= SHORT for v in loose)}[mode]
