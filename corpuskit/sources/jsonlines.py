"""Strict parsing of single JSON lines, for use inside Arrow batches."""

from __future__ import annotations

import json


def _reject(name: str):
    raise ValueError(f"{name} is no JSON value")


def json_object(line: str | None) -> dict | None:
    """The JSON object in ``line``, or None when the line holds anything else.

    Numbers come back as ``Number`` texts, NaN and infinities are refused, and nesting deeper than the interpreter
    can follow counts as unreadable.
    """
    if line is None:
        return None
    try:
        value = json.loads(line, parse_constant=_reject, parse_int=Number, parse_float=Number)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


class Number(str):
    """A JSON number as it is spelt."""

    __slots__ = ()
