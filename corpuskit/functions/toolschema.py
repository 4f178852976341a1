"""Schemas of tools derived from Python: functions, dataclasses, pydantic models and ready dictionaries."""

from __future__ import annotations

import dataclasses
import enum
import inspect
import re
import types
import typing
from collections.abc import Callable, Mapping, Sequence
from typing import Any

_PLAIN = {str: "string", int: "integer", float: "number", bool: "boolean", type(None): "null"}
_SECTION = re.compile(r"^\s*(Args|Arguments|Parameters)\s*:\s*$")
_ENTRY = re.compile(r"^\s+(\w+)\s*(?:\([^)]*\))?\s*:\s*(.+?)\s*$")


class SchemaError(TypeError):
    """No schema can be derived."""


def type_schema(hint: Any) -> dict[str, Any]:
    """The JSON Schema of a type hint; ``Annotated`` hints may carry further keywords as a dictionary.

    A union with None is the schema of the rest; other unions, and hints without a JSON counterpart, accept anything.
    """
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin is typing.Annotated:
        extra = [m for m in args[1:] if isinstance(m, Mapping)]
        return type_schema(args[0]) | {k: v for m in extra for k, v in m.items()}
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        return type_schema(rest[0]) if len(rest) == 1 else {}
    if origin is typing.Literal:
        return {"enum": list(args)}
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        return {"enum": [m.value for m in hint]}
    if hint in _PLAIN:
        return {"type": _PLAIN[hint]}
    base = origin or hint
    if isinstance(base, type) and dataclasses.is_dataclass(base):
        return schema_of(base)["parameters"]
    if isinstance(base, type) and issubclass(base, Mapping):
        return {"type": "object"}
    if isinstance(base, type) and issubclass(base, (Sequence, set, frozenset)):
        item = type_schema(args[0]) if args else {}
        return {"type": "array"} | ({"items": item} if item else {})
    return {}


def _may_miss(hint: Any) -> bool:
    return type(None) in typing.get_args(hint)


def docstring_parts(text: str | None) -> tuple[str, dict[str, str]]:
    """The first paragraph of a docstring and what its section of arguments says of each."""
    lines = inspect.cleandoc(text or "").splitlines()
    start = next((i for i, line in enumerate(lines) if _SECTION.match(line)), len(lines))
    about = dict(m.groups() for line in lines[start + 1 :] if (m := _ENTRY.match(line)))
    return " ".join(" ".join(lines[:start]).split("  ")[0].split()) if start else "", about


def _parameters(fields: list[tuple[str, Any, bool]], about: Mapping[str, str]) -> dict[str, Any]:
    """The object schema of (name, hint, has a default) fields."""
    properties = {}
    for name, hint, _ in fields:
        own = type_schema(hint)
        properties[name] = own | ({"description": about[name]} if name in about and "description" not in own else {})
    needed = [name for name, hint, has_default in fields if not has_default and not _may_miss(hint)]
    return {"type": "object", "properties": properties} | ({"required": needed} if needed else {})


def schema_of(source: Callable | type | Mapping[str, Any]) -> dict[str, Any]:
    """name, description and parameters of a tool.

    Of a function: its signature, hints and docstring; of a dataclass: its fields; of a pydantic model: its own schema; a
    dictionary with a name and parameters stands for itself.
    """
    if isinstance(source, Mapping):
        if not isinstance(source.get("name"), str) or not isinstance(source.get("parameters", {}), Mapping):
            raise SchemaError("a tool has a name and parameters")
        return {"description": "", "parameters": {"type": "object", "properties": {}}} | dict(source)
    if isinstance(source, type) and hasattr(source, "model_json_schema"):
        whole = source.model_json_schema()
        kept = {k: whole[k] for k in ("properties", "required", "$defs") if k in whole}
        return {"name": whole.get("title", source.__name__), "description": (source.__doc__ or "").strip(), "parameters": {"type": "object"} | kept}
    if isinstance(source, type) and not dataclasses.is_dataclass(source) or not callable(source):
        raise SchemaError(f"no schema of {source!r}")
    hints = typing.get_type_hints(source, include_extras=True)
    written = source.__doc__ if not (source.__doc__ or "").startswith(f"{source.__name__}(") else ""
    summary, about = docstring_parts(written)
    if isinstance(source, type):
        missing = dataclasses.MISSING
        fields = [(f.name, hints[f.name], f.default is not missing or f.default_factory is not missing) for f in dataclasses.fields(source)]
    else:
        flexible = (inspect.Parameter.VAR_POSITIONAL, inspect.Parameter.VAR_KEYWORD)
        own = [p for p in inspect.signature(source).parameters.values() if p.kind not in flexible and p.name not in ("self", "cls")]
        fields = [(p.name, hints.get(p.name, Any), p.default is not p.empty) for p in own]
    return {"name": source.__name__, "description": summary, "parameters": _parameters(fields, about)}
