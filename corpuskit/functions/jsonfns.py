"""Row functions over JSON and expression texts: Arrow functions, since Spark has no built-in with these semantics."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from corpuskit.functions import pyground, pyjson, types as Y


def _each(fn, texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fn(t))


@F.pandas_udf(Y.STRING)
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys and without white space; null for no JSON."""
    return _each(lambda t: pyjson.canonical(pyjson.load(t)) if pyjson.load(t) is not pyjson.BROKEN else None, texts)


@F.pandas_udf(Y.STRING)
def tool_call_text(names: pd.Series, arguments: pd.Series) -> pd.Series:
    """A tool call as an assistant writes it: the name first, then the arguments with sorted keys."""
    out = []
    for name, args in zip(names, arguments, strict=True):
        value = pyjson.load(args) if args is not None else pyjson.BROKEN
        out.append(pyjson.call_text(name, value) if name is not None and isinstance(value, dict) else None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(Y.STRING)
def legacy_call_text(targets: pd.Series) -> pd.Series:
    """The name and arguments of a target (JSON) as older files spell a call: a space after marks, ASCII only."""
    return _each(lambda t: json.dumps({"name": v.get("name"), "arguments": v.get("arguments", {})}) if isinstance(v := pyjson.load(t), dict) else None, targets)


@F.pandas_udf(Y.struct(result=Y.DOUBLE, error=Y.STRING))
def calculate(texts: pd.Series) -> pd.DataFrame:
    """The value of an arithmetic expression (+ - * / // % ** and brackets, at most 200 characters) or why it has none."""
    rows = [pyjson.calculate(t) if t is not None else (None, None) for t in texts]
    return pd.DataFrame({"result": pd.Series([r for r, _ in rows], dtype="float64"), "error": pd.Series([e for _, e in rows], dtype=object)})


@F.pandas_udf(Y.LONG)
def safe_eval(texts: pd.Series) -> pd.Series:
    """The value of an integer expression of + - * (at most 60 characters); null for anything else."""
    return pd.Series([pyjson.integer_value(t) if t is not None else None for t in texts], dtype="Int64")


def schema_errors(schema: dict):
    """An Arrow function from JSON texts to the list of what is wrong under ``schema``; null texts give null."""
    pyjson.check_schema(schema)

    @F.pandas_udf(Y.STRINGS)
    def errors(texts: pd.Series) -> pd.Series:
        return _each(lambda t: pyjson.schema_errors(pyjson.load(t), schema), texts)

    return errors


@F.pandas_udf(Y.struct(text=Y.STRING, valid=Y.BOOL, repaired=Y.BOOL))
def repair_json(texts: pd.Series) -> pd.DataFrame:
    """The text made parseable where dropping trailing commas and closing brackets does it."""
    rows = [pyjson.repaired(t) if t is not None else (None, None, None) for t in texts]
    return pd.DataFrame({"text": pd.Series([r[0] for r in rows], dtype=object), "valid": pd.Series([r[1] for r in rows], dtype="boolean"), "repaired": pd.Series([r[2] for r in rows], dtype="boolean")})


@F.pandas_udf(Y.STRING)
def json_prefix_state(texts: pd.Series) -> pd.Series:
    """complete, extendable or broken: what a text is as the beginning of JSON."""
    return _each(pyjson.prefix_state, texts)


def parse_tool_call(tools: dict[str, dict[str, str]] | None = None):
    """An Arrow function that reads a tool call: status (none, malformed, ok), why, name and canonical arguments.

    ``tools``: per tool, the type (str, int, float, bool) of each argument; a call has exactly these arguments. Without
    ``tools`` any name and any arguments will do.
    """

    schemas = {name: pyjson.arguments_schema(declared) for name, declared in tools.items()} if tools is not None else None

    @F.pandas_udf(Y.struct(status=Y.STRING, why=Y.STRING, name=Y.STRING, arguments=Y.STRING))
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [pyjson.tool_call(t, schemas) if t is not None else (None,) * 4 for t in texts]
        return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(("status", "why", "name", "arguments"))})

    return parse


def grounding(mode: str = "balanced"):
    """An Arrow function from a call's arguments (a JSON object) and the source text to fields (field, grounded, span,
    transformation), all_grounded and blocks: whether the call must not be run in ``mode`` (strict, balanced, permissive).

    Null where the arguments are no object; a null source has no words.
    """
    if mode not in pyground.MODES:
        raise ValueError(f"unknown mode {mode!r}")
    kind = Y.struct(fields=ArrayType(Y.struct(field=Y.STRING, grounded=Y.BOOL, span=Y.STRING, transformation=Y.STRING)), all_grounded=Y.BOOL, blocks=Y.BOOL)

    @F.pandas_udf(kind)
    def ground(arguments: pd.Series, sources: pd.Series) -> pd.DataFrame:
        rows = []
        for text, source in zip(arguments, sources, strict=True):
            value = pyjson.load(text) if text is not None else None
            if not isinstance(value, dict):
                rows.append((None, None, None))
                continue
            found = pyground.grounded_fields(value, source or "")
            rows.append(([dict(zip(("field", "grounded", "span", "transformation"), f, strict=True)) for f in found], all(f[1] for f in found), pyground.blocks(value, found, mode)))
        return pd.DataFrame({"fields": pd.Series([r[0] for r in rows], dtype=object), "all_grounded": pd.Series([r[1] for r in rows], dtype="boolean"), "blocks": pd.Series([r[2] for r in rows], dtype="boolean")})

    return ground


@F.pandas_udf(Y.STRINGS)
def example_errors(texts: pd.Series) -> pd.Series:
    """What is wrong with a supervised example (id, messages, tools, target) given as JSON; empty when it is valid."""
    return _each(lambda t: pyjson.example_errors(pyjson.load(t)), texts)


@F.pandas_udf(Y.BOOL)
def json_equal(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether two texts are the same JSON value; false where either is none."""
    read = lambda t: pyjson.BROKEN if t is None else pyjson.load(t)
    return pd.Series([(a := read(x)) is not pyjson.BROKEN and (b := read(y)) is not pyjson.BROKEN and a == b for x, y in zip(left, right, strict=True)], dtype="boolean")


def parse_structured(schema: dict, repair: bool = True):
    """An Arrow function that reads a text as JSON under ``schema``: value (canonical), valid, repaired and errors."""
    pyjson.check_schema(schema)

    @F.pandas_udf(Y.struct(value=Y.STRING, valid=Y.BOOL, repaired=Y.BOOL, errors=Y.STRINGS))
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [pyjson.structured(t, schema, repair) if t is not None else (None,) * 4 for t in texts]
        return pd.DataFrame({"value": pd.Series([r[0] for r in rows], dtype=object), "valid": pd.Series([r[1] for r in rows], dtype="boolean"), "repaired": pd.Series([r[2] for r in rows], dtype="boolean"), "errors": pd.Series([r[3] for r in rows], dtype=object)})

    return parse


def matches_grammar(pattern: str):
    """Whether a text as a whole matches the pattern."""
    full = rf"^(?:{pattern})$"
    re.compile(full)
    return lambda column: column.rlike(full)


def choice_state(text, choices: list[str]):
    """complete for a choice, extendable for the beginning of one, else broken."""
    options = F.array(*map(F.lit, choices))
    return F.when(F.array_contains(options, text), "complete").when(F.exists(options, lambda c: F.startswith(c, text)), "extendable").otherwise("broken")
