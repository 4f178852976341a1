"""Deterministic row functions: units, dates, schedules, confidence, routing, grounding, scoring of answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from corpuskit.functions import jsonfns as J, text as T
from corpuskit.functions.vectors import total

# Units in their dimension's base unit (metre, gram, litre).
LENGTH = {"mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344}
MASS = {"mg": 0.001, "g": 1.0, "kg": 1000.0, "oz": 28.349523125, "lb": 453.59237}
VOLUME = {"ml": 0.001, "l": 1.0, "tsp": 0.00492892, "tbsp": 0.0147868, "cup": 0.24, "floz": 0.0295735, "pt": 0.473176, "qt": 0.946353, "gal": 3.78541}
DEGREES = ("c", "f", "k")


def unit_convert(value: Column, unit: Column, to: Column) -> Column:
    """The value in another unit of its dimension; null for unknown units and across dimensions."""
    factors = F.create_map(*[F.lit(x) for table in (LENGTH, MASS, VOLUME) for u, f in table.items() for x in (u, f)])
    kinds = F.create_map(*[F.lit(x) for kind, table in (("length", LENGTH), ("mass", MASS), ("volume", VOLUME)) for u in table for x in (u, kind)])
    kelvin = F.when(unit == "c", value + 273.15).when(unit == "f", (value - 32) * 5 / 9 + 273.15).otherwise(value)
    degrees = F.when(to == "c", kelvin - 273.15).when(to == "f", (kelvin - 273.15) * 9 / 5 + 32).otherwise(kelvin)
    both = unit.isin(*DEGREES) & to.isin(*DEGREES)
    return F.when(both, degrees).when(F.try_element_at(kinds, unit) == F.try_element_at(kinds, to), value * F.try_element_at(factors, unit) / F.try_element_at(factors, to))


def add_days(date: Column, days: Column) -> Column:
    """An ISO date moved by a number of days, as text; null for other texts."""
    return F.date_format(F.date_add(F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(date, "yyyy-MM-dd")), days), "yyyy-MM-dd")


def days_between(start: Column, end: Column) -> Column:
    iso = lambda d: F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(d, "yyyy-MM-dd"))
    return F.datediff(iso(end), iso(start))


def lr_at(step: Column, kind: str, base: float, least: float, warmup: int, steps: int) -> Column:
    """The learning rate of a step: linear warm-up, then constant, linear or cosine."""
    if kind not in ("constant", "linear", "cosine"):
        raise ValueError(f"unknown schedule {kind!r}")
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / max(1, steps - warmup)))
    late = {"constant": F.lit(base), "linear": base + (least - base) * p, "cosine": least + (base - least) * 0.5 * (1.0 + F.cos(F.pi() * p))}[kind]
    return F.when(step < warmup, base * (step + 1) / warmup).otherwise(late) if warmup else late


def tool_margin(scores: Column) -> Column:
    """How far the best of the ranked scores is ahead of the second, 0 to 1; 1 for fewer than two, null for null."""
    top, second = F.get(scores, F.lit(0)), F.get(scores, F.lit(1))
    return F.when(F.size(scores) <= 1, F.lit(1.0)).when(top <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (top - second) / top)))


def argument_confidence(errors: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - 0.25 * errors)


def share_of(passed: Column, n: Column) -> Column:
    """Passed by all; 1 where there is none."""
    return F.when(n == 0, F.lit(1.0)).otherwise(passed / n)


def confidence(*components: Column) -> Column:
    """The least of the components that are present; 0 when none is."""
    return F.coalesce(F.least(*components) if len(components) > 1 else components[0], F.lit(0.0))


def confidence_action(value: Column, execute: float = 0.9, verify: float = 0.7) -> Column:
    return F.when(value >= execute, "execute").when(value >= verify, "verify").otherwise("clarify")


# Cues by which a request is routed.
GREETING = r"(?i)^\s*(hi|hello|hey|thanks|thank you|good (morning|afternoon|evening))\W*\s*$"
ARITHMETIC = r"(?i)\d\s*(?:[+*/^]|x|times|plus|minus|divided by|multiplied by)\s*\d|\d\s+-\s+\d"
STEP_HINTS = ("and then", "after that", "first", "next,", "steps to", "plan a", "plan my")
DEEP_HINTS = ("analyze", "compare", "conflicting", "trade-off", "tradeoff", "why does", "explain why")
DOUBT_HINTS = ("i think", "maybe", "not sure", "could be wrong")


def route(text: Column, tool_score: Column | None = None, has_schema: Column | None = None, has_calculator: bool = True) -> Column:
    """mode and level of a request. ``tool_score``: the best lexical score of a tool (null or absent: no tools)."""
    clean = T.strip(text)
    low = F.lower(clean)
    any_of = lambda hints: reduce(lambda a, b: a | b, [low.contains(h) for h in hints])
    as_route = lambda mode, level: F.struct(F.lit(mode).alias("mode"), (level if isinstance(level, Column) else F.lit(level)).alias("level"))
    score = F.lit(None).cast("double") if tool_score is None else tool_score
    schema = F.lit(False) if has_schema is None else has_schema
    return (
        F.when(clean.isNull() | (clean == ""), as_route("ask_clarification", "fast"))
        .when(schema, as_route("structured_output", "normal"))
        .when(clean.rlike(GREETING), as_route("chat", "fast"))
        .when(clean.rlike(ARITHMETIC) & F.lit(has_calculator), as_route("tool_call", "fast"))
        .when(any_of(STEP_HINTS), as_route("plan", F.when(any_of(DEEP_HINTS), "deep").otherwise("normal")))
        .when(any_of(DEEP_HINTS), as_route("reason", F.when(any_of(DOUBT_HINTS), "verify").otherwise("deep")))
        .when(F.coalesce(score > 0, F.lit(False)), as_route("tool_call", "fast"))
        .otherwise(as_route("chat", "fast"))
    )


def grounded_string(value: Column, source: Column) -> Column:
    """How a value stands in the source: verbatim, case_insensitive, date_normalized; null where it doesn't."""
    date = F.coalesce(*[F.try_to_date(value, f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy")])
    forms = [F.date_format(date, f) for f in ("yyyy-MM-dd", "MMMM dd, yyyy", "MMM dd, yyyy", "MM/dd/yyyy", "yyyy")]
    low = F.lower(source)
    dated = reduce(lambda a, b: a | b, [F.coalesce(low.contains(F.lower(f)), F.lit(False)) for f in forms])
    return F.when(source.contains(value), "verbatim").when(low.contains(F.lower(value)), "case_insensitive").when(dated, "date_normalized")


def grounded_number(value: Column, source: Column) -> Column:
    """Whether a number stands in the source as a number of its own; whole floats also without a fraction."""
    found = F.regexp_extract_all(source, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    whole = F.when(value == F.floor(value), F.floor(value).cast("string"))
    return F.when(F.array_contains(found, value.cast("string")), "verbatim").when(F.array_contains(found, whole), "number_normalized")


# How a refusal begins.
REFUSALS = ("i can't", "i cannot", "i can’t", "sorry, i can't", "sorry, i can’t", "sorry, i cannot")


def score_text(kind: Column, text: Column, expected: Column, needles: Column) -> Column:
    """Whether an answer passes. Kinds: exact, contains, contains_ci, clarify, refusal, no_tool, final_answer, json.

    ``expected`` is the wanted text, ``needles`` the wanted parts; null for other kinds.
    """
    out = T.squash(text)
    low, call, want = F.lower(out), T.looks_like_call(out), T.squash(expected)
    has = lambda hay, fold: F.forall(F.coalesce(needles, F.array().cast("array<string>")), lambda x: F.contains(hay, F.lower(x) if fold else x))
    final = T.squash(F.element_at(F.split(text, "####"), -1))
    starts = reduce(lambda a, b: a | b, [low.startswith(s) for s in REFUSALS])
    return (
        F.when(kind == "exact", out == want)
        .when(kind == "contains", has(out, False) & ~call)
        .when(kind == "contains_ci", has(low, True) & ~call)
        .when(kind == "clarify", out.endswith("?") & ~call)
        .when(kind == "refusal", starts & ~call)
        .when(kind == "no_tool", ~call & has(low, False))
        .when(kind == "json", F.coalesce(J.json_equal(F.when(kind == "json", text), expected), F.lit(False)))
        .when(kind == "final_answer", (final == want) | F.array_contains(F.split(final, " "), want))
    )


CALL = J.parse_tool_call()  #: reads a call of any tool


def call_score(call: Column, known: Column, wanted: Column, arguments: Column, value: Column | None = None) -> Column:
    """status, name_ok and args_ok of a call (see ``CALL``) of one of the tools ``known`` (null: any), where the tool
    ``wanted`` should be called with ``arguments`` (JSON); a calculator's expression may have any form of the ``value``.

    The scorer tool_name asks for name_ok, tool_call for both.
    """
    strange = (call["status"] == "ok") & known.isNotNull() & ~F.coalesce(F.array_contains(known, call["name"]), F.lit(False))
    status = F.when(strange, "malformed").otherwise(call["status"])
    name_ok = F.coalesce((status == "ok") & (call["name"] == wanted), F.lit(False))
    same = J.json_equal(call["arguments"], arguments)
    if value is not None:
        same = F.when(wanted == "calculator", J.safe_eval(F.get_json_object(call["arguments"], "$.expr")).eqNullSafe(value)).otherwise(same)
    return F.struct(status.alias("status"), name_ok.alias("name_ok"), (name_ok & F.coalesce(same, F.lit(False))).alias("args_ok"))


def mean_of(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))
