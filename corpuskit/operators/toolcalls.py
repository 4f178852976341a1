"""Calls of registered functions as rows: known, valid, confirmed, run. Errors are data, never exceptions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.functions import jsonfns as J, tools


@dataclass(frozen=True)
class Tool:
    """A named column function over JSON arguments, with the schema its arguments must meet."""

    name: str
    description: str
    schema: Mapping[str, object]
    run: Callable[[Column], Column]
    needs_confirmation: bool = False


class Registry:
    def __init__(self, found: Sequence[Tool] = ()):
        self.tools = {t.name: t for t in found}
        if len(self.tools) != len(found):
            raise ValueError("tool names must be unique")

    def add(self, tool: Tool) -> Registry:
        return Registry([*self.tools.values(), tool])

    def execute(self, calls: DataFrame, confirmed: Column | None = None) -> DataFrame:
        """``calls`` (name, arguments: JSON text) with ok, value, error_code and error.

        Codes: unknown_tool, invalid_arguments, confirmation_required, failed (the function gave null).
        """
        yes = F.lit(False) if confirmed is None else F.coalesce(confirmed, F.lit(False))
        out = calls
        none = F.lit(None).cast("string")
        for i, t in enumerate(self.tools.values()):
            mine = F.when(F.col("name") == t.name, F.col("arguments"))
            out = out.withColumn(f"_e{i}", J.schema_errors(dict(t.schema))(F.coalesce(mine, F.lit("null")))).withColumn(f"_v{i}", t.run(mine).cast("string"))
        known = F.col("name").isin(*self.tools) if self.tools else F.lit(False)
        code, value, error = F.when(~F.coalesce(known, F.lit(False)), "unknown_tool"), none, none
        for i, t in enumerate(self.tools.values()):
            mine, bad = F.col("name") == t.name, F.size(f"_e{i}") > 0
            wait = mine & F.lit(t.needs_confirmation) & ~yes
            code = code.when(mine & bad, "invalid_arguments").when(wait, "confirmation_required").when(mine & F.col(f"_v{i}").isNull(), "failed")
            error = F.when(mine & bad, F.array_join(f"_e{i}", "; ")).otherwise(error)
            value = F.when(mine & ~bad & ~wait, F.col(f"_v{i}")).otherwise(value)
        out = out.withColumns({"error_code": code, "value": value, "error": error})
        return out.withColumn("ok", F.col("error_code").isNull()).drop(*[f"_{c}{i}" for i in range(len(self.tools)) for c in "ev"])


def builtin_tools() -> Registry:
    """Calculator, unit conversion and date arithmetic."""
    arg = lambda a, k: F.get_json_object(a, f"$.{k}")
    text, number = {"type": "string"}, {"type": "number"}
    shape = lambda **p: {"type": "object", "required": list(p), "properties": p, "additionalProperties": False}
    return Registry([
        Tool("calculator", "Work out an arithmetic expression.", shape(expression={"type": "string", "maxLength": 200}), lambda a: J.calculate(arg(a, "expression"))["result"]),
        Tool("unit_convert", "Convert a value between units.", shape(value=number, from_unit=text, to_unit=text), lambda a: tools.unit_convert(arg(a, "value").cast("double"), arg(a, "from_unit"), arg(a, "to_unit"))),
        Tool("add_days", "Move a date by days.", shape(date=text, days={"type": "integer"}), lambda a: tools.add_days(arg(a, "date"), arg(a, "days").cast("int"))),
        Tool("days_between", "Days from one date to another.", shape(start_date=text, end_date=text), lambda a: tools.days_between(arg(a, "start_date"), arg(a, "end_date"))),
    ])


@dataclass(frozen=True)
class Step:
    """A step of a plan: a tool and its arguments, each a column over the rows or over earlier steps' values."""

    tool: str
    arguments: Mapping[str, Column]


def run_plan(rows: DataFrame, registry: Registry, steps: Sequence[Step]) -> DataFrame:
    """``rows`` with step_1, step_2, ... (ok, value, error_code); a step after a failed one reads its null value."""
    out = rows
    for i, s in enumerate(steps, 1):
        args = F.to_json(F.struct(*[c.alias(k) for k, c in s.arguments.items()]))
        out = registry.execute(out.withColumns({"name": F.lit(s.tool), "arguments": args}))
        out = out.withColumn(f"step_{i}", F.struct("ok", "value", "error_code")).drop("name", "arguments", "ok", "value", "error_code", "error")
    return out


def verified(rows: DataFrame, verifiers: Mapping[str, Column]) -> DataFrame:
    """``rows`` with one boolean per verifier (null counts as failed) and the share that passed; 1 without verifiers."""
    checks = {name: F.coalesce(c, F.lit(False)) for name, c in verifiers.items()}
    share = reduce(lambda a, b: a + b, [c.cast("int") for c in checks.values()], F.lit(0)) / max(1, len(checks)) if checks else F.lit(1.0)
    return rows.withColumns({**checks, "verified_share": share})


def accepts(examples: DataFrame, schema: Mapping[str, object] | None = None) -> Column:
    """Whether an example (target_type, target_text, prompt) passes: a tool call's arguments meet the schema, a bare sum's
    answer is the calculator's; everything else passes."""
    call_ok = F.size(J.schema_errors(dict(schema))(F.coalesce(F.get_json_object("target_text", "$.arguments"), F.lit("null")))) == 0 if schema else F.lit(True)
    sum_ = F.regexp_extract("prompt", r"^\s*(?:What is\s+)?([-+*/%().\d\s]+?)[=?\s]*$", 1)
    result = J.calculate(F.when(sum_ != "", sum_))["result"]
    return F.when(F.col("target_type") == "tool_call", call_ok).when(result.isNotNull(), F.col("target_text").try_cast("double").eqNullSafe(result)).otherwise(True)
