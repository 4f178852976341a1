"""Reports of checkpoints: which measurements count where, comparisons across stages, and Markdown.

A report is rows (scope, metric, value): scope is "own" for the stage's own measurements and the name of an earlier stage
for what is measured of that stage again.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from importlib.resources import files
from json import loads

from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.operators import gates

# The measurements that are shown of every evaluation, by name, with their paths in its report.
KEY_METRICS = {
    "validation_loss": "loss.validation.loss",
    "held_out_loss": "loss.eval.loss",
    "perplexity": "loss.eval.perplexity",
    "copy_accuracy": "capabilities.copy.accuracy",
    "instruction_accuracy": "capabilities.instruction.accuracy",
    "factual_qa_accuracy": "capabilities.factual_qa.accuracy",
    "structured_output_accuracy": "capabilities.structured.accuracy",
    "clarification_accuracy": "capabilities.clarification.accuracy",
    "refusal_accuracy": "capabilities.refusal.accuracy",
    "correct_tool_rate": "tool_behavior.correct_tool_rate",
    "argument_accuracy": "tool_behavior.argument_accuracy",
    "wrong_tool_rate": "tool_behavior.wrong_tool_rate",
    "malformed_call_rate": "tool_behavior.malformed_call_rate",
    "false_positive_call_rate": "tool_behavior.false_positive_call_rate",
}
# The sections that say what a model can do; and the loss on natural text held out.
CAPABILITY_SECTIONS = ("generation", "grammar")
NATURAL_LOSS = "loss.text_val_"
OWN = "own"


def section(metric: Column) -> Column:
    return F.substring_index(metric, ".", 1)


def is_capability(metric: Column) -> Column:
    return section(metric).isin(*CAPABILITY_SECTIONS)


def key_metrics(reports: DataFrame, report: str = "report") -> DataFrame:
    """name, metric, value of the measurements shown of every evaluation, null where the report (JSON) has none."""
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("metric"), gates.metric_of(F.col(report), p).alias("value")) for n, p in KEY_METRICS.items()])).alias("m")
    rest = [c for c in reports.columns if c != report]
    return reports.select(*rest, names).select(*rest, "m.name", "m.metric", "m.value")


def data_failures(checks: DataFrame, metrics: DataFrame) -> DataFrame:
    """The checks (metric, min, max) on training data that fail: they can be made before a run begins."""
    return gates.check_metrics(checks.filter(section(F.col("metric")) == "data"), metrics).filter(~F.col("ok"))


def capability_measurements(checks: DataFrame) -> DataFrame:
    """The checks that a later stage makes again."""
    return checks.filter(is_capability(F.col("metric")))


def capability_snapshot(metrics: DataFrame) -> DataFrame:
    """The measurements that are kept for comparison when a stage is promoted."""
    return metrics.filter(is_capability(F.col("metric")))


def compare_reports(current: DataFrame, previous: DataFrame | None, allowed: DataFrame, stage: str, previous_stage: str | None = None, promoted: DataFrame | None = None, same_held_out: bool = False) -> DataFrame:
    """scope, against, metric, current, previous, worse, allowed, ok: how far a report may be worse than earlier ones.

    ``allowed``: scope, metric, direction (up: larger is worse), allowed. Own measurements are compared with the previous
    report of the same stage; after a change of stage only losses on natural text are, and only if both stages held out
    the same text (``same_held_out``). Capabilities of earlier stages are compared with the previous report's measurement
    of them (its own ones, if it was of that stage) and with those at promotion (``promoted``: scope, metric, value),
    unless these are what the previous report has. A measurement missing on either side passes.
    """
    own, kept = F.col("scope") == OWN, is_capability(F.col("metric"))
    same = previous_stage == stage
    want = allowed.filter((own & (F.lit(same) | (F.col("metric").startswith(NATURAL_LOSS) & F.lit(same_held_out)))) | (~own & kept))
    now = current.select("scope", "metric", F.col("value").alias("current"))
    out = None
    if previous is not None:
        scope = F.when(own & F.lit(not same), F.lit(previous_stage)).otherwise(F.col("scope"))
        # After a change of stage the previous report's own measurements are those of an earlier stage, and its natural
        # losses also the ones to compare with.
        rows = previous.filter(F.lit(same) | ~own | F.lit(previous_stage).isNotNull()).select(scope.alias("scope"), "metric", "value")
        if not same:
            rows = rows.unionByName(previous.filter(own & F.col("metric").startswith(NATURAL_LOSS)))
        out = _worse(want, now, rows, "previous")
    if promoted is not None:
        at_promotion = promoted.filter(kept)
        if previous is not None:
            before = rows.filter(kept).select("scope", "metric", F.col("value").alias("_before"))
            pairs = at_promotion.join(before, ["scope", "metric"], "full").groupBy("scope").agg(F.bool_and(F.col("value").eqNullSafe(F.col("_before"))).alias("_equal"))
            at_promotion = at_promotion.join(pairs.filter("_equal").select("scope"), "scope", "left_anti")
        rows = _worse(want.filter(~own), now, at_promotion, "promotion", only_known=True)
        out = rows if out is None else out.unionByName(rows)
    return _worse(want, now, now.select("scope", "metric", F.col("current").alias("value")), "none").limit(0) if out is None else out


def _worse(want: DataFrame, now: DataFrame, then: DataFrame, against: str, only_known: bool = False) -> DataFrame:
    then = then.select("scope", "metric", F.col("value").alias("previous"))
    if only_known:
        want = want.join(then.select("scope").distinct(), "scope", "left_semi")
    rows = want.join(now, ["scope", "metric"], "left").join(then, ["scope", "metric"], "left")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    worse = F.when(finite("current") & finite("previous"), F.when(F.col("direction") == "up", F.col("current") - F.col("previous")).otherwise(F.col("previous") - F.col("current")))
    return rows.select("scope", F.lit(against).alias("against"), "metric", "current", "previous", worse.alias("worse"), "allowed", F.coalesce(worse <= F.col("allowed") + 1e-12, F.lit(True)).alias("ok"))


def regressed(comparison: DataFrame) -> DataFrame:
    """regressed, n_checks, n_failed of a comparison."""
    return comparison.agg(F.coalesce(F.bool_or(~F.col("ok")), F.lit(False)).alias("regressed"), F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.col("ok")).alias("n_failed"))


def stage_config(stage: str) -> dict:
    """The gate, objective and allowances of one of the stages that come with the package."""
    every = loads(files("corpuskit").joinpath("configs/stages.json").read_text(encoding="utf-8"))
    if stage not in every:
        raise KeyError(f"unknown stage {stage!r}; there are {sorted(every)}")
    return every[stage]


def checks_of(spark, config: Mapping, part: str) -> DataFrame:
    """metric, min, max rows of a stage's gate or objective."""
    bound = lambda c, k: float(c[k]) if k in c else None
    return spark.createDataFrame([(c["metric"], bound(c, "min"), bound(c, "max")) for c in config[part]], "metric string, min double, max double")


def allowances_of(spark, config: Mapping, scope: str = OWN) -> DataFrame:
    """scope, metric, direction, allowed rows of a stage."""
    return spark.createDataFrame([(scope, a["metric"], a["direction"], float(a["allowed"])) for a in config["allowed"]], "scope string, metric string, direction string, allowed double")


# --- Markdown ---------------------------------------------------------------------------------------------------------


def visible(text: str) -> str:
    """Control characters, but for line ends and tabs, as escapes."""
    return re.sub(r"[\x00-\x08\x0b-\x1f\x7f]", lambda m: f"\\x{ord(m.group()):02x}", text)


def fenced(text: str) -> str:
    """A code block around any text: its fence is longer than every run of back ticks inside."""
    fence = "`" * max(3, 1 + max((len(r) for r in re.findall("`+", text)), default=0))
    return f"{fence}\n{visible(text)}\n{fence}"


def shown(value: object) -> str:
    """A number with four places, a whole one with thousands apart, a truth as yes or no, nothing as a dash."""
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int):
        return f"{value:,}"
    return f"{value:.4f}" if isinstance(value, float) else visible(str(value)).replace("|", "\\|").replace("\n", " ")


def markdown_table(rows: Sequence[Mapping[str, object]], columns: Sequence[str]) -> str:
    head = ["| " + " | ".join(columns) + " |", "|" + " - |" * len(columns)]
    return "\n".join([*head, *("| " + " | ".join(shown(r[c]) for c in columns) + " |" for r in rows)])


def render_report(title: str, verdict: Mapping[str, object], checks: DataFrame, comparison: DataFrame | None = None, texts: Sequence[tuple[str, str]] = ()) -> str:
    """A stage's report: the verdict, its checks (one row a measurement), the comparison and sample texts."""
    parts = [f"# {title}", "\n".join(f"- {k}: {shown(v)}" for k, v in verdict.items())]
    parts += ["## Checks", markdown_table(_bounded(checks), checks.columns)]
    if comparison is not None:
        parts += ["## Compared with earlier reports", markdown_table(_bounded(comparison), comparison.columns)]
    for prompt, text in texts:
        parts += [f"### {shown(prompt)}", fenced(text)]
    return "\n\n".join(parts) + "\n"


def _bounded(rows: DataFrame, most: int = 10_000) -> list[Mapping[str, object]]:
    """The rows of a report, ordered by their columns; more than ``most`` are an error, never cut off."""
    got = rows.orderBy(*rows.columns).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report has at most {most} rows")
    return [r.asDict() for r in got]


def render_history(history: DataFrame, columns: Sequence[str], most: int = 10_000) -> str:
    """A Markdown table of a history of at most ``most`` checkpoints (more are an error), in its own order of columns."""
    return markdown_table(_bounded(history.select(*columns), most), columns)
