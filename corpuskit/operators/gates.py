"""Thresholds on metrics, regressions between checkpoints and training diagnostics. Metrics are rows (metric, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def metric_of(report_json: Column, path: str) -> Column:
    """A number at a dotted path of a JSON report; null where it is absent or no number (booleans are none)."""
    v = F.try_parse_json(report_json)
    at = "$." + path
    kind = F.schema_of_variant(F.try_variant_get(v, at, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(v, at, "double"))


def check_metrics(checks: DataFrame, metrics: DataFrame, bound_required: bool = True) -> DataFrame:
    """Each check (metric, min, max) with its value and whether it holds. A missing metric fails, and so does a check
    without any bound when one is required."""
    joined = checks.select("metric", F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max")).join(metrics.select("metric", "value"), "metric", "left")
    ok = _finite(F.col("value")) & F.coalesce(F.col("value") >= F.col("min"), F.col("min").isNull()) & F.coalesce(F.col("value") <= F.col("max"), F.col("max").isNull())
    if bound_required:
        ok = ok & (F.col("min").isNotNull() | F.col("max").isNotNull())
    return joined.withColumn("ok", F.coalesce(ok, F.lit(False)))


def evaluate_gate(checks: DataFrame, metrics: DataFrame, summary: Mapping[str, object] | None = None, expect_stage: str | None = None, require_complete: bool = False, require_no_divergence: bool = True) -> DataFrame:
    """passed, n_checks, n_failed: whether a stage may be promoted. No check at all doesn't pass."""
    s = dict(summary or {})
    flags = []
    if expect_stage is not None:
        flags.append(("stage", s.get("stage") == expect_stage))
    if require_complete:
        flags.append(("stage_complete", s.get("stage_complete") is True))
    if require_no_divergence:
        flags.append(("no_divergence", s.get("stop_reason") not in (None, "diverged")))
    spark = metrics.sparkSession
    own = spark.createDataFrame([(n, bool(ok)) for n, ok in flags], "metric string, ok boolean")
    every = check_metrics(checks, metrics).select("metric", "ok").unionByName(own)
    return every.agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("passed"), F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.col("ok")).alias("n_failed"))


def objective_verdict(checks: DataFrame, metrics: DataFrame, budget_ok: bool = True, baseline: bool = False, retained_ok: bool = True, regressed: bool = False) -> DataFrame:
    """met: not the baseline, within budget, all checks hold, capabilities are retained and nothing regressed."""
    all_ok = check_metrics(checks, metrics, bound_required=False).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("checks_ok"))
    rest = not baseline and budget_ok and retained_ok and not regressed
    return all_ok.select("checks_ok", (F.col("checks_ok") & F.lit(rest)).alias("met"))


def regression_checks(current: DataFrame, previous: DataFrame, allowed: DataFrame) -> DataFrame:
    """Each allowance (metric, direction up or down, allowed) with both values, how much worse, and whether it holds.

    ``up``: larger is worse. A metric missing on either side passes.
    """
    j = allowed.join(current.select("metric", F.col("value").alias("current")), "metric", "left").join(previous.select("metric", F.col("value").alias("previous")), "metric", "left")
    both = _finite(F.col("current")) & _finite(F.col("previous"))
    worse = F.when(both, F.when(F.col("direction") == "up", F.col("current") - F.col("previous")).otherwise(F.col("previous") - F.col("current")))
    return j.withColumn("worse", worse).withColumn("ok", F.coalesce(F.col("worse") <= F.col("allowed") + 1e-12, F.lit(True)))


def regressions(history: DataFrame, allowed: DataFrame) -> DataFrame:
    """stage, step, metric, current, previous, worse, ok: every report against the one before it of its stage.

    ``history``: stage, step, metric, value; one partition per (stage, metric) history.
    """
    w = Window.partitionBy("stage", "metric").orderBy("step")
    rows = history.withColumn("previous", F.lag("value").over(w)).filter("previous is not null").join(allowed, "metric")
    worse = F.when(F.col("direction") == "up", F.col("value") - F.col("previous")).otherwise(F.col("previous") - F.col("value"))
    return rows.select("stage", "step", "metric", F.col("value").alias("current"), "previous", worse.alias("worse"), (worse <= F.col("allowed") + 1e-12).alias("ok"))


def memorization_signal(history: DataFrame, patience: int = 2, by: str = "run") -> DataFrame:
    """``by``, step, memorizing: validation loss rose and training loss fell at each of the last ``patience`` steps."""
    order = Window.partitionBy(by).orderBy("step")
    bad = (F.col("val_loss") > F.lag("val_loss").over(order)) & (F.col("train_loss_recent") < F.lag("train_loss_recent").over(order))
    rows = history.select(by, "step", "val_loss", "train_loss_recent").withColumn("bad", F.coalesce(bad, F.lit(False)))
    recent = order.rowsBetween(-(patience - 1), 0)
    return rows.select(by, "step", ((F.count(F.lit(1)).over(recent) == patience) & F.min(F.col("bad").cast("int")).over(recent).cast("boolean")).alias("memorizing"))


def recent_loss(losses: DataFrame, last: int = 20, by: str = "run") -> DataFrame:
    """``by``, step, train_loss_recent: the mean of the last (up to) ``last`` step losses."""
    w = Window.partitionBy(by).orderBy("step").rowsBetween(-(last - 1), 0)
    return losses.select(by, "step", F.avg("loss").over(w).alias("train_loss_recent"))


def metrics_from_report(reports: DataFrame, paths: Sequence[str], report: str = "report") -> DataFrame:
    """metric, value rows of dotted paths of a JSON report column; absent ones are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("metric"), metric_of(F.col(report), p).alias("value")) for p in paths])).alias("m")
    return reports.select(*[c for c in reports.columns if c != report], pairs).select(*[c for c in reports.columns if c != report], "m.metric", "m.value").filter("value is not null")


def resolve_mode(stage: Column, own_stage: Column, complete: Column, exhausted: Column, requested: Column, own_gate_failed: Column | None = None) -> Column:
    """How a run goes on from an artifact: resume, continue or init-from; null where the request can't be met."""
    failed = F.lit(False) if own_gate_failed is None else own_gate_failed
    same, auto = stage == own_stage, requested == "auto"
    reopen = same & (~complete | failed)
    go_on = (requested == "continue") | (auto & same & ((~complete & exhausted) | (complete & failed)))
    resume = (requested == "resume") | (auto & same & ~complete)
    begin = (requested == "init-from") | (auto & ~same)
    return (
        F.when(go_on, F.when(reopen, "continue"))
        .when(resume, F.when(same & ~complete & ~exhausted, "resume"))
        .when(begin, F.when(complete & ~same, "init-from"))
    )
