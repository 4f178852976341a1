"""Roll-ups of graded answers. Rows: id, category, scorer, paraphrase, ok, text, tokens, finish and, for tools, status,
name_ok."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.functions import text as T

# Scorers that want a tool call, and the categories of the capability report.
TOOL_SCORERS = ("tool_call", "tool_name")
REPORT = {"language": ("language", "paraphrase"), "grammar": ("grammar", "spelling", "punctuation"), "reasoning": ("reasoning",), "math": ("math",), "knowledge": ("knowledge",), "comprehension": ("comprehension", "extraction"), "instruction": ("instruction",), "dialogue": ("dialogue",), "tools": ("tools",), "safety": ("safety",), "integration": ("integration",)}


def rate(hit: Column, among: Column | None = None) -> Column:
    """The share of hits among rows; null when there is no row."""
    return F.avg(F.when(among, F.coalesce(hit, F.lit(False)).cast("int")) if among is not None else F.coalesce(hit, F.lit(False)).cast("int"))


def capability_accuracy(rows: DataFrame) -> DataFrame:
    """category, n, accuracy and, where both kinds of phrasing occur, their accuracies."""
    para, seen = F.col("paraphrase").eqNullSafe(True), F.col("paraphrase").eqNullSafe(False)
    g = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), rate(F.col("ok")).alias("accuracy"), rate(F.col("ok"), para).alias("p"), rate(F.col("ok"), seen).alias("s"))
    both = F.col("p").isNotNull() & F.col("s").isNotNull()
    return g.select("category", "n", "accuracy", F.when(both, F.col("p")).alias("paraphrase_accuracy"), F.when(both, F.col("s")).alias("seen_phrasing_accuracy"))


def tool_behavior(rows: DataFrame) -> DataFrame:
    """One row of independent rates; null where nothing was asked."""
    tool = F.col("scorer").isin(*TOOL_SCORERS)
    of = lambda c: rate(F.col("ok"), F.col("category") == c)
    return rows.agg(
        F.count_if(tool).alias("requests_needing_a_tool"),
        rate(F.col("name_ok"), tool).alias("correct_tool_rate"),
        rate(F.col("ok"), F.col("scorer") == "tool_call").alias("argument_accuracy"),
        rate((F.col("status") == "ok") & ~F.coalesce("name_ok", F.lit(False)), tool).alias("wrong_tool_rate"),
        rate(F.col("status") == "none", tool).alias("no_call_rate"),
        rate(F.col("status") == "malformed", tool).alias("malformed_call_rate"),
        F.count_if(~tool).alias("requests_needing_no_tool"),
        rate(T.looks_like_call(F.col("text")), ~tool).alias("false_positive_call_rate"),
        of("clarification").alias("clarification_on_missing_argument_accuracy"),
        of("clarification_followup").alias("clarification_followup_call_accuracy"),
        of("tool_result").alias("tool_result_incorporation_accuracy"),
        of("refusal").alias("refusal_accuracy"),
    )


def generation_block(rows: DataFrame) -> DataFrame:
    rep = T.repetition(F.col("text"))
    return rows.agg(F.count(F.lit(1)).alias("graded_examples"), F.avg("tokens").alias("mean_response_tokens"), F.avg(F.length("text")).alias("mean_response_chars"), rate(F.col("finish") == "length").alias("unterminated_rate"), F.avg(rep).alias("mean_repetition"), rate(rep > 0.5).alias("looping_rate"))


def weighted_rollup(capabilities: DataFrame) -> DataFrame:
    """category, n, accuracy of the report's categories, weighted by examples; n is 0 and accuracy null where unmeasured."""
    spark = capabilities.sparkSession
    names = spark.createDataFrame([(k, c) for k, cs in REPORT.items() for c in cs], "report string, category string")
    g = names.join(capabilities.select("category", "n", "accuracy"), "category", "left").groupBy("report").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("accuracy")), F.nullif(F.sum("n"), F.lit(0))).alias("accuracy"))
    return g.withColumnRenamed("report", "category")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, a, b, delta of metrics both reports have (metric, value)."""
    return a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric").withColumn("delta", F.col("b") - F.col("a"))


def check_cases(cases: DataFrame) -> DataFrame:
    """case_id, category, passed. Cases: expect_call, expected_tool, expected_call_count, expected_arguments (map) and
    calls, an array of (tool, arguments: map)."""
    n = F.size(F.coalesce("calls", F.array().cast("array<struct<tool:string,arguments:map<string,string>>>")))
    same = F.filter("calls", lambda c: c["tool"] == F.col("expected_tool"))
    match = F.coalesce(F.get(same, F.lit(0)), F.get("calls", F.lit(0)))
    args = F.forall(F.map_entries("expected_arguments"), lambda e: F.try_element_at(match["arguments"], e["key"]).eqNullSafe(e["value"]))
    ok = F.when(~F.col("expect_call"), n == 0).otherwise((n > 0) & (n == F.col("expected_call_count")) & (F.col("expected_tool").isNull() | (F.size(same) > 0)) & (F.col("expected_arguments").isNull() | F.coalesce(args, F.lit(False))))
    return cases.select("case_id", "category", F.coalesce(ok, F.lit(False)).alias("passed"))


def suite_summary(results: DataFrame) -> DataFrame:
    """category, passed, total, with a row of category null for all cases; the pass rate of none is 1."""
    per = results.groupBy("category").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))
    whole = results.agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total")).select(F.lit(None).cast("string").alias("category"), "passed", "total")
    return per.unionByName(whole).withColumn("pass_rate", F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("passed") / F.nullif("total", F.lit(0))))


def perplexity(losses: DataFrame, *by: str) -> DataFrame:
    """Mean loss, perplexity and bits per byte of per-example sums (loss, tokens, bytes)."""
    mean = F.try_divide(F.sum("loss"), F.sum("tokens"))
    aggs = [mean.alias("loss"), F.exp(F.least(mean, F.lit(30.0))).alias("perplexity"), F.try_divide(F.sum("loss"), F.ln(F.lit(2.0)) * F.sum("bytes")).alias("bits_per_byte")]
    return losses.groupBy(*by).agg(*aggs) if by else losses.agg(*aggs)
