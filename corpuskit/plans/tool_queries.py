"""Queries of tools, validation, diagnostics, memory and curricula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.functions import jsonfns as J, tools
from corpuskit.operators import curriculum, gates, memory, reports
from corpuskit.operators.dedup import first_deliveries
from corpuskit.plans import sqltext as S
from corpuskit.plans.catalogue import query
from corpuskit.plans.corpus_queries import EXAMPLES
from corpuskit.session import table


@query("unit_convert", "SELECT l_orderkey, l_linenumber, round(l_quantity * 453.59237 / 28.349523125, 6) AS ounces, round(l_quantity * 1609.344 / 1000.0, 6) AS km, round((l_quantity - 32) * 5 / 9, 6) AS celsius FROM lineitem")
def unit_convert(spark: SparkSession, d: str) -> DataFrame:
    to = lambda a, b: F.round(tools.unit_convert(F.col("l_quantity"), F.lit(a), F.lit(b)), 6)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", to("lb", "oz").alias("ounces"), to("mi", "km").alias("km"), to("f", "c").alias("celsius"))


@query("date_arith", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 - 200 AS INTEGER), '%Y-%m-%d') AS moved, CAST(date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders")
def date_arith(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", tools.add_days(day, (F.col("o_orderkey") % 400 - 200).cast("int")).alias("moved"), tools.days_between(F.lit("1995-06-17"), day).alias("days"))


@query("lr_schedule", "SELECT s AS step, round(CASE WHEN s < 100 THEN 0.003 * (s + 1) / 100 ELSE 0.0003 + 0.0027 * 0.5 * (1 + cos(pi() * least(1.0, (s - 100) / 1900.0))) END, 12) AS cosine, round(CASE WHEN s < 100 THEN 0.003 * (s + 1) / 100 ELSE 0.003 - 0.0027 * least(1.0, (s - 100) / 1900.0) END, 12) AS linear FROM range(2200) t(s)")
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    step = F.col("id")
    of = lambda k: F.round(tools.lr_at(step, k, 0.003, 0.0003, 100, 2000), 12).alias(k)
    return spark.range(2200).select(step.alias("step"), of("cosine"), of("linear"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """What the users say in each example, all turns, beside its tools and target."""
    said = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    rows = first_deliveries(table(spark, d, "chat_examples").select("example_id", "messages", "tools", "target_type", "target_text"), "example_id")
    return rows.select("example_id", F.coalesce(said, F.lit("")).alias("prompt"), "tools", "target_type", "target_text")


_PROMPTS = f"(SELECT example_id, coalesce(array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: coalesce(m.content, '')), chr(10)), '') AS prompt, tools, target_type, target_text FROM {EXAMPLES})"


def _any(hints: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(prompt), '{h}')" for h in hints) + ")"


@query(
    "router",
    f"""
SELECT example_id, CASE WHEN trim(prompt) = '' THEN 'ask_clarification' WHEN regexp_matches(prompt, '(?i)^\\s*(hi|hello|hey|thanks|thank you|good (morning|afternoon|evening))\\W*\\s*$') THEN 'chat'
  WHEN regexp_matches(prompt, '(?i)\\d\\s*(?:[+*/^]|x|times|plus|minus|divided by|multiplied by)\\s*\\d|\\d\\s+-\\s+\\d') THEN 'tool_call'
  WHEN {_any(tools.STEP_HINTS)} THEN 'plan' WHEN {_any(tools.DEEP_HINTS)} THEN 'reason' ELSE 'chat' END AS mode FROM {_PROMPTS}
""",
)
def router(spark: SparkSession, d: str) -> DataFrame:
    return prompts(spark, d).select("example_id", tools.route(F.col("prompt"))["mode"].alias("mode"))


@query("grounding", f"SELECT example_id, CASE WHEN contains(prompt, n) THEN 'verbatim' WHEN contains(lower(prompt), lower(n)) THEN 'case_insensitive' ELSE 'none' END AS grounded FROM (SELECT example_id, prompt, coalesce(string_split(target_text, ' ')[1], '') AS n FROM {_PROMPTS})")
def grounding(spark: SparkSession, d: str) -> DataFrame:
    word = F.coalesce(F.get(F.split("target_text", " "), F.lit(0)), F.lit(""))
    return prompts(spark, d).select("example_id", F.coalesce(tools.grounded_string(word, F.col("prompt")), F.lit("none")).alias("grounded"))


@query(
    "grounded_calls",
    rf"""
WITH c AS (SELECT example_id, prompt, json_extract(target_text, '$.arguments') AS args FROM {_PROMPTS} WHERE target_type = 'tool_call' AND json_valid(target_text)),
f AS (SELECT example_id, prompt, unnest(json_keys(args)) AS field, args FROM c),
g AS (SELECT example_id, field, list_contains(regexp_extract_all(prompt, '-?\d+(?:\.\d+)?'), json_extract_string(args, '$.' || field)) AS grounded FROM f)
SELECT example_id, count(*) AS n_fields, count(*) FILTER (grounded) AS n_grounded, count(*) FILTER (grounded) < count(*) AS blocked FROM g GROUP BY example_id
""",
)
def grounded_calls(spark: SparkSession, d: str) -> DataFrame:
    """How many of a call's arguments stand in what the user said, and whether strict grounding blocks the call."""
    calls = prompts(spark, d).filter("target_type = 'tool_call'").select("example_id", "prompt", F.get_json_object("target_text", "$.arguments").alias("arguments")).filter("arguments is not null")
    rows = calls.select("example_id", J.grounding("strict")(F.col("arguments"), F.col("prompt")).alias("g"))
    return rows.filter(F.size("g.fields") > 0).select("example_id", F.size("g.fields").cast("bigint").alias("n_fields"), F.size(F.filter("g.fields", lambda f: f["grounded"])).cast("bigint").alias("n_grounded"), F.col("g.blocks").alias("blocked"))


@query(
    "confidence",
    """
WITH s AS (SELECT vec_id, label, list_sort(embedding::DOUBLE[], 'DESC') AS s FROM embeddings),
c AS (SELECT vec_id, least(CASE WHEN s[1] <= 0 THEN 0.0 ELSE least(1.0, greatest(0.0, (s[1] - s[2]) / s[1])) END, greatest(0.0, 1.0 - 0.25 * (vec_id % 3)), CASE WHEN label = 0 THEN 1.0 ELSE (label - 1) / label END) AS c FROM s)
SELECT vec_id, round(c, 9) AS confidence, CASE WHEN c >= 0.9 THEN 'execute' WHEN c >= 0.7 THEN 'verify' ELSE 'clarify' END AS action FROM c
""",
)
def confidence(spark: SparkSession, d: str) -> DataFrame:
    """Vectors read as the scores of tools, ranked; errors and passed checks from the other numbers of the row."""
    ranked = F.sort_array(F.transform("embedding", lambda x: x.cast("double")), asc=False)
    rows = table(spark, d, "embeddings").select("vec_id", "label", ranked.alias("s"))
    c = tools.confidence(tools.tool_margin(F.col("s")), tools.argument_confidence(F.col("vec_id") % 3), tools.share_of(F.col("label") - 1, F.col("label")))
    return rows.select("vec_id", F.round(c, 9).alias("confidence"), tools.confidence_action(c).alias("action"))


@query("json_numbers", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k, json_valid(props) AS valid FROM events")
def json_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.coalesce(gates.metric_of(F.col("props"), "k").cast("bigint"), F.lit(-1)).alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


EVENT_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "exclusiveMaximum": 90}}, "additionalProperties": False}


@query("json_validate", "SELECT event_id, CAST(CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 10 THEN 1 ELSE 0 END + CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) >= 90 THEN 1 ELSE 0 END AS INTEGER) AS n_errors FROM events")
def json_validate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", J.schema_errors(EVENT_SCHEMA)(F.col("props")).alias("e"))
    return rows.select("event_id", F.size("e").alias("n_errors"))


@query("json_repair")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines: parseable as they are, after a repair, or not at all, and what a broken one is as a beginning."""
    rows = table(spark, d, "raw_records").select("record_id", "raw_json").distinct().select("record_id", J.repair_json("raw_json").alias("r"), J.json_prefix_state("raw_json").alias("prefix"))
    return rows.select("record_id", "r.valid", "r.repaired", "prefix")


@query("canonical_json")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records").select("record_id", "raw_json").distinct().select("record_id", J.canonical_json("raw_json").alias("canonical"))


@query("validate_examples")
def validate_examples(spark: SparkSession, d: str) -> DataFrame:
    """How many raw lines are wrong as supervised examples, by first error."""
    rows = table(spark, d, "raw_records").select("record_id", "raw_json").distinct().select(J.example_errors("raw_json").alias("e"))
    return rows.groupBy(F.coalesce(F.get("e", F.lit(0)), F.lit("valid")).alias("first_error")).agg(F.count(F.lit(1)).alias("n"))


@query("calculator", "SELECT l_orderkey, l_linenumber, CAST((CAST(l_quantity AS INTEGER) + l_linenumber) * l_linenumber - l_orderkey // 7 AS DOUBLE) AS result, CAST((CAST(l_quantity AS INTEGER) + l_linenumber) * l_linenumber AS BIGINT) AS whole FROM lineitem")
def calculator(spark: SparkSession, d: str) -> DataFrame:
    """Sums over order lines, worked out as texts and by the columns."""
    e = F.format_string("(%d + %d) * %d - %d // 7", F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.col("l_linenumber"), F.col("l_orderkey"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", J.calculate(e).alias("c"), J.safe_eval(F.regexp_replace(e, r" - \d+ // 7", "")).alias("whole"))
    return rows.select("l_orderkey", "l_linenumber", "c.result", "whole")


def _json(path: str) -> str:
    return f"json_extract(CASE WHEN json_valid(target_text) THEN target_text END, '{path}')"


@query(
    "tool_calls",
    f"""
SELECT example_id, CASE WHEN NOT {S.looks_like_call("coalesce(target_text, '')")} THEN 'none' WHEN NOT json_valid(target_text) OR list_sort(json_keys(CASE WHEN json_valid(target_text) THEN target_text END)) <> ['arguments', 'name'] OR json_type({_json("$.arguments")}) <> 'OBJECT' THEN 'malformed'
  WHEN NOT list_contains(tools, {_json("$.name")} ->> '$') THEN 'malformed' ELSE 'ok' END AS status,
  CASE WHEN {S.looks_like_call("coalesce(target_text, '')")} AND json_type({_json("$.arguments")}) = 'OBJECT' THEN {_json("$.name")} ->> '$' ELSE '' END AS name FROM {_PROMPTS}
""",
)
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """What the examples' targets are as calls of the tools that the example declares."""
    rows = prompts(spark, d).select("example_id", "tools", tools.CALL(F.coalesce("target_text", F.lit(""))).alias("c"))
    score = tools.call_score(F.col("c"), F.coalesce("tools", F.array().cast("array<string>")), F.col("c.name"), F.col("c.arguments"))
    return rows.select("example_id", score["status"].alias("status"), F.coalesce("c.name", F.lit("")).alias("name"))


@query("memory_upsert", "SELECT user_id AS entry_id, max(event_id) AS seq, arg_max(event_type, event_id) AS scope, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def memory_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Users' last events; an error deletes the entry."""
    writes = table(spark, d, "events").select(F.col("user_id").alias("entry_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("scope"), "value", (F.col("event_type") == "error").alias("deleted"))
    return memory.upsert(writes).select("entry_id", "seq", "scope", "value")


@query("memory_ring", "WITH e AS (SELECT user_id AS entry_id, min(event_id) AS first_seq, arg_max(value, event_id) AS value FROM events GROUP BY user_id) SELECT entry_id, first_seq, value FROM e ORDER BY first_seq DESC LIMIT 50")
def memory_ring(spark: SparkSession, d: str) -> DataFrame:
    writes = table(spark, d, "events").select(F.col("user_id").alias("entry_id"), F.col("event_id").alias("seq"), "value")
    return memory.ring(writes, 50).select("entry_id", "first_seq", "value")


_HISTORY = "SELECT event_type AS run, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS step, avg(value) AS val_loss, avg(value + user_id % 7) AS train_loss_recent FROM events GROUP BY ALL"


def _history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.date_format("ts", "yyyyMMdd").cast("int").alias("step")).agg(F.avg("value").alias("val_loss"), F.avg(F.col("value") + F.col("user_id") % 7).alias("train_loss_recent"))


@query("memorization_signal", f"WITH h AS ({_HISTORY}), b AS (SELECT *, coalesce(val_loss > lag(val_loss) OVER w AND train_loss_recent < lag(train_loss_recent) OVER w, false) AS bad FROM h WINDOW w AS (PARTITION BY run ORDER BY step)) SELECT run, step, count(*) OVER r = 2 AND bool_and(bad) OVER r AS memorizing FROM b WINDOW r AS (PARTITION BY run ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)")
def memorization_signal(spark: SparkSession, d: str) -> DataFrame:
    return gates.memorization_signal(_history(spark, d))


@query("recent_loss", "SELECT event_type AS run, event_id AS step, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS train_loss_recent FROM events")
def recent_loss(spark: SparkSession, d: str) -> DataFrame:
    losses = table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return gates.recent_loss(losses).withColumn("train_loss_recent", F.round("train_loss_recent", 6))


@query(
    "regression_lag",
    f"""
WITH h AS ({_HISTORY}), m AS (SELECT run AS stage, step, 'val_loss' AS metric, val_loss AS v, 0.5 AS allowed FROM h UNION ALL SELECT run, step, 'train_loss_recent', train_loss_recent, 0.25 FROM h),
p AS (SELECT stage, step, metric, allowed, v AS current, lag(v) OVER (PARTITION BY stage, metric ORDER BY step) AS previous FROM m)
SELECT stage, step, metric, round(current, 6) AS current, round(previous, 6) AS previous, round(current - previous, 6) AS worse, current - previous <= allowed + 1e-12 AS ok FROM p WHERE previous IS NOT NULL
""",
)
def regression_lag(spark: SparkSession, d: str) -> DataFrame:
    both = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("val_loss", "train_loss_recent")])).alias("m")
    rows = _history(spark, d).select(F.col("run").alias("stage"), "step", both).select("stage", "step", "m.metric", "m.value")
    allowed = spark.createDataFrame([("val_loss", "up", 0.5), ("train_loss_recent", "up", 0.25)], "metric string, direction string, allowed double")
    out = gates.regressions(rows, allowed)
    return out.select("stage", "step", "metric", *[F.round(c, 6).alias(c) for c in ("current", "previous", "worse")], "ok")


_SCOPED = """
SELECT CASE WHEN event_type IN ('view', 'click') THEN 'own' ELSE 'words' END AS scope, CASE WHEN event_type IN ('view', 'click') THEN 'loss.' ELSE 'generation.' END || event_type AS metric,
       event_id % 2 = 0 AS late, avg(value) AS value FROM events GROUP BY ALL
"""


@query(
    "report_comparison",
    f"""
WITH m AS ({_SCOPED}), a AS (SELECT scope, metric, CASE WHEN metric LIKE 'loss%' THEN 'up' ELSE 'down' END AS direction, 0.25 AS allowed FROM (SELECT DISTINCT scope, metric FROM m)),
j AS (SELECT a.*, n.value AS current, p.value AS previous FROM a LEFT JOIN (SELECT * FROM m WHERE late) n USING (scope, metric) LEFT JOIN (SELECT * FROM m WHERE NOT late) p USING (scope, metric))
SELECT scope, metric, round(CASE direction WHEN 'up' THEN current - previous ELSE previous - current END, 6) AS worse, coalesce(CASE direction WHEN 'up' THEN current - previous ELSE previous - current END <= allowed + 1e-12, true) AS ok FROM j
""",
)
def report_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Mean values per type of event as two reports of a stage, its own ones and those of an earlier stage."""
    own = F.col("event_type").isin("view", "click")
    rows = table(spark, d, "events").select(F.when(own, reports.OWN).otherwise("words").alias("scope"), F.concat(F.when(own, "loss.").otherwise("generation."), "event_type").alias("metric"), (F.col("event_id") % 2 == 0).alias("late"), "value")
    rows = rows.groupBy("scope", "metric", "late").agg(F.avg("value").alias("value"))
    allowed = rows.select("scope", "metric").distinct().select("scope", "metric", F.when(F.col("metric").startswith("loss"), "up").otherwise("down").alias("direction"), F.lit(0.25).alias("allowed"))
    got = reports.compare_reports(rows.filter("late"), rows.filter("not late"), allowed, "reasoning", "reasoning")
    return got.select("scope", "metric", F.round("worse", 6).alias("worse"), "ok")


@query("resolve_mode", "SELECT event_id, CASE WHEN user_id % 2 = 0 AND event_id % 3 = 0 THEN 'none' WHEN user_id % 2 = 0 AND event_id % 5 = 0 THEN 'continue' WHEN user_id % 2 = 0 THEN 'resume' WHEN event_id % 3 = 0 THEN 'init-from' ELSE 'none' END AS mode FROM events")
def resolve_mode(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts of the same stage for even users, complete for every third event, out of budget for every fifth."""
    same, complete, spent = F.col("user_id") % 2 == 0, F.col("event_id") % 3 == 0, F.col("event_id") % 5 == 0
    mode = gates.resolve_mode(F.lit("s1"), F.when(same, "s1").otherwise("s0"), complete, spent, F.lit("auto"))
    return table(spark, d, "events").select("event_id", F.coalesce(mode, F.lit("none")).alias("mode"))


@query("curriculum_stage")
def curriculum_stage(spark: SparkSession, d: str) -> DataFrame:
    """A stage of checked examples of several generators."""
    out = curriculum.build_stage(spark, {"arith_direct": 2.0, "percent": 1.0, "fraction": 1.0, "gcd": 1.0, "arith_tool": 1.0, "grammar": 1.0}, 700)
    return curriculum.verified(out).select("source", "split", "id", "prompt", "answer", "ok")


@query("curriculum_groups")
def curriculum_groups(spark: SparkSession, d: str) -> DataFrame:
    """Examples of groups of generators, for training and evaluation, per kind of task."""
    out = None
    for group in ("knowledge", "dialogue", "tools", "safety"):
        for split, n in (("train", 60), ("val", 20)):
            part = curriculum.generate_group(spark, group, n, split).select(F.lit(group).alias("source"), F.lit(split).alias("split"), "sub")
            out = part if out is None else out.unionByName(part)
    return out.groupBy("source", "split", "sub").agg(F.count(F.lit(1)).alias("n"))


@query("math_curriculum_verified")
def math_curriculum_verified(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of task, how many generated answers the recomputation confirms."""
    out = None
    for name in ("arith_direct", "arith_times", "arith_minus", "percent", "fraction", "gcd", "lcm"):
        part = curriculum.generate(spark, name, 100)
        out = part if out is None else out.unionByName(part)
    checked = curriculum.verified(out)
    return checked.groupBy("sub").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(curriculum.recompute(F.col("sub"), F.col("prompt")).isNotNull()).alias("n_recomputed"))
