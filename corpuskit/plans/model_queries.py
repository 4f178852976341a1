"""Queries over chat examples and vectors: rendering, packing, mixtures, ranking, quantisation, metrics, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.functions import text as T, tools, vectors as V
from corpuskit.operators import bpe, chat, evaluation, gates, metrics, mixture, packing, retrieval, sampling
from corpuskit.operators.dedup import first_deliveries
from corpuskit.plans import sqltext as S
from corpuskit.plans.catalogue import query
from corpuskit.plans.corpus_queries import CHUNKS, EXAMPLES, chunks_of
from corpuskit.session import table

MAX_TOKENS = 1024


def rendered(spark: SparkSession, d: str) -> DataFrame:
    rows = first_deliveries(table(spark, d, "chat_examples").select(F.col("example_id").alias("id"), "source", "category", "messages", "tools", "target_type", "target_text"), "id")
    norm = chat.normalize_examples(rows, keep=("source",))
    return norm.filter("error is null").withColumn("segments", chat.segments())


_NORMAL = f"""
n AS (SELECT example_id AS id, source, category AS given, target_type, tools,
  list_transform(messages, lambda m: struct_pack(role := m.role, content := m.content, train := coalesce(m.train, m.role = 'assistant'))) AS turns,
  target_text, len(messages) > 0 AND messages[-1].role = 'assistant' AS ends FROM {EXAMPLES}),
t AS (SELECT *, CASE WHEN target_text IS NOT NULL AND NOT ends THEN list_append(turns, struct_pack(role := 'assistant', content := target_text, train := true)) ELSE turns END AS m,
  CASE WHEN coalesce(given, '') = '' AND NOT ends AND target_text IS NOT NULL THEN coalesce(target_type, '') ELSE coalesce(given, '') END AS category FROM n),
ok AS (SELECT * FROM t WHERE len(turns) > 0 AND len(list_filter(m, lambda x: x.train)) > 0 AND len(list_filter(m, lambda x: x.train AND trim(x.content) = '')) = 0
  AND len(list_filter(turns, lambda x: x.content IS NULL OR x.role IS NULL OR x.role NOT IN ('system', 'user', 'assistant', 'tool'))) = 0),
r AS (SELECT id, source, category, '<BOS>' || CASE WHEN len(coalesce(tools, [])) > 0 THEN 'tools: ' || array_to_string(tools, ', ') || chr(10) ELSE '' END
  || array_to_string(list_transform(list_filter(m, lambda x: x.role = 'system'), lambda x: 'system:' || chr(10) || x.content || chr(10)), '')
  || array_to_string(list_transform(list_filter(m, lambda x: x.role <> 'system'), lambda x: x.role || ':' || chr(10) || x.content || CASE WHEN x.role = 'assistant' THEN '<EOS>' ELSE chr(10) END), '') AS sequence,
  list_sum(list_transform(m, lambda x: strlen(x.content) + len(x.role) + 2 + 1)) + 1 + CASE WHEN len(coalesce(tools, [])) > 0 THEN strlen('tools: ' || array_to_string(tools, ', ')) + 1 ELSE 0 END AS n_tokens,
  list_sum(list_transform(list_filter(m, lambda x: x.train), lambda x: strlen(x.content) + 1)) AS n_loss FROM ok)
"""


@query("chat_render", f"WITH {_NORMAL} SELECT id, category, sequence FROM r")
def chat_render(spark: SparkSession, d: str) -> DataFrame:
    return rendered(spark, d).select("id", "category", chat.rendered_text(F.col("segments")).alias("sequence"))


@query("token_lengths", f"WITH {_NORMAL} SELECT id, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_loss AS BIGINT) AS n_loss FROM r")
def token_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d).select("id", "n_tokens", "n_loss")


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return rendered(spark, d).select("id", "source", "category", chat.token_count(F.col("segments")).cast("bigint").alias("n_tokens"), chat.loss_token_count(F.col("segments")).cast("bigint").alias("n_loss"))


@query("dataset_stats", f"WITH {_NORMAL} SELECT count(*) AS n_examples, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(min(n_tokens) AS BIGINT) AS min_tokens, CAST(max(n_tokens) AS BIGINT) AS max_tokens, round_even(avg(n_tokens), 2) AS mean_tokens, CAST(sum(n_loss) AS BIGINT) AS loss_tokens FROM r")
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    return chat.dataset_stats(_lengths(spark, d))


@query("examples_by_category", f"WITH {_NORMAL} SELECT CASE WHEN category = '' THEN '(none)' ELSE category END AS category, count(*) AS n_examples FROM r GROUP BY 1")
def examples_by_category(spark: SparkSession, d: str) -> DataFrame:
    return chat.by_category(rendered(spark, d))


@query("invalid_examples", f"WITH {_NORMAL} SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM ok) AS n_invalid, (SELECT count(*) FROM ok) AS n_valid")
def invalid_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = first_deliveries(table(spark, d, "chat_examples").select(F.col("example_id").alias("id"), "category", "messages", "tools", "target_type", "target_text"), "id")
    return chat.normalize_examples(rows).agg(F.count_if(F.col("error").isNotNull()).alias("n_invalid"), F.count_if(F.col("error").isNull()).alias("n_valid"))


_TOOLS = "CASE WHEN len(coalesce(tools, [])) > 0 THEN 'tools: ' || array_to_string(tools, ', ') || chr(10) ELSE '' END"


@query(
    "render_prompt",
    f"""
WITH {_NORMAL}, p AS (SELECT id, tools, m[1:len(m) - 1] AS p FROM ok WHERE len(m) > 1)
SELECT id, '<BOS>' || {_TOOLS} || array_to_string(list_transform(list_filter(p, lambda x: x.role = 'system'), lambda x: 'system:' || chr(10) || x.content || chr(10)), '')
  || array_to_string(list_transform(list_filter(p, lambda x: x.role <> 'system'), lambda x: x.role || ':' || chr(10) || x.content || CASE WHEN x.role = 'assistant' THEN '<EOS>' ELSE chr(10) END), '') || 'assistant:' || chr(10) AS prompt
FROM p WHERE p[-1].role <> 'assistant'
""",
)
def render_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The prompt before each example's last assistant turn."""
    rows = rendered(spark, d).withColumn("messages", F.slice("messages", 1, F.greatest(F.size("messages") - 1, F.lit(0)))).filter(F.size("messages") > 0)
    return rows.select("id", chat.prompt_text().alias("prompt")).filter("prompt is not null")


_SEGMENT = "struct_pack(h := {h}, t := {t}, z := {z})"


def _segment(text: str, trained: str = "false", special: int = 0) -> str:
    return _SEGMENT.format(h=f"hex(encode({text}))", t=trained, z=special)


@query(
    "token_ids",
    f"""
WITH {_NORMAL}, g AS (SELECT id, list_concat([{_segment("''", special=1)}], CASE WHEN len(coalesce(tools, [])) > 0 THEN [{_segment(_TOOLS)}] ELSE [] END,
  flatten(list_transform(list_concat(list_filter(m, lambda x: x.role = 'system'), list_filter(m, lambda x: x.role <> 'system')), lambda x: CASE WHEN x.role = 'assistant' THEN [{_segment("'assistant:' || chr(10)")}, {_segment("x.content", "x.train")}, {_segment("''", "x.train", 2)}] ELSE [{_segment("x.role || ':' || chr(10) || x.content || chr(10)")}] END))) AS segs FROM ok),
i AS (SELECT id, list_transform(segs, lambda p: struct_pack(t := p.t, v := CASE WHEN p.z > 0 THEN [p.z] ELSE list_transform(range(1, length(p.h) // 2 + 1), lambda k: CAST('0x' || substr(p.h, 2 * k - 1, 2) AS INTEGER) + 4) END)) AS s FROM g),
f AS (SELECT id, flatten(list_transform(s, lambda p: p.v)) AS ids, list_concat([-100], flatten(list_transform(s, lambda p: list_transform(p.v, lambda v: CASE WHEN p.t THEN v ELSE -100 END)))[2:]) AS labels FROM i),
o AS (SELECT *, CASE WHEN len(ids) <= {MAX_TOKENS} THEN 'whole' WHEN len(list_filter(labels[2:{MAX_TOKENS}], lambda v: v <> -100)) > 0 THEN 'truncated' ELSE 'dropped' END AS overflow FROM f)
SELECT id, CASE WHEN overflow = 'dropped' THEN '' ELSE array_to_string(ids[1:{MAX_TOKENS}], ' ') END AS ids, CASE WHEN overflow = 'dropped' THEN '' ELSE array_to_string(labels[1:{MAX_TOKENS}], ' ') END AS labels, len(ids) AS n_ids, overflow FROM o
""",
)
def token_ids(spark: SparkSession, d: str) -> DataFrame:
    """Byte tokens and labels of every example (as texts of numbers), cut to the length of a row where they are longer:
    overflow tells which are, and n_ids how long they were."""
    rows = rendered(spark, d).select("id", chat.byte_tokens("segments").alias("t")).select("id", "t.ids", "t.labels", F.size("t.ids").cast("bigint").alias("n_ids"))
    text = lambda c: F.array_join(c, " ").alias(c)
    return chat.apply_overflow(rows, MAX_TOKENS, "truncate").select("id", text("ids"), text("labels"), "n_ids", F.coalesce("overflow", F.lit("whole")).alias("overflow"))


_LENGTHS = f"n_ids AS (SELECT id, least(n_tokens, {MAX_TOKENS}) AS length, n_tokens > {MAX_TOKENS} AS cut, row_number() OVER (ORDER BY id) AS rn FROM r)"
_PACKED = f"""
p(rn, row_no, used, segment_no) AS (SELECT rn, CAST(0 AS BIGINT), length, 1 FROM n_ids WHERE rn = 1 UNION ALL
  SELECT n.rn, CASE WHEN p.used + n.length > {MAX_TOKENS} THEN p.row_no + 1 ELSE p.row_no END, CASE WHEN p.used + n.length > {MAX_TOKENS} THEN n.length ELSE p.used + n.length END, CASE WHEN p.used + n.length > {MAX_TOKENS} THEN 1 ELSE p.segment_no + 1 END
  FROM p JOIN n_ids n ON n.rn = p.rn + 1)
"""


@query("packed_rows", f"WITH RECURSIVE {_NORMAL}, {_LENGTHS}, {_PACKED} SELECT id, CAST(length AS INTEGER) AS length, cut, row_no, segment_no FROM p JOIN n_ids USING (rn)")
def packed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every example's row and segment in the packed epoch; what is longer than a row counts as cut to it."""
    rows = _lengths(spark, d).select("id", F.least("n_tokens", F.lit(MAX_TOKENS)).cast("int").alias("length"), (F.col("n_tokens") > MAX_TOKENS).alias("cut"))
    return packing.pack_rows(rows, MAX_TOKENS, "length", "id")


@query(
    "padding_utilisation",
    f"""
WITH RECURSIVE {_NORMAL}, {_LENGTHS}, {_PACKED} SELECT count(*) AS n_examples, count(*) FILTER (cut) AS n_cut, CAST(max(row_no) + 1 AS BIGINT) AS n_rows, round(sum(length) / (count(*) * {MAX_TOKENS}), 6) AS padded, round(sum(length) / ((max(row_no) + 1) * {MAX_TOKENS}), 6) AS packed FROM p JOIN n_ids USING (rn)
""",
)
def padding_utilisation(spark: SparkSession, d: str) -> DataFrame:
    """How full rows are, with one example a row and packed, and how many examples were cut to a row."""
    rows = packed_rows(spark, d)
    packed = rows.groupBy("row_no").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("n"), F.count_if("cut").alias("cut"))
    return packed.agg(F.sum("n").alias("n_examples"), F.sum("cut").alias("n_cut"), F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("used") / (F.sum("n") * MAX_TOKENS), 6).alias("padded"), F.round(F.sum("used") / (F.count(F.lit(1)) * MAX_TOKENS), 6).alias("packed"))


@query(
    "epoch_plan",
    """
WITH e AS (SELECT DISTINCT source, example_id AS id FROM chat_examples), w AS (SELECT source, weight / sum(weight) OVER () * (SELECT count(*) FROM e) AS x FROM dataset_manifest WHERE entry_type = 'synthetic' AND split = 'train'),
f AS (SELECT *, floor(x) AS fl FROM w), q AS (SELECT source, CAST(fl + CASE WHEN row_number() OVER (ORDER BY x - fl DESC, source) <= (SELECT count(*) FROM e) - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f),
n AS (SELECT source, count(*) AS n FROM e GROUP BY source), p AS (SELECT source, quota, n, CAST(ceil(quota / n) AS BIGINT) AS turns FROM q JOIN n USING (source) WHERE quota > 0),
r AS (SELECT source, id, quota, n, turns, unnest(range(1, turns + 1)) AS repeat FROM e JOIN p USING (source)),
k AS (SELECT *, row_number() OVER (PARTITION BY source, repeat ORDER BY sha256('0:1:' || source || ':' || repeat || ':' || id), id) AS place FROM r)
SELECT source, id, CAST(repeat AS INTEGER) AS repeat, sha256('0:1:order:' || source || ':' || repeat || ':' || id) AS order_key FROM k WHERE repeat < turns OR place <= quota - n * (turns - 1)
""",
)
def epoch_plan(spark: SparkSession, d: str) -> DataFrame:
    """An epoch of as many examples as there are, dealt by the sources' weights, small sources repeated."""
    rows = table(spark, d, "chat_examples").select("source", F.col("example_id").alias("id")).distinct()
    quotas = _quotas(spark, d, rows.count())
    return sampling.epoch_order(rows, quotas, 0, 1)


def _quotas(spark: SparkSession, d: str, total: int) -> DataFrame:
    weights = table(spark, d, "dataset_manifest").filter("entry_type = 'synthetic' and split = 'train'").select("source", "weight")
    return sampling.largest_remainder(weights, total, "source", "weight")


@query(
    "mixture_quotas",
    """
WITH w AS (SELECT source, weight / sum(weight) OVER () * 100003 AS x FROM dataset_manifest), f AS (SELECT *, floor(x) AS fl FROM w)
SELECT source, CAST(fl + CASE WHEN row_number() OVER (ORDER BY x - fl DESC, source) <= 100003 - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f
""",
)
def mixture_quotas(spark: SparkSession, d: str) -> DataFrame:
    return sampling.largest_remainder(table(spark, d, "dataset_manifest"), 100003, "source", "weight")


@query(
    "mixture_weights",
    """
WITH r AS (SELECT source AS name, weight, CASE WHEN entry_type = 'synthetic' THEN 'replay' ELSE 'primary' END AS role FROM dataset_manifest)
SELECT name, round_even(weight / sum(weight) OVER (PARTITION BY role) * CASE WHEN role = 'replay' THEN 0.15 ELSE 0.85 END, 6) AS weight FROM r
""",
)
def mixture_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dataset_manifest").select(F.col("source").alias("name"), "weight", F.when(F.col("entry_type") == "synthetic", "replay").otherwise("primary").alias("role"))
    return mixture.effective_mixture(rows, 0.15)


@query("repeat_factors", "WITH s AS (SELECT source, count(DISTINCT example_id) AS n FROM chat_examples GROUP BY source) SELECT source, round_even(examples / n, 3) AS repeat_factor, round_even(examples * 3 / n, 2) AS planned_passes FROM dataset_manifest JOIN s USING (source) WHERE examples IS NOT NULL")
def repeat_factors(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "chat_examples").select("source", "example_id").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return mixture.repeat_factors(table(spark, d, "dataset_manifest").filter("examples is not null").select("source", F.col("examples").alias("quota")), sizes, 3)


@query("example_fraction", f"SELECT round(0.8 * s / (0.8 * s + 0.2 * n), 9) AS fraction FROM (SELECT avg(strlen(target_text)) AS s FROM {EXAMPLES}), (SELECT avg(strlen(text)) AS n FROM {CHUNKS})")
def example_fraction(spark: SparkSession, d: str) -> DataFrame:
    examples = table(spark, d, "chat_examples").select("example_id", "target_text")
    examples = first_deliveries(examples, "example_id")
    sizes = examples.select(F.octet_length("target_text").alias("s"), F.lit(None).cast("int").alias("n")).unionByName(chunks_of(spark, d, "text").select(F.lit(None).cast("int").alias("s"), F.octet_length("text").alias("n")))
    return sizes.agg(F.avg("s").alias("s"), F.avg("n").alias("n")).select(F.round(mixture.example_fraction(0.8, F.col("s"), F.col("n")), 9).alias("fraction"))


_TERMS = "list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))"


@query(
    "bm25_top",
    f"""
WITH d AS (SELECT doc_id AS doc, {_TERMS.format(x="coalesce(text, '')")} AS t FROM documents),
tf AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), c AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d),
q AS (SELECT query, term, count(*) AS times FROM (SELECT item_id AS query, unnest({_TERMS.format(x="text")}) AS term FROM eval_items) GROUP BY ALL),
s AS (SELECT query, doc, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term), c GROUP BY query, doc)
SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 5
""",
)
def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation passage as a query over all documents."""
    queries = table(spark, d, "eval_items").select(F.col("item_id").alias("query"), "text")
    return retrieval.bm25_top(queries, table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), 5, digits=6)


@query(
    "embedding_top",
    """
WITH p AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM p) WHERE rank <= 5
""",
)
def embedding_top(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose id is divisible by 20 as queries against all rows."""
    e = table(spark, d, "embeddings")
    return retrieval.cosine_top(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v")))


@query("hash_embedding")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d, "text").select("chunk_no", retrieval.hash_embed()(F.col("text")).alias("embedding"))


@query(
    "quantize_int8",
    """
WITH s AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x))) AS peak FROM embeddings),
q AS (SELECT vec_id, CAST(CASE WHEN peak = 0 THEN CAST(1 AS FLOAT) ELSE peak END / CAST(127 AS FLOAT) AS FLOAT) AS scale, embedding FROM s)
SELECT vec_id, round(CAST(scale AS DOUBLE), 9) AS scale, CAST(list_sum(list_transform(embedding, lambda x: CAST(round_even(CAST(CAST(x / scale AS FLOAT) AS DOUBLE), 0) AS BIGINT))) AS BIGINT) AS total,
       CAST(list_max(list_transform(embedding, lambda x: CAST(round_even(CAST(CAST(x / scale AS FLOAT) AS DOUBLE), 0) AS BIGINT))) AS BIGINT) AS top FROM q
""",
)
def quantize_int8(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "embeddings").select("vec_id", V.quantize(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round(F.col("q.scale").cast("double"), 9).alias("scale"), F.aggregate("q.values", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.array_max("q.values").cast("bigint").alias("top"))


@query(
    "quantize_int4",
    """
WITH s AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x))) AS peak FROM embeddings),
q AS (SELECT vec_id, CAST(CASE WHEN peak = 0 THEN CAST(1 AS FLOAT) ELSE peak END / CAST(7 AS FLOAT) AS FLOAT) AS scale, embedding FROM s),
v AS (SELECT vec_id, scale, list_transform(embedding, lambda x: CAST(greatest(-7, least(7, round_even(CAST(CAST(x / scale AS FLOAT) AS DOUBLE), 0))) AS INTEGER)) AS v FROM q)
SELECT vec_id, round(CAST(scale AS DOUBLE), 9) AS scale, array_to_string(list_transform(range(1, len(v) // 2 + 1), lambda i: printf('%02X', v[2 * i - 1] + 8 + (v[2 * i] + 8) * 16)), '') AS packed FROM v
""",
)
def quantize_int4(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "embeddings").select("vec_id", V.quantize(F.col("embedding"), 7).alias("q"))
    return q.select("vec_id", F.round(F.col("q.scale").cast("double"), 9).alias("scale"), F.hex(V.pack_int4(F.col("q.values"))).alias("packed"))


@query(
    "sampling_filters",
    """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp((x::DOUBLE - list_max(embedding)::DOUBLE) / 0.5)) AS e FROM embeddings),
p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e),
k AS (SELECT vec_id, p, list_transform(p, lambda x: CASE WHEN x >= list_sort(p, 'DESC')[8] THEN x ELSE 0.0 END) AS k FROM p),
n AS (SELECT vec_id, unnest(list_transform(k, lambda x: x / list_sum(k))) AS x, unnest(range(len(k))) AS i FROM k),
c AS (SELECT vec_id, x, i, coalesce(sum(x) OVER (PARTITION BY vec_id ORDER BY x DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT vec_id, CAST(count(*) AS BIGINT) AS kept, round(max(x) / sum(x), 6) AS top, CAST(arg_min(i, (-x, i)) AS INTEGER) AS best FROM c WHERE before < 0.7 AND x > 0 GROUP BY vec_id
""",
)
def sampling_filters(spark: SparkSession, d: str) -> DataFrame:
    """Vectors read as logits: temperature, softmax, top-k, top-p."""
    p = V.softmax(V.apply_temperature(F.col("embedding"), 0.5))
    rows = table(spark, d, "embeddings").select("vec_id", p.alias("p"))
    rows = rows.select("vec_id", V.top_k_filter(F.col("p"), 8).alias("k")).select("vec_id", V.top_p_filter(F.col("k"), 0.7).alias("f"))
    return rows.select("vec_id", F.size(F.filter("f", lambda x: x > 0)).cast("bigint").alias("kept"), F.round(F.array_max("f"), 6).alias("top"), V.argmax(F.col("f")).alias("best"))


@query("select_token")
def select_token(spark: SparkSession, d: str) -> DataFrame:
    """One seeded draw from each vector read as logits, with tokens banned by n-grams and a repetition penalty."""
    u = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(3)), 11) * F.lit(2.0**-53)
    used = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.pmod(F.xxhash64("vec_id", i), F.lit(16))).cast("int"))
    rows = table(spark, d, "embeddings").select("vec_id", V.repetition_penalty(F.transform("embedding", lambda x: x.cast("double")), used, 1.2).alias("logits"), used.alias("used"))
    return rows.select("vec_id", V.select_token(F.col("logits"), u, 0.7, 20, 0.9).alias("token"), V.banned_ngram_tokens(F.col("used"), 2).alias("banned"))


@query(
    "text_repetition",
    f"""
WITH t AS (SELECT chunk_no, trim(text) AS t FROM {CHUNKS})
SELECT chunk_no, round(CASE WHEN length(t) < 12 THEN 0.0 ELSE 1.0 - len(list_distinct(g)) / len(g) END, 9) AS repetition,
  round(CASE WHEN len(w) < 2 THEN CASE WHEN len(w) > 0 THEN 1.0 ELSE 0.0 END ELSE len(list_distinct(b)) / len(b) END, 9) AS distinct_2
FROM (SELECT chunk_no, t, w, list_transform(range(1, length(t) - 4), lambda i: substr(t, i, 6)) AS g, {S.grams("w", 2)} AS b FROM (SELECT *, {S.words("t")} AS w FROM (SELECT chunk_no, {S.squash("t")} AS t FROM t)))
""",
)
def text_repetition(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d, "text").select("chunk_no", F.round(T.repetition(F.col("text")), 9).alias("repetition"), F.round(T.distinct_n(T.words(F.col("text")), 2), 9).alias("distinct_2"))


@query(
    "generation_metrics",
    f"""
WITH t AS (SELECT source, t, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(t, ' ') END AS w FROM (SELECT source, trim(text) AS t FROM {CHUNKS})),
m AS (SELECT source, t, length(t) AS c, CASE WHEN length(t) < 12 THEN 0.0 ELSE 1.0 - len(list_distinct(g)) / len(g) END AS rep, len(list_distinct(w)) / len(w) AS d1, CASE WHEN len(w) < 2 THEN 1.0 ELSE len(list_distinct(b)) / len(b) END AS d2
  FROM (SELECT *, list_transform(range(1, length(t) - 4), lambda i: substr(t, i, 6)) AS g, {S.grams("w", 2)} AS b FROM t))
SELECT source, count(*) AS n, round(avg(CASE WHEN t <> '' THEN 1 ELSE 0 END), 6) AS non_empty_rate, round(avg(rep), 6) AS mean_repetition, round(avg(CASE WHEN rep > 0.5 THEN 1 ELSE 0 END), 6) AS looping_rate,
  round(avg(d1), 6) AS mean_distinct_1, round(avg(d2), 6) AS mean_distinct_2, round(avg(c), 6) AS mean_chars, round(avg(c), 6) AS mean_tokens_generated, round(avg(CASE WHEN t LIKE '%.' THEN 1 ELSE 0 END), 6) AS eos_rate FROM m GROUP BY source
""",
)
def generation_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks_of(spark, d, "source", "text").select("source", F.col("text").alias("generation"), F.length(F.trim("text")).alias("tokens_generated"), F.when(F.trim("text").endswith("."), "eos").otherwise("max_new_tokens").alias("finish_reason"))
    out = metrics.generation_metrics(rows, "source")
    return out.select("source", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("source", "n")])


_CORE = "regexp_replace({w}, '^[.,!?;:\"''()\\[\\]{{}}“”‘’…-]+|[.,!?;:\"''()\\[\\]{{}}“”‘’…-]+$', '', 'g')"
_IS_WORD = f"regexp_full_match(regexp_replace({_CORE.format(w='w')}, '[''’-]', '', 'g'), '\\p{{L}}+')"


@query("lexicon", f"SELECT word, count(*) AS n FROM (SELECT lower(replace({_CORE.format(w='w')}, '’', '''')) AS word FROM (SELECT unnest(string_split({S.squash('text')}, ' ')) AS w FROM {CHUNKS}) WHERE {_IS_WORD}) GROUP BY word ORDER BY n DESC, word LIMIT 500")
def lexicon(spark: SparkSession, d: str) -> DataFrame:
    return metrics.lexicon(chunks_of(spark, d, "text"), 500)


@query(
    "language_likeness",
    f"""
WITH t AS (SELECT chunk_no, source, trim(text) AS t, string_split({S.squash("text")}, ' ') AS ws FROM {CHUNKS}),
m AS (SELECT source, len(list_filter(ws, lambda w: {_IS_WORD})) / len(ws) AS wl, length(regexp_replace(regexp_replace(t, '\\s', '', 'g'), '[^\\p{{L}}.,!?;:''"\\-()’“”]', '', 'g')) / length(regexp_replace(t, '\\s', '', 'g')) AS al,
  CASE WHEN regexp_matches(t, '[.!?]["''”’)\\]]*$') THEN 1 ELSE 0 END AS e, list_sum(list_transform(list_filter(ws, lambda w: {_IS_WORD}), lambda w: length({_CORE.format(w="w")}))) AS letters, len(list_filter(ws, lambda w: {_IS_WORD})) AS n FROM t)
SELECT source, count(*) AS n, round(avg(wl), 6) AS word_like_fraction, round(avg(al), 6) AS alpha_fraction, round(avg(e), 6) AS terminator_fraction, round(sum(letters) / sum(n), 6) AS mean_word_length FROM m GROUP BY source
""",
)
def language_likeness(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.grammar_metrics(chunks_of(spark, d, "source", "text"), None, "source", key="chunk_no")
    return out.select("source", "n", *[F.round(c, 6).alias(c) for c in ("word_like_fraction", "alpha_fraction", "terminator_fraction", "mean_word_length")])


@query("grammar_metrics")
def grammar_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks_of(spark, d, "source", "text")
    return metrics.grammar_metrics(rows, metrics.lexicon(rows, 2000), "source", key="chunk_no")


def graded(spark: SparkSession, d: str) -> DataFrame:
    """Examples as graded rows: the last assistant turn against the target, by the scorer of the example's meta (a call
    where the target is one)."""
    rows = first_deliveries(table(spark, d, "chat_examples").select("example_id", "source", "category", "messages", "tools", "target_type", "target_text", "meta"), "example_id")
    said = F.element_at(F.filter("messages", lambda m: m["role"] == "assistant"), -1)["content"]
    is_call = F.coalesce(F.col("target_type") == "tool_call", F.lit(False))
    scorer = F.when(is_call, "tool_call").otherwise(F.coalesce(F.get_json_object("meta", "$.score"), F.lit("exact")))
    rows = rows.select("example_id", "source", F.lower(F.coalesce("category", F.lit(""))).alias("category"), scorer.alias("scorer"), F.get_json_object("meta", "$.paraphrase").cast("boolean").alias("paraphrase"), F.coalesce(F.when(F.exists("messages", lambda m: m["role"] == "assistant"), said), F.lit("")).alias("text"), F.coalesce("target_text", F.lit("")).alias("expected"), "tools")
    wants = F.col("scorer") == "tool_call"
    call = tools.call_score(tools.CALL(F.when(wants, F.col("text"))), F.col("tools"), F.get_json_object("expected", "$.name"), F.get_json_object("expected", "$.arguments"))
    rows = rows.withColumn("call", F.when(wants, call))
    plain = tools.score_text(F.col("scorer"), F.col("text"), F.col("expected"), F.array("expected"))
    ok = F.when(wants, F.col("call.args_ok")).otherwise(F.coalesce(plain, F.lit(False)))
    return rows.select("example_id", "source", "category", "scorer", "paraphrase", "text", "expected", ok.alias("ok"), "call.status", "call.name_ok")


def _json(x: str, path: str) -> str:
    return f"json_extract(CASE WHEN json_valid({x}) THEN {x} END, '{path}')"


_GRADED = f"""
a0 AS (SELECT example_id, source, lower(coalesce(category, '')) AS category, CASE WHEN target_type = 'tool_call' THEN 'tool_call' ELSE coalesce(json_extract_string(meta, '$.score'), 'exact') END AS scorer, CAST(json_extract_string(meta, '$.paraphrase') AS BOOLEAN) AS paraphrase,
  coalesce(list_filter(messages, lambda m: m.role = 'assistant')[-1].content, '') AS text, coalesce(target_text, '') AS expected, tools FROM {EXAMPLES}),
a AS (SELECT *, CASE WHEN scorer <> 'tool_call' THEN NULL WHEN NOT {S.looks_like_call("text")} THEN 'none'
    WHEN json_valid(text) AND list_sort(json_keys(CASE WHEN json_valid(text) THEN text END)) = ['arguments', 'name'] AND json_type({_json("text", "$.arguments")}) = 'OBJECT' AND (tools IS NULL OR list_contains(tools, {_json("text", "$.name")} ->> '$')) THEN 'ok' ELSE 'malformed' END AS status FROM a0),
g0 AS (SELECT *, CASE WHEN scorer = 'tool_call' THEN coalesce(status = 'ok' AND {_json("text", "$.name")} = {_json("expected", "$.name")}, false) END AS name_ok FROM a),
g AS (SELECT *, coalesce(CASE scorer WHEN 'tool_call' THEN name_ok AND {_json("text", "$.arguments")} = {_json("expected", "$.arguments")} WHEN 'exact' THEN {S.squash("text")} = {S.squash("expected")} WHEN 'contains' THEN contains({S.squash("text")}, expected) AND NOT {S.looks_like_call("text")}
  WHEN 'json' THEN {_json("text", "$")} = {_json("expected", "$")}
  WHEN 'contains_ci' THEN contains(lower({S.squash("text")}), lower(expected)) AND NOT {S.looks_like_call("text")} WHEN 'clarify' THEN {S.squash("text")} LIKE '%?' AND NOT {S.looks_like_call("text")}
  WHEN 'no_tool' THEN contains(lower({S.squash("text")}), expected) AND NOT {S.looks_like_call("text")}
  WHEN 'refusal' THEN regexp_matches(lower({S.squash("text")}), '^(i can''t|i cannot|i can’t|sorry, i can''t|sorry, i can’t|sorry, i cannot)') AND NOT {S.looks_like_call("text")}
  WHEN 'final_answer' THEN {S.squash("string_split(text, '####')[-1]")} = {S.squash("expected")} OR list_contains(string_split({S.squash("string_split(text, '####')[-1]")}, ' '), {S.squash("expected")}) END, false) AS ok FROM g0)
"""


@query("score_answers", f"WITH {_GRADED} SELECT example_id, scorer, ok FROM g")
def score_answers(spark: SparkSession, d: str) -> DataFrame:
    return graded(spark, d).select("example_id", "scorer", "ok")


@query("capability_accuracy", f"WITH {_GRADED}, c AS (SELECT category, count(*) AS n, avg(CASE WHEN ok THEN 1 ELSE 0 END) AS accuracy, avg(CASE WHEN ok THEN 1 ELSE 0 END) FILTER (paraphrase) AS p, avg(CASE WHEN ok THEN 1 ELSE 0 END) FILTER (NOT paraphrase) AS s FROM g GROUP BY category) SELECT category, n, round(accuracy, 9) AS accuracy, round(coalesce(CASE WHEN s IS NOT NULL THEN p END, -1), 9) AS paraphrase_accuracy, round(coalesce(CASE WHEN p IS NOT NULL THEN s END, -1), 9) AS seen_phrasing_accuracy FROM c")
def capability_accuracy(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.capability_accuracy(graded(spark, d))
    return out.select("category", "n", F.round("accuracy", 9).alias("accuracy"), *[F.round(F.coalesce(c, F.lit(-1.0)), 9).alias(c) for c in ("paraphrase_accuracy", "seen_phrasing_accuracy")])


_REPORT_SQL = ", ".join(f"('{k}', '{c}')" for k, cs in evaluation.REPORT.items() for c in cs)


@query("weighted_rollup", f"WITH {_GRADED}, c AS (SELECT category, count(*) AS n, avg(CASE WHEN ok THEN 1 ELSE 0 END) AS accuracy FROM g GROUP BY category) SELECT r.report AS category, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, round(coalesce(sum(n * accuracy) / nullif(sum(n), 0), -1), 9) AS accuracy FROM (VALUES {_REPORT_SQL}) r(report, category) LEFT JOIN c USING (category) GROUP BY r.report")
def weighted_rollup(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.weighted_rollup(evaluation.capability_accuracy(graded(spark, d))).select("category", "n", F.round(F.coalesce("accuracy", F.lit(-1.0)), 9).alias("accuracy"))


def _rate(hit: str, among: str) -> str:
    return f"round(coalesce(avg(CASE WHEN {hit} THEN 1 ELSE 0 END) FILTER ({among}), -1), 9)"


_CALLS = "scorer = 'tool_call'"


@query(
    "tool_behavior",
    f"""
WITH {_GRADED} SELECT CAST(count(*) FILTER ({_CALLS}) AS BIGINT) AS requests_needing_a_tool, {_rate("name_ok", _CALLS)} AS correct_tool_rate, {_rate("ok", _CALLS)} AS argument_accuracy,
  {_rate("status = 'ok' AND NOT name_ok", _CALLS)} AS wrong_tool_rate, {_rate("status = 'none'", _CALLS)} AS no_call_rate, {_rate("status = 'malformed'", _CALLS)} AS malformed_call_rate,
  CAST(count(*) FILTER (NOT {_CALLS}) AS BIGINT) AS requests_needing_no_tool, {_rate(S.looks_like_call("text"), f"NOT {_CALLS}")} AS false_positive_call_rate,
  {_rate("ok", "category = 'clarification'")} AS clarification_on_missing_argument_accuracy, {_rate("ok", "category = 'clarification_followup'")} AS clarification_followup_call_accuracy,
  {_rate("ok", "category = 'tool_result'")} AS tool_result_incorporation_accuracy, {_rate("ok", "category = 'refusal'")} AS refusal_accuracy FROM g
""",
)
def tool_behavior(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.tool_behavior(graded(spark, d))
    return out.select(*[F.round(F.coalesce(c, F.lit(-1.0)), 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_LAST = "regexp_matches(text, '[.?!}]$')"


@query(
    "generation_block",
    f"""
WITH {_GRADED}, r AS (SELECT *, trim(text) AS t FROM g),
p AS (SELECT *, CASE WHEN length(t) < 12 THEN 0.0 ELSE 1.0 - len(list_distinct(q)) / len(q) END AS rep FROM (SELECT *, list_transform(range(1, length(t) - 4), lambda i: substr(t, i, 6)) AS q FROM r))
SELECT count(*) AS graded_examples, round(avg(strlen(text)), 6) AS mean_response_tokens, round(avg(length(text)), 6) AS mean_response_chars, round(avg(CASE WHEN {_LAST} THEN 0 ELSE 1 END), 6) AS unterminated_rate, round(avg(rep), 6) AS mean_repetition, round(avg(CASE WHEN rep > 0.5 THEN 1 ELSE 0 END), 6) AS looping_rate FROM p
""",
)
def generation_block(spark: SparkSession, d: str) -> DataFrame:
    """Answers that stop in the middle of a sentence count as cut off."""
    rows = graded(spark, d).withColumn("tokens", F.octet_length("text")).withColumn("finish", F.when(F.col("text").rlike(r"[.?!}]$"), "eos").otherwise("length"))
    out = evaluation.generation_block(rows)
    return out.select("graded_examples", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def _accuracies(spark: SparkSession, d: str, split: str) -> DataFrame:
    rows = graded(spark, d).withColumn("metric", F.concat(F.lit("capabilities."), "category"))
    sources = table(spark, d, "dataset_manifest").select("source", "split")
    return rows.join(sources, "source").filter(F.col("split") == split).groupBy("metric").agg(F.round(F.avg(F.col("ok").cast("int")), 9).alias("value"))


_METRICS = "m AS (SELECT split, 'capabilities.' || category AS metric, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 9) AS value FROM g JOIN (SELECT source, split FROM dataset_manifest) USING (source) GROUP BY ALL)"


@query("eval_compare", f"WITH {_GRADED}, {_METRICS} SELECT metric, a.value AS a, b.value AS b, round(b.value - a.value, 9) AS delta FROM m a JOIN m b USING (metric) WHERE a.split = 'train' AND b.split = 'test'")
def eval_compare(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.compare(_accuracies(spark, d, "train"), _accuracies(spark, d, "test")).withColumn("delta", F.round("delta", 9))


@query("gate_check", f"WITH {_GRADED}, {_METRICS}, c(metric, lo, hi) AS (VALUES ('capabilities.math', 0.1, 1.0), ('capabilities.dialogue', NULL, 0.9), ('capabilities.nothing', 0.0, NULL)) SELECT c.metric, round(coalesce(value, -1), 9) AS value, coalesce(value >= coalesce(lo, value) AND value <= coalesce(hi, value), false) AS ok FROM c LEFT JOIN (SELECT * FROM m WHERE split = 'train') m USING (metric)")
def gate_check(spark: SparkSession, d: str) -> DataFrame:
    checks = spark.createDataFrame([("capabilities.math", 0.1, 1.0), ("capabilities.dialogue", None, 0.9), ("capabilities.nothing", 0.0, None)], "metric string, min double, max double")
    return gates.check_metrics(checks, _accuracies(spark, d, "train")).select("metric", F.round(F.coalesce("value", F.lit(-1.0)), 9).alias("value"), "ok")


_LETTERS, _BLANK = r"\p{L}\p{M}\p{Nl}", r"\s\x0b\x1c-\x1f\x85\p{Z}"


@query("bpe_pieces", f"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, ' ?[{_LETTERS}]+| ?\\p{{Nd}}| ?[^{_LETTERS}\\p{{Nd}}{_BLANK}]+|[{_BLANK}]+')) AS piece FROM {CHUNKS}) GROUP BY piece")
def bpe_pieces(spark: SparkSession, d: str) -> DataFrame:
    """How often each pre-token occurs in the chunks."""
    return bpe.piece_counts(chunks_of(spark, d, "text"))


_PARTS = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS HUGEINT)) AS VARCHAR)" for i in range(4))


@query("content_hash", f"SELECT sha256(count(*) || ':' || {_PARTS}) AS content_hash FROM (SELECT sha256(example_id || chr(31) || coalesce(target_text, chr(0))) AS h FROM {EXAMPLES})")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return chat.content_hash(first_deliveries(table(spark, d, "chat_examples").select("example_id", "target_text"), "example_id"), "example_id", columns=["target_text"])
