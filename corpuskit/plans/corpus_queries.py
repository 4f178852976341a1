"""Queries of corpus preparation: text rules, chunks, duplicates, contamination, samples, splits, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.functions import text as T
from corpuskit.operators import chunking, contamination, dedup, mixture, pipeline, sampling
from corpuskit.plans import sqltext as S
from corpuskit.plans.catalogue import query
from corpuskit.session import Workspace, table
from corpuskit.sources import shards


def chunks_of(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Chunks without second deliveries."""
    return dedup.first_deliveries(table(spark, d, "corpus_chunks").select("chunk_no", *cols), "chunk_no")


def examples_of(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Chat examples without second deliveries, beside their source's split."""
    rows = dedup.first_deliveries(table(spark, d, "chat_examples").select("example_id", "source", *cols), "example_id")
    return rows.join(table(spark, d, "dataset_manifest").select("source", "split"), "source")


CHUNKS = "(SELECT DISTINCT ON (chunk_no) * FROM corpus_chunks)"
EXAMPLES = "(SELECT DISTINCT ON (example_id) * FROM chat_examples)"

_GROUP = ("source", "shard_sha256", "doc_index")


@query(
    "corpus_flagship",
    f"""
WITH c AS (SELECT chunk_no, source, text, {S.normal("text")} AS plain, concat_ws('|', source, shard_sha256, doc_index) AS group_key FROM {CHUNKS}),
kept AS (SELECT *, sha256(plain) AS k FROM c QUALIFY row_number() OVER (PARTITION BY sha256(plain) ORDER BY chunk_no) = 1),
ev AS (SELECT DISTINCT unnest({S.grams("w", 8)}) AS gram FROM (SELECT {S.words("n")} AS w FROM (SELECT {S.normal("text")} AS n FROM eval_items))),
own AS (SELECT chunk_no, unnest({S.grams("w", 8)}) AS gram FROM (SELECT chunk_no, {S.words("plain")} AS w FROM kept)),
clean AS (SELECT * FROM kept WHERE chunk_no NOT IN (SELECT chunk_no FROM own JOIN ev USING (gram))),
g AS (SELECT group_key, row_number() OVER (ORDER BY sha256('0:' || group_key), group_key) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT group_key FROM clean)),
s AS (SELECT group_key, CASE WHEN n < 3 THEN 'train' WHEN rn <= ceil(0.02 * n) THEN 'test' WHEN rn <= ceil(0.02 * n) + ceil(0.02 * n) THEN 'val' ELSE 'train' END AS split FROM g)
SELECT split, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM clean JOIN s USING (group_key) GROUP BY split
""",
)
def corpus_flagship(spark: SparkSession, d: str) -> DataFrame:
    """Exact dedup, decontamination, group split, counts. Texts are normalised once and written in that form."""
    space = Workspace(spark, "flagship")
    rows = chunks_of(spark, d, "text", *_GROUP)
    rows = rows.select("chunk_no", F.concat_ws("|", *_GROUP).alias("group_key"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), T.normalize_text(F.col("text")).alias("plain"))
    rows = space.write(rows.withColumn("key", F.sha2("plain", 256)), "plain")
    firsts = dedup.first_ids(rows, F.col("key"), "chunk_no").select("chunk_no")
    kept = space.write(rows.drop("key").join(firsts, "chunk_no", "left_semi"), "kept")
    grams = contamination.eval_ngrams(table(spark, d, "eval_items"), 8)
    dirty = contamination.contaminated(kept, grams, 8, "chunk_no", "plain")
    clean = kept.drop("plain").join(dirty, "chunk_no", "left_anti")
    splits = sampling.split_groups(clean, 0.02, 0.02, 0)
    return clean.join(splits, "group_key").groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.sum("chars").cast("bigint").alias("chars"), F.sum("bytes").cast("bigint").alias("bytes"))


@query("normalize_text", f"SELECT chunk_no, {S.normal('text')} AS plain FROM {CHUNKS}")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d, "text").select("chunk_no", T.normalize_text(F.col("text")).alias("plain"))


@query("normalize_documents", f"SELECT doc_id, {S.normal('text')} AS plain FROM documents")
def normalize_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("plain"))


def _lines(x: str) -> str:
    return rf"string_split_regex({x}, '\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


_PARAGRAPHS = f"""
SELECT doc_id, list_filter(CASE WHEN regexp_matches(text, '\\n{S.SPACE}*\\n')
  THEN list_transform(string_split_regex(text, '\\n{S.SPACE}*\\n'), lambda b: array_to_string(list_filter(list_transform({_lines('b')}, lambda l: {S.strip('l')}), lambda l: l <> ''), ' '))
  ELSE list_transform({_lines('text')}, lambda l: {S.strip('l')}) END, lambda p: p <> '') AS ps
FROM documents WHERE text IS NOT NULL"""


@query("paragraphs", f"SELECT doc_id, CAST(place - 1 AS INTEGER) AS place, ps[place] AS paragraph FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS place FROM ({_PARAGRAPHS}))")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("place", "paragraph"))


@query(
    "paragraph_dedup",
    f"""
WITH p AS (SELECT doc_id, place, ps[place] AS p FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS place FROM ({_PARAGRAPHS}))),
k AS (SELECT *, CASE WHEN length(p) >= 40 THEN substr(sha256({S.normal("p")}), 1, 16) END AS key FROM p),
m AS (SELECT *, key IS NULL OR row_number() OVER (PARTITION BY key ORDER BY doc_id, place) = 1 AS stays FROM k)
SELECT d.doc_id, CAST(coalesce(sum(CASE WHEN stays THEN 1 ELSE 0 END), 0) AS BIGINT) AS kept, CAST(coalesce(sum(CASE WHEN NOT stays THEN 1 ELSE 0 END), 0) AS BIGINT) AS removed
FROM documents d LEFT JOIN m USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id
""",
)
def paragraph_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", T.paragraphs(F.col("text")).alias("paragraphs"))
    return dedup.paragraph_dedup(docs).select("doc_id", F.size("paragraphs").cast("bigint").alias("kept"), "removed")


@query("sentence_split", r"SELECT item_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))) AS sentence FROM eval_items")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", F.explode(T.split_sentences(F.col("text"))).alias("sentence"))


@query("chunks")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", T.paragraphs(F.col("text")).alias("paragraphs"))
    return chunking.chunk_documents(docs, 600, 8)


@query("record_ids", f"SELECT chunk_no, source || '-' || substr(sha256(text), 1, 16) AS record_id, id = source || '-' || substr(sha256(text), 1, 16) AS as_given FROM {CHUNKS}")
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    own = T.record_id(F.col("source"), F.col("text"))
    return chunks_of(spark, d, "source", "text", "id").select("chunk_no", own.alias("record_id"), (F.col("id") == own).alias("as_given"))


@query(
    "shard_provenance",
    r"""
SELECT source, shards[i] AS shard, CASE WHEN coalesce(shard_format, '') <> '' THEN shard_format WHEN regexp_matches(lower(shards[i]), '\.(jsonl|ndjson|json)(\.gz)?$') THEN 'jsonl' ELSE 'text' END AS format,
       sha256[i] AS sha256, sha256[i] IS NOT NULL AS pinned, 'https://host.example/' || shards[i] AS address
FROM (SELECT *, unnest(range(1, len(shards) + 1)) AS i FROM dataset_manifest)
""",
)
def shard_provenance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dataset_manifest").select("source", "shard_format", F.posexplode("shards").alias("i", "shard"), "sha256")
    url = F.concat(F.lit("HTTPS://user:key@Host.example/"), F.col("shard"), F.lit("?token=1#part"))
    digest = F.get("sha256", F.col("i"))
    return rows.select("source", "shard", shards.shard_format_column(F.col("shard"), F.col("shard_format")).alias("format"), digest.alias("sha256"), digest.isNotNull().alias("pinned"), T.redact_url(url).alias("address"))


_PLAIN_CHAT = f"array_to_string({S.plain_words('''array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), ' ')''')}, ' ')"


@query("exact_dedup_examples", f"SELECT key, count(*) AS copies, min(example_id) AS kept_id FROM (SELECT example_id, sha256({_PLAIN_CHAT}) AS key FROM {EXAMPLES}) GROUP BY key")
def exact_dedup_examples(spark: SparkSession, d: str) -> DataFrame:
    text = F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), " ")
    keyed = table(spark, d, "chat_examples").select("example_id", F.sha2(T.plain_text(text), 256).alias("key")).distinct()
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("example_id").alias("kept_id"))


@query("near_dedup_examples")
def near_dedup_examples(spark: SparkSession, d: str) -> DataFrame:
    """Exact Jaccard over word shingles of whole documents."""
    return dedup.dedup_examples(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 0.9)


@query("minhash_signature")
def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    plain = table(spark, d, "documents").select("doc_id", T.normalize_text(F.coalesce("text", F.lit(""))).alias("plain"))
    return plain.select("doc_id", dedup.minhash(F.col("plain")).alias("signature"))


@query("near_dedup_corpus")
def near_dedup_corpus(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_texts(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "near")


@query(
    "exact_dedup_corpus",
    f"""
WITH k AS (SELECT chunk_no, min(chunk_no) OVER (PARTITION BY sha256({S.normal("text")})) AS first FROM {CHUNKS})
SELECT chunk_no AS id, CASE WHEN chunk_no = first THEN 'kept' ELSE 'exact' END AS decision, CASE WHEN chunk_no <> first THEN first ELSE -1 END AS duplicate_of FROM k
""",
)
def exact_dedup_corpus(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_texts(chunks_of(spark, d, "text").withColumnRenamed("chunk_no", "id"), "exact").na.fill(-1, ["duplicate_of"])


_TOP = 200


@query("word_ngrams_top", f"SELECT gram, count(*) AS n FROM (SELECT unnest({S.grams('w', 3)}) AS gram FROM (SELECT {S.words('t')} AS w FROM (SELECT {S.normal('text')} AS t FROM {CHUNKS}))) GROUP BY gram ORDER BY n DESC, gram LIMIT {_TOP}")
def word_ngrams_top(spark: SparkSession, d: str) -> DataFrame:
    plain = chunks_of(spark, d, "text").select(T.normalize_text(F.col("text")).alias("plain"))
    return plain.select(F.explode(T.grams(T.words(F.col("plain")), 3)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(_TOP)


_EVAL_GRAMS = f"SELECT DISTINCT unnest({S.grams('w', 8)}) AS gram FROM (SELECT {S.words('n')} AS w FROM (SELECT {S.normal('text')} AS n FROM eval_items))"


@query("contaminated_docs", f"SELECT DISTINCT id FROM (SELECT doc_id AS id, unnest({S.grams('w', 8)}) AS gram FROM (SELECT doc_id, {S.words('n')} AS w FROM (SELECT doc_id, {S.normal('text')} AS n FROM documents))) JOIN ({_EVAL_GRAMS}) USING (gram)")
def contaminated_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return contamination.contaminated(docs, contamination.eval_ngrams(table(spark, d, "eval_items"), 8), 8)


def _split_texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    prompt, full = contamination.prompt_and_full(F.col("messages"), F.col("target_text"))
    rows = examples_of(spark, d, "messages", "target_text").select(F.col("example_id").alias("id"), "split", prompt.alias("prompt"), full.alias("full"))
    return rows.filter("split = 'train'"), rows.filter("split <> 'train'")


def _turns(where: str) -> str:
    return f"array_to_string(list_transform(list_filter(messages, lambda m: {where}), lambda m: coalesce(m.role, '') || ':' || coalesce(m.content, '')), chr(31))"


_TEXTS = f"""
t AS (SELECT example_id AS id, split, {_turns("m.role IS DISTINCT FROM 'assistant'")} AS prompt,
             {_turns("true")} || CASE WHEN target_text IS NULL THEN '' ELSE chr(31) || 'assistant:' || target_text END AS whole
      FROM {EXAMPLES} JOIN (SELECT source, split FROM dataset_manifest) USING (source)),
k AS (SELECT id, split, sha256(prompt) AS ep, sha256(whole) AS ef, sha256({S.normal("prompt")}) AS np, sha256({S.normal("whole")}) AS nf FROM t),
f AS (SELECT id, {", ".join(f"{c} IN (SELECT {c} FROM k WHERE split = 'train') AS {n}" for c, n in (("ep", "exact_prompt"), ("ef", "exact_full"), ("np", "normalized_prompt"), ("nf", "normalized_full")))} FROM k WHERE split <> 'train')
"""


@query("overlap_flags", f"WITH {_TEXTS} SELECT * FROM f")
def overlap_flags(spark: SparkSession, d: str) -> DataFrame:
    return contamination.check_overlap(*_split_texts(spark, d))


@query(
    "overlap_report",
    f"WITH {_TEXTS} SELECT count(*) AS eval_examples, count(*) FILTER (exact_prompt) AS exact_prompt_overlap, count(*) FILTER (exact_full) AS exact_full_overlap, count(*) FILTER (normalized_prompt) AS normalized_prompt_overlap, count(*) FILTER (normalized_full) AS normalized_full_overlap, bool_or(exact_prompt OR exact_full OR normalized_prompt OR normalized_full) AS contaminated FROM f",
)
def overlap_report(spark: SparkSession, d: str) -> DataFrame:
    return contamination.overlap_summary(contamination.check_overlap(*_split_texts(spark, d)))


@query(
    "cross_split_overlap",
    f"""
WITH {_TEXTS}, s AS (SELECT DISTINCT split, substr(np, 1, 16) AS key FROM k)
SELECT x.split AS a, y.split AS b, count(*) AS n_texts FROM s x JOIN s y ON x.key = y.key AND x.split < y.split GROUP BY ALL
""",
)
def cross_split_overlap(spark: SparkSession, d: str) -> DataFrame:
    prompt, _ = contamination.prompt_and_full(F.col("messages"))
    return contamination.cross_split_overlap(examples_of(spark, d, "messages").select("split", prompt.alias("text")))


@query(
    "prompts_left_out",
    f"WITH {_TEXTS} SELECT id, split FROM k WHERE split <> 'train' AND ep NOT IN (SELECT ep FROM k WHERE split = 'train') AND np NOT IN (SELECT np FROM k WHERE split = 'train')",
)
def prompts_left_out(spark: SparkSession, d: str) -> DataFrame:
    train, held = _split_texts(spark, d)
    return contamination.left_out(held, train, F.col("prompt")).select("id", "split")


@query("bottom_k_sample", "SELECT doc_id, substr(sha256('7:' || doc_id), 1, 16) AS rank_hash FROM documents ORDER BY rank_hash, doc_id LIMIT 200")
def bottom_k_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.bottom_k(table(spark, d, "documents").select("doc_id"), 200, 7, F.col("doc_id"), "doc_id")


_CHUNK_GROUPS = f"SELECT DISTINCT concat_ws('|', source, shard_sha256, doc_index) AS group_key FROM {CHUNKS}"


@query(
    "split_groups",
    f"SELECT group_key, CASE WHEN n < 3 THEN 'train' WHEN rn <= ceil(0.05 * n) THEN 'test' WHEN rn <= 2 * ceil(0.05 * n) THEN 'val' ELSE 'train' END AS split FROM (SELECT group_key, row_number() OVER (ORDER BY sha256('3:' || group_key), group_key) AS rn, count(*) OVER () AS n FROM ({_CHUNK_GROUPS}))",
)
def split_groups(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split_groups(chunks_of(spark, d, *_GROUP).select(F.concat_ws("|", *_GROUP).alias("group_key")), 0.05, 0.05, 3)


@query("split_records", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY substr(sha256('5:' || doc_id), 1, 12), doc_id) <= greatest(1, round_even(0.1 * count(*) OVER (), 0)) THEN 'val' ELSE 'train' END AS split FROM documents")
def split_records(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split_records(table(spark, d, "documents"), 0.1, 5, "doc_id")


@query(
    "stratified_split",
    """
WITH l AS (SELECT doc_id, coalesce(min(quality), 0) AS stratum FROM doc_labels GROUP BY doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('1:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM l)
SELECT doc_id, stratum, CASE WHEN rn <= round_even(n * 0.8, 0) THEN 'train' WHEN rn <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split FROM r
""",
)
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "doc_labels").groupBy("doc_id").agg(F.coalesce(F.min("quality"), F.lit(0)).alias("quality"))
    return sampling.stratified_split(labels, F.col("quality"), seed=1, id_col="doc_id")


@query("limit_per_category", "SELECT category, example_id FROM (SELECT coalesce(category, '') AS category, example_id, row_number() OVER (PARTITION BY coalesce(category, '') ORDER BY example_id) AS rn FROM (SELECT DISTINCT example_id, category FROM chat_examples)) WHERE rn <= 20")
def limit_per_category(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_examples").select(F.coalesce("category", F.lit("")).alias("category"), "example_id").distinct()
    return sampling.limit_per(rows, 20, F.col("category"), "example_id").select("category", "example_id")


@query("heldout_buckets", f"SELECT source, count(*) FILTER (h) AS heldout, count(*) AS n FROM (SELECT source, CAST(('0x' || substr(sha256('corpus:' || chunk_no), 1, 8)) AS BIGINT) % 5 = 0 AS h FROM {CHUNKS}) GROUP BY source")
def heldout_buckets(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d, "source").groupBy("source").agg(F.count_if(T.heldout("corpus", F.col("chunk_no"))).alias("heldout"), F.count(F.lit(1)).alias("n"))


@query(
    "source_stats",
    f"SELECT source, count(*) AS chunks, count(DISTINCT concat_ws('|', shard_sha256, doc_index)) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(CASE WHEN length(text) < coalesce(min_chars, 32) THEN 1 ELSE 0 END) AS BIGINT) AS short FROM {CHUNKS} JOIN (SELECT source, min_chars FROM dataset_manifest) USING (source) GROUP BY source",
)
def source_stats(spark: SparkSession, d: str) -> DataFrame:
    manifest = table(spark, d, "dataset_manifest").select("source", F.coalesce("min_chars", F.lit(32)).alias("min_chars"))
    rows = chunks_of(spark, d, "source", "text", "shard_sha256", "doc_index").join(manifest, "source")
    # Two levels: a source's documents are counted apart, so no task holds a source's set of documents.
    per = rows.groupBy("source", "shard_sha256", "doc_index").agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("text")).alias("l"), F.sum(F.octet_length("text")).alias("b"), F.count_if(F.length("text") < F.col("min_chars")).alias("s"))
    return per.groupBy("source").agg(F.sum("c").alias("chunks"), F.count(F.lit(1)).alias("documents"), F.sum("l").cast("bigint").alias("chars"), F.sum("b").cast("bigint").alias("bytes"), F.sum("s").cast("bigint").alias("short"))


@query("natural_fraction", f"SELECT round_even(coalesce(sum(CASE WHEN NOT coalesce(supplemental, false) THEN strlen(text) ELSE 0 END) / sum(strlen(text)), 0.0), 6) AS natural_fraction FROM {CHUNKS} JOIN (SELECT source, supplemental FROM dataset_manifest) USING (source)")
def natural_fraction(spark: SparkSession, d: str) -> DataFrame:
    stats = chunks_of(spark, d, "source", "text").groupBy("source").agg(F.sum(F.octet_length("text")).alias("tokens"))
    return mixture.natural_fraction(stats.join(table(spark, d, "dataset_manifest").select("source", "supplemental"), "source"))


@query("token_counts_byte", "SELECT doc_id, CAST(coalesce(strlen(text), 0) + 2 AS BIGINT) AS n_tokens FROM documents")
def token_counts_byte(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 2).cast("bigint").alias("n_tokens"))


def sourced_documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents beside what the manifest says of their source, and the quotas. Sources without an entry have nulls."""
    manifest = table(spark, d, "dataset_manifest")
    default = lambda c, n: F.coalesce(c, F.lit(n)).alias(c)
    is_text = shards.shard_format_column(F.get("shards", F.lit(0)), F.col("shard_format")) == "text"
    sources = manifest.select("source", is_text.alias("is_text"), default("chunk_chars", 1000), default("min_chars", 32), default("group_chunks", 8))
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), T.paragraphs(F.col("text")).alias("paragraphs"))
    return docs.join(F.broadcast(sources), "source", "left"), manifest.select("source", "max_records")


@query("prepared_corpus")
def prepared_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline over documents, near duplicates included, per source."""
    docs, quotas = sourced_documents(spark, d)
    return pipeline.PreparedCorpus(docs, table(spark, d, "eval_items"), pipeline.Settings(chunk_chars=600, dedup="near"), quotas).source_counts()


@query("prepared_splits")
def prepared_splits(spark: SparkSession, d: str) -> DataFrame:
    docs, quotas = sourced_documents(spark, d)
    return pipeline.split_counts(pipeline.PreparedCorpus(docs, table(spark, d, "eval_items"), pipeline.Settings(chunk_chars=600, dedup="exact", validation=0.05, test=0.05), quotas).records())
