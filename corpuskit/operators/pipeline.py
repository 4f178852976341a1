"""The corpus pipeline: documents, paragraph dedup, chunks, dedup, decontamination, group split, counts.

Order of the steps (it decides the counters): paragraphs seen before go first, chunks are numbered and counted, short
chunks go before they enter any index, then duplicates, then chunks with an n-gram of an evaluation text; groups are
split last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from corpuskit.functions import text as T
from corpuskit.operators import chunking, contamination, dedup, sampling
from corpuskit.session import Workspace


STRETCH = 100_000  #: documents, or chunks of one document, that one task numbers for a quota


@dataclass(frozen=True)
class Settings:
    chunk_chars: int = 1000
    min_chars: int = 32
    group_chunks: int = 8
    dedup: str = "exact"
    threshold: float = 0.8
    ngram: int = 8
    validation: float = 0.02
    test: float = 0.02
    seed: int = 0


class PreparedCorpus:
    """The pipeline over ``docs``: doc_id (unique, ordered), source, paragraphs; shard, and is_text where shards are prose.

    Sources may differ: where ``docs`` has chunk_chars, min_chars or group_chunks, these hold for the document, and the
    settings only where they are null.
    ``chunks`` has every chunk with its fate: short, exact, near, contaminated, kept or beyond_quota. Quotas
    (``max_records``: source, max_records and, where ``docs`` has shards, n_shards) keep the first chunks of each shard, up
    to its even part of the quota rounded up, and of these the first of the source; chunks beyond the quota still suppress
    later near-duplicates. Characters of words longer than a chunk are lost and counted.
    """

    def __init__(self, docs: DataFrame, eval_texts: DataFrame | None = None, settings: Settings = Settings(), max_records: DataFrame | None = None):
        s, self.settings = settings, settings
        self.space = space = Workspace(docs.sparkSession, "corpus")
        own = lambda c, default: (F.coalesce(c, F.lit(default)) if c in docs.columns else F.lit(default)).alias(c)
        docs = docs.select("doc_id", "source", "paragraphs", own("is_text", False), own("chunk_chars", s.chunk_chars), own("min_chars", s.min_chars), own("group_chunks", s.group_chunks), (F.col("shard") if "shard" in docs.columns else F.lit("")).alias("shard"))
        plain = docs if s.dedup == "none" else dedup.paragraph_dedup(docs.select("doc_id", "paragraphs")).drop("removed").join(docs.drop("paragraphs"), "doc_id")
        self.documents = docs
        plain = plain.withColumn("lost", chunking.lost_characters(F.col("paragraphs"), F.col("chunk_chars")))
        chunks = chunking.chunk_documents(plain, F.col("chunk_chars"), F.col("group_chunks"), F.col("is_text"), ("doc_id", "source", "shard", "is_text", "min_chars", "group_chunks", "lost"))
        chunks = chunks.withColumn("lost", F.when(F.col("chunk_index") == 0, F.col("lost")).otherwise(0))
        # The order of chunks as one number, wide enough for any two of doc_id (bigint) and chunk_index (int).
        chunks = chunks.withColumn("ord", (F.col("doc_id").cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("chunk_index")).cast("decimal(30,0)"))
        chunks = space.write(chunks.withColumn("short", F.length("text") < F.col("min_chars")).drop("min_chars", "group_chunks"), "chunks")
        long = chunks.filter("not short").select(F.col("ord").alias("id"), "text")
        fate = dedup.dedup_texts(long, s.dedup, s.threshold, seed=s.seed).select(F.col("id").alias("ord"), "decision")
        fate = space.write(fate, "fate")
        if eval_texts is not None:
            kept = long.join(fate.filter("decision = 'kept'").select(F.col("ord").alias("id")), "id", "left_semi")
            dirty = contamination.contaminated(kept, contamination.eval_ngrams(eval_texts, s.ngram), s.ngram).select(F.col("id").alias("ord"), F.lit(True).alias("dirty"))
        else:
            dirty = fate.select("ord", F.lit(True).alias("dirty")).limit(0)
        decided = chunks.join(fate, "ord", "left").join(dirty, "ord", "left")
        verdict = F.when(F.col("short"), "short").when(F.col("decision") != "kept", F.col("decision")).when(F.col("dirty"), "contaminated").otherwise("kept")
        decided = decided.withColumn("fate", verdict).drop("short", "decision", "dirty")
        decided = space.write(decided, "fates")
        if max_records is not None:
            decided = self._within_quota(decided, max_records)
        self.chunks = space.write(decided, "decided")

    def _within_quota(self, decided: DataFrame, quotas: DataFrame) -> DataFrame:
        """The chunks with kept ones beyond their shard's or their source's quota marked as such."""
        shards = F.greatest(F.col("n_shards"), F.lit(1)) if "n_shards" in quotas.columns else F.lit(1)
        quotas = quotas.filter("max_records > 0").select("source", F.col("max_records").alias("_most"), F.ceil(F.col("max_records") / shards).alias("_per"))
        stretch = [F.floor(F.col("doc_id") / STRETCH), F.when(F.col("is_text"), F.floor(F.col("chunk_index") / STRETCH)).otherwise(0)]
        open_ = decided.filter("fate = 'kept'").select("ord", "source", "shard", "doc_id", "chunk_index", "is_text").join(quotas, "source")
        shard = sampling.places(open_, ["source", "shard"], stretch, ["ord"]).filter(F.col("_place") <= F.col("_per")).drop("_place")
        within = sampling.places(shard, ["source"], stretch, ["ord"]).filter(F.col("_place") <= F.col("_most"))
        marked = decided.join(within.select("ord", F.lit(True).alias("_in")), "ord", "left").join(quotas.select("source", "_most"), "source", "left")
        beyond = (F.col("fate") == "kept") & F.col("_most").isNotNull() & F.col("_in").isNull()
        return marked.withColumn("fate", F.when(beyond, "beyond_quota").otherwise(F.col("fate"))).drop("_in", "_most")

    def records(self) -> DataFrame:
        """id, text, category, source, split: the kept chunks, a repeated id once (the first)."""
        s = self.settings
        group = F.concat_ws("\x1f", "source", F.col("doc_id").cast("string"), F.col("group_index").cast("string"))
        kept = self.chunks.filter("fate = 'kept'").withColumn("group_key", group)
        splits = sampling.split_groups(kept, s.validation, s.test, s.seed)
        rows = kept.join(splits, "group_key").withColumn("id", T.record_id(F.col("source"), F.col("text")))
        rows = dedup.first_wins(rows, F.col("id"), "ord")
        return rows.select("id", "text", F.lit("corpus").alias("category"), "source", "split")

    def source_counts(self) -> DataFrame:
        """Per source: documents, chunks and their fates, which add up to the chunks."""
        docs = self.documents.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
        of = lambda f: F.count_if(F.col("fate") == f)
        per = self.chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), of("short").alias("short_dropped"), of("exact").alias("exact_removed"), of("near").alias("near_removed"), of("contaminated").alias("contaminated"), of("beyond_quota").alias("beyond_quota"), of("kept").alias("chunks_kept"), F.sum("lost").cast("bigint").alias("characters_lost"))
        return docs.join(per, "source", "left").na.fill(0)


def plain_chunks(docs: DataFrame, max_records: int = 0, n_shards: int = 1) -> DataFrame:
    """id, text, category, source of the chunks of one source's documents (with chunk_chars, min_chars), none removed but
    short ones and those beyond the quota, which is spread evenly over the shards."""
    chunks = chunking.chunk_documents(docs, F.col("chunk_chars"), F.col("group_chunks"), F.col("is_text"), ("doc_id", "source", "shard", "is_text", "min_chars", "group_chunks"))
    chunks = chunks.filter(F.length("text") >= F.col("min_chars"))
    if max_records:
        stretch = [F.floor(F.col("doc_id") / STRETCH), F.when(F.col("is_text"), F.floor(F.col("chunk_index") / STRETCH)).otherwise(0)]
        chunks = sampling.places(chunks, ["shard"], stretch, ["doc_id", "chunk_index"]).filter(F.col("_place") <= -(-max_records // n_shards)).drop("_place")
        chunks = sampling.places(chunks, ["source"], stretch, ["doc_id", "chunk_index"]).filter(F.col("_place") <= max_records)
    return chunks.select(T.record_id(F.col("source"), F.col("text")).alias("id"), "text", F.lit("corpus").alias("category"), "source")


def split_counts(records: DataFrame, supplemental: list[str] | None = None) -> DataFrame:
    """Per split: records, characters, bytes (byte tokens but for the two marks); with ``supplemental`` sources named, also
    the records and bytes of the natural others."""
    natural = ~F.col("source").isin(*supplemental) if supplemental else F.lit(True)
    more = [] if supplemental is None else [F.count_if(natural).alias("natural_records"), F.coalesce(F.sum(F.when(natural, F.octet_length("text"))), F.lit(0)).cast("bigint").alias("natural_bytes")]
    return records.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("text")).cast("bigint").alias("chars"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), *more)
