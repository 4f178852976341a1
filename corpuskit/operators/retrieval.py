"""Ranking texts by BM25 and vectors by cosine."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from corpuskit.functions import text as T, types as Y
from corpuskit.session import Workspace, spread


def term_stats(docs: DataFrame, asked: DataFrame) -> tuple[DataFrame, float, float]:
    """tf (doc, term, tf, len) of the terms ``asked`` (term), the number of ``docs`` (doc, text) and their mean length.

    Other terms are dropped where documents are read, before anything is shuffled; Spark broadcasts the asked ones while
    they are few. Lengths count after stop words, over all documents; a mean of 0 counts as 1.
    """
    terms = spread(docs.select("doc", "text")).select("doc", T.ranking_terms(F.coalesce("text", F.lit(""))).alias("t"))
    each = terms.select("doc", F.size("t").alias("len"), F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = Workspace(docs.sparkSession, "ranking").write(each.groupBy("doc", "term", "len").agg(F.count(F.lit(1)).alias("tf")), "tf")
    n, mean = terms.agg(F.count(F.lit(1)), F.avg(F.size("t"))).first()
    return tf, float(n), float(mean or 1.0)


def bm25_scores(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query, doc, score for every pair with a common term; repeated query terms count repeatedly.

    ``queries`` (query, text) is a stated query set: each of its terms meets the documents that have it. Pairs without a
    common term score exactly 0 and are not listed.
    """
    asked = queries.select("query", F.explode(T.ranking_terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
    # Two numbers of the whole corpus enter as constants, so that no join without a key is needed.
    tf, n, avg_len = term_stats(docs, asked)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = asked.join(df, "term").withColumn("w", F.col("times") * F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(avg_len)))
    return weighted.join(tf, "term").groupBy("query", "doc").agg(F.sum(part).alias("score"))


def bm25_top(queries: DataFrame, docs: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75, digits: int = 9) -> DataFrame:
    """query, doc, score, rank: the best ``k`` documents of each query that share a term; ties by document."""
    scores = bm25_scores(queries, docs, k1, b).withColumn("score", F.round("score", digits))
    rn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return scores.withColumn("rank", rn).filter(F.col("rank") <= k)


def bm25_rank_all(query: str, docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """doc, score for every document, those without a common term at 0."""
    spark = docs.sparkSession
    asked = spark.createDataFrame([(0, query)], "query int, text string")
    return docs.select("doc").join(bm25_scores(asked, docs, k1, b).select("doc", "score"), "doc", "left").select("doc", F.coalesce("score", F.lit(0.0)).alias("score"))


def retrieve(query: str, entries: DataFrame, k: int = 5, scope: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    """The best ``k`` entries (entry_id, content, scope, confidence) of a scope; filters come before the statistics."""
    kept = entries.filter(F.col("confidence") >= min_confidence)
    kept = kept.filter(F.col("scope") == scope) if scope is not None else kept
    ranked = bm25_rank_all(query, kept.select(F.col("entry_id").alias("doc"), F.col("content").alias("text")))
    return ranked.orderBy(F.desc("score"), "doc").limit(k).select(F.col("doc").alias("entry_id"), "score")


def tool_text(tools: DataFrame) -> DataFrame:
    """doc, text of tools (name, description, parameters: array of name, description) as rankers read them."""
    parts = F.transform("parameters", lambda p: F.concat_ws(" ", p["name"], p["description"]))
    return tools.select(F.col("name").alias("doc"), F.concat_ws(" ", "name", "description", F.array_join(parts, " ")).alias("text"))


def hash_embed(dim: int = 64):
    """An Arrow function: white-space tokens hashed into ``dim`` signed buckets, then scaled to length 1."""

    @F.pandas_udf(Y.FLOATS)
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}
        out = []
        for t in texts:
            v = np.zeros(dim)
            for token in (t or "").lower().split():
                if token not in known:
                    h = blake2b(token.encode(), digest_size=8).digest()
                    known[token] = (int.from_bytes(h[:4], "little") % dim, 1.0 if h[4] & 1 else -1.0)
                v[known[token][0]] += known[token][1]
            size = float(np.sqrt(v @ v))
            out.append((v / size if size else v).tolist())
        return pd.Series(out, dtype=object)

    return embed


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """query, vec_id, similarity, rank: the ``k`` vectors nearest to each query vector (never itself).

    Exact: the query set (query, q: array of numbers) meets all vectors (vec_id, v) in blocks. Each block of queries is
    compared to each partition of vectors by one matrix product, and a partition passes on only its best ``k``.
    """
    spark = vectors.sparkSession
    out = None
    for block in _query_blocks(queries):
        names = [q for q, _ in block]
        sent = spark.sparkContext.broadcast((names, np.array([v for _, v in block], np.float64)))

        def near(batches, sent=sent):
            import pyarrow as pa

            names, q = sent.value
            norms = np.sqrt((q * q).sum(axis=1))
            q = q / np.where(norms == 0, 1, norms)[:, None]
            best_s, best_i = np.full((len(names), 0), 0.0), np.full((len(names), 0), 0, np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, lists = batch["vec_id"].to_numpy(), batch["v"]
                v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                n = np.sqrt((v * v).sum(axis=1))
                s = np.round(q @ (v / np.where(n == 0, 1, n)[:, None]).T, digits)
                s[np.array(names)[:, None] == ids[None, :]] = -2
                s, i = np.concatenate([best_s, s], axis=1), np.concatenate([best_i, np.broadcast_to(ids, (len(names), len(ids)))], axis=1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)
            for a in range(0, len(names) if best_s.shape[1] else 0, 1000):
                part = slice(a, a + 1000)
                keep = best_s[part].ravel() > -2
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names[part], np.int64), best_s.shape[1])[keep]), pa.array(best_i[part].ravel()[keep]), pa.array(best_s[part].ravel()[keep])], names=["query", "vec_id", "similarity"])

        found = vectors.select("vec_id", "v").mapInArrow(near, "query bigint, vec_id bigint, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query bigint, vec_id bigint, similarity double, rank int")
    rn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "vec_id"))
    return out.withColumn("rank", rn).filter(F.col("rank") <= k)


def _query_blocks(queries: DataFrame, size: int = 2_000):
    block = []
    for row in queries.select("query", "q").orderBy("query").toLocalIterator():
        block.append((row.query, row.q))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block

