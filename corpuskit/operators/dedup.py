"""Exact, paragraph and near-duplicate removal. The earliest item wins; order is a column, never a partition's.

Near-duplicate removal is greedy in order: an item goes iff some kept earlier item is similar. It is done in rounds.
Candidates share a bucket (an LSH band, or a shingle of the prefix filter). In each round the first items of every bucket
are compared with their later mates; those that lead all their buckets are decided, and what is similar to a kept one goes.
The first round has one leader a bucket, so the pairs of a bucket of copies grow with its size, not with its square; later
rounds have sixteen times as many for what is left. No threshold drops a case.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F
from pyspark.sql.types import ArrayType, LongType

from corpuskit import session
from corpuskit.functions import text as T
from corpuskit.session import Workspace, spread

PRIME = 4_294_967_291  #: the largest prime below 2 ** 32


def first_wins(df: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """The first row of each key. Null keys are equal to each other."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_ids(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """key, id: the least id per key, by an aggregate that combines copies before the shuffle."""
    return df.groupBy(key.alias("key")).agg(F.min(id_col).alias(id_col))


def first_deliveries(df: DataFrame, key: str, *order: str, small_whole: bool = True) -> DataFrame:
    """One row for each ``key`` (a null key is one key too): the first in ``order``, nulls last, then the least content.

    Keys alone are shuffled to find those that repeat; rows of other keys stay where they are read. Repeated keys are
    written to the shared folder, so that Spark knows their size and broadcasts them only while they are small; the rows
    of these keys are the only ones that are shuffled whole. Tables below session.SMALL_BYTES (by Spark's estimate) are shuffled
    whole at once (unless ``small_whole`` is off), which spares them a job and spreads a file of one row group over all
    cores; the rows are the same.
    """
    # Maps and variants have no order; they don't occur among the columns that deliveries are told apart by.
    rest = [F.xxhash64(c) if "map<" in t or t == "variant" else F.col(c) for c, t in df.dtypes if c not in (key, *order)]
    w = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in order], *rest)
    first = lambda rows: rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    if small_whole and session.is_small(df):
        return first(df)
    space = Workspace(df.sparkSession, "deliveries")
    again = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key")
    again = space.write(again, "repeated")
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(again, same, "left_anti").unionByName(first(df.join(again, same, "left_semi")))


def paragraph_dedup(docs: DataFrame, min_chars: int = 40, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, paragraphs, removed: each document (id and paragraphs) without long paragraphs seen before.

    A paragraph of at least ``min_chars`` characters stays where it stands first in the order of (id, place); shorter
    ones always stay. Documents that lose all paragraphs keep an empty list.
    """
    docs = spread(docs)
    rows = docs.select(id_col, F.posexplode("paragraphs").alias("place", "paragraph"))
    rows = rows.withColumn("key", F.when(F.length("paragraph") >= min_chars, T.content_key(F.col("paragraph"))))
    # The first place per paragraph is an aggregate of two numbers; texts are not shuffled by key.
    firsts = rows.filter("key is not null").groupBy("key").agg(F.min(F.struct(id_col, "place")).alias("_first")).select("key", F.col(f"_first.{id_col}").alias("_id"), F.col("_first.place").alias("_place"))
    stays = firsts.select(F.col("_id").alias(id_col), F.col("_place").alias("place"), F.lit(True).alias("_stays"))
    kept = rows.join(stays, [id_col, "place"], "left").withColumn("_keep", F.col("key").isNull() | F.col("_stays"))
    lists = kept.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.when(F.col("_keep"), F.struct("place", "paragraph")))).alias("_p"),
        F.count_if(F.col("_keep").isNull()).alias("removed"),
    )
    out = docs.select(id_col).join(lists, id_col, "left")
    return out.select(id_col, F.coalesce(F.transform("_p", lambda p: p["paragraph"]), F.array().cast("array<string>")).alias("paragraphs"), F.coalesce("removed", F.lit(0)).cast("bigint").alias("removed"))


def coefficients(seed: int, num_perm: int) -> tuple[list[int], list[int]]:
    """The multipliers and shifts of the permutations."""
    rng = np.random.default_rng(np.random.SeedSequence([seed, 0x5EED]))
    a, b = (rng.integers(least, 2**31, size=num_perm, dtype=np.uint64) for least in (1, 0))
    return a.tolist(), b.tolist()


def minhash(text: Column, num_perm: int = 64, shingle: int = 5, seed: int = 0) -> Column:
    """The MinHash signature of a normalised text's word shingles.

    An Arrow function: 64 permutations of a few hundred hashes are one matrix in NumPy, while a lambda per permutation
    costs the JVM some fifty times as much.
    """
    a, b = (np.array(x, np.uint64)[:, None] for x in coefficients(seed, num_perm))

    @F.pandas_udf(ArrayType(LongType()))
    def sign(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            w = (t or "").split()
            grams = {" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))}
            h = np.fromiter((crc32(g.encode()) for g in grams), np.uint64, len(grams))
            out.append(((a * h + b) % np.uint64(PRIME)).min(axis=1).astype(np.int64))
        return pd.Series(out, dtype=object)

    return sign(text)


def bands(signature: Column, n_bands: int = 16, num_perm: int = 64) -> Column:
    """One bucket key per band: a hash of the band's rows (a collision adds a candidate, never loses one)."""
    per = num_perm // n_bands
    return F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.xxhash64(i, F.slice(signature, i * per + 1, per)))


def _counted(df: DataFrame, space: Workspace, step: str) -> tuple[DataFrame, int]:
    seen = Observation()
    out = space.write(df.observe(seen, F.count(F.lit(1)).alias("n")), step)
    return out, seen.get["n"]


def _resolve(ready: DataFrame, edges: DataFrame, space: Workspace, name: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Kept and removed items (id; id, removed_for) among ``ready`` and the items similar to them.

    ``edges``: leader, id, similar, the leader first. A ready item without an edge from an undecided one is kept; what is
    similar to it goes, and with what goes its edges; and so on until nothing moves.
    """
    kept_all, gone_all, step = None, None, 0
    add = lambda whole, part: part if whole is None else whole.unionByName(part)
    while True:
        kept, n = _counted(ready.join(edges.select("id").distinct(), "id", "left_anti"), space, f"{name}-kept-{step}")
        if not n:
            return kept_all, gone_all
        hits = edges.join(kept.withColumnRenamed("id", "leader"), "leader", "left_semi").groupBy("id").agg(F.min("leader").alias("removed_for"))
        hits, m = _counted(hits, space, f"{name}-gone-{step}")
        kept_all, gone_all = add(kept_all, kept), add(gone_all, hits)
        if not m:
            return kept_all, gone_all
        out = hits.select("id")
        edges = space.write(edges.join(out, "id", "left_anti").join(out.withColumnRenamed("id", "leader"), "leader", "left_anti"), f"{name}-edges-{step}")
        ready = space.write(ready.join(kept, "id", "left_anti").join(out, "id", "left_anti"), f"{name}-ready-{step}")
        step += 1


def ordered_greedy(items: DataFrame, buckets: DataFrame, similar: Callable[[DataFrame], DataFrame], space: Workspace, most_leaders: int = 1024) -> DataFrame:
    """id, removed_for: a kept, earlier, similar item for each removed one.

    ``items``: id, payload columns. ``buckets``: id, bucket. ``similar`` gets pairs (leader, id, with the payloads of the
    leader under l_ and of the item under i_) and keeps the similar ones. A bucket has one leader in the first round, which
    takes most copies away, and sixteen times as many in each further one, up to ``most_leaders``, so that few rounds are
    needed unless a bucket holds more unlike items than that.
    """
    payload = [c for c in items.columns if c != "id"]
    items = space.write(items, "items")
    left = space.write(buckets.select("bucket", "id").distinct(), "open-0")
    gone, turn = None, 0
    while True:
        # Buckets with a single open item can't pair it; an item whose buckets are all such needs no further look.
        several = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
        shared = space.write(left.join(several, "bucket", "left_semi"), f"shared-{turn}")
        place = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
        heads = shared.withColumn("_rn", place).filter(F.col("_rn") <= min(16**turn, most_leaders)).select("bucket", "id")
        # An item that leads all its buckets meets all its earlier mates in this round: it can be decided.
        count = F.count(F.lit(1)).alias("c")
        ready = space.write(heads.groupBy("id").agg(count).join(shared.groupBy("id").agg(count), ["id", "c"]).select("id"), f"ready-{turn}")
        pairs = shared.join(heads.withColumnRenamed("id", "leader"), "bucket").filter("id > leader").select("leader", "id").distinct()
        for name, col in (("l_", "leader"), ("i_", "id")):
            pairs = pairs.join(items.select(F.col("id").alias(col), *[F.col(c).alias(name + c) for c in payload]), col)
        edges = space.write(similar(pairs).select("leader", "id"), f"edges-{turn}")
        kept, hits = _resolve(ready, edges, space, f"round-{turn}")
        rest = shared
        if kept is not None:
            rest = shared.join(kept.unionByName(hits.select("id")), "id", "left_anti")
            gone = hits if gone is None else gone.unionByName(hits)
        left, n = _counted(rest, space, f"open-{turn + 1}")
        for step in ("open", "shared"):
            space.drop(f"{step}-{turn}")
        turn += 1
        if not n:
            break
    return items.select("id", F.col("id").alias("removed_for")).limit(0) if gone is None else gone


def dedup_texts(texts: DataFrame, mode: str = "near", threshold: float = 0.8, num_perm: int = 64, n_bands: int = 16, shingle: int = 5, seed: int = 0) -> DataFrame:
    """id, decision (kept, exact or near), duplicate_of: one row per text of ``texts`` (id: unique and ordered; text).

    ``exact``: equal normalised texts. ``near``: also texts whose signatures agree with a kept earlier one's in at least
    ``threshold`` of their places and in one whole band. An exact copy of a text that went as near counts as near too.
    ``none`` keeps all. Copies of a text are decided once; null texts are normalised as empty ones.
    """
    if mode not in ("near", "exact", "none") or num_perm % n_bands:
        raise ValueError("mode must be near, exact or none, and the bands must divide the permutations")
    rows = spread(texts.select("id", "text"))
    if mode == "none":
        return rows.select("id", F.lit("kept").alias("decision"), F.lit(None).cast(rows.schema["id"].dataType).alias("duplicate_of"))
    space = Workspace(texts.sparkSession, "dedup")
    plain = T.normalize_text(F.coalesce("text", F.lit("")))
    keyed = space.write(rows.select("id", plain.alias("plain")).withColumn("key", F.sha2("plain", 256)), "plain")
    firsts = first_ids(keyed, F.col("key"), "id").withColumnRenamed("id", "first")
    members = keyed.select("id", "key").join(firsts, "key").select("id", "first")
    if mode == "exact":
        return members.select("id", F.when(F.col("id") == F.col("first"), "kept").otherwise("exact").alias("decision"), F.when(F.col("id") != F.col("first"), F.col("first")).alias("duplicate_of"))
    members = space.write(members, "members")
    heads = keyed.join(members.filter("id = first").select("id"), "id", "left_semi")
    signed = space.write(heads.select("id", minhash(F.col("plain"), num_perm, shingle, seed).alias("sig")), "signed")
    equal = lambda p: p.withColumn("_n", F.aggregate(F.zip_with("l_sig", "i_sig", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)).filter(F.col("_n") >= threshold * num_perm - 1e-9)
    gone = ordered_greedy(signed, signed.select("id", F.explode(bands(F.col("sig"), n_bands, num_perm)).alias("bucket")), equal, space)
    out = members.join(gone.withColumnRenamed("id", "first"), "first", "left")
    return out.select("id", F.when(F.col("removed_for").isNotNull(), "near").when(F.col("id") != F.col("first"), "exact").otherwise("kept").alias("decision"), F.when(F.col("removed_for").isNotNull(), F.col("removed_for")).when(F.col("id") != F.col("first"), F.col("first")).alias("duplicate_of"))


def dedup_examples(texts: DataFrame, threshold: float = 0.9, size: int = 3) -> DataFrame:
    """id, decision, duplicate_of: as above, but by the exact Jaccard similarity of word shingles.

    Candidates share a shingle of their prefix: with the shingles of each text ordered from the rarest, two sets of
    similarity t share one among the first n - ceil(t n) + 1 of both. Texts without words equal each other.
    """
    space = Workspace(texts.sparkSession, "dedup")
    keyed = space.write(spread(texts.select("id", "text")).select("id", T.plain_text(F.coalesce("text", F.lit(""))).alias("plain")).withColumn("key", F.sha2("plain", 256)), "plain")
    firsts = first_ids(keyed, F.col("key"), "id").withColumnRenamed("id", "first")
    members = space.write(keyed.select("id", "key").join(firsts, "key").select("id", "first"), "members")
    heads = keyed.join(members.filter("id = first").select("id"), "id", "left_semi").select("id", T.shingles(F.col("plain"), size).alias("set"))
    hashed = space.write(heads.select("id", F.transform("set", lambda s: F.xxhash64(s)).alias("set")), "sets")
    grams = hashed.select("id", F.size("set").alias("n"), F.explode("set").alias("g"))
    rarity = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rank = Window.partitionBy("id").orderBy("df", "g")
    prefix = grams.join(rarity, "g").withColumn("rn", F.row_number().over(rank)).filter(F.col("rn") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    close = lambda p: p.filter(T.jaccard(F.col("l_set"), F.col("i_set")) >= threshold)
    gone = ordered_greedy(hashed, prefix.select("id", F.col("g").alias("bucket")), close, space)
    out = members.join(gone.withColumnRenamed("id", "first"), "first", "left")
    return out.select("id", F.when(F.col("removed_for").isNotNull(), "near").when(F.col("id") != F.col("first"), "exact").otherwise("kept").alias("decision"), F.when(F.col("removed_for").isNotNull(), F.col("removed_for")).when(F.col("id") != F.col("first"), F.col("first")).alias("duplicate_of"))


def dedup_report(decisions: DataFrame) -> DataFrame:
    """How many were kept and removed as exact and near copies."""
    return decisions.agg(F.count_if(F.col("decision") == "kept").alias("kept"), F.count_if(F.col("decision") == "exact").alias("exact_removed"), F.count_if(F.col("decision") == "near").alias("near_removed"))
