"""Splits that keep related records together (problem 3).

Rows are related by a shared chunk group, author or entity. Random-mate contraction finds the families: in each round
every vertex tosses a coin, tails collapse into a neighbouring head, and the edges are relabelled by SQL joins until
none is left; the recorded collapses are then unwound into labels. Families are dealt to splits by cumulative weight.

All joins are on 64-bit ids or 128-bit key hashes. A hot author, group or family is pre-aggregated before each shuffle
(min, count), and what joins back to it is one row per key, so adaptive execution can split the hot side. Each round's
tables are written to the shared folder, so lost executors cost no more than the running round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from corpuskit.llm._common import hash128, with_manifest
from corpuskit.session import Workspace

# Author entries that name nobody, as sorted name parts in lower case.
NOBODY = ["", "anon", "anonymous", "author no", "none", "a n", "unknown", "unbekannt", "null", "nobody", "author unknown", "n a", "na", "nil", "tbd", "not available", "staff", "editor", "admin"]
MOST_SPLITS = 100  #: more splits than this are an error: each is a branch of one expression
BIN_ROWS = 200_000  #: rows that a hash range of families holds on average at most
_JSONL = r"(?i)\.(jsonl|ndjson|json)(\.gz)?$"


def author_parts(author: Column) -> Column:
    """The sorted name parts of an author entry, joined by a space; null where it names nobody."""
    parts = F.array_sort(F.regexp_extract_all(F.lower(author), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)))
    name = F.array_join(parts, " ")
    return F.when(author.isNotNull() & ~name.isin([" ".join(sorted(x.split())) for x in NOBODY]), name)


def entity_keys(entities: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(entities, lambda e: F.regexp_replace(F.lower(e), r"(?U)^\s+|\s+$", "")), lambda e: e.isNotNull() & (e != "")))


def _keyed(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """chunk_no, the hash of its group (null without a complete group key) and the hashes of its author and entities."""
    rows = chunks.select("chunk_no", "source", "shard_sha256", "doc_index", "chunk_index", "author", "entity_ids").filter(F.col("chunk_no").isNotNull())
    is_jsonl = F.when(F.coalesce(F.trim("shard_format"), F.lit("")) != "", F.lower(F.trim("shard_format")) == "jsonl").otherwise(F.get("shards", F.lit(0)).rlike(_JSONL))
    rows = with_manifest(rows, manifest.select("source", "group_chunks", is_jsonl.alias("_jsonl")), "group_chunks", "_jsonl")
    group = F.when(F.coalesce("_jsonl", F.lit(False)), F.lit(0)).otherwise(F.floor(F.col("chunk_index") / F.greatest("group_chunks", F.lit(1)))).cast("bigint")
    rows = rows.withColumn("_group", group)
    whole = F.col("source").isNotNull() & F.col("shard_sha256").isNotNull() & F.col("doc_index").isNotNull() & F.col("_group").isNotNull()
    g1, g2 = hash128("source", "shard_sha256", "doc_index", "_group")
    # A row without a whole group key is a group of its own.
    alone = hash128(F.lit("row"), "chunk_no")
    name = author_parts(F.col("author"))
    keys = F.concat(
        F.when(name.isNull(), F.array()).otherwise(F.array(F.struct(*[h.alias(f"k{i}") for i, h in enumerate(hash128(F.lit("author"), name))]))),
        F.coalesce(F.transform(entity_keys(F.col("entity_ids")), lambda e: F.struct(*[h.alias(f"k{i}") for i, h in enumerate(hash128(F.lit("entity"), e))])), F.array()),
    )
    return rows.select("chunk_no", F.when(whole, g1).otherwise(alone[0]).alias("g1"), F.when(whole, g2).otherwise(alone[1]).alias("g2"), keys.alias("keys"))


def _counted(df: DataFrame, space: Workspace, step: str) -> tuple[DataFrame, int]:
    """Write ``df`` and count its rows on the way."""
    seen = Observation()
    out = space.write(df.observe(seen, F.count(F.lit(1)).alias("n")), step)
    return out, seen.get["n"]


def contract(edges: DataFrame, space: Workspace, seed: int = 0) -> DataFrame | None:
    """vertex, root for every vertex that is no root: random-mate contraction of ``edges`` (u, v: distinct ids).

    A vertex that never occurs is its own root. The expected number of edges falls by a quarter at least in each round,
    so the rounds grow with the logarithm of the edges; the sum of all rounds' shuffles is a small multiple of the first.
    """
    edges, left = _counted(edges, space, "edges-0")
    parents: list[DataFrame] = []
    done = 0
    while left:
        head = lambda c: F.xxhash64(F.col(c), F.lit(seed), F.lit(done)).bitwiseAND(F.lit(1)) == 1  # noqa: B023, E731
        mates = edges.select(F.when(head("v"), F.col("u")).otherwise(F.col("v")).alias("vertex"), F.when(head("v"), F.col("v")).otherwise(F.col("u")).alias("mate")).where(head("vertex") != head("mate"))
        parents.append(space.write(mates.groupBy("vertex").agg(F.min("mate").alias("root")), f"mates-{done}"))
        for end in ("u", "v"):
            step = parents[-1].select(F.col("vertex").alias(end), F.col("root").alias("_to"))
            edges = edges.join(step, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        edges = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        edges, left = _counted(edges, space, f"edges-{done + 1}")
        space.drop(f"edges-{done}")
        done += 1
    if not parents:
        return None
    # Unwinding: every collapse points to a vertex that may have collapsed later; doubling the steps reaches the root.
    labels, moved, turn = space.write(reduce(DataFrame.unionByName, parents), "labels-0"), 1, 0
    for i in range(done):
        space.drop(f"mates-{i}")
    while moved:
        turn += 1
        later = labels.select(F.col("vertex").alias("root"), F.col("root").alias("_root"))
        seen = Observation()
        ahead = labels.join(later, "root", "left").select("vertex", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved"))
        labels = space.write(ahead.observe(seen, F.count_if("_moved").alias("n")).drop("_moved"), f"labels-{turn}")
        moved = seen.get["n"]
        space.drop(f"labels-{turn - 1}")
    return labels


def families(chunks: DataFrame, manifest: DataFrame, seed: int = 0) -> DataFrame:
    """chunk_no, family_no: every row with the smallest chunk_no of all rows related to it, directly or through others.

    Needs chunk_no, source, shard_sha256, doc_index, chunk_index, author and entity_ids; further columns are ignored.
    A row whose group key has a null is no one's group mate; a null, blank or nobody's author and null or blank
    entities relate nothing; a source outside the manifest counts as text shards with 8 chunks a group. A source
    without shard_format takes that of its first shard's suffix. Repeated rows count once; rows without a chunk_no
    can't be named and are left out. An empty table gives an empty result.
    """
    space = Workspace(chunks.sparkSession, "families")
    keyed = _keyed(chunks, manifest)
    groups = keyed.groupBy("g1", "g2").agg(F.min("chunk_no").alias("gid"))
    rows = space.write(keyed.join(groups, ["g1", "g2"]).select("chunk_no", "gid", "keys"), "rows")
    # A key is named by the smallest group that has it: two keys of one name share that group and are related anyhow.
    links = rows.filter(F.size("keys") > 0).select("gid", F.explode("keys").alias("k")).select("gid", "k.k0", "k.k1").distinct()
    links = space.write(links, "links")
    names = links.groupBy("k0", "k1").agg(F.min("gid").alias("kid"))
    members = space.write(links.join(names, ["k0", "k1"]).select("gid", "kid").distinct(), "members")
    space.drop("links")
    # All groups are tails and all keys heads at first: each group collapses into its smallest key.
    hooks = members.groupBy("gid").agg(F.min("kid").alias("hook"))
    edges = members.join(hooks, "gid").filter("kid <> hook").select(F.least("kid", "hook").alias("u"), F.greatest("kid", "hook").alias("v")).distinct()
    labels = contract(edges, space, seed)
    roots = hooks.withColumnRenamed("hook", "root")
    if labels is not None:
        roots = hooks.join(labels.withColumnRenamed("vertex", "hook"), "hook", "left").select("gid", F.coalesce("root", "hook").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("gid").alias("family_no"))
    of_group = space.write(roots.join(smallest, "root").select("gid", "family_no"), "roots")
    return rows.select("chunk_no", "gid").distinct().join(of_group, "gid", "left").select("chunk_no", F.coalesce("family_no", "gid").alias("family_no"))


def family_members(found: DataFrame) -> DataFrame:
    """family_no with each other chunk_no of the family; a row alone gives nothing."""
    return found.filter("chunk_no <> family_no").select("family_no", "chunk_no")


def assign_splits(found: DataFrame, targets: DataFrame, seed: int = 0, bins: int | None = None) -> DataFrame:
    """chunk_no, family_no, split: families go whole to splits, in shares near ``targets`` (split, fraction).

    Families heavier than a fiftieth of the smallest split's share come first, heaviest first (there are at most 50 to
    the share of it, whatever the data); the rest follow in the order of a salted hash. A family belongs to the split in
    whose stretch of the cumulative weight its middle lies, the largest split's stretch being first. The running sum is
    two-level: over ``bins`` hash ranges (at least 4096, and more as the rows grow), then within each, so no task sees more
    than its range. The ranges' sums, one number each, are added up in one task: 10 ** 12 rows have 5 million.
    Null or non-positive fractions get nothing; without any positive one the split is null.
    """
    space = Workspace(found.sparkSession, "splits")
    rows = space.write(found, "rows")
    weight = space.write(rows.groupBy("family_no").agg(F.count(F.lit(1)).alias("w")), "weights")
    total = weight.agg(F.sum("w")).first()[0] or 0
    shares = targets.select("split", "fraction").filter("fraction > 0 and split is not null").limit(MOST_SPLITS + 1).collect()
    if len(shares) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits")
    shares = sorted(((r.fraction, r.split) for r in shares), key=lambda x: (-x[0], x[1]))
    if not shares:
        return rows.withColumn("split", F.lit(None).cast("string"))
    bins = bins or max(4096, total // BIN_ROWS)
    heavy = total * shares[-1][0] / sum(f for f, _ in shares) / 50
    big, rest = weight.filter(F.col("w") > heavy), weight.filter(F.col("w") <= heavy)
    rest = rest.withColumn("h", F.xxhash64("family_no", F.lit(seed))).withColumn("bin", F.pmod(F.shiftrightunsigned("h", 20), F.lit(bins)).cast("bigint"))
    line = Window.orderBy("first", "order", "bin").rowsBetween(Window.unboundedPreceding, -1)
    slots = big.select(F.lit(0).alias("first"), (-F.col("w")).alias("order"), F.col("family_no").alias("bin"), "w")
    slots = slots.union(rest.groupBy("bin").agg(F.sum("w").alias("w")).select(F.lit(1), F.lit(0).cast("bigint"), "bin", "w"))
    slots = slots.withColumn("before", F.coalesce(F.sum("w").over(line), F.lit(0))).select("first", F.col("bin").alias("_bin"), "before")
    within = Window.partitionBy("bin").orderBy("h", "family_no").rowsBetween(Window.unboundedPreceding, -1)
    dealt = rest.withColumn("inner", F.coalesce(F.sum("w").over(within), F.lit(0))).select("family_no", "w", "inner", F.lit(1).alias("first"), F.col("bin").alias("_bin"))
    dealt = dealt.unionByName(big.select("family_no", "w", F.lit(0).cast("bigint").alias("inner"), F.lit(0).alias("first"), F.col("family_no").alias("_bin")))
    middle = F.col("before") + F.col("inner") + F.col("w") / 2
    split, upto = F.lit(shares[-1][1]), sum(f for f, _ in shares)
    whole = upto
    for fraction, name in reversed(shares[:-1]):
        upto = sum(f for f, n in shares if (-f, n) <= (-fraction, name))
        split = F.when(middle < total * upto / whole, F.lit(name)).otherwise(split)
    placed = dealt.join(slots, ["first", "_bin"]).select("family_no", split.alias("split"))
    return rows.join(placed, "family_no").select("chunk_no", "family_no", "split")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Per split: rows, families, target and actual share."""
    per = assigned.groupBy("split", "family_no").agg(F.count(F.lit(1)).alias("n")).groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_families"))
    total = Window.partitionBy(F.lit(1))  # one row per split
    return per.join(targets.select("split", "fraction"), "split", "full").select("split", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_families", F.lit(0)).alias("n_families"), "fraction", F.round(F.coalesce("n_rows", F.lit(0)) / F.sum("n_rows").over(total), 6).alias("actual_share"))
