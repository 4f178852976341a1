"""Samples, splits and limits that depend on keys and seeds alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def rank_hash(seed: int, key: Column, digits: int = 64) -> Column:
    """Hex digits of a seeded hash; their order is the order of the numbers they spell, whatever the sign."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, digits)


def bottom_k(df: DataFrame, k: int, seed: int, key: Column, *ties: Column | str) -> DataFrame:
    """The ``k`` rows of smallest seeded hash (16 digits), in that order: a top-k over partitions, no full sort."""
    ranked = df.withColumn("rank_hash", rank_hash(seed, key, 16))
    return ranked.orderBy("rank_hash", *ties).limit(k) if k > 0 else ranked.limit(0)


def numbered(df: DataFrame, hash_col: str, order: list[Column | str], by: str | None = None) -> DataFrame:
    """``df`` with _rn (the place of a row within its group ``by``, or in the whole, from 1) and _n (the group's size).

    Rows are dealt to 4096 ranges by the leading digits of their hash; a running sum over the ranges' sizes gives each
    range its offset and places within a range are numbered apart. So the largest group is spread over 4096 tasks.
    """
    group = F.lit(0) if by is None else F.col(by)
    rows = df.withColumn("_group", group).withColumn("_range", F.substring(hash_col, 1, 3))
    sizes = rows.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_c"))
    per = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_c").over(per.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_group").alias("_g"), F.col("_range").alias("_r"), before.alias("_before"), F.sum("_c").over(per).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_group", "_range").orderBy(*order))
    out = rows.withColumn("_in", place).join(offsets, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("_rn", F.col("_before") + F.col("_in")).drop("_group", "_range", "_in", "_before", "_g", "_r")


def places(df: DataFrame, by: list[str], parts: list[Column], order: list[Column | str]) -> DataFrame:
    """``df`` with _place, a row's place within its group ``by`` in the given order, from 1.

    ``parts`` cut each group into stretches that follow each other in the order. A running sum over the sizes of the
    stretches gives each its offset, and places within a stretch are numbered apart: no task sees a whole group.
    """
    rows = df.withColumns({f"_part{i}": p for i, p in enumerate(parts)})
    cut = [f"_part{i}" for i in range(len(parts))]
    sizes = rows.groupBy(*by, *cut).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy(*cut).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).drop("_c")
    inside = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*by, *cut).orderBy(*order)))
    return inside.join(offsets, [*by, *cut]).withColumn("_place", F.col("_before") + F.col("_in")).drop(*cut, "_in", "_before")


def split_groups(groups: DataFrame, validation: float, test: float, seed: int, key: str = "group_key") -> DataFrame:
    """``key``, split: the first ceil(test * G) groups by seeded hash to test, the next ceil(validation * G) to val.

    Fewer than three groups all go to train.
    """
    if not (0 <= validation < 1 and 0 <= test < 1 and validation + test < 1):
        raise ValueError("fractions must be at least 0 and leave something for training")
    ranked = numbered(groups.select(key).distinct().withColumn("_hash", rank_hash(seed, F.col(key))), "_hash", ["_hash", key])
    n_test, n_val = (F.when(F.col("_n") < 3, 0).otherwise(F.ceil(F.lit(float(f)) * F.col("_n"))) for f in (test, validation))
    return ranked.select(key, F.when(F.col("_rn") <= n_test, "test").when(F.col("_rn") <= n_test + n_val, "val").otherwise("train").alias("split"))


def split_records(records: DataFrame, fraction: float, seed: int, id_col: str = "id") -> DataFrame:
    """``id_col``, split: max(1, round(fraction * n)) records of smallest seeded hash (12 digits) to val."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    ranked = numbered(records.select(id_col).withColumn("_hash", rank_hash(seed, F.col(id_col), 12)), "_hash", ["_hash", id_col])
    return ranked.select(id_col, F.when(F.col("_rn") <= F.greatest(F.lit(1), F.rint(F.lit(fraction) * F.col("_n"))), "val").otherwise("train").alias("split"))


def stratified_split(df: DataFrame, stratum: Column, train: float = 0.8, validation: float = 0.1, test: float = 0.1, seed: int = 0, id_col: str = "id") -> DataFrame:
    """``id_col``, stratum, split: within each stratum round(n * train) rows to train, round(n * validation) to val, the
    rest to test, in the order of a seeded hash."""
    if abs(train + validation + test - 1) > 1e-6:
        raise ValueError("the fractions must add up to 1")
    rows = df.select(id_col, stratum.alias("stratum")).withColumn("_hash", rank_hash(seed, F.col(id_col)))
    rows = numbered(rows, "_hash", ["_hash", id_col], "stratum")
    n_train, n_val = F.rint(F.col("_n") * train), F.rint(F.col("_n") * validation)
    return rows.select(id_col, "stratum", F.when(F.col("_rn") <= n_train, "train").when(F.col("_rn") <= n_train + n_val, "val").otherwise("test").alias("split"))


def limit_per(df: DataFrame, n: int, by: Column, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each group (Spark limits each group before the shuffle)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def largest_remainder(weights: DataFrame, total: int, name: str = "name", weight: str = "weight", order: str | None = None) -> DataFrame:
    """``name``, quota: ``total`` dealt in proportion to the weights; what rounding leaves goes to the largest fractions
    (then to the first in ``order``). One row per source."""
    all_ = Window.partitionBy(F.lit(1))
    exact = F.col(weight) / F.sum(weight).over(all_) * total
    rows = weights.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact").cast("bigint"))
    rows = rows.withColumn("_rest", F.lit(total) - F.sum("_floor").over(all_))
    rn = F.row_number().over(all_.orderBy((F.col("_exact") - F.col("_floor")).desc(), order or name))
    return rows.select(name, (F.col("_floor") + (rn <= F.col("_rest")).cast("bigint")).alias("quota"))


def epoch_order(examples: DataFrame, quotas: DataFrame, seed: int, epoch: int) -> DataFrame:
    """source, id, repeat, order_key: an epoch's examples, ``quota`` per source, small sources used again in full turns.

    A pure function of seed and epoch. ``examples``: source, id; ``quotas``: source, quota. Ordering by order_key (then
    source, id, repeat) gives the shuffled epoch.
    """
    sizes = examples.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    plan = quotas.join(sizes, "source").filter("quota > 0").select("source", "quota", "_n", F.ceil(F.col("quota") / F.col("_n")).cast("int").alias("_turns"))
    rows = examples.select("source", "id").join(plan, "source").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("_turns"))))
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.lit(epoch), "source", "repeat", F.col("id").cast("string")), 256)
    rows = rows.withColumn("_hash", h)
    # All turns but the last are whole; the last one needs places.
    last = numbered(rows.filter("repeat = _turns").withColumnRenamed("_n", "_size"), "_hash", ["_hash", "id"], "source")
    cut = last.filter(F.col("_rn") <= F.col("quota") - F.col("_size") * (F.col("_turns") - 1)).select("source", "id", "repeat")
    whole = rows.filter("repeat < _turns")
    return whole.select("source", "id", "repeat").unionByName(cut).select("source", "id", "repeat", F.sha2(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.lit("order"), "source", "repeat", F.col("id").cast("string")), 256).alias("order_key"))


def tokenizer_sample(natural: DataFrame, supplemental: DataFrame, natural_records: int = 8000, supplemental_records: int = 4000, seed: int = 0) -> DataFrame:
    """id, text, natural: a bottom-k sample of natural texts and one of supplemental ones (columns id, text)."""
    pick = lambda df, k, flag: bottom_k(df.select("id", "text"), k, seed, F.col("id"), "text").select("id", "text", F.lit(flag).alias("natural"))
    return pick(natural, natural_records, True).unionByName(pick(supplemental, supplemental_records, False))
