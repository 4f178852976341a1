"""A reproducible sample that stays stable as data grows (problem 2).

Each stratum has a fixed rate; a record is in the sample when the salted hash of its key lies below the stratum's
threshold. Thresholds are only ever raised, so what was selected once stays selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuskit.llm._common import manifest_of

DIGITS = 13  #: hex digits of the hash that count: 52 bits, exact in a double


def threshold(rate: Column) -> Column:
    """The rate as the smallest hash (in hex digits) that is outside; null and negative rates select nothing."""
    steps = F.floor(F.least(F.greatest(F.coalesce(rate, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * F.lit(float(16**DIGITS)))
    return F.lpad(F.lower(F.hex(steps.cast("bigint"))), DIGITS + 1, "0")


def key_hash(seed: Column, stratum: Column, key: Column) -> Column:
    return F.concat(F.lit("0"), F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), stratum, key), 256), 1, DIGITS))


def strata(manifest: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """source, seed and threshold per stratum. ``earlier`` (source, threshold) holds thresholds used before."""
    now = manifest_of(manifest, "seed", "sample_share").select("source", F.coalesce("seed", F.lit(0)).alias("seed"), threshold(F.col("sample_share")).alias("threshold"))
    if earlier is None:
        return now
    before = earlier.select("source", F.col("threshold").alias("_before")).groupBy("source").agg(F.max("_before").alias("_before"))
    return now.join(before, "source", "left").select("source", "seed", F.greatest("threshold", "_before").alias("threshold"))


def remembered_thresholds(manifest: DataFrame, folder: str) -> DataFrame:
    """source, threshold: the thresholds to pass as ``earlier``, kept in ``folder`` (of a file system all executors share).

    Those of the manifest are added to the ones kept there, and the largest of a source counts; so a rate lowered in the
    manifest never takes back what runs with this folder selected before.
    """
    spark = manifest.sparkSession
    now = strata(manifest).select("source", "threshold")
    spark.createDataFrame(now.collect(), now.schema).write.mode("append").parquet(folder)  # one row per source
    return spark.read.schema(now.schema).parquet(folder).groupBy("source").agg(F.max("threshold").alias("threshold"))


def stable_sample(examples: DataFrame, manifest: DataFrame, earlier: DataFrame | None = None, up_to_batch: int | None = None) -> DataFrame:
    """example_id, source, batch_no (the first that delivered it) and key_hash of the selected examples.

    Whether an example is selected depends on its id, source and the source's seed and rate alone, never on other
    rows, their order or partitioning. Hence batches 1..k give a subset of batches 1..k+1, reruns agree, and raising a
    rate only adds. Repeated deliveries count once. Rows with a null example_id, or of a source without a manifest
    entry (a null source included), have no stratum and are never selected; a null rate is 0 and a null seed is 0.
    Columns beyond example_id, source and batch_no are ignored; an empty table gives an empty sample.
    """
    rows = examples.select("example_id", "source", "batch_no").filter(F.col("example_id").isNotNull())
    if up_to_batch is not None:
        rows = rows.filter(F.col("batch_no") <= up_to_batch)
    rows = rows.join(strata(manifest, earlier), "source")
    rows = rows.withColumn("key_hash", key_hash(F.col("seed"), F.col("source"), F.col("example_id")))
    # The filter comes before the only shuffle, which then carries the sample alone.
    return rows.filter(F.col("key_hash") < F.col("threshold")).groupBy("example_id", "source", "key_hash").agg(F.min("batch_no").alias("batch_no"))


def sample_rates(examples: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per source: distinct examples, selected ones, target and actual share."""
    rows = examples.select("example_id", "source").filter(F.col("example_id").isNotNull())
    rows = rows.join(strata(manifest), "source").withColumn("key_hash", key_hash(F.col("seed"), F.col("source"), F.col("example_id")))
    each = rows.groupBy("source", "example_id").agg(F.max((F.col("key_hash") < F.col("threshold")).cast("int")).alias("hit"))
    counts = each.groupBy("source").agg(F.count(F.lit(1)).alias("n_examples"), F.sum("hit").cast("bigint").alias("n_selected"))
    return counts.join(manifest_of(manifest, "sample_share"), "source").select("source", "n_examples", "n_selected", "sample_share", F.round(F.col("n_selected") / F.col("n_examples"), 9).alias("actual_share"))


def sample_growth(examples: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per number of batches k: size of the sample of batches 1..k and how many of it batch k added."""
    added = stable_sample(examples, manifest).groupBy("batch_no").agg(F.count(F.lit(1)).alias("added"))
    upto = Window.partitionBy(F.lit(1)).orderBy("batch_no")  # one row per batch
    return added.select("batch_no", "added", F.sum("added").over(upto).alias("selected"))
