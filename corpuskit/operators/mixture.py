"""Mixtures of sources: weights, shares and repeat factors. All tables here have one row per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def effective_mixture(weights: DataFrame, replay_fraction: float) -> DataFrame:
    """name, weight: primary sources share 1 - replay_fraction, replayed ones replay_fraction, to 6 places.

    ``weights``: name, role (primary or replay), weight. Without replay sources the primary ones share all.
    """
    role = Window.partitionBy("role")
    replay = F.max((F.col("role") == "replay").cast("int")).over(Window.partitionBy(F.lit(1)))
    budget = F.when(F.col("role") == "replay", F.lit(replay_fraction)).when(replay == 1, F.lit(1 - replay_fraction)).otherwise(1.0)
    return weights.withColumn("_w", F.try_divide(F.col("weight"), F.sum("weight").over(role)) * budget).groupBy("name").agg(F.bround(F.sum("_w"), 6).alias("weight")).filter("weight is not null")


def example_fraction(byte_share: float, mean_synthetic: Column | float, mean_natural: Column | float):
    """The share of examples that gives natural text ``byte_share`` of the bytes, from both sides' mean sizes."""
    s = F.lit(byte_share)
    a, b = (x if hasattr(x, "alias") else F.lit(x) for x in (mean_synthetic, mean_natural))
    return s * a / (s * a + (1 - s) * b)


def repeat_factors(quotas: DataFrame, sizes: DataFrame, epochs: int = 1) -> DataFrame:
    """source, repeat_factor (3 places), planned_passes (2 places) from quotas (source, quota) and sizes (source, n)."""
    j = quotas.join(sizes, "source")
    return j.select("source", F.bround(F.try_divide(F.col("quota"), F.col("n")), 3).alias("repeat_factor"), F.bround(F.try_divide(F.col("quota") * epochs, F.col("n")), 2).alias("planned_passes"))


def natural_fraction(stats: DataFrame) -> DataFrame:
    """natural_fraction of sources' tokens (source, tokens, supplemental), to 6 places; 0 without tokens."""
    natural = F.sum(F.when(~F.coalesce("supplemental", F.lit(False)), F.col("tokens")).otherwise(0))
    return stats.agg(F.bround(F.coalesce(F.try_divide(natural, F.sum("tokens")), F.lit(0.0)), 6).alias("natural_fraction"))
