"""Streams of deliveries: repeated ones dropped within a watermark, and running counts (an extension of the batch
operators; their results are the batch ones over the rows seen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.functions import text as T


def first_deliveries(stream: DataFrame, key: str, at: str, delay: str = "30 days") -> DataFrame:
    """Each key once, if its deliveries are no further apart than ``delay``; state is dropped beyond it."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def first_texts(stream: DataFrame, text: str, at: str, delay: str = "30 days") -> DataFrame:
    """Each normalised text once within ``delay``."""
    rows = stream.withColumn("content_key", T.content_key(F.col(text))).withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(["content_key"])


def windowed_counts(stream: DataFrame, at: str, width: str, *by: Column | str, delay: str = "1 hour") -> DataFrame:
    """Rows per tumbling window and group."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return rows.groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
