"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Send Arrow batches of ``df`` through ``fn``, from columns as lists to columns as lists."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = fn(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def manifest_of(manifest: DataFrame, *cols: str) -> DataFrame:
    """One row per source of the manifest, with the project's defaults filled in; further columns are ignored."""
    defaults = {"text_field": "text", "chunk_chars": 1000, "min_chars": 32, "group_chunks": 8, "chunk_overlap": 0}
    fill = [F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in cols]
    return manifest.filter(F.col("source").isNotNull()).select("source", *fill).dropDuplicates(["source"])


def with_manifest(df: DataFrame, manifest: DataFrame, *cols: str) -> DataFrame:
    """``df`` (with a column ``source``) beside its manifest entry; sources without an entry get the defaults.

    The manifest has one row per source; Spark broadcasts it only below its size threshold and shuffles beyond.
    """
    defaults = {"text_field": "text", "chunk_chars": 1000, "min_chars": 32, "group_chunks": 8, "chunk_overlap": 0}
    joined = df.join(manifest_of(manifest, *cols), "source", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(defaults[c])) for c in cols if c in defaults})


def hash128(*cols: Column | str) -> list[Column]:
    """Two independent 64-bit hashes of the columns."""
    return [F.xxhash64(F.lit("a"), *cols), F.xxhash64(F.lit("b"), *cols)]
