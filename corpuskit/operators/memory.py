"""A store of short notes: entries (entry_id, content, source, scope, confidence, timestamp) in the order of ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def upsert(writes: DataFrame, seq: str = "seq", key: str = "entry_id") -> DataFrame:
    """The last write of each entry; deletions are writes with ``deleted``."""
    latest = writes.groupBy(key).agg(F.max_by(F.struct(*[c for c in writes.columns if c != key]), seq).alias("_w")).select(key, "_w.*")
    return latest.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in writes.columns else latest


def ring(writes: DataFrame, size: int = 50, seq: str = "seq", key: str = "entry_id") -> DataFrame:
    """The ``size`` entries added last; writing an entry again changes it but not its place."""
    latest = writes.groupBy(key).agg(F.min(seq).alias("first_seq"), F.max_by(F.struct(*[c for c in writes.columns if c != key]), seq).alias("_w"))
    return latest.orderBy(F.desc("first_seq")).limit(size).select(key, "first_seq", "_w.*")


def listed(entries: DataFrame, scope: str | None = None) -> DataFrame:
    """Entries of a scope by time."""
    return (entries.filter(F.col("scope") == scope) if scope is not None else entries).orderBy("timestamp", "entry_id")
