"""Packing sequences into rows and batches.

Packing is next-fit in order: a row takes examples until the next one doesn't fit. That is a scan whose state is the
number of tokens used in the open row, so it is done in two passes: every block of consecutive examples tabulates, for each
possible state at its start, the state at its end and the rows it opens; the tables are chained block by block; then each
block numbers its examples. Only the tables (three times max_len + 2 numbers a block) pass through one task, as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from corpuskit.session import Workspace

IGNORE = -100


def next_fit(lengths: np.ndarray, max_len: int, used: int) -> tuple[np.ndarray, int]:
    """For each length, how many rows were opened up to it, given ``used`` tokens in the open row (max_len + 1: none).

    Row starts are found by binary search over the running sum, one step a row.
    """
    ends = np.cumsum(lengths)
    opened = np.zeros(len(lengths), np.int64)
    at = int(np.searchsorted(ends, max_len - used, "right")) if used <= max_len else 0
    state = used + (int(ends[at - 1]) if at else 0)
    while at < len(lengths):
        opened[at] = 1
        before = int(ends[at - 1]) if at else 0
        stop = int(np.searchsorted(ends, before + max_len, "right"))
        state = int(ends[stop - 1]) - before
        at = stop
    return np.cumsum(opened), state


def transitions(lengths: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every state 0 .. max_len + 1 at the start: the state at the end, the rows opened, and how many examples the row
    has that is open at the end (of this block alone)."""
    n, ends = len(lengths), np.cumsum(lengths)
    before = np.concatenate([[0], ends[:-1]]) if n else np.zeros(0, np.int64)
    stop = np.searchsorted(ends, before + max_len, "right")
    last, rows, held = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):  # a row that begins at i
        rows[i] = 1 + rows[stop[i]]
        last[i], held[i] = (ends[n - 1] - before[i], n - i) if stop[i] == n else (last[stop[i]], held[stop[i]])
    states = np.arange(max_len + 2)
    first = np.where(states <= max_len, np.searchsorted(ends, max_len - states, "right"), 0)
    whole, at = first == n, np.minimum(first, n)
    return np.where(whole, states + (ends[-1] if n else 0), last[at]), rows[first], np.where(whole, n, held[at])


def pack_rows(df: DataFrame, max_len: int, length: str, *order: str) -> DataFrame:
    """``df`` with row_no (from 0) and segment_no (from 1): its examples in the given order, packed next-fit.

    The order must be total. A length beyond ``max_len`` (or below 1, or null) is an error.
    """
    space = Workspace(df.sparkSession, "packing")
    bad = F.coalesce((F.col(length) > max_len) | (F.col(length) < 1), F.lit(True))
    checked = df.withColumn("_len", F.when(bad, F.raise_error(F.lit(f"a length lies outside 1 .. {max_len}")).cast("int")).otherwise(F.col(length).cast("int")))
    # One global sort by range; a written partition is a block of consecutive examples. The rows are written before it, or
    # what they come from would be computed for the sample of the ranges as well.
    checked = space.write(checked, "rows")
    blocks = space.write(checked.orderBy(*order).withColumn("_block", F.spark_partition_id()), "blocks")
    arrays = ("end", "rows", "held")

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            tables = transitions(part["_len"].to_numpy().astype(np.int64), max_len)
            yield pa.RecordBatch.from_arrays([part["_block"].chunk(0)[:1], *(pa.array([t.tolist()], pa.list_(pa.int64())) for t in tables)], names=["_block", *arrays])

    lengths = blocks.select("_block", "_len", *order).repartition("_block").sortWithinPartitions("_block", *order).select("_block", "_len")
    tables = lengths.mapInArrow(tabulate, "_block int, end array<bigint>, rows array<bigint>, held array<bigint>")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, row, segment = max_len + 1, 0, 0
        for batch in batches:
            out = []
            for at, block in enumerate(batch["_block"].to_pylist()):
                out.append((block, state, row, segment))
                end, rows, held = (batch[c][at][state].as_py() for c in arrays)
                state, row, segment = end, row + rows, held if rows else segment + held
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["_block", "_state", "_row", "_segment"])

    # One row per block, hence per partition of the sort: the side that is broadcast below.
    starts = tables.repartition(1).sortWithinPartitions("_block").mapInArrow(chain, "_block int, _state int, _row bigint, _segment bigint")
    entered = blocks.join(F.broadcast(starts), "_block").repartition("_block").sortWithinPartitions("_block", *order)
    schema = StructType([*df.schema.fields, StructField("row_no", LongType()), StructField("segment_no", IntegerType())])
    kinds = to_arrow_schema(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            state, row, segment = (part[c][0].as_py() for c in ("_state", "_row", "_segment"))
            opened, _ = next_fit(part["_len"].to_numpy().astype(np.int64), max_len, state)
            # The place in a row: the distance to its first example, or beyond the examples it had before the block.
            begin = np.searchsorted(opened, opened, "left")
            place = np.arange(len(opened)) - begin + 1 + np.where(opened == 0, segment, 0)
            done = pa.Table.from_arrays([*(part[f.name].cast(f.type) for f in list(kinds)[:-2]), pa.array(row + opened - 1), pa.array(place, pa.int32())], schema=kinds)
            yield from done.to_batches(max_chunksize=10_000)

    return entered.select(*df.columns, "_block", "_len", "_state", "_row", "_segment").mapInArrow(number, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block of a partition sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        blocks = batch["_block"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                if held and held[-1]["_block"][0] != batch["_block"][a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def padded(ids: Column, width: int | Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), (F.lit(width) if isinstance(width, int) else width) - F.size(ids)))


def collate_packed(rows: DataFrame, width: int, pad: int = 0) -> DataFrame:
    """row_no, input_ids, labels, segment_ids, n_examples, n_real, n_loss from packed examples (row_no, segment_no, ids,
    labels). A row holds at most ``width`` tokens, so its list is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("segment_no", "ids", "labels")))
    g = rows.groupBy("row_no").agg(parts.alias("p"))
    ids = F.flatten(F.transform("p", lambda s: s["ids"]))
    labels = F.flatten(F.transform("p", lambda s: s["labels"]))
    segs = F.flatten(F.transform("p", lambda s: F.array_repeat(s["segment_no"], F.size(s["ids"]))))
    return g.select("row_no", padded(ids, width, pad).alias("input_ids"), padded(labels, width, IGNORE).alias("labels"), padded(segs, width, 0).alias("segment_ids"), F.size("p").alias("n_examples"), F.size(ids).alias("n_real"), F.size(F.filter(labels, lambda x: x != IGNORE)).alias("n_loss"))


def collate_padded(rows: DataFrame, width: int, pad: int = 0) -> DataFrame:
    """Each example (ids, labels) as a row of its own, cut to and padded up to ``width``, with its attention mask."""
    ids, labels = F.slice("ids", 1, width), F.slice("labels", 1, width)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.lit(width) - F.size(ids)))
    return rows.withColumns({"input_ids": padded(ids, width, pad), "padded_labels": padded(labels, width, IGNORE), "attention_mask": mask})


def micro_batches(rows: DataFrame, batch_size: int, row: str = "row_no", drop_last: bool = True) -> DataFrame:
    """``rows`` with batch_no; the last batch goes when it is short and ``drop_last`` is set."""
    out = rows.withColumn("batch_no", F.floor(F.col(row) / batch_size).cast("bigint"))
    if not drop_last:
        return out
    last = rows.agg(F.max(row)).first()[0]
    return out.filter(F.col("batch_no") < (0 if last is None else (last + 1) // batch_size))
