"""Documents to paragraphs to chunks, with chunk and group numbers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.functions import types as Y

_AFTER_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _pieces(paragraph: str, limit: int) -> list[str]:
    """A paragraph in pieces: whole sentences packed together; a sentence beyond the limit by words, each cut to it."""
    if len(paragraph) <= limit:
        return [paragraph]
    units: list[list[str]] = [[]]
    for sentence in _AFTER_SENTENCE.split(paragraph):
        # An overlong sentence starts and ends pieces of its own.
        if len(sentence) > limit:
            units += [sentence.split(), []]
        else:
            units[-1].append(sentence)
    out: list[str] = []
    for unit in units:
        line: list[str] = []
        size = 0
        for part in filter(None, unit):
            if line and size + 1 + len(part) > limit:
                out.append(" ".join(line))
                line, size = [], 0
            size += len(part) + (1 if line else 0)
            line.append(part)
        if line:
            out.append(" ".join(line))
    return [p[:limit] for p in out]


def pack_paragraphs(paragraphs: list[str], limit: int) -> list[str]:
    """Consecutive paragraphs packed into chunks of at most ``limit`` characters, a blank line between them."""
    chunks: list[list[str]] = []
    room = -1
    for paragraph in paragraphs:
        for piece in _pieces(paragraph, limit):
            if room < len(piece) + 2 or not chunks:
                chunks.append([])
                room = limit + 2
            chunks[-1].append(piece)
            room -= len(piece) + 2
    return ["\n\n".join(c) for c in chunks]


def chunk_paragraphs(paragraphs: Column, chunk_chars: int | Column) -> Column:
    """Chunks of an array of paragraphs (an Arrow function: packing is a fold over whole documents)."""
    if isinstance(chunk_chars, int) and chunk_chars < 16:
        raise ValueError("chunk_chars must be at least 16")

    @F.pandas_udf(Y.STRINGS)
    def pack(docs: pd.Series, limits: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else pack_paragraphs(list(d), max(16, int(n))) for d, n in zip(docs, limits, strict=True)], dtype=object)

    return pack(paragraphs, F.lit(chunk_chars) if isinstance(chunk_chars, int) else chunk_chars)


def lost_characters(paragraphs: Column, chunk_chars: Column) -> Column:
    """How many characters ``chunk_paragraphs`` drops: what stands beyond the limit in words longer than it."""
    words = F.flatten(F.transform(F.filter(paragraphs, lambda p: F.length(p) > chunk_chars), lambda p: F.split(p, r"(?U)[\s\x1c-\x1f]+")))
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.greatest(F.length(w) - chunk_chars, F.lit(0)))


def chunk_documents(docs: DataFrame, chunk_chars: int | Column = 1000, group_chunks: int | Column = 8, is_text: Column | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, chunk_index, group_index, text: one row per chunk of ``docs`` (``keys`` and paragraphs).

    In text shards every ``group_chunks`` chunks are a group; a document of a record shard is one group. Chunks are
    numbered before any of them is dropped.
    """
    rows = docs.select(*keys, F.posexplode(chunk_paragraphs(F.col("paragraphs"), chunk_chars)).alias("chunk_index", "text"), *([is_text.alias("_text")] if is_text is not None else []))
    group = F.floor(F.col("chunk_index") / (F.lit(group_chunks) if isinstance(group_chunks, int) else group_chunks)).cast("int")
    if is_text is not None:
        group = F.when(F.col("_text"), group).otherwise(0)
    return rows.select(*keys, "chunk_index", group.alias("group_index"), "text")
