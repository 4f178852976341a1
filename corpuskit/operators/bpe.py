"""Byte-pair encoding with a given vocabulary of merges, and the piece counts a vocabulary would be learned from."""

from __future__ import annotations

import json
import re
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.functions import types as Y

FIRST = 260  #: the first id after four specials and 256 bytes
PIECES = r" ?[^\W\d_]+| ?\d| ?(?:[^\s\w]|_)+|\s+"


def piece_counts(texts: DataFrame) -> DataFrame:
    """piece, n over column text: pre-tokens counted in the JVM, combined before the shuffle."""
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit(f"(?U)({PIECES})"), F.lit(1))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


class Merges:
    """An ordered list of merges (pairs of ids); merge i makes id 260 + i."""

    def __init__(self, merges: list[tuple[int, int]]):
        self.merges = [(int(a), int(b)) for a, b in merges]
        self.rank = {m: i for i, m in enumerate(self.merges)}
        self.bytes = [b""] * 4 + [bytes([i]) for i in range(256)]
        for a, b in self.merges:
            if not (4 <= a < len(self.bytes) and 4 <= b < len(self.bytes)):
                raise ValueError(f"merge ({a}, {b}) names a token that doesn't exist yet")
            self.bytes.append(self.bytes[a] + self.bytes[b])

    def identity(self) -> str:
        return sha256(json.dumps(self.merges).encode()).hexdigest()

    def save(self) -> str:
        return json.dumps({"merges": self.merges})

    @classmethod
    def load(cls, text: str) -> Merges:
        return cls(json.loads(text)["merges"])

    def piece(self, piece: str) -> list[int]:
        """The ids of a piece: the earliest-ranked merge first, at its leftmost place."""
        ids = [b + 4 for b in piece.encode()]
        while len(ids) > 1:
            rank, at = min((self.rank.get(p, len(self.merges)), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == len(self.merges):
                break
            ids[at : at + 2] = [FIRST + rank]
        return ids

    def encode(self, text: str) -> list[int]:
        known: dict[str, list[int]] = {}
        return [i for p in re.findall(PIECES, text) for i in known.setdefault(p, self.piece(p))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids if i >= 4).decode(errors="replace")


def encode(text: Column, merges: Merges) -> Column:
    """Token ids by an Arrow function that remembers pieces within a batch."""

    @F.pandas_udf(Y.INTS)
    def ids(texts: pd.Series) -> pd.Series:
        known: dict[str, list[int]] = {}
        out = []
        for t in texts:
            row: list[int] | None = None if t is None else []
            for p in re.findall(PIECES, t or ""):
                if p not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[p] = merges.piece(p)
                row += known[p]
            out.append(row)
        return pd.Series(out, dtype=object)

    return ids(text)


def merges_from_ranks(ranks: dict[bytes, int]) -> Merges:
    """The merges of a public byte-level vocabulary (bytes to rank): each longer token splits into the two parts that
    lower ranks make of it."""
    order = sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__)
    ids = {bytes([i]): i + 4 for i in range(256)}
    out: list[tuple[int, int]] = []
    for token in order:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joined = [(ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best, i = min((r, i) for r, i in joined if r < ranks[token]) if any(r < ranks[token] for r, _ in joined) else (None, 0)
            if best is None:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2 and all(p in ids for p in parts):
            out.append((ids[parts[0]], ids[parts[1]]))
            ids[token] = FIRST + len(out) - 1
    return Merges(out)
