"""Duplicates hidden by formatting differences (problem 5).

Nested records are hashed bottom-up: leaves are normalised, the digests of an object's members are sorted (their order
means nothing), those of an array are not. Records are grouped by root digest, and every group is confirmed by the
comparison of the whole normalised structure.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from corpuskit.functions.pytext import reading_text, storable
from corpuskit.llm._common import map_rows, with_manifest
from corpuskit.session import Workspace
from corpuskit.sources.jsonlines import Number, json_object


def _number(spelt: str) -> str:
    try:
        value = Decimal(spelt)
        return str(int(value)) if value == value.to_integral_value() and abs(value.adjusted()) < 400 else str(value.normalize())
    except (ArithmeticError, ValueError):
        return spelt


def _leaf(value: object) -> tuple[bytes, str]:
    if isinstance(value, Number):
        kind, text = b"n", "n" + _number(value)
    elif isinstance(value, str):
        kind, text = b"s", "s" + repr(storable(reading_text(value)))
    else:
        kind, text = b"c", repr(value)
    return hashlib.blake2b(kind + text.encode("utf-8", "replace"), digest_size=16).digest(), text


def canonical(value: object) -> tuple[bytes, str]:
    """The digest of a JSON value and its whole normalised structure as a text, whatever the depth of nesting.

    Nodes are worked off bottom-up by a stack of open ones: their kind, the members still to come and the finished ones.
    """
    done: list = []
    stack: list[tuple[bytes, Iterator, list, str | None]] = [(b"", iter([(None, value)]), done, None)]
    while stack:
        kind, members, finished, own_name = stack[-1]
        for name, member in members:
            if isinstance(member, dict):
                stack.append((b"o", iter(member.items()), [], name))
                break
            if isinstance(member, list):
                stack.append((b"a", iter([(None, x) for x in member]), [], name))
                break
            finished.append((name, *_leaf(member)))
        else:
            stack.pop()
            if not stack:
                break
            if kind == b"o":
                parts = sorted((hashlib.blake2b(n.encode("utf-8", "replace") + b"\0" + d, digest_size=16).digest(), repr(n) + ":" + t) for n, d, t in finished)
                text = "{" + ",".join(t for _, t in parts) + "}"
                digests = [d for d, _ in parts]
            else:
                text = "[" + ",".join(t for _, _, t in finished) + "]"
                digests = [d for _, d, _ in finished]
            stack[-1][2].append((own_name, hashlib.blake2b(kind + b"".join(digests), digest_size=16).digest(), text))
    return done[0][1:]


def _roots(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in ("record_id", "d1", "d2", "whole")}
    for key, line, field in zip(cols["record_id"], cols["raw_json"], cols["text_field"], strict=True):
        record = json_object(line) or {}
        text = record.get(field)
        if not isinstance(text, str) or isinstance(text, Number) or not text.strip():
            continue
        digest, whole = canonical({"text": text, "title": record.get("title"), "author": record.get("author"), "attrs": record.get("attrs")})
        for name, value in zip(out, (key, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), whole), strict=True):
            out[name].append(value)
    return out


def digests(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """record_id, root digest (d1, d2) and the whole normalised structure of every usable record."""
    rows = with_manifest(records.select("record_id", "source", "raw_json").filter("record_id is not null"), manifest, "text_field").select("record_id", "raw_json", "text_field")
    return map_rows(rows, _roots, "record_id bigint, d1 bigint, d2 bigint, whole string")


class RecordClasses:
    """The classes of records that are the same but for formatting.

    Two records are the same when their texts (each under its source's text_field), titles, authors and all values of
    attrs read the same, whatever the order of fields; a missing title, author or attrs equals a null one; id, meta and
    all else don't count. Lines that are null, no JSON object or without a non-blank string as text belong to no class,
    nor do rows with a null record_id. Repeated deliveries of a record_id count once. Columns beyond record_id, source
    and raw_json are ignored; an empty table has no classes.

    Digests are computed once and written to the shared folder. Copies are combined before every shuffle, so a class
    that holds a third of all rows is a handful of rows after its map side; listing its members joins one row per class
    to the ids, which adaptive execution splits where a class is hot. The full comparison reads the structures of records
    whose root others have too; those of single records are never shuffled where Spark broadcasts the shared roots or
    filters by them (it does so by itself from 10 GB on).
    """

    def __init__(self, records: DataFrame, manifest: DataFrame):
        space = Workspace(records.sparkSession, "records")
        self.rows = space.write(digests(records, manifest), "digests")
        self.ids = self.rows.select("record_id", "d1", "d2").distinct().withColumn("whole", F.lit(""))
        # The full comparison: roots with several records, by one row for each distinct structure.
        shared = self.rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = space.write(shared, "shared").filter("n > 1").select("d1", "d2")
        structures = self.rows.join(shared, ["d1", "d2"], "left_semi").groupBy("d1", "d2", "whole").agg(F.count(F.lit(1)).alias("n"))
        clashing = space.write(structures.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("structures")).filter("structures > 1").select("d1", "d2"), "clashing")
        if not clashing.isEmpty():
            # Different structures under one 128-bit digest: their rows are told apart by the structure itself.
            apart = self.rows.join(clashing, ["d1", "d2"]).select("record_id", "d1", "d2", "whole").distinct()
            self.ids = self.ids.join(clashing, ["d1", "d2"], "left_anti").unionByName(apart)

    def collapsed(self) -> DataFrame:
        """kept_id, copies: one row per class with its smallest record_id and the number of its records."""
        return self._classes().select("kept_id", "copies")

    def _classes(self) -> DataFrame:
        return self.ids.groupBy("d1", "d2", "whole").agg(F.min("record_id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))

    def members(self) -> DataFrame:
        """kept_id, copy_id: every other record of each class beside its smallest record_id."""
        several = self._classes().filter("copies > 1").drop("copies")
        return self.ids.join(several, ["d1", "d2", "whole"]).filter("record_id <> kept_id").select("kept_id", F.col("record_id").alias("copy_id"))
