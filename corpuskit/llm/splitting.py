"""Splitting oversized texts at natural boundaries (problem 1).

The least number of pieces is computed, equal-length targets are placed, each is snapped to the strongest boundary
nearby (paragraph, sentence, word), and pieces are added while any limit fails. Where a stretch has no boundary within
reach of its target, or no number of pieces keeps them all above the least size, the same targets are placed once more
with a cut at the target itself, and at last without the least size.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from math import ceil

from pyspark.sql import DataFrame, functions as F

from corpuskit.functions.pytext import storable
from corpuskit.llm._common import map_rows, with_manifest
from corpuskit.operators.dedup import first_deliveries
from corpuskit.sources.jsonlines import Number, json_object

_BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*|[\u2029]\s*")
_LINE = re.compile(r"[\n\r\x85\u2028\u2029]\s*")
_SENTENCE = re.compile(r"[.!?…\u061f\u0964]+[)\]\"'\u201d\u2019\u00bb]*\s+|[\u3002\uff01\uff1f\uff61]+[\u300d\u300f\u201d\u2019\uff09]*\s*")
_WORD = re.compile(r"\s+|[\u3001\uff0c\uff1b\uff1a]\s*")
#: Scripts written without spaces: any place between two letters serves where nothing better is near.
_UNSPACED = re.compile(r"(?<=[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])(?=[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])")


class _Cutter:
    def __init__(self, text: str, limit: int, overlap: int, least: int):
        self.text, self.n, self.limit = text, len(text), max(2, limit)
        self.overlap = max(0, min(overlap, self.limit // 2))
        self.least = max(1, min(least, self.limit - self.overlap))
        paragraph = _BLANK_LINE if _BLANK_LINE.search(text) else _LINE
        ends = [sorted(m.end() for m in p.finditer(text)) for p in (paragraph, _SENTENCE, _WORD, _UNSPACED)]
        self.levels = [e for e in ends if e]
        self.starts = sorted({x for e in ends for x in e})
        if not self.starts:
            self.overlap = 0  # pieces begin at boundaries only, so there is nothing to share

    def nearest(self, lo: int, hi: int, target: float, levels: list[list[int]]) -> int | None:
        """The strongest boundary in [lo, hi]; of equally strong ones, the one nearest to the target."""
        for ends in levels:
            i, j = bisect_left(ends, lo), bisect_right(ends, hi)
            if i < j:
                k = bisect_left(ends, target, i, j)
                return min(ends[max(i, k - 1) : min(j, k + 1)], key=lambda x: abs(x - target))
        return None

    def snap(self, lo: int, hi: int, target: float, near: float) -> int | None:
        a, b = max(lo, ceil(target - near)), min(hi, int(target + near))
        found = self.nearest(a, b, target, self.levels) if a <= b else None
        return found if found is not None else self.nearest(lo, hi, target, self.levels)

    def restart(self, cut: int, start: int) -> int:
        """Where the piece after ``cut`` begins: a boundary at most ``overlap`` before it."""
        if not self.overlap:
            return cut
        at = bisect_left(self.starts, max(cut - self.overlap, start + 1))
        return min(cut, self.starts[at]) if at < len(self.starts) else cut

    def too_small(self, start: int, end: int) -> bool:
        return end - start < self.least or len(self.text[start:end].strip()) < self.least

    def unbroken(self) -> bool:
        """Whether some stretch without a boundary is longer than a piece may be."""
        marks = [0, *sorted({x for e in self.levels for x in e}), self.n]
        return any(b - a > self.limit for a, b in zip(marks, marks[1:], strict=False))

    def balanced(self, pieces: int, anywhere: bool = False, at_last: bool = False) -> list[tuple[int, int]] | None:
        """``pieces`` pieces around equal-length targets, or None when a limit fails.

        ``anywhere``: where no boundary lies within reach, the cut is at the target. ``at_last``: pieces may be of any
        size and joined characters may part; then no limit can fail from the least number of pieces on, since every cut
        leaves no more than the further pieces hold.
        """
        least = 1 if at_last else self.least
        room, start, cut, spans = self.limit - self.overlap, 0, 0, []
        stride = (self.n - self.overlap) / pieces
        for i in range(1, pieces):
            target = self.overlap + i * stride
            lo = max(start + least, cut + 1, ceil(self.n - (pieces - i) * room))
            hi = min(start + self.limit, self.n - (pieces - i))  # the rest needs a character for each piece
            if lo > hi:
                return None
            cut_at = self.snap(lo, hi, target, stride / 3)
            if anywhere and cut_at is None:
                cut_at = self.hard(lo, hi, target)
                if cut_at is None and at_last:
                    cut_at = min(max(int(target), lo), hi)
            if cut_at is None or not at_last and self.too_small(start, cut_at):
                return None
            spans.append((start, cut_at))
            cut, start = cut_at, self.restart(cut_at, start)
        if self.n - start > self.limit or not at_last and self.too_small(start, self.n):
            return None
        return [*spans, (start, self.n)]

    def hard(self, lo: int, hi: int, target: float) -> int | None:
        """The place nearest to the target that is not before a combining mark or inside a joined sequence."""
        at = min(max(int(target), lo), hi)
        for x in sorted(range(max(lo, at - 16), min(hi, at + 16) + 1), key=lambda x: abs(x - at)):
            if not unicodedata.combining(self.text[x]) and self.text[x] not in "\u200d\ufe0f" and self.text[x - 1] != "\u200d":
                return x
        return None

    def spans(self) -> list[tuple[int, int]]:
        if self.n <= self.limit:
            return [(0, self.n)]
        fewest = max(2, ceil((self.n - self.overlap) / (self.limit - self.overlap)))
        # A stretch longer than a piece can't be cut at a boundary, whatever the number of pieces.
        for anywhere in (True,) if self.unbroken() else (False, True):
            pieces = fewest
            for attempt in range(12):
                if found := self.balanced(pieces, anywhere):
                    return found
                pieces += 1 if attempt < 4 else max(1, pieces // 8)
        return self.balanced(fewest, True, True)


def split_spans(text: str, limit: int, overlap: int = 0, least: int = 1) -> list[tuple[int, int]]:
    """Offsets of the pieces of ``text``: each at most ``limit`` characters, together the whole text.

    Neighbours share at most ``overlap`` characters (at most half the limit). A piece below ``least`` characters comes
    only where no placement avoids it. A text within the limit is one piece; the empty text is one empty piece.
    """
    return _Cutter(text, limit, overlap, least).spans()


def _pieces(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in ("record_id", "piece_no", "start_char", "end_char", "text")}
    for key, line, field, limit, overlap, least in zip(cols["record_id"], cols["raw_json"], cols["text_field"], cols["chunk_chars"], cols["chunk_overlap"], cols["min_chars"], strict=True):
        text = (json_object(line) or {}).get(field)
        if not isinstance(text, str) or isinstance(text, Number):
            continue
        text = storable(text).strip()
        if len(text) <= limit:
            continue
        for no, (a, b) in enumerate(split_spans(text, limit, overlap, least)):
            for name, value in zip(out, (key, no, a, b, text[a:b]), strict=True):
                out[name].append(value)
    return out


def split_oversized(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pieces of every record whose text is longer than its source's ``chunk_chars``.

    ``records`` needs record_id, source, raw_json and fetched_at; other columns are ignored, whatever their names.
    Result: record_id, piece_no (from 0), start_char, end_char (offsets in the text without outer white space), text.

    Lines that are null, no JSON object, or whose text field is missing, null or no string give no piece, nor do texts
    within the limit, blank ones included. A null source counts as one without manifest entry and takes the defaults;
    a repeated delivery of a record_id gives no further pieces, and of long deliveries that differ the earliest counts.
    Rows with a null record_id are kept together as one key. An empty table gives an empty result.
    """
    rows = with_manifest(records.select("record_id", "source", "raw_json", "fetched_at"), manifest, "text_field", "chunk_chars", "chunk_overlap", "min_chars")
    # A JSON spelling is never shorter than its text: shorter lines can't hold an oversized text and needn't be shuffled.
    rows = rows.filter(F.length("raw_json") > F.col("chunk_chars"))
    rows = first_deliveries(rows.drop("source"), "record_id", "fetched_at", small_whole=False).drop("fetched_at")
    return map_rows(rows, _pieces, "record_id bigint, piece_no int, start_char int, end_char int, text string")


def oversized(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """record_id of every record that ``split_oversized`` cuts."""
    return split_oversized(records, manifest).filter("piece_no = 0").select("record_id")
