"""Evaluation texts leaking into training text (problem 6).

Items and documents are read as words. Item-sized windows (eight words, or the whole of a shorter item), and document
windows longer or shorter by up to the allowed edits, are embedded by
the CGK random walk, under which texts a small edit distance apart come to lie a small Hamming distance apart; bit
sampling over the embedding, repeated until the target recall is reached, proposes window pairs, and the exact edit
distance of the words decides. A window without edits walks the same walk, so exact leaks are never missed.

The items are a stated query set. They are taken in blocks of a fixed size, each of which is sent to all executors and
meets every document once; a document's windows are matched where the document is read, so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuskit.functions.pytext import alnum_words
from corpuskit.llm.overlap import distance, merged

WINDOW = 8  #: words in a row that make a leak
SAMPLED = 6  #: embedding places a bit-sampling table looks at
BLOCK_ITEMS = 5_000  #: items that are sent to the executors at once
BLOCK_CHARS = 8_000_000  #: and their characters
_SLICE = 50_000  #: windows that are embedded at once
_PAIRS = 200_000  #: proposed pairs that are verified at once
_PAD = np.uint64(0x9E3779B97F4A7C15)


class Walk:
    """CGK walks over windows of ``width`` words, one for each table, and the steps at which the table looks.

    Every table has a walk of its own: a pair whose paths part early in one walk may stay together in the next.
    """

    def __init__(self, width: int, tables: int, seed: int = 0):
        self.width, steps = width, 3 * width
        self.tables = []
        for t in range(tables):
            rng = np.random.default_rng([seed, width, t])
            coins, mix = (rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (steps, 1))
            looks = np.sort(rng.choice(steps, min(SAMPLED, steps), replace=False))
            self.tables.append((coins[: looks[-1] + 1], set(looks.tolist()), mix[0]))

    def keys(self, words: np.ndarray, starts: np.ndarray, length: int | None = None) -> np.ndarray:
        """One key per table for each window of ``length`` words (the width if not given): (tables, windows)."""
        out = np.zeros((len(self.tables), len(starts)), np.uint64)
        end, last = starts + (length or self.width), len(words) - 1
        for t, (coins, looks, mix) in enumerate(self.tables):
            at = starts.astype(np.int64)
            for step, coin in enumerate(coins):
                here = np.where(at < end, words[np.minimum(at, last)], _PAD)
                if step in looks:
                    out[t] = (out[t] + here) * mix
                at += ((here * coin) >> np.uint64(63)).astype(np.int64)
        return out ^ (out >> np.uint64(29))


def tables_for(width: int, edits: int, recall: float, seed: int = 0) -> int:
    """How many tables make a pair ``edits`` edits apart meet in one at least with the probability ``recall``.

    Measured on random windows: the smallest number whose share of meeting pairs is a standard error above the target, for
    replacements, insertions and deletions alike.
    """
    if not edits:
        return 1
    rng, trials = np.random.default_rng([seed, width, edits]), 4000
    words = rng.integers(0, 2**63, (trials, width), dtype=np.uint64)
    other = words.copy()
    for row in other:
        row[rng.choice(width, min(edits, width), replace=False)] = rng.integers(0, 2**63, dtype=np.uint64)
    few = min(edits, width - 1)
    longer = np.stack([np.insert(row, np.sort(rng.integers(0, width + 1, edits)), rng.integers(0, 2**63, edits, dtype=np.uint64)) for row in words])
    shorter = np.stack([np.delete(row, rng.choice(width, few, replace=False)) for row in words])
    walk, at = Walk(width, 64, seed), np.arange(trials)
    own = walk.keys(words.ravel(), at * width)
    kinds = [own == walk.keys(x.ravel(), at * x.shape[1], x.shape[1]) for x in (other, longer, shorter)]
    met = np.min([np.logical_or.accumulate(k, axis=0).mean(axis=1) for k in kinds], axis=0)
    enough = np.flatnonzero(met >= recall + np.sqrt(recall * (1 - recall) / trials))
    return int(enough[0]) + 1 if len(enough) else 64


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` words in a row."""
    out = words[: max(0, len(words) - n + 1)]
    for k in range(1, n):
        more = words[k : k + len(out)]
        out = out * _PAD + (more ^ (more >> np.uint64(31)))
    return out


class _Known(dict):
    """Hashes of words, remembered; emptied between documents when there are very many."""

    def __missing__(self, word: str) -> int:
        self[word] = h = int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "big")
        return h


def _hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class _Windows:
    """The windows of one width of a block of items, indexed by their keys."""

    def __init__(self, width: int, items: list[tuple[int, np.ndarray]], edits: int, recall: float):
        # An item shorter than a window has to stand whole and unchanged.
        self.width, self.edits = width, edits if width >= WINDOW else 0
        self.walk = Walk(width, tables_for(width, self.edits, recall))
        self.words = np.concatenate([w for _, w in items])
        self.runs: dict[int, np.ndarray] = {}
        counts = np.array([len(w) - width + 1 for _, w in items])
        first = np.cumsum([0, *(len(w) for _, w in items[:-1])])
        self.item = np.repeat(np.arange(len(items)), counts)
        self.offset = np.concatenate([np.arange(c) for c in counts])
        self.start = first[self.item] + self.offset
        self.ids = [i for i, _ in items]
        self.sizes = [len(w) for _, w in items]
        keys = self.walk.keys(self.words, self.start)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def upto(self, words: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
        """The number of ``n``-word runs that some item has, up to each place of a document; only those that begin at the
        places ``at`` are looked up."""
        if n not in self.runs:
            self.runs[n] = np.unique(_grams(self.words, n))
        own, hit = self.runs[n], np.zeros(len(words) + 1, np.int64)
        if len(own) and len(at):
            doc = words[at]
            for k in range(1, n):
                more = words[at + k]
                doc = doc * _PAD + (more ^ (more >> np.uint64(31)))
            hit[at + 1] = own[np.minimum(np.searchsorted(own, doc), len(own) - 1)] == doc
        return np.cumsum(hit)

    def possible(self, words: np.ndarray, starts: np.ndarray, length: int, singles: np.ndarray) -> np.ndarray:
        """The windows of ``length`` words that may lie within the allowed edits of an item's; the others need no embedding.

        A word that no item has takes an edit of its own (``singles``: the number of words some item has, up to each
        place), and an edit spoils two pairs of neighbours at most. What edits leave of the longer window falls into one
        run more than there are edits, so the longest of them has a known least length.
        """
        starts = starts[singles[starts + length] - singles[starts] >= length - self.edits]
        for n, needed in ((2, length - 1 - 2 * self.edits), (self.longest_run(length), 1)):
            if 2 <= n <= length and needed > 0 and len(starts):
                at = np.zeros(len(words), bool)
                for j in range(length - n + 1):
                    at[starts + j] = True
                upto = self.upto(words, n, np.flatnonzero(at))
                starts = starts[upto[starts + length - n + 1] - upto[starts] >= needed]
        return starts

    def longest_run(self, length: int) -> int:
        return -(-(max(self.width, length) - self.edits) // (self.edits + 1))

    def matches(self, words: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document window (of ``length`` words), item window and edits of every pair within the allowed distance that a
        table proposes.

        Proposed pairs are verified in blocks, so that a phrase many windows share never fills the memory.
        """
        n_own, found = len(self.start), []
        for t, own in enumerate(self.walk.keys(words, starts, length)):
            lo, hi = np.searchsorted(self.keys[t], own, "left"), np.searchsorted(self.keys[t], own, "right")
            hit = np.flatnonzero(hi > lo)
            upto = np.cumsum((hi - lo)[hit])
            for part in np.split(hit, np.searchsorted(upto, np.arange(_PAIRS, upto[-1] if len(upto) else 0, _PAIRS))):
                reps = (hi - lo)[part]
                slot = np.repeat(lo[part], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                found.append(self.verified(words, starts, np.repeat(part, reps), self.order[t][slot], length))
        pairs, first = np.unique(np.concatenate([d * n_own + i for d, i, _ in found]), return_index=True)
        doc, own = np.divmod(pairs, n_own)
        return doc, own, np.concatenate([e for *_, e in found])[first]

    def found(self, words: np.ndarray, ends: np.ndarray, single: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Start, item window and fewest edits of each place of a document that matches; ``ends``: where each word's
        document ends; ``single``: whether some item has the word. In blocks of starts, each with the windows of all lengths.
        """
        starts, places = np.arange(len(words)), {}
        singles = np.concatenate([[0], np.cumsum(np.isin(words, self.words) if single is None else single)])
        for length in range(max(1, self.width - self.edits), self.width + self.edits + 1):
            places[length] = self.possible(words, starts[starts + length <= ends], length, singles)
        every = np.unique(np.concatenate(list(places.values())))
        for i in range(0, len(every), _SLICE):
            first, last = every[i], every[min(i + _SLICE, len(every)) - 1]
            hits = []
            for length, place in places.items():
                part = place[np.searchsorted(place, first) : np.searchsorted(place, last, "right")]
                doc, own, apart = self.matches(words, part, length)
                hits.append((part[doc], own, apart))
            at, own, apart = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.lexsort((apart, own, at))
            at, own, apart = at[order], own[order], apart[order]
            fewest = np.ones(len(at), bool)
            fewest[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
            yield at[fewest], own[fewest], apart[fewest]

    def verified(self, words: np.ndarray, starts: np.ndarray, doc: np.ndarray, own: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs whose words are at most ``edits`` edits apart, with their distance."""
        if length != self.width:
            a, b = words[starts[doc][:, None] + np.arange(length)], self.words[self.start[own][:, None] + np.arange(self.width)]
            if self.edits == 1:
                # One word apart: what the shorter window shares with both ends of the longer one covers it.
                long, short = (a, b) if length > self.width else (b, a)
                head = np.logical_and.accumulate(long[:, :-1] == short, axis=1).sum(axis=1)
                tail = np.logical_and.accumulate((long[:, 1:] == short)[:, ::-1], axis=1).sum(axis=1)
                apart = np.where(head + tail >= short.shape[1], 1, 2)
            else:
                far = [distance(x.tolist(), y.tolist(), self.edits) for x, y in zip(a, b, strict=True)]
                apart = np.array([self.edits + 1 if d is None else d for d in far], np.int64)
            keep = apart <= self.edits
            return doc[keep], own[keep], apart[keep]
        steps = np.arange(self.width)
        a, b = words[starts[doc][:, None] + steps], self.words[self.start[own][:, None] + steps]
        apart = (a != b).sum(axis=1)
        if self.edits > 1:
            # Between windows of one width, edits shift words by half their number at most; a word without an equal one
            # within that reach takes an edit of its own. What passes this bound is computed.
            near = a == b
            for s in range(1, self.edits // 2 + 1):
                near[:, s:] |= a[:, s:] == b[:, :-s]
                near[:, :-s] |= a[:, :-s] == b[:, s:]
            for k in np.flatnonzero((apart > self.edits) & ((~near).sum(axis=1) <= self.edits)):
                d = distance(a[k].tolist(), b[k].tolist(), self.edits)
                apart[k] = self.edits + 1 if d is None else d
        keep = apart <= self.edits  # for at most one edit between windows of one width, a replacement, the count of unequal words is the distance
        return doc[keep], own[keep], apart[keep]


class _Block:
    def __init__(self, items: list[tuple[int, str]], edits: int, recall: float):
        self.known = known = _Known()
        read = [(i, _hashes(alnum_words(t), known)) for i, t in items]
        read = [(i, w) for i, w in read if len(w)]
        self.vocabulary = np.unique(np.concatenate([w for _, w in read])) if read else np.zeros(0, np.uint64)
        widths = {min(WINDOW, len(w)) for _, w in read}
        self.windows = [_Windows(k, [(i, w) for i, w in read if min(WINDOW, len(w)) == k], edits, recall) for k in sorted(widths)]
        self.has = [np.isin(self.vocabulary, g.words) for g in self.windows]

    def scan(self, docs: list[tuple[int, list[str]]]) -> Iterator[tuple]:
        if len(self.known) > 500_000:
            self.known.clear()
        lengths = [len(w) for _, w in docs]
        words = _hashes([x for _, w in docs for x in w], self.known)
        owner = np.repeat(np.arange(len(docs)), lengths)
        ends = np.cumsum(lengths)[owner]
        found: dict[tuple[int, int, int], list] = {}
        place = np.minimum(np.searchsorted(self.vocabulary, words), max(0, len(self.vocabulary) - 1))
        inside = self.vocabulary[place] == words if len(self.vocabulary) else np.zeros(len(words), bool)
        for g, group in enumerate(self.windows):
            for part in group.found(words, ends, inside & self.has[g][place]):
                for at, w, e in zip(*part, strict=True):
                    entry = found.setdefault((owner[at], g, group.item[w]), [0, 0, set(), set()])
                    entry[0 if e == 0 else 1] += 1
                    entry[3].add((int(group.offset[w]), int(group.offset[w]) + group.width))
                    if e == 0:
                        entry[2].add((int(group.offset[w]), int(group.offset[w]) + group.width))
        for (d, g, item), (exact, near, sure, spans) in found.items():
            size = self.windows[g].sizes[item]
            yield docs[d][0], self.windows[g].ids[item], exact, near, merged(sure) / size, merged(spans) / size


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The query set in blocks of bounded size, streamed to the driver one after the other."""
    block, chars = [], 0
    for row in items.select("item_id", "text").filter("item_id is not null and text is not null").dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        chars += len(row.text)
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many partitions as there are cores; large scans stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


SCHEMA = "doc_id bigint, item_id bigint, exact_windows int, near_windows int, exact_coverage double, coverage double"


def leaks(documents: DataFrame, items: DataFrame, edits: int = 1, recall: float = 0.95) -> DataFrame:
    """doc_id, item_id, exact_windows, near_windows, exact_coverage, coverage: one row for each item found in a document.

    Words are runs of letters and digits after NFKC and lower case. A place of a document and a window of an item count as
    exact without edits and as near with up to ``edits`` word edits (replacements, insertions, deletions); exact ones are
    always found, near ones with the probability ``recall``.
    Coverage is the share of the item's words in matched windows. Items below eight words count only whole and exact.

    Rows with a null id are left out; null, blank and wordless texts hold nothing and wordless items occur nowhere.
    Repeated rows count once (of differing texts under one id the larger counts are kept). Other columns than doc_id
    and text, item_id and text are ignored. Empty tables give an empty result. Texts may be of any length.
    """
    spark = documents.sparkSession
    docs = spread(documents.select("doc_id", "text").filter("doc_id is not null and text is not null"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("exact_windows", pa.int32()), ("near_windows", pa.int32()), ("exact_coverage", pa.float64()), ("coverage", pa.float64())])
    out = None
    for part in _blocks(items):
        sent = spark.sparkContext.broadcast(part)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = None
            for batch in batches:
                block = block or _Block(sent.value, edits, recall)
                ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
                for i in range(0, len(ids), 500):
                    rows = list(block.scan([(d, alnum_words(t)) for d, t in zip(ids[i : i + 500], texts[i : i + 500], strict=True)]))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        found = docs.mapInArrow(scan, SCHEMA)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("exact_windows", "near_windows", "exact_coverage", "coverage")))


def leaked(found: DataFrame) -> DataFrame:
    """doc_id, item_id of the exact leaks."""
    return found.filter("exact_windows > 0").select("doc_id", "item_id")


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: documents that hold part of it, all of it, or something near, and the largest share found."""
    per = found.groupBy("item_id").agg(F.count_if(F.col("exact_windows") > 0).alias("n_docs"), F.count_if(F.col("exact_coverage") >= 1).alias("n_docs_whole"), F.count_if(F.col("exact_windows") == 0).alias("n_docs_near_only"), F.round(F.max("coverage"), 6).alias("max_coverage"))
    keys = items.select("item_id", "suite", "split").filter("item_id is not null").dropDuplicates(["item_id"])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return keys.join(per, "item_id", "left").select("item_id", "suite", "split", zero("n_docs"), zero("n_docs_whole"), zero("n_docs_near_only"), F.coalesce("max_coverage", F.lit(0.0)).alias("max_coverage"))
