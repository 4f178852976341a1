"""Same or near-same records across splits (problem 4).

The prompts of the evaluation splits are normalised, made distinct and cut into passages, which are dealt to shards; an
Aho-Corasick automaton over each shard's passages scans the training texts that can hold one of them, matched intervals
are merged into the covered part of each evaluation prompt, and an exact word-level edit distance decides.

Why nothing is lost: with at most one edit for every eight words of the longer prompt, a prompt of n words can take part
in pairs of at most n // 7 edits. It is cut into n // 7 + 1 passages; one edit spoils one passage, so at least one stands
unchanged in any partner. Near-same prompts have equal numbers and signs, so texts meet only within their set of numbers.

Passages are cut around the prompt's rarest words, their anchors, and a passage goes to the shard of its anchor. A
training text goes to the shards of those of its words that are anchors: to as many as it has anchors, however many
evaluation prompts and shards there are. An anchor that many training texts have is dealt by a hash of the text over
several shards, all of which hold its passages. Rarity, and how many texts have a word, are read from counts in a fixed
number of buckets; whether a word is an anchor, from a filter of a fixed number of bits. Both have the same size for any
data, and what they get wrong by collisions costs a copy of a text, never a pair.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from corpuskit.functions.pytext import SIGNS, reading_words, storable
from corpuskit.llm._common import map_rows
from corpuskit.session import Workspace

PASSAGES = 20_000  #: passages of a shard, on average
PORTION = 50_000  #: training texts with one anchor that one shard scans, about
COUNTERS = 1 << 18  #: buckets in which words are counted (one number each on the driver and in every worker)
FILTER_BITS = 1 << 23  #: bits of the filter of anchors (1 MB)
_BITMAP = 1 << 15  # bits of one of Spark's bitmaps
_MIX = 0x9E3779B97F4A7C15
_ALL64 = (1 << 64) - 1


def edits_for(words: int) -> int:
    """The most edits by which a pair may differ whose longer prompt has so many words."""
    return words // 8


def numbers(words: list[str]) -> list[str]:
    return [w for w in words if w.isdecimal() or w in SIGNS]


def distance(a: list[str], b: list[str], most: int) -> int | None:
    """The word-level edit distance if it is at most ``most``, by the diagonal band that can hold it."""
    if abs(len(a) - len(b)) > most:
        return None
    spare = Counter(a)
    spare.subtract(b)
    if max(sum(x for x in spare.values() if x > 0), -sum(x for x in spare.values() if x < 0)) > most:
        return None
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (j > 0 and x != b[j - 1]) if j else i)
        row = new
        if min(row.values()) > most:
            return None
    return row[len(b)] if row.get(len(b), far) <= most else None


def passages(words: list[str], rarity: list) -> list[tuple[int, int, int]]:
    """(start, end, anchor) of word ranges that together are the whole prompt, one more than a pair may have edits, each
    around a word that is rare by ``rarity`` (a count for each word). Counts within a power of two are equal; of equally
    rare words those are taken that stand apart."""
    n, parts = len(words), len(words) // 7 + 1
    anchors = sorted(sorted(range(n), key=lambda i: (rarity[i].bit_length(), i * 2654435769 % 2**32))[:parts])
    ends = [(a + b + 1) // 2 for a, b in zip(anchors, anchors[1:], strict=False)]
    return list(zip([0, *ends], [*ends, n], anchors, strict=True))


def merged(spans: Iterable[tuple[int, int]]) -> int:
    """How many words the spans cover together."""
    total, upto = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


class _Router:
    """Where passages and texts go: the words' hashes within a set of numbers, their counts, the filter and the shards."""

    def __init__(self, counts: np.ndarray, portion: int, bits: np.ndarray | None = None, shards: int = 1):
        self.counts, self.portion, self.bits, self.shards = counts, portion, bits, shards

    @staticmethod
    def hashes(numbers_key: int, words: Iterable[str]) -> list[int]:
        """As Spark's xxhash64(numbers_key, word), unsigned."""
        seed = xxh64_intdigest(struct.pack("<q", numbers_key), 42)
        return [xxh64_intdigest(w.encode(), seed) for w in words]

    def count(self, h: int) -> int:
        return int(self.counts[h & (COUNTERS - 1)])

    def portions(self, h: int) -> int:
        return max(1, -(-self.count(h) // self.portion))

    def is_anchor(self, h: int) -> bool:
        """Whether a word is an anchor, or a set of numbers one of an evaluation prompt."""
        bit = (h >> 20) & (FILTER_BITS - 1)
        return bool(self.bits[bit >> 3] >> (bit & 7) & 1)

    def shard(self, h: int, portion: int) -> int:
        return (((h ^ portion * _MIX) * _MIX & _ALL64) >> 32) % self.shards

    def shards_of_text(self, numbers_key: int, text: str) -> set[int]:
        if not self.is_anchor(numbers_key):
            return set()
        found = [h for h in self.hashes(numbers_key, set(text.split(" "))) if self.is_anchor(h)]
        own = xxh64_intdigest(text.encode()) if any(self.portions(h) > 1 for h in found) else 0
        return {self.shard(h, own % self.portions(h)) for h in found}


class _Shard:
    """The evaluation prompts of one shard and, for each set of numbers, the automaton over the passages dealt to it.

    ``prompts``: (numbers key, text) to the prompt's ids and the spans of its passages here. An automaton is built when
    the first training text with its numbers comes.
    """

    def __init__(self, prompts: dict[tuple[int, str], tuple[tuple[int, int], set[tuple[int, int]]]]):
        self.prompts = [(text, ids, spans) for (_, text), (ids, spans) in prompts.items()]
        self.seen: list[set[tuple[int, int]]] = [set() for _ in self.prompts]
        self.of_key: dict[int, list[int]] = {}
        for i, (key, _) in enumerate(prompts):
            self.of_key.setdefault(key, []).append(i)
        self.automata: dict = {}

    def automaton(self, key: int):
        import ahocorasick

        found: dict[str, list[tuple[int, int, int]]] = {}
        for i in self.of_key[key]:
            text, _, spans = self.prompts[i]
            words = text.split(" ")
            for a, b in spans:
                found.setdefault(" " + " ".join(words[a:b]) + " ", []).append((i, a, b))
        out = ahocorasick.Automaton()
        for passage, places in found.items():
            out.add_word(passage, places)
        out.make_automaton()
        return out

    def scan(self, key: int, text: str) -> Iterator[tuple[tuple[int, int], int, set[tuple[int, int]]]]:
        """The ids of evaluation prompts near ``text``, with their distance and the matched passages."""
        if key not in self.of_key:
            return
        if key not in self.automata:
            self.automata[key] = self.automaton(key)
        hits: dict[int, set[tuple[int, int]]] = {}
        for _, places in self.automata[key].iter(f" {text} "):
            for i, a, b in places:
                hits.setdefault(i, set()).add((a, b))
        if hits:
            words = text.split(" ")
            for i, spans in hits.items():
                self.seen[i] |= spans
                other, ids, _ = self.prompts[i]
                others = other.split(" ")
                d = 0 if text == other else distance(words, others, edits_for(max(len(words), len(others))))
                if d is not None and (d == 0 or numbers(words) == numbers(others)):
                    yield ids, d, spans


_SPANS = "array<struct<a:int,b:int>>"
_DEALT = f"is_train boolean, shard int, numbers_key bigint, t1 bigint, t2 bigint, text string, spans {_SPANS}"
_FOUND = f"train1 bigint, train2 bigint, eval1 bigint, eval2 bigint, edits int, spans {_SPANS}"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _structs(spans: Iterable[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"a": a, "b": b} for a, b in sorted(spans)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's evaluation rows come first; its training rows then stream through the automaton.

    Pairs come out as they are found; at the end, for each evaluation prompt, the passages that any training text had
    (with null for the training text).
    """
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    schema = pa.schema([*((c, pa.int64()) for c in ("train1", "train2", "eval1", "eval2")), ("edits", pa.int32()), ("spans", span)])
    held: dict = {}
    shard = None
    for batch in batches:
        out: list[tuple] = []
        cols = [batch[c].to_pylist() for c in ("is_train", "numbers_key", "t1", "t2", "text")]
        for row, (train, key, t1, t2, text) in enumerate(zip(*cols, strict=True)):
            if not train:
                entry = held.setdefault((key, text), ((t1, t2), set()))
                entry[1].update((s["a"], s["b"]) for s in batch["spans"][row].as_py())
            elif held:
                shard = shard or _Shard(held)
                out += [(t1, t2, *ids, d, _structs(spans)) for ids, d, spans in shard.scan(key, text)]
        if out:
            yield _batch(out, schema)
    touched = [(None, None, *ids, None, _structs(spans)) for (_, ids, _), spans in zip(shard.prompts, shard.seen, strict=True) if spans] if shard else []
    if touched:
        yield _batch(touched, schema)


def _normalise(cols: dict[str, list]) -> dict[str, list]:
    words = [reading_words(p or "") for p in cols["prompt"]]
    keys = [int.from_bytes(blake2b(" ".join(numbers(w)).encode(), digest_size=8).digest(), "big", signed=True) for w in words]
    texts = [storable(" ".join(w)) for w in words]
    ids = [struct.unpack(">qq", blake2b(t.encode(), digest_size=16).digest()) for t in texts]
    return cols | {"text": texts, "numbers_key": keys, "t1": [a for a, _ in ids], "t2": [b for _, b in ids], "n_words": [len(w) for w in words]}


class CrossSplitOverlaps:
    """Pairs of a training and an evaluation example with the same or nearly the same prompt.

    ``examples`` needs example_id, source and messages (role, content); ``manifest`` source and split. Other columns are
    ignored. An example's split is its source's; examples of sources without an entry or with another split (null
    included) take no part, nor do those with a null id or without a word in their user turns (null or empty messages,
    null contents). Repeated deliveries count once; equal texts are scanned once and expanded to their examples at the
    end. Empty tables give no pairs. Texts are told apart by 128-bit hashes.
    """

    def __init__(self, examples: DataFrame, manifest: DataFrame, passages: int = PASSAGES, portion: int = PORTION):
        self.space = Workspace(examples.sparkSession, "overlap")
        splits = manifest.select("source", "split").filter(F.col("split").isin("train", "val", "test") & F.col("source").isNotNull()).dropDuplicates(["source"])
        users = F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["content"])
        rows = examples.select("example_id", "source", F.array_join(users, " ").alias("prompt")).filter(F.col("example_id").isNotNull() & (F.trim("prompt") != ""))
        rows = rows.join(splits, "source").select("example_id", "source", "split", (F.col("split") == "train").alias("is_train"), "prompt")
        rows = map_rows(rows, _normalise, "example_id string, source string, split string, is_train boolean, text string, numbers_key bigint, t1 bigint, t2 bigint, n_words int").filter("text <> ''")
        self.rows, self._each = self.space.write(rows, "prompts"), None
        found = self.space.write(self._found(passages, portion), "found")
        both = F.array_distinct(F.flatten(F.collect_list("spans")))
        covered = F.aggregate(both, F.lit(0), lambda n, s: n + s["b"] - s["a"])  # passages of one prompt never overlap
        #: train1, train2, eval1, eval2, edits, covered_words: one row per pair of distinct texts.
        self.pairs = self.space.write(found.filter("train1 is not null").groupBy("train1", "train2", "eval1", "eval2").agg(F.min("edits").alias("edits"), covered.alias("covered_words")), "pairs")
        #: eval1, eval2, covered_words: what training texts hold of each evaluation text, all of them together.
        self.covered = found.filter("train1 is null").groupBy("eval1", "eval2").agg(covered.alias("covered_words"))

    def _found(self, per_shard: int, portion: int) -> DataFrame:
        texts = self.space.write(self.rows.select("is_train", "numbers_key", "t1", "t2", "text").distinct(), "texts")
        context = texts.sparkSession.sparkContext
        train, held = texts.filter("is_train").drop("is_train"), texts.filter("not is_train").drop("is_train")
        word = train.select("numbers_key", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
        # At most COUNTERS rows of two numbers, whatever the data.
        buckets = word.groupBy(F.xxhash64("numbers_key", "word").bitwiseAND(F.lit(COUNTERS - 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toArrow()
        counts = np.zeros(COUNTERS, np.int64)
        counts[buckets["bucket"].to_numpy()] = buckets["n"].to_numpy()
        sent = context.broadcast(counts)

        def cut(cols: dict[str, list]) -> dict[str, list]:
            router, out = _Router(sent.value, portion), {c: [] for c in ("numbers_key", "t1", "t2", "text", "anchor", "portions", "spans")}
            for key, t1, t2, text in zip(*(cols[c] for c in ("numbers_key", "t1", "t2", "text")), strict=True):
                words = text.split(" ")
                own = router.hashes(key, words)
                by_anchor: dict[int, list[tuple[int, int]]] = {}
                for a, b, i in passages(words, [router.count(h) for h in own]):
                    by_anchor.setdefault(own[i], []).append((a, b))
                for h, spans in by_anchor.items():
                    for column, value in zip(out.values(), (key, t1, t2, text, h - (h >> 63 << 64), router.portions(h), _structs(spans)), strict=True):
                        column.append(value)
            return out

        cuts = self.space.write(map_rows(held, cut, f"numbers_key bigint, t1 bigint, t2 bigint, text string, anchor bigint, portions int, spans {_SPANS}"), "cuts")
        bit = F.shiftright("h", 20).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
        # FILTER_BITS / 8 bytes at most, whatever the data.
        maps = cuts.select(F.explode(F.array("anchor", "numbers_key")).alias("h")).select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for r in maps:
            bits[(r.part - 1) * _BITMAP // 8 : r.part * _BITMAP // 8] = np.frombuffer(r.bits, np.uint8)
        held_passages = cuts.agg(F.sum(F.size("spans") * F.col("portions"))).first()[0] or 0
        shards = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held_passages // per_shard))
        sent_bits = context.broadcast(bits)

        def deal_texts(cols: dict[str, list]) -> dict[str, list]:
            router = _Router(sent.value, portion, sent_bits.value, shards)
            return cols | {"shards": [sorted(router.shards_of_text(k, t)) for k, t in zip(cols["numbers_key"], cols["text"], strict=True)]}

        def deal_cuts(cols: dict[str, list]) -> dict[str, list]:
            router = _Router(sent.value, portion, None, shards)
            return cols | {"shards": [sorted({router.shard(h % (1 << 64), p) for p in range(n)}) for h, n in zip(cols["anchor"], cols["portions"], strict=True)]}

        kept = "numbers_key bigint, t1 bigint, t2 bigint, text string"
        dealt = map_rows(train, deal_texts, f"{kept}, shards array<int>").withColumns({"is_train": F.lit(True), "spans": F.lit(None).cast(_SPANS)})
        dealt = dealt.unionByName(map_rows(cuts, deal_cuts, f"{kept}, spans {_SPANS}, shards array<int>").withColumn("is_train", F.lit(False)))
        dealt = dealt.withColumn("shard", F.explode("shards")).select(*[c.split()[0] for c in _DEALT.split(", ")])
        dealt = dealt.repartition(shards, "shard").sortWithinPartitions("is_train")
        return dealt.mapInArrow(_scan, _FOUND)

    def _examples(self) -> DataFrame:
        """Each example and text once, written once."""
        if self._each is None:
            self._each = self.space.write(self.rows.select("example_id", "source", "split", "is_train", "t1", "t2", "n_words").distinct(), "examples")
        return self._each

    def examples(self) -> DataFrame:
        """train_id, train_source, eval_id, eval_source, eval_split, edits, coverage: one row per pair of examples."""
        rows = self._examples()
        train = rows.filter("is_train").select(F.col("example_id").alias("train_id"), F.col("source").alias("train_source"), F.col("t1").alias("train1"), F.col("t2").alias("train2"))
        held = rows.filter("not is_train").select(F.col("example_id").alias("eval_id"), F.col("source").alias("eval_source"), F.col("split").alias("eval_split"), F.col("t1").alias("eval1"), F.col("t2").alias("eval2"), "n_words")
        joined = self.pairs.join(held, ["eval1", "eval2"]).join(train, ["train1", "train2"])
        return joined.select("train_id", "train_source", "eval_id", "eval_source", "eval_split", "edits", F.round(F.col("covered_words") / F.col("n_words"), 6).alias("coverage"))

    def found(self) -> DataFrame:
        """first_id, second_id: the two examples of each pair, the smaller id first."""
        return self.examples().select(F.least("train_id", "eval_id").alias("first_id"), F.greatest("train_id", "eval_id").alias("second_id"))

    def report(self) -> DataFrame:
        """Per split and source: examples, how many take part in an overlap (and how many read the same), and pairs; for
        evaluation splits also the mean share of a prompt's words that stands in training prompts with the same numbers,
        passage by passage, and how many prompts stand there as a whole (n_covered), whether as pairs or not.

        Pairs are counted from the numbers of examples of each text; no pair of examples is ever made.
        """
        rows = self._examples()
        sizes = rows.groupBy("is_train", "t1", "t2").agg(F.count(F.lit(1)).alias("n"))
        ends = []
        for own, other, is_train in (("train", "eval", True), ("eval", "train", False)):
            mates = sizes.filter(F.col("is_train") != is_train).select(F.col("t1").alias(f"{other}1"), F.col("t2").alias(f"{other}2"), "n")
            per = self.pairs.join(mates, [f"{other}1", f"{other}2"]).groupBy(F.col(f"{own}1").alias("t1"), F.col(f"{own}2").alias("t2")).agg(F.sum("n").alias("p"), F.min("edits").alias("e"))
            ends.append(per.withColumn("is_train", F.lit(is_train)))
        # One row for each text that has anything to report: its pairs, its least edits, and what of it is covered.
        part = self.covered.select(F.col("eval1").alias("t1"), F.col("eval2").alias("t2"), F.lit(None).cast("bigint").alias("p"), F.lit(None).cast("int").alias("e"), F.lit(False).alias("is_train"), "covered_words")
        texts = ends[0].unionByName(ends[1]).withColumn("covered_words", F.lit(None).cast("int")).unionByName(part)
        texts = self.space.write(texts.groupBy("is_train", "t1", "t2").agg(F.max("p").alias("p"), F.max("e").alias("e"), F.max("covered_words").alias("covered_words")), "by-text")
        share = F.when(~F.col("is_train"), F.coalesce("covered_words", F.lit(0)) / F.col("n_words"))
        each = rows.join(texts, ["is_train", "t1", "t2"], "left").groupBy("split", "source", "example_id").agg(F.sum("p").alias("p"), F.min("e").alias("e"), F.max(share).alias("c"))
        return each.groupBy("split", "source").agg(
            F.count(F.lit(1)).alias("n_examples"), F.count("p").alias("n_overlapping"), F.count_if(F.col("e") == 0).alias("n_same"), F.coalesce(F.sum("p"), F.lit(0)).cast("bigint").alias("n_pairs"),
            F.round(F.avg("c"), 6).alias("mean_coverage"), F.count_if(F.col("c") >= 1).alias("n_covered"),
        )
