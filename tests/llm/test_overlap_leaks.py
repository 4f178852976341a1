import random

import pytest

from corpuskit.functions.pytext import alnum_words, reading_words
from corpuskit.llm import leaks, overlap

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rng = random.Random(0)
    for _ in range(3000):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        most, true = rng.randint(0, 4), lev(a, b)
        assert overlap.distance(a, b, most) == (true if true <= most else None)


def mutate(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        i = rng.randrange(len(w) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            w.insert(i, rng.choice(WORDS))
        elif w and kind == 1:
            w.pop(min(i, len(w) - 1))
        elif w:
            w[min(i, len(w) - 1)] = rng.choice(WORDS)
    return w


EXAMPLES = "example_id string, source string, messages array<struct<role:string,content:string>>, split string, text string, is_train int, numbers_key string"


def examples(spark, rows):
    return spark.createDataFrame([(i, s, m, "x", "y", 1, "z") for i, s, m in rows], EXAMPLES)


def test_all_near_pairs_are_found(spark):
    rng = random.Random(2)
    rows = []
    for i in range(250):
        base = [rng.choice(WORDS) for _ in range(rng.choice([1, 3, 6, 7, 8, 9, 15, 16, 24, 40]))]
        if rng.random() < 0.4:
            base.insert(0, str(rng.randint(1, 3)))
        text = " ".join(base)
        for c in range(rng.randint(1, 3)):
            w = mutate(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 5]))
            rows.append((f"{i}-{c}", rng.choice(["tr", "va", "te", "tr"]), [("user", " ".join(w).upper()), ("assistant", text)]))
    m = spark.createDataFrame([("tr", "train", 1), ("va", "val", 1), ("te", "test", 1)], "source string, split string, text int")
    text = {i: reading_words(ms[0][1]) for i, _, ms in rows}
    side = {i: s == "tr" for i, s, _ in rows}
    want = set()
    for a in text:
        for b in text:
            if side[a] and not side[b] and text[a] and text[b]:
                n = max(len(text[a]), len(text[b]))
                if overlap.numbers(text[a]) == overlap.numbers(text[b]) and lev(text[a], text[b]) <= n // 8:
                    want.add((min(a, b), max(a, b)))
    for per_shard, portion in ((20_000, 50_000), (7, 9)):  # small shards and portions spread hot anchors
        found = overlap.CrossSplitOverlaps(examples(spark, rows), m, per_shard, portion)
        got = found.found().collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
        report = found.report().collect()
        for kind, mine in (("train", True), ("val", False), ("test", False)):
            own = {x for p in want for x in p if side[x] == mine and (mine or dict((i, s) for i, s, _ in rows)[x] == kind[:2])}
            assert sum(r.n_overlapping for r in report if r.split == kind) == len(own)
        assert sum(r.n_pairs for r in report if r.split == "train") == len(want) == sum(r.n_pairs for r in report if r.split != "train")
    assert len(want) > 50


def test_hashes_are_those_of_spark(spark):
    rows = [(k, w) for k in (0, 7, -(2**62)) for w in ("a", "größer", "x" * 100)]
    got = spark.createDataFrame(rows, "k bigint, w string").selectExpr("k", "w", "xxhash64(k, w) AS h").collect()
    assert all(overlap._Router.hashes(r.k, [r.w]) == [r.h % 2**64] for r in got)


def test_collisions_and_hot_anchors_lose_nothing(spark, monkeypatch):
    """Counts in four buckets and a filter of few bits: every text goes everywhere, and the pairs stay the same."""
    rng = random.Random(4)
    rows = [(f"{i}", "va" if i % 4 == 0 else "tr", [("user", " ".join(rng.choice(WORDS) for _ in range(rng.choice([2, 9, 17]))))]) for i in range(200)]
    m = spark.createDataFrame([("tr", "train"), ("va", "val")], "source string, split string")
    want = {tuple(r) for r in overlap.CrossSplitOverlaps(examples(spark, rows), m).found().collect()}
    monkeypatch.setattr(overlap, "COUNTERS", 4)
    assert want and {tuple(r) for r in overlap.CrossSplitOverlaps(examples(spark, rows), m, 5, 3).found().collect()} == want


def test_coverage_unites_training_texts(spark):
    m = spark.createDataFrame([("tr", "train"), ("va", "val")], "source string, split string")
    w = [f"w{i}" for i in range(40)]
    rows = [("e", "va", [("user", " ".join(w[:28]))]), ("a", "tr", [("user", " ".join([*w[:20], "other", "words", "here"]))]), ("b", "tr", [("user", " ".join(["start", *w[8:28], *w[30:]]))]), ("f", "va", [("user", "nothing of it")])]
    got = overlap.CrossSplitOverlaps(examples(spark, rows), m)
    assert got.found().count() == 0
    report = {r.split: r for r in got.report().collect()}
    assert report["val"].n_covered == 1 and report["val"].mean_coverage == 0.5 and report["train"].mean_coverage is None


def test_overlap_cases(spark):
    m = spark.createDataFrame([("tr", "train"), ("va", "val"), ("no", None), ("tr", "train")], "source string, split string")
    u = lambda *t: [("user", x) for x in t]
    rows = [
        ("a", "tr", u("What is 4+5?")), ("a", "tr", u("What is 4+5?")), ("b", "va", u("what IS 4 + 5")), ("c", "va", u("what is 5 + 4")), ("d", "va", u("what is", "4+5")), ("e", "no", u("What is 4+5?")), ("f", "zz", u("What is 4+5?")), ("g", None, u("What is 4+5?")),
        (None, "tr", u("What is 4+5?")), ("h", "tr", None), ("i", "va", []), ("j", "va", u(None)), ("k", "tr", u("...")), ("l", "va", u("?")), ("m", "tr", [("assistant", "what is 4+5")]), ("n", "tr", u("long " * 20_000)), ("o", "va", u("long " * 20_000 + "tail")),
    ]
    got = overlap.CrossSplitOverlaps(examples(spark, rows), m)
    assert sorted(map(tuple, got.found().collect())) == [("a", "b"), ("a", "d"), ("n", "o")]
    report = {(r.split, r.source): (r.n_examples, r.n_overlapping, r.n_same, r.n_pairs) for r in got.report().collect()}
    assert report == {("train", "tr"): (2, 2, 1, 3), ("val", "va"): (4, 3, 2, 3)}
    empty = overlap.CrossSplitOverlaps(examples(spark, []), m)
    assert empty.found().count() == 0 and overlap.CrossSplitOverlaps(examples(spark, rows), m.limit(0)).found().count() == 0


def brute(docs, items):
    out = set()
    for i, t in items:
        w = alnum_words(t or "")
        k = min(8, len(w))
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for d, x in docs:
            v = alnum_words(x or "")
            if any(tuple(v[j : j + k]) in grams for j in range(len(v) - k + 1)):
                out.add((d, i))
    return out


def test_exact_leaks_are_complete(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 5, 7, 8, 9, 20, 50])))) for i in range(40)] + [(98, None), (99, " ?! "), (5, None)]
    docs = []
    for d in range(120):
        parts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))]
        if rng.random() < 0.5:
            w = alnum_words(rng.choice(items[:40])[1])
            a = rng.randint(0, max(0, len(w) - 8))
            parts.append(" -- ".join(w[a : a + rng.randint(7, 20)]).upper())
        docs.append((d, " . ".join(parts)))
    docs += [(500, None), (501, ""), (502, "x" * 100_000), (503, "pad " * 300_000 + items[39][1]), (0, docs[0][1])]
    d = spark.createDataFrame([(*x, 1, "t") for x in docs], "doc_id bigint, text string, item_id int, coverage string")
    i = spark.createDataFrame([(*x, "s", "v", 2) for x in items], "item_id bigint, text string, suite string, split string, doc_id int")
    found = leaks.leaks(d, i)
    got = [tuple(r) for r in leaks.leaked(found).collect()]
    assert set(got) == brute(docs, items) and len(got) == len(set(got))
    report = {r.item_id: r for r in leaks.leak_report(found, i).collect()}
    assert len(report) == 42 and report[98].n_docs == 0
    assert leaks.leaks(d.limit(0), i).count() == 0 and leaks.leaks(d, i.limit(0)).count() == 0


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "red green blue")], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, "two three four five six seven eight nine ten"), (2, "green blue"), (3, "blue")], "item_id bigint, text string")
    whole = sorted(map(tuple, leaks.leaks(d, i).collect()))
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 1)
    assert sorted(map(tuple, leaks.leaks(d, i).collect())) == whole and len(whole) == 3


def test_near_windows_reach_the_target_recall(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(8))) for i in range(300)]
    docs = []
    for i, t in items:
        w = t.split()
        w[rng.randrange(8)] = "other"
        docs.append((i, "start " + " ".join(w) + " end"))
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), edits=1, recall=0.95)
    hits = {(r.doc_id, r.item_id) for r in found.filter("near_windows > 0").collect()}
    assert sum((i, i) in hits for i, _ in items) >= 0.9 * len(items) and all(a == b for a, b in hits)


def test_near_windows_by_insertion_and_deletion(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(8))) for i in range(300)]
    docs = []
    for i, t in items:
        for k in (0, 1):
            w = t.split()
            at = rng.randint(2, 5)
            w[at : at + k] = [] if k else ["other"]
            docs.append((2 * i + k, "start " + " ".join(w) + " end"))
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), edits=1, recall=0.95)
    hits = {(r.doc_id, r.item_id) for r in found.filter("near_windows > 0 and exact_windows = 0").collect()}
    for k in (0, 1):
        assert sum((2 * i + k, i) in hits for i, _ in items) >= 0.9 * len(items)
    assert all(a // 2 == b for a, b in hits)


@pytest.mark.parametrize("edits", [1, 2])
def test_reported_places_are_within_the_edits(edits):
    import numpy as np

    rng = random.Random(edits)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(12))) for i in range(8)]
    group = leaks._Block(items, edits, 0.95).windows[0]
    known = leaks._Known()
    text = [x for _, t in items for x in mutate(rng, t.split(), edits)]
    words = leaks._hashes(text, known)
    best = {}
    for s in range(len(text)):
        for w, o in enumerate(group.start):
            d = min((lev(words[s : s + n].tolist(), group.words[o : o + 8].tolist()) for n in range(8 - edits, 9 + edits) if s + n <= len(text)), default=99)
            if d <= edits:
                best[s, w] = d
    got = {(int(a), int(w)): int(e) for part in group.found(words, np.full(len(words), len(words))) for a, w, e in zip(*part, strict=True)}
    assert set(got) <= set(best) and len(got) >= 0.9 * len(best) and all(got[k] >= best[k] for k in got)
    assert {k for k, d in best.items() if d == 0} <= {k for k, e in got.items() if e == 0}


def test_cgk_turns_edits_into_few_differences():
    import numpy as np

    rng = np.random.default_rng(0)
    walk = leaks.Walk(8, 64)
    a = rng.integers(0, 2**63, (2000, 8), dtype=np.uint64)
    shifted = np.concatenate([a[:, 1:], rng.integers(0, 2**63, (2000, 1), dtype=np.uint64)], axis=1)
    other = rng.integers(0, 2**63, (2000, 8), dtype=np.uint64)
    starts = np.arange(2000) * 8
    meet = lambda b: (walk.keys(a.ravel(), starts) == walk.keys(b.ravel(), starts)).mean()
    assert meet(a) == 1.0 and meet(shifted) > 20 * max(meet(other), 1e-4)


def test_passages_cover_the_prompt():
    rng = random.Random(0)
    for n in range(1, 80):
        spans = overlap.passages([rng.choice(WORDS) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)])
        assert len(spans) == n // 7 + 1 and spans[0][0] == 0 and spans[-1][1] == n and all(a <= i < b for a, b, i in spans) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    shard = overlap._Shard({(0, "a b"): ((1, 2), {(0, 2)})})
    assert [x[0] for x in shard.scan(0, "a b")] == [(1, 2)] and not list(shard.scan(1, "a b"))
