import json
import random

import pytest

from corpuskit.llm import families as fam, records as rec
from corpuskit.session import Workspace

CHUNKS = "chunk_no bigint, source string, shard_sha256 string, doc_index bigint, chunk_index bigint, author string, entity_ids array<string>, gid int, keys string, group_chunks string"
MANIFEST = "source string, shard_format string, shards array<string>, group_chunks int, text_field string, chunk_no string, raw_json int"


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "path", "star", "clique", "empty"])
def test_contraction_finds_the_components(spark, shape):
    rng = random.Random(4)
    edges = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "path": [(i, i + 1) for i in range(150)], "star": [(0, i) for i in range(1, 300)], "clique": [(i, j) for i in range(20) for j in range(i)], "empty": []}[shape]
    edges = [(a, b) for a, b in edges if a != b]
    got = fam.contract(spark.createDataFrame(edges, "u bigint, v bigint"), Workspace(spark, "test"))
    want = components(edges)
    if not edges:
        assert got is None
        return
    roots = {r.vertex: r.root for r in got.collect()}
    label = {x: roots.get(x, x) for x in want}
    assert not set(roots.values()) & set(roots)
    assert len(set(zip(label.values(), want.values()))) == len(set(want.values())) == len(set(label.values()))


def test_relations(spark):
    m = spark.createDataFrame([("t", "text", ["x"], 2, None, "c", 1), ("j", "", ["x.jsonl.gz"], 2, None, "c", 1), ("e", None, ["y.txt"], None, None, "c", 1)], MANIFEST)
    rows = [
        (1, "t", "h", 0, 0, None, None), (2, "t", "h", 0, 1, "", []), (3, "t", "h", 0, 2, "Unknown", [None, " "]), (4, "j", "h", 5, 0, None, None), (5, "j", "h", 5, 9, "N/A", None),
        (6, "t", "k", 0, 0, "Ann  Lee", None), (7, "t", "l", 0, 0, "LEE, Ann", ["E1"]), (8, "t", "m", 0, 0, "bob", [" e1 "]), (9, "e", "n", 0, 7, "lee.ann", None), (10, "e", "n", 0, 8, None, None),
        (11, None, "h", 0, 0, None, None), (12, None, "h", 0, 0, None, None), (13, "t", None, 0, 0, None, None), (14, "t", None, 0, 0, "Anon.", None), (6, "t", "k", 0, 0, "Ann  Lee", None), (None, "t", "h", 0, 0, "Ann Lee", ["E1"]), (15, "t", "q", 0, None, "solo", ["e" * 10000]),
    ]
    df = spark.createDataFrame([(*r, 1, "k", "g") for r in rows], CHUNKS)
    got = {r.chunk_no: r.family_no for r in fam.families(df, m).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6, 10: 10, 11: 11, 12: 12, 13: 13, 14: 14, 15: 15}
    assert sorted((r.family_no, r.chunk_no) for r in fam.family_members(fam.families(df, m)).collect()) == [(1, 2), (4, 5), (6, 7), (6, 8), (6, 9)]
    assert fam.families(df.limit(0), m).count() == 0 and fam.families(df, m.limit(0)).count() == 15


def test_splits_keep_families_and_shares(spark):
    rng = random.Random(1)
    sizes = [3000, 400] + [rng.randint(1, 6) for _ in range(1500)]
    rows, n = [], 0
    for size in sizes:
        rows += [(n + i, n) for i in range(size)]
        n += size
    found = spark.createDataFrame(rows, "chunk_no bigint, family_no bigint")
    targets = spark.createDataFrame([("train", 0.9, 1), ("val", 0.05, 1), ("test", 0.05, 1), ("none", None, 1)], "split string, fraction double, w int")
    out = fam.assign_splits(found, targets, bins=64)
    per = {r.split: r["count"] / n for r in out.groupBy("split").count().collect()}
    assert per == pytest.approx({"train": 0.9, "val": 0.05, "test": 0.05}, abs=0.003)
    assert out.groupBy("family_no").agg({"split": "approx_count_distinct"}).filter("`approx_count_distinct(split)` > 1").count() == 0
    assert out.count() == n and sorted(map(tuple, out.collect())) == sorted(map(tuple, fam.assign_splits(found.repartition(5), targets, bins=64).collect()))
    assert fam.assign_splits(found.limit(0), targets).count() == 0 and fam.assign_splits(found, targets.limit(0)).filter("split is null").count() == n
    report = {r.split: r for r in fam.split_report(out, targets).collect()}
    assert report["none"].n_rows == 0 and report["train"].n_rows / n == pytest.approx(0.9, abs=0.003)


def classes(spark, rows, fields=(("s", "body"),)):
    m = spark.createDataFrame([(s, None, None, None, f, "c", 1) for s, f in fields], MANIFEST)
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "record_id bigint, source string, raw_json string, d1 int, whole string")
    c = rec.RecordClasses(df, m)
    return sorted(map(tuple, c.members().collect())), {r.kept_id: r.copies for r in c.collapsed().collect()}


def test_same_but_for_formatting(spark):
    a = {"id": 1, "body": "Hello,  World! 4+5", "title": "T", "attrs": {"x": [1, {"p": "Q", "r": None}], "y": 2.0}}
    b = {"attrs": {"y": 2, "x": [1.0, {"r": None, "p": "q"}]}, "meta": 7, "title": "t.", "body": "hello world 4 + 5", "author": None, "id": 2}
    other = [{**a, "title": "U"}, {**a, "author": "x"}, {**a, "attrs": {"x": [{"p": "Q", "r": None}, 1], "y": 2}}, {**a, "attrs": {**a["attrs"], "z": None}}, {**a, "body": "Hello World 45"}, {**a, "attrs": None}]
    rows = [(5, "s", json.dumps(a)), (3, "s", json.dumps(b)), (3, "s", json.dumps(b)), (9, "u", json.dumps({**a, "text": a["body"], "body": 0}))]
    rows += [(20 + i, "s", json.dumps(o)) for i, o in enumerate(other)]
    rows += [(40, "s", None), (41, "s", "{"), (42, "s", '{"body": " "}'), (43, "s", '{"body": 3}'), (44, None, '{"body": "x"}'), (None, "s", json.dumps(a)), (45, "s", '{"body": "' + "w " * 100_000 + '"}'), (46, "s", '{"body": "' + "W, " * 100_000 + '"}')]
    pairs, copies = classes(spark, rows)
    assert pairs == [(3, 5), (3, 9), (45, 46)] and copies[3] == 3 and copies[45] == 2 and len(copies) == 2 + len(other)


def test_hot_class_and_empty_table(spark):
    line = json.dumps({"body": "the same"})
    pairs, copies = classes(spark, [(i, "s", line if i % 3 else json.dumps({"body": f"own {i}"})) for i in range(900)])
    assert copies[1] == 600 and len(pairs) == 599
    assert classes(spark, [])[0] == []


def test_clashing_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(rec, "canonical", lambda value: (b"\0" * 16, repr(value["text"])))
    pairs, copies = classes(spark, [(1, "s", '{"body": "a"}'), (2, "s", '{"body": "b"}'), (3, "s", '{"body": "a"}')])
    assert pairs == [(1, 3)] and copies == {1: 2, 2: 1}


def test_canonical_numbers_and_depth():
    n = rec.Number
    same = lambda a, b: rec.canonical(a)[0] == rec.canonical(b)[0]
    assert same(n("1"), n("1.0")) and same(n("1e2"), n("100")) and not same(n("1"), "1") and not same(True, n("1")) and not same(None, "none") and not same(n("1.5"), n("15"))
    deep = "x"
    for _ in range(2000):
        deep = {"b": n("1"), "a": [deep]}
    turned = "X."
    for _ in range(2000):
        turned = {"a": [turned], "b": n("1.0")}
    assert rec.canonical(deep) == rec.canonical(turned) and rec.canonical(deep) != rec.canonical({"b": n("1"), "a": [deep]})


def test_deeply_nested_lines(spark):
    nest = lambda k, leaf: "[" * k + leaf + "]" * k
    line = lambda k, order: '{"body": "t", "attrs": {"x": ' + nest(k, '{"a": 1, "b": 2}' if order else '{"b": 2, "a": 1}') + "}}"
    pairs, _ = classes(spark, [(1, "s", line(450, True)), (2, "s", line(450, False)), (3, "s", line(2000, True)), (4, "s", line(2000, False))])
    assert pairs == [(1, 2), (3, 4)]


def test_canonical_large_numbers():
    n = rec.Number
    assert rec.canonical(n("1e999999999"))
