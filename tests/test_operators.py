import gzip
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.functions.pytext import reading_text
from corpuskit import session
from corpuskit.operators import bpe, chat, chunking, contamination, curriculum, dedup, evaluation, gates, memory, metrics, mixture, packing, pipeline, retrieval, sampling
from corpuskit.sources import shards

WORDS = "river stone lamp bread cloud train paper glass horse field sun moon salt tree bird".split()


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- chunks -----------------------------------------------------------------------------------------------------------


def test_pack_paragraphs_keeps_limits_and_order():
    rng = random.Random(1)
    for _ in range(200):
        paragraphs = [". ".join(text_of(rng, rng.randint(1, 9)) for _ in range(rng.randint(1, 4))) + "." for _ in range(rng.randint(0, 6))]
        limit = rng.randint(16, 120)
        out = chunking.pack_paragraphs(paragraphs, limit)
        assert all(0 < len(c) <= limit for c in out)
        assert " ".join(out).split() == " ".join(paragraphs).split()
        # Greedy: a chunk's first piece would not have fitted before it.
        for a, b in zip(out, out[1:]):
            assert len(a) + 2 + len(b.split("\n\n")[0]) > limit
    assert chunking.pack_paragraphs(["x" * 50], 20) == ["x" * 20]  # a longer word is cut off


def test_chunk_documents(spark):
    docs = spark.createDataFrame([(1, ["one two three four", "five six"], True), (2, ["seven"], False), (3, [], True)], "doc_id int, paragraphs array<string>, is_text boolean")
    rows = chunking.chunk_documents(docs, 20, 1, F.col("is_text")).orderBy("doc_id", "chunk_index").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, "one two three four"), (1, 1, 1, "five six"), (2, 0, 0, "seven")]


# --- duplicates -------------------------------------------------------------------------------------------------------


def greedy(items, similar):
    kept, out = [], {}
    for i, x in items:
        for j, y in kept:
            if similar(x, y):
                out[i] = "near"
                break
        else:
            kept.append((i, x))
            out[i] = "kept"
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = [text_of(rng, rng.randint(4, 30)) for _ in range(8)]
    texts = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(rng.choice([" ".join(w), " ".join(w).upper() + "!", "  ".join(w)]))
    return list(enumerate(texts + ["", "...", "one"]))


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash_dedup_is_greedy_in_order(spark, seed):
    items = corpus(seed)
    a, b = (np.array(x, np.uint64)[:, None] for x in dedup.coefficients(0, 64))

    def signature(t):
        w = reading_text(t).split()
        g = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        return ((a * np.array([zlib.crc32(x.encode()) for x in g], np.uint64) + b) % np.uint64(4294967291)).min(axis=1)

    def similar(x, y):
        return any((x[i : i + 4] == y[i : i + 4]).all() for i in range(0, 64, 4)) and (x == y).mean() >= 0.8

    want, firsts = {}, {}
    unique = []
    for i, t in items:
        k = reading_text(t)
        if k not in firsts:
            firsts[k] = i
            unique.append((i, signature(t)))
    heads = greedy(unique, similar)
    for i, t in items:
        f = firsts[reading_text(t)]
        want[i] = heads[i] if i == f else "near" if heads[f] == "near" else "exact"
    got = dedup.dedup_texts(spark.createDataFrame(items, "id int, text string"), "near")
    assert {r.id: r.decision for r in got.collect()} == want
    assert "near" in want.values() and "exact" in want.values()


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_dedup_is_greedy_in_order(spark, seed):
    import re

    items = corpus(seed)

    def shingles(t):
        w = re.findall("[a-z0-9]+", t.lower())
        return {" ".join(w)} if 0 < len(w) < 3 else {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}

    unique, firsts = [], {}
    for i, t in items:
        k = " ".join(re.findall("[a-z0-9]+", t.lower()))
        if k not in firsts:
            firsts[k] = i
            unique.append((i, shingles(t)))
    heads = greedy(unique, lambda x, y: len(x & y) >= 0.6 * len(x | y))
    got = {r.id: r.decision for r in dedup.dedup_examples(spark.createDataFrame(items, "id int, text string"), 0.6).collect()}
    assert {i: d for i, d in got.items() if i in heads} == heads and "near" in heads.values()


def test_dedup_modes_and_report(spark):
    df = spark.createDataFrame([(1, "Same text here"), (2, "same TEXT, here"), (3, "other"), (4, None), (5, "")], "id int, text string")
    assert [r.decision for r in dedup.dedup_texts(df, "exact").orderBy("id").collect()] == ["kept", "exact", "kept", "kept", "exact"]
    assert dedup.dedup_report(dedup.dedup_texts(df, "none")).first().kept == 5
    with pytest.raises(ValueError):
        dedup.dedup_texts(df, "near", num_perm=10, n_bands=3)


@pytest.mark.parametrize("small", [0, 1 << 40])
def test_first_deliveries(spark, monkeypatch, small):
    monkeypatch.setattr(session, "SMALL_BYTES", small)
    rows = [(1, 5, "b"), (1, 3, "c"), (1, 3, "a"), (2, None, "z"), (2, 9, "y"), (3, 1, "x"), (3, 1, "x"), (None, 2, "n"), (None, 1, "m"), (4, None, None)]
    df = spark.createDataFrame(rows, "k int, at int, text string")
    got = sorted(map(tuple, dedup.first_deliveries(df, "k", "at").collect()), key=str)
    assert got == sorted([(1, 3, "a"), (2, 9, "y"), (3, 1, "x"), (None, 1, "m"), (4, None, None)], key=str)
    assert dedup.first_deliveries(df.limit(0), "k", "at").count() == 0


def test_paragraph_dedup(spark):
    long = "This is the footer that every single page carries at its end."
    docs = spark.createDataFrame([(1, ["a", long]), (2, [long]), (3, ["a", long.upper(), "b"])], "doc_id int, paragraphs array<string>")
    rows = dedup.paragraph_dedup(docs).orderBy("doc_id").collect()
    assert [(r.paragraphs, r.removed) for r in rows] == [(["a", long], 0), ([], 1), (["a", "b"], 1)]


# --- contamination, samples, splits -----------------------------------------------------------------------------------


def test_contamination(spark):
    rng = random.Random(5)
    secret = text_of(rng, 12)
    texts = [(i, text_of(rng, 30)) for i in range(20)] + [(20, "before " + secret.upper().replace(" ", ",  ") + " after")]
    grams = contamination.eval_ngrams(spark.createDataFrame([(secret,)], "text string"), 8)
    got = contamination.contaminated(spark.createDataFrame(texts, "id int, text string"), grams, 8)
    assert [r.id for r in got.collect()] == [20]


def test_overlap_kinds(spark):
    schema = "id string, prompt string, full string"
    train = spark.createDataFrame([("t1", "user:What is 2 + 2?", "a"), ("t2", "user:Hi", "b")], schema)
    held = spark.createDataFrame([("e1", "user:What is 2 + 2?", "x"), ("e2", "user: what is 2+2", "y"), ("e3", "user:new", "b!"), ("e4", "user:?", "z")], schema)
    got = {r.id: (r.exact_prompt, r.exact_full, r.normalized_prompt, r.normalized_full) for r in contamination.check_overlap(train, held).collect()}
    assert got == {"e1": (True, False, True, False), "e2": (False, False, False, False), "e3": (False, False, False, True), "e4": (False, False, False, False)} | {"e2": got["e2"]}
    with pytest.raises(contamination.ContaminationError):
        contamination.assert_no_contamination(train, held)


def test_bottom_k_is_order_free(spark):
    rows = [(i,) for i in range(500)]
    random.Random(0).shuffle(rows)
    a = {r.id for r in sampling.bottom_k(spark.createDataFrame(rows, "id int").repartition(7), 50, 3, F.col("id"), "id").collect()}
    b = {r.id for r in sampling.bottom_k(spark.range(500), 50, 3, F.col("id"), "id").collect()}
    assert a == b and len(a) == 50
    assert sampling.bottom_k(spark.range(5), 0, 3, F.col("id")).count() == 0


def test_group_split_sizes(spark):
    groups = spark.range(50).select(F.col("id").cast("string").alias("group_key"))
    got = {r.split: r["count"] for r in sampling.split_groups(groups, 0.1, 0.1, 0).groupBy("split").count().collect()}
    assert got == {"train": 40, "val": 5, "test": 5}
    assert {r.split for r in sampling.split_groups(groups.limit(2), 0.4, 0.4, 0).collect()} == {"train"}
    with pytest.raises(ValueError):
        sampling.split_groups(groups, 0.5, 0.5, 0)


def test_stratified_split_and_quotas(spark):
    df = spark.range(50).withColumn("s", F.when(F.col("id") < 40, "big").otherwise(None))
    got = {(r.stratum, r.split): r["count"] for r in sampling.stratified_split(df, F.col("s"), 0.8, 0.1, 0.1).groupBy("stratum", "split").count().collect()}
    assert got == {("big", "train"): 32, ("big", "val"): 4, ("big", "test"): 4, (None, "train"): 8, (None, "val"): 1, (None, "test"): 1}
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "name string, weight double")
    assert {r.name: r.quota for r in sampling.largest_remainder(w, 10).collect()} == {"a": 4, "b": 3, "c": 3}


def test_epoch_order(spark):
    ex = spark.createDataFrame([("a", i) for i in range(3)] + [("b", i) for i in range(10)], "source string, id int")
    q = spark.createDataFrame([("a", 8), ("b", 4), ("c", 0)], "source string, quota int")
    rows = sampling.epoch_order(ex, q, 0, 1).collect()
    assert sum(r.source == "a" for r in rows) == 8 and sum(r.source == "b" for r in rows) == 4
    assert max(sum(r.source == "a" and r.id == i for r in rows) for i in range(3)) == 3 and len({(r.source, r.id, r.repeat) for r in rows}) == 12
    assert {r.order_key for r in rows} != {r.order_key for r in sampling.epoch_order(ex, q, 0, 2).collect()}


# --- examples, rows, ranking ------------------------------------------------------------------------------------------


def test_render_masks_and_errors(spark):
    m = "array<struct<role:string,content:string,train:boolean>>"
    rows = [
        ("1", None, [("user", "Hi", None), ("system", "Be kind", None), ("assistant", "Yö", None)], ["t"], None, None),
        ("2", "plain text", None, None, None, None),
        ("3", None, [("user", "Q", None)], None, "answer", "A"),
        ("4", None, [("user", "Q", True)], None, None, None),
        ("5", None, [("robot", "Q", None)], None, None, None),
        ("6", None, [("assistant", " ", None)], None, None, None),
        ("7", " ", None, None, None, None),
        ("8", "x", [("user", "Q", None)], None, None, None),
    ]
    df = spark.createDataFrame(rows, f"id string, text string, messages {m}, tools array<string>, target_type string, target_text string")
    norm = chat.normalize_examples(df)
    errors = {r.id: r.error for r in norm.collect()}
    assert [k for k, v in errors.items() if v is None] == ["1", "2", "3"]
    out = {r.id: r for r in norm.filter("error is null").withColumn("s", chat.segments()).select("id", "category", chat.rendered_text(F.col("s")).alias("t"), chat.byte_tokens("s").alias("b"), chat.token_count(F.col("s")).alias("n"), chat.loss_token_count(F.col("s")).alias("l")).collect()}
    assert out["1"].t == "<BOS>tools: t\nsystem:\nBe kind\nuser:\nHi\nassistant:\nYö<EOS>"
    assert out["2"].t == "<BOS>plain text<EOS>" and out["3"].t == "<BOS>user:\nQ\nassistant:\nA<EOS>" and out["3"].category == "answer"
    for r in out.values():
        assert len(r.b.ids) == len(r.b.labels) == r.n and sum(x != -100 for x in r.b.labels) == r.l and r.b.labels[0] == -100
    text = spark.createDataFrame([(out["1"].b.ids,)], "ids array<int>").select(chat.decode_bytes(chat.before_eos(F.col("ids"))).alias("t")).first().t
    assert text == out["1"].t.replace("<BOS>", "").replace("<EOS>", "")


def test_overflow(spark):
    df = spark.createDataFrame([(1, [1, 5, 6], [-100, -100, 6]), (2, [1, 5], [-100, 5])], "id int, ids array<int>, labels array<int>")
    states = lambda p: [(r.overflow, len(r.ids)) for r in chat.apply_overflow(df, 2, p).orderBy("id").collect()]
    assert states("drop") == [("dropped", 0), (None, 2)] and states("truncate") == [("dropped", 0), (None, 2)]
    with pytest.raises(Exception, match="longer"):
        chat.apply_overflow(df, 2, "error").collect()


@pytest.mark.parametrize("n", [0, 1, 500])
def test_pack_rows_is_next_fit(spark, n):
    rng = random.Random(n)
    lengths = [rng.randint(1, 20) for _ in range(n)]
    got = packing.pack_rows(spark.createDataFrame(list(enumerate(lengths)), "id int, length int").repartition(5), 32, "length", "id").orderBy("id").collect()
    row, used, want = -1, 99, []
    for x in lengths:
        if used + x > 32:
            row, used, seg = row + 1, 0, 0
        used, seg = used + x, seg + 1
        want.append((row, seg))
    assert [(r.row_no, r.segment_no) for r in got] == want
    with pytest.raises(Exception, match="outside"):
        packing.pack_rows(spark.createDataFrame([(1, 33)], "id int, length int"), 32, "length", "id").collect()


def test_collate(spark):
    df = spark.createDataFrame([(0, 1, [1, 7], [-100, 7]), (0, 2, [1, 8, 2], [-100, -100, 2]), (1, 1, [1], [-100])], "row_no int, segment_no int, ids array<int>, labels array<int>")
    a, b = packing.collate_packed(df, 6).orderBy("row_no").collect()
    assert a.input_ids == [1, 7, 1, 8, 2, 0] and a.labels == [-100, 7, -100, -100, 2, -100] and a.segment_ids == [1, 1, 2, 2, 2, 0] and (a.n_examples, a.n_real, a.n_loss) == (2, 5, 2)
    assert b.input_ids == [1, 0, 0, 0, 0, 0]
    assert packing.micro_batches(spark.range(5).withColumnRenamed("id", "row_no"), 2).count() == 4


def test_bm25_against_a_plain_loop(spark):
    import math
    import re

    from corpuskit.functions.text import STOP_WORDS

    rng = random.Random(8)
    docs = [(i, text_of(rng, rng.randint(0, 12))) for i in range(30)]
    query = "the lamp and the lamp of bread"
    terms = lambda t: [w for w in re.findall("[a-z0-9]+", t.lower()) if w not in STOP_WORDS]
    d = {i: terms(t) for i, t in docs}
    avg = sum(map(len, d.values())) / len(d)
    want = {}
    for i, t in d.items():
        want[i] = sum(math.log(1 + (30 - df + 0.5) / (df + 0.5)) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for q in terms(query) if t.count(q) and (df := sum(q in x for x in d.values())))
    got = {r.doc: r.score for r in retrieval.bm25_rank_all(query, spark.createDataFrame(docs, "doc int, text string")).collect()}
    assert got == pytest.approx(want)


def test_cosine_top_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(80, 8))
    v[5] = 0
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id bigint, v array<double>").repartition(5)
    got = retrieval.cosine_top(df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("q")), df, 3).collect()
    n = v / np.where(np.linalg.norm(v, axis=1) == 0, 1, np.linalg.norm(v, axis=1))[:, None]
    for q in range(0, 80, 20):
        s = np.round(n @ n[q], 6)
        want = sorted((i for i in range(80) if i != q), key=lambda i: (-s[i], i))[:3]
        assert [r.vec_id for r in sorted((r for r in got if r.query == q), key=lambda r: r["rank"])] == want


def test_bpe():
    merges = bpe.Merges([(101, 102), (260, 103)])
    text = bytes([97, 98, 99]).decode() + " abc ab"
    ids = merges.encode(text)
    assert merges.decode(ids) == text and ids[0] == 261
    assert bpe.Merges.load(merges.save()).identity() == merges.identity()
    with pytest.raises(ValueError):
        bpe.Merges([(4, 999)])


def test_public_ranks_become_merges():
    import base64
    from pathlib import Path

    path = Path("/opt/tokenizers/byte_bpe_50k.tiktoken")
    if not path.exists():
        pytest.skip("no vocabulary")
    ranks = {base64.b64decode(a): int(b) for a, b in list(map(bytes.split, path.open("rb")))[:2000]}
    merges = bpe.merges_from_ranks(ranks)
    assert len(merges.merges) == sum(len(t) > 1 for t in ranks)
    assert merges.decode(merges.encode("the rain in the north")) == "the rain in the north"


# --- statistics and verdicts ------------------------------------------------------------------------------------------


def test_generation_and_grammar_metrics(spark):
    rows = spark.createDataFrame([("Good day. Nice to see you.", 5, "eos"), ("  ", 0, "eos"), ("abababababababab", 4, "max_new_tokens")], "generation string, tokens_generated int, finish_reason string")
    m = metrics.generation_metrics(rows).first()
    assert m.n == 3 and m.non_empty_rate == pytest.approx(2 / 3) and m.eos_rate == pytest.approx(2 / 3) and m.looping_rate == 0.5
    assert metrics.generation_metrics(rows.limit(0)).first().mean_repetition is None
    g = spark.createDataFrame([(1, "He paid 3.5 euros. then he left,quickly"), (2, "Fine.")], "id int, text string")
    known = spark.createDataFrame([("he",), ("paid",)], "word string")
    m = metrics.grammar_metrics(g, known).first()
    assert m.n == 2 and m.sentence_start_capitalized == 0.0 and m.terminator_fraction == 0.5
    assert m.space_after_punctuation == pytest.approx(0.5) and m.known_word_fraction == pytest.approx((3 / 7) / 2)


def test_evaluation_rollups(spark):
    rows = spark.createDataFrame([("1", "math", "final_answer", True, True, "4", None, None), ("2", "math", "final_answer", False, False, "5", None, None), ("3", "tools", "tool_call", None, True, "{}", "ok", True), ("4", "tools", "tool_call", None, False, "", "none", False), ("5", "spelling", "exact", None, True, '{"name": 1}', None, None)], "id string, category string, scorer string, paraphrase boolean, ok boolean, text string, status string, name_ok boolean")
    caps = {r.category: r for r in evaluation.capability_accuracy(rows).collect()}
    assert caps["math"].accuracy == 0.5 and caps["math"].paraphrase_accuracy == 1.0 and caps["tools"].paraphrase_accuracy is None
    t = evaluation.tool_behavior(rows).first()
    assert t.correct_tool_rate == 0.5 and t.no_call_rate == 0.5 and t.false_positive_call_rate == pytest.approx(1 / 3) and t.refusal_accuracy is None
    r = {x.category: x for x in evaluation.weighted_rollup(evaluation.capability_accuracy(rows)).collect()}
    assert r["grammar"].n == 1 and r["safety"].n == 0 and r["safety"].accuracy is None


def test_acceptance_cases(spark):
    call = "array<struct<tool:string,arguments:map<string,string>>>"
    rows = [("a", "positive", True, "t", 1, {"x": "1"}, [("t", {"x": "1", "y": "2"})]), ("b", "positive", True, "t", 1, {"x": "1"}, [("t", {"x": "2"})]), ("c", "irrelevant", False, None, 0, None, []), ("d", "irrelevant", False, None, 0, None, [("t", {})]), ("e", "parallel", True, "t", 2, None, [("t", {})])]
    out = evaluation.check_cases(spark.createDataFrame(rows, f"case_id string, category string, expect_call boolean, expected_tool string, expected_call_count int, expected_arguments map<string,string>, calls {call}"))
    assert [r.passed for r in out.orderBy("case_id").collect()] == [True, False, True, False, False]
    assert {r.category: r.pass_rate for r in evaluation.suite_summary(out).collect()}[None] == 0.4


def test_gates_and_regressions(spark):
    values = spark.createDataFrame([("a", 0.5), ("b", float("nan"))], "metric string, value double")
    checks = spark.createDataFrame([("a", 0.4, 0.6), ("b", 0.0, None), ("c", 0.0, None), ("a", None, None)], "metric string, min double, max double")
    assert sorted((r.metric, r.ok) for r in gates.check_metrics(checks, values).collect()) == [("a", False), ("a", True), ("b", False), ("c", False)]
    ok = spark.createDataFrame([("a", 0.4, None)], "metric string, min double, max double")
    assert gates.evaluate_gate(ok, values, {"stop_reason": "done", "stage": "s"}, "s").first().passed
    assert not gates.evaluate_gate(ok, values, {}).first().passed
    assert not gates.evaluate_gate(ok.limit(0), values, require_no_divergence=False).first().passed
    allowed = spark.createDataFrame([("a", "up", 0.1), ("z", "down", 0.0)], "metric string, direction string, allowed double")
    now = spark.createDataFrame([("a", 0.7)], "metric string, value double")
    assert sorted((r.metric, r.ok) for r in gates.regression_checks(now, values, allowed).collect()) == [("a", False), ("z", True)]


def test_report_paths(spark):
    df = spark.createDataFrame([('{"a": {"b": 2, "c": true, "d": "x"}}',)], "report string")
    got = gates.metrics_from_report(df, ["a.b", "a.c", "a.d", "a.e"]).collect()
    assert [(r.metric, r.value) for r in got] == [("a.b", 2.0)]


def test_memory(spark):
    writes = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "z"), (4, "c", "w")], "seq int, entry_id string, content string")
    assert [(r.entry_id, r.content) for r in memory.ring(writes, 2).collect()] == [("c", "w"), ("b", "y")]
    assert {r.entry_id: r.content for r in memory.upsert(writes).collect()} == {"a": "z", "b": "y", "c": "w"}


def test_mixture(spark):
    w = spark.createDataFrame([("a", "primary", 3.0), ("b", "primary", 1.0), ("a", "replay", 1.0)], "name string, role string, weight double")
    assert {r.name: r.weight for r in mixture.effective_mixture(w, 0.2).collect()} == pytest.approx({"a": 0.8, "b": 0.2})


def test_curriculum(spark):
    for g in curriculum.GENERATORS:
        train = curriculum.generate(spark, g.name, 5, "train")
        rows = curriculum.verified(train).collect()
        assert rows and all(r.ok and r.prompt and r.answer is not None for r in rows) and len({r.prompt for r in rows}) == len(rows)
    stage = curriculum.build_stage(spark, {"arith_direct": 1, "compare": 1}, 40, val_fraction=0.1).collect()
    prompts = {s: {r.prompt for r in stage if r.split == s} for s in ("train", "val", "test")}
    assert not prompts["train"] & prompts["val"] and not prompts["val"] & prompts["test"] and not prompts["train"] & prompts["test"]
    wrong = spark.createDataFrame([("arith", "What is 2 + 2?", "5", "final_answer")], "sub string, prompt string, answer string, score string")
    assert not curriculum.verified(wrong).first().ok


# --- shards and the pipeline ------------------------------------------------------------------------------------------


def test_shards(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one\\ntwo"}\n\n{"text": 3}\n{"text": "x\\n\\ny"}\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(json.dumps({"text": "zipped"}) + "\n")
    (tmp_path / "c.txt").write_bytes(b"first\nline\n\n \nsecond \xff\n")
    rows = shards.documents(spark, str(tmp_path / "a.jsonl"), "jsonl").orderBy("doc_index").collect()
    assert [r.paragraphs for r in rows] == [["one", "two"], ["x", "y"]]
    assert shards.documents(spark, str(tmp_path / "b.jsonl.gz"), "jsonl").first().paragraphs == ["zipped"]
    assert shards.documents(spark, str(tmp_path / "c.txt"), "text").first().paragraphs == ["first line", "second �"]
    (tmp_path / "bad.jsonl").write_text('{"text": "a"}\n{"text"\n')
    with pytest.raises(Exception, match="no JSON"):
        shards.documents(spark, str(tmp_path / "bad.jsonl"), "jsonl").collect()
    assert [(r.line_no, r.malformed) for r in shards.iter_examples(spark, str(tmp_path / "bad.jsonl")).orderBy("line_no").collect()] == [(1, False), (2, True)]
    assert shards.shard_format("x/Y.JSON.gz") == "jsonl" and shards.shard_format("x.txt") == "text" and shards.shard_format("x.txt", "jsonl") == "jsonl"
    digest, size = shards.file_sha256(tmp_path / "a.jsonl")
    row = shards.checksums(spark, str(tmp_path / "a.jsonl")).first()
    assert (row.sha256, row.bytes) == (digest, size) and shards.fetch_shard("a.jsonl", str(tmp_path), expected_sha256=digest)[1] == digest
    for bad in (lambda: shards.fetch_shard("a.jsonl", str(tmp_path), expected_sha256="0"), lambda: shards.fetch_shard("https://u:p@h/x"), lambda: shards.fetch_shard("none", str(tmp_path))):
        with pytest.raises(shards.ShardError) as e:
            bad()
        assert "u:p" not in str(e.value)


def test_read_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n [2] \n')
    assert shards.read_jsonl(spark, str(tmp_path / "x.jsonl")).count() == 2
    (tmp_path / "x.jsonl").write_text("nope\n")
    with pytest.raises(Exception, match="no JSON"):
        shards.read_jsonl(spark, str(tmp_path / "x.jsonl")).collect()


def test_manifest():
    entry = {"source": "s", "type": "local", "path": "a.txt", "chunk_chars": 300}
    assert shards.read_manifest(json.dumps({"datasets": [entry]}))[0].chunk_chars == 300
    for bad in ({**entry, "colour": 1}, {**entry, "chunk_chars": 3}, {**entry, "sha256": ["a", "b"]}, {**entry, "split": "dev"}, {"source": "s", "type": "local"}):
        with pytest.raises(shards.ShardError):
            shards.read_manifest(json.dumps({"entries": [bad]}))
    with pytest.raises(shards.ShardError):
        shards.read_manifest(json.dumps({"entries": [entry, entry]}))


def test_pipeline_counts_and_tampering(spark, tmp_path):
    rng = random.Random(11)
    secret = text_of(rng, 10)
    texts = [text_of(rng, 40) + "." for _ in range(30)]
    texts[7] = "So it goes: " + secret + " and on."
    texts[8] = texts[3].upper()
    texts[9] = "tiny"
    docs = spark.createDataFrame([(i, f"s{i % 2}", [t]) for i, t in enumerate(texts)], "doc_id bigint, source string, paragraphs array<string>")
    evals = spark.createDataFrame([(secret,)], "text string")
    corpus_ = pipeline.PreparedCorpus(docs, evals, pipeline.Settings(chunk_chars=1000, min_chars=10, dedup="near", validation=0.1, test=0.1))
    fates = {r.doc_id: r.fate for r in corpus_.chunks.collect()}
    assert fates[7] == "contaminated" and fates[9] == "short" and 8 not in fates and sum(f == "kept" for f in fates.values()) == 27
    counts = {r.source: r for r in corpus_.source_counts().collect()}
    assert counts["s0"].documents == 15 and counts["s1"].contaminated == 1 and counts["s1"].short_dropped == 1
    records = corpus_.records()
    assert {r.split: r.records for r in pipeline.split_counts(records).collect()} == {"train": 21, "val": 3, "test": 3}
    shards.write_corpus(records, str(tmp_path / "out"))
    assert shards.load_corpus(spark, str(tmp_path / "out")).count() == 27
    victim = next((tmp_path / "out/records/split=val").glob("*.json"))
    (victim.parent / ("." + victim.name + ".crc")).unlink()
    victim.write_text(victim.read_text().replace("river", "RIVER").replace("stone", "STONE").replace("lamp", "LAMP"))
    spark.catalog.clearCache()
    with pytest.raises(shards.ShardError):
        shards.load_corpus(spark, str(tmp_path / "out")).count()


def test_quota(spark):
    docs = spark.createDataFrame([(i, "s", [f"{w} stands alone in this paragraph number {i}"]) for i, w in enumerate(WORDS)], "doc_id bigint, source string, paragraphs array<string>")
    quota = spark.createDataFrame([("s", 4)], "source string, max_records int")
    got = pipeline.PreparedCorpus(docs, None, pipeline.Settings(min_chars=1), quota).chunks.filter("fate = 'kept'").collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3]


def test_large_document_numbers_stay_apart(spark):
    ids = [5, 2**43 + 5, 2**44 + 5, 2**63 - 1]
    docs = spark.createDataFrame([(i, "s", [f"{w} stands alone in this paragraph of its own"]) for i, w in zip(ids, WORDS)], "doc_id bigint, source string, paragraphs array<string>")
    got = pipeline.PreparedCorpus(docs, None, pipeline.Settings(dedup="near")).chunks.orderBy("ord").collect()
    assert [r.doc_id for r in got] == ids and {r.fate for r in got} == {"kept"}


def test_sources_have_their_own_chunks(spark):
    words = [f"word{i:02d}" for i in range(60)]
    rows = [(0, "a", [" ".join(words)], True, 100, 16, 2), (1, "b", [" ".join(reversed(words))], True, 200, 16, 3), (2, "c", ["x" * 20], False, 100, 16, 8), (3, "c", ["y" * 20], False, 100, 24, 8), (4, "d", ["z" * 20], None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, paragraphs array<string>, is_text boolean, chunk_chars int, min_chars int, group_chunks int")
    got = pipeline.PreparedCorpus(docs).chunks.orderBy("doc_id", "chunk_index").collect()
    assert [max(len(r.text) for r in got if r.doc_id == d) for d in (0, 1)] == [97, 195]
    assert [[r.group_index for r in got if r.doc_id == d] for d in (0, 1)] == [[0, 0, 1, 1, 2], [0, 0, 0]]
    assert [r.fate for r in got if r.doc_id > 1] == ["kept", "short", "short"]


def test_api_uses_each_source_of_the_manifest(spark, tmp_path):
    from corpuskit import api

    (tmp_path / "a.txt").write_text("\n\n".join(" ".join(f"p{p}w{i}" for i in range(40)) for p in range(4)))
    (tmp_path / "b.jsonl").write_text("".join(json.dumps({"text": f"short text {i:07d}"}) + "\n" for i in range(5)))
    entries = [{"source": "a", "path": "a.txt", "chunk_chars": 100}, {"source": "b", "path": "b.jsonl", "min_chars": 16}]
    (tmp_path / "m.json").write_text(json.dumps({"datasets": entries}))
    api.prepare_corpus(spark, str(tmp_path / "m.json"), str(tmp_path / "out"), str(tmp_path))
    texts = [(r.source, len(r.text)) for r in shards.load_corpus(spark, str(tmp_path / "out")).collect()]
    assert max(n for s, n in texts if s == "a") <= 100 and sum(s == "b" for s, _ in texts) == 5


def test_prepared_queries_use_the_manifest(spark):
    from corpuskit.plans import corpus_queries

    docs, quotas = corpus_queries.sourced_documents(spark, "/root/testdata/sf0.001")
    of = {r.source: r for r in docs.drop("paragraphs", "doc_id").distinct().collect()}
    assert (of["field_guide"].chunk_chars, of["field_guide"].min_chars, of["field_guide"].group_chunks, of["field_guide"].is_text) == (300, 20, 5, True)
    assert (of["mill_stories"].chunk_chars, of["mill_stories"].group_chunks, of["mill_stories"].is_text) == (600, 8, False)
    assert {r.source: r.max_records for r in quotas.collect()}["sum_cards"] == 5000


def test_streaming_first_deliveries(spark, tmp_path):
    from corpuskit.streaming import ingest

    data = spark.createDataFrame([(1, "a b", "2024-01-01 00:00:00"), (1, "a b", "2024-01-02 00:00:00"), (2, "A  b!", "2024-01-03 00:00:00")], "id int, text string, at string").withColumn("at", F.to_timestamp("at"))
    data.write.parquet(str(tmp_path / "in"))
    for fn, n in ((lambda s: ingest.first_deliveries(s, "id", "at"), 2), (lambda s: ingest.first_texts(s, "text", "at"), 1)):
        stream = fn(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(f"out{n}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(f"out{n}").count() == n


def test_registered_functions_run_as_rows(spark):
    from corpuskit.operators import toolcalls

    calls = [("calculator", '{"expression": "2*3"}'), ("calculator", '{"expression": "2*"}'), ("calculator", "{}"), ("nothing", "{}"), ("add_days", '{"date": "2024-01-31", "days": 1}'), (None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(calls)], "i int, name string, arguments string")
    got = [(r.value, r.error_code) for r in toolcalls.builtin_tools().execute(df).orderBy("i").collect()]
    assert got == [("6.0", None), (None, "failed"), (None, "invalid_arguments"), (None, "unknown_tool"), ("2024-02-01", None), (None, "unknown_tool")]
    ask = toolcalls.Registry([toolcalls.Tool("x", "", {"type": "object"}, lambda a: F.lit("done"), True)])
    one = spark.createDataFrame([("x", "{}")], "name string, arguments string")
    assert ask.execute(one).first().error_code == "confirmation_required" and ask.execute(one, F.lit(True)).first().value == "done"
    plan = toolcalls.run_plan(spark.range(1), toolcalls.builtin_tools(), [toolcalls.Step("calculator", {"expression": F.lit("1+1")}), toolcalls.Step("add_days", {"date": F.lit("2024-01-01"), "days": F.col("step_1.value").cast("double").cast("int")})])
    assert plan.first().step_2.value == "2024-01-03"
    checked = toolcalls.verified(spark.range(1), {"a": F.lit(True), "b": F.lit(None).cast("boolean")}).first()
    assert checked.verified_share == 0.5
    ex = spark.createDataFrame([("answer", "4", "What is 2 + 2?"), ("answer", "5", "2 + 2 = ?"), ("tool_call", '{"name":"t","arguments":{"a":1}}', "x"), ("answer", "hello", "Say hello")], "target_type string, target_text string, prompt string")
    assert [r.ok for r in ex.select(toolcalls.accepts(ex, {"type": "object", "required": ["a"]}).alias("ok")).collect()] == [True, False, True, True]


def test_api_prepares_a_corpus(spark, tmp_path):
    from corpuskit import api

    rng = random.Random(2)
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"text": text_of(rng, 30)}) + "\n" for _ in range(20)))
    (tmp_path / "b.txt").write_text("\n\n".join(text_of(rng, 30) for _ in range(20)))
    entries = [{"source": "a", "path": "a.jsonl", "sha256": shards.file_sha256(tmp_path / "a.jsonl")[0]}, {"source": "b", "path": "b.txt", "chunk_chars": 300}]
    (tmp_path / "m.json").write_text(json.dumps({"datasets": entries}))
    counts = api.prepare_corpus(spark, str(tmp_path / "m.json"), str(tmp_path / "out"), str(tmp_path), settings=pipeline.Settings(validation=0.1, test=0.1)).collect()
    assert {r.split for r in counts} == {"train", "val", "test"} and shards.load_corpus(spark, str(tmp_path / "out")).count() == sum(r.records for r in counts)
    rows = spark.createDataFrame([("1", "hello", None)], "id string, text string, messages array<struct<role:string,content:string,train:boolean>>")
    assert api.render(rows).first().text == "<BOS>hello<EOS>"


def test_attach_corpus(spark):
    stage = curriculum.build_stage(spark, {"arith_direct": 1.0}, 20)
    rng = random.Random(3)
    corpus_ = spark.createDataFrame([(str(i), text_of(rng, 40), "train" if i < 20 else "val" if i < 25 else "test") for i in range(30)], "id string, text string, split string")
    out = curriculum.attach_corpus(stage, corpus_, 0.8, {"arith_direct": 1.0}, 10, 3)
    assert out["train"].count() == 20 and out["val"].count() == 3 and out["lexicon"].count() == 10
    assert sum(r.weight for r in out["mixture"].collect()) == pytest.approx(1)


def test_check_contamination_of_examples(spark):
    from corpuskit import api

    m = "id string, messages array<struct<role:string,content:string>>, target_text string"
    train = spark.createDataFrame([("1", [("user", "a b")], "x")], m)
    assert api.check_contamination(train, spark.createDataFrame([("2", [("user", "c")], "x")], m)).first().contaminated is False
    assert api.check_contamination(train, spark.createDataFrame([("2", [("user", "A b!")], "x")], m), allow=True).first().normalized_prompt_overlap == 1
