import json
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpuskit.llm import sampling, splitting

MANIFEST = "source string, text_field string, chunk_chars int, min_chars int, chunk_overlap int, seed bigint, sample_share double, text string, record_id string"
RECORDS = "record_id bigint, source string, raw_json string, fetched_at timestamp, text_field int, chunk_chars string, piece_no int"


def manifest(spark, *rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], MANIFEST)


def check(text, limit, overlap, least):
    spans = splitting.split_spans(text, limit, overlap, least)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, _) in zip(spans, spans[1:]):
        assert a < c <= b and b - c <= overlap
    assert all(b - a <= limit for a, b in spans)
    return spans


@settings(max_examples=300, deadline=None)
@given(st.text("ab .\n!?é、。か", max_size=400), st.integers(2, 60), st.integers(0, 40), st.integers(1, 30))
def test_pieces_cover_the_text_within_the_limits(text, limit, overlap, least):
    check(text, limit, min(overlap, limit // 2), least)


def test_cuts_are_natural_and_pieces_balanced():
    rng = random.Random(0)
    for _ in range(200):
        sentences = [" ".join("word" * rng.randint(1, 2) for _ in range(rng.randint(3, 9))).capitalize() + "." for _ in range(rng.randint(5, 40))]
        text = "".join(s + rng.choice([" ", " ", " ", "\n\n"]) for s in sentences).strip()
        spans = check(text, 200, 30, 20)
        if len(spans) > 1:
            assert all(text[b - 1].isspace() for _, b in spans[:-1]) and all(a == 0 or text[a - 1].isspace() for a, _ in spans)
            assert min(b - a for a, b in spans) >= 20
            assert len(spans) <= -(-len(text) // 100) + 1


def test_a_paragraph_end_is_preferred():
    text = "a" * 40 + " b.\n\n" + "Cc dd ee. " * 6
    assert splitting.split_spans(text, 70)[0][1] == 45


def test_unbroken_stretches_keep_balanced_targets():
    rng = random.Random(1)
    for _ in range(100):
        parts = [rng.choice(["word " * rng.randint(1, 30), "Short one. ", "x" * rng.randint(100, 400) + " "]) for _ in range(12)]
        text = "".join(parts).strip()
        cutter = splitting._Cutter(text, 90, 0, 5)
        spans = check(text, 90, 0, 5)
        marks = {x for e in cutter.levels for x in e}
        for i, (a, b) in enumerate(spans[:-1], 1):
            # A hard cut stands only where no boundary lies within reach.
            lo, hi = max(a + 5, len(text) - (len(spans) - i) * 90), min(a + 90, len(text) - (len(spans) - i))
            assert b in marks or not any(lo <= x <= hi for x in marks)
        assert len(spans) <= 2 * -(-len(text) // 90) + 2


def test_no_choice():
    assert [b - a for a, b in check("x" * 1000, 100, 10, 20)] == [100] * 10
    check("x" * 95 + " " + "y" * 300, 100, 0, 50)
    family = "\U0001f468‍\U0001f469‍\U0001f467" * 30
    assert not any(family[a] == "‍" or family[a - 1] == "‍" for a, _ in splitting.split_spans(family, 40)[1:])
    assert splitting.split_spans("", 10) == [(0, 0)]
    assert len(check("long words " * 100_000, 1000, 50, 30)) > 1000


def test_defined_cases(spark):
    text = "One two three. " * 10
    line = lambda **o: json.dumps(o)
    rows = [
        (1, "s", line(body=text), None), (1, "s", line(body=text), None), (2, "s", line(text=text), None), (3, "s", "{" + line(body=text), None), (4, "s", None, None),
        (5, "s", line(body=None), None), (6, "s", line(body=[text]), None), (7, "s", line(body="  \t"), None), (8, "s", line(body=" " * 300 + "short"), None),
        (9, None, line(text="x " * 400), None), (10, "new", line(text="y " * 600), None), (11, "s", line(body="\ud800" + text), None), (12, "s", "[1]", None), (13, "s", '{"body": NaN}', None), (14, "s", '{"body": ' + "[" * 5000, None), (15, "s", line(body="12345" * 30), None), (16, "s", '{"body": ' + "1" * 5000 + "}", None),
    ]
    df = spark.createDataFrame([(*r, 1, "2", 3) for r in rows], RECORDS)
    m = manifest(spark, ("s", "body", 60, 5, 10, 0, 0.1), (None, None, None, None, None, None, None), ("s2", None, None, None, None, None, None))
    got = splitting.split_oversized(df, m).collect()
    assert {r.record_id for r in got} == {1, 10, 11, 15} == {r.record_id for r in splitting.oversized(df, m).collect()}
    for key in (1, 10, 11, 15):
        parts = sorted((r.piece_no, r.start_char, r.end_char, r.text) for r in got if r.record_id == key)
        assert [p[0] for p in parts] == list(range(len(parts))) and all(len(t) == b - a for _, a, b, t in parts)
    assert splitting.split_oversized(df.limit(0), m).count() == 0 and splitting.split_oversized(df, m.limit(0)).count() == 2


def sample_of(df):
    return {r.example_id for r in df.collect()}


def test_sample_is_stable(spark):
    m = manifest(spark, ("a", None, None, None, None, 7, 0.3), ("b", None, None, None, None, None, None), ("c", None, None, None, None, 1, 1.0), ("d", None, None, None, None, 1, 2.0))
    rows = [(f"{s}{i}", s, i % 5 + 1, 0, "x") for i in range(1000) for s in "abcdz"] + [(None, "a", 1, 0, "x"), ("n", None, 1, 0, "x"), ("a1", "a", 5, 0, "x")]
    df = spark.createDataFrame(rows, "example_id string, source string, batch_no int, seed int, threshold string")
    whole = sampling.stable_sample(df, m)
    s = sample_of(whole)
    assert s == sample_of(sampling.stable_sample(df.repartition(7).orderBy(F.rand(1)), m)) and whole.count() == len(s)
    assert 240 < sum(x[0] == "a" for x in s) < 360 and not any(x[0] in "bzn" for x in s) and sum(x[0] == "c" for x in s) == 1000 == sum(x[0] == "d" for x in s)
    upto = [sample_of(sampling.stable_sample(df, m, up_to_batch=k)) for k in range(1, 6)]
    assert all(a <= b for a, b in zip(upto, upto[1:])) and upto[-1] == s
    assert sample_of(sampling.stable_sample(df.filter("batch_no = 3"), m)) <= s
    lower = manifest(spark, ("a", None, None, None, None, 7, 0.1))
    assert sample_of(sampling.stable_sample(df, lower, earlier=sampling.strata(m))) == {x for x in s if x[0] == "a"}
    assert sampling.stable_sample(df.limit(0), m).count() == 0
    rates = {r.source: r for r in sampling.sample_rates(df, m).collect()}
    assert rates["c"].n_examples == 1000 and rates["c"].actual_share == 1.0 and rates["b"].n_selected == 0


def test_thresholds_are_remembered(spark, tmp_path):
    rows = spark.createDataFrame([(f"e{i}", "s", 1) for i in range(500)], "example_id string, source string, batch_no int")
    rate = lambda r: manifest(spark, ("s", None, None, None, None, 7, r))
    chosen = lambda m: {r.example_id for r in sampling.stable_sample(rows, m, sampling.remembered_thresholds(m, str(tmp_path / "t"))).collect()}
    first, lowered, raised = chosen(rate(0.3)), chosen(rate(0.1)), chosen(rate(0.5))
    assert first == lowered and first < raised and 100 < len(first) < 200
    assert chosen(rate(0.2)) == raised


def test_growth_adds_up(spark):
    m = manifest(spark, ("a", None, None, None, None, 7, 0.5))
    df = spark.createDataFrame([(str(i), "a", i % 3) for i in range(300)], "example_id string, source string, batch_no int")
    rows = sampling.sample_growth(df, m).orderBy("batch_no").collect()
    assert [r.selected for r in rows] == [sum(x.added for x in rows[: i + 1]) for i in range(3)]


def test_threshold_is_monotone(spark):
    r = spark.createDataFrame([(x / 50 - 0.2,) for x in range(80)], "r double").select(sampling.threshold(F.col("r")).alias("t")).collect()
    assert [x.t for x in r] == sorted(x.t for x in r) and {len(x.t) for x in r} == {14}
    assert spark.range(1).select(sampling.threshold(F.lit(None).cast("double")).alias("t")).first().t == "0" * 14
