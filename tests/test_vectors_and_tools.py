import math
import random

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import tools, vectors as V


def one(spark, expr, **cols):
    return spark.range(1).select(expr.alias("o")).first()["o"]


def arr(values):
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


def test_softmax_and_filters(spark):
    x = [1.0, 3.0, 2.0, 3.0]
    e = [math.exp(v - 3) for v in x]
    assert one(spark, V.softmax(arr(x))) == pytest.approx([v / sum(e) for v in e])
    p = [0.1, 0.4, 0.1, 0.4]
    assert one(spark, V.top_k_filter(arr(p), 1)) == pytest.approx([0, 0.5, 0, 0.5])  # ties at the threshold stay
    assert one(spark, V.top_p_filter(arr(p), 0.5)) == pytest.approx([0, 0.5, 0, 0.5])
    assert one(spark, V.top_p_filter(arr(p), 0.3)) == pytest.approx([0, 1, 0, 0])
    assert one(spark, V.argmax(arr(x))) == 1 and one(spark, V.argmax(arr([]))) is None
    assert [one(spark, V.pick(arr(p), F.lit(u))) for u in (0.0, 0.05, 0.3, 0.55, 0.99)] == [0, 0, 1, 2, 3]


def test_token_bans_and_penalty(spark):
    ids = lambda v: F.array(*map(F.lit, v)).cast("array<int>")
    assert one(spark, V.banned_ngram_tokens(ids([1, 2, 3, 1, 2]), 3)) == [3]
    assert one(spark, V.banned_ngram_tokens(ids([1, 2, 1]), 1)) == [1, 2]
    assert one(spark, V.banned_ngram_tokens(ids([1]), 3)) == []
    assert one(spark, V.repetition_penalty(arr([2, -2, 1]), ids([0, 1]), 2.0)) == [1, -4, 1]


def test_quantisation_round_trip(spark):
    rng = random.Random(0)
    x = [rng.uniform(-3, 3) for _ in range(33)]
    for most in (127, 7):
        q = V.quantize(arr(x), most)
        got = spark.range(1).select(q.alias("q")).select(V.dequantize(F.col("q")).alias("o"), "q.scale").first()
        assert max(abs(a - b) for a, b in zip(x, got.o, strict=True)) <= got.scale / 2 + 1e-6
    q = spark.range(1).select(V.quantize(arr(x), 7).alias("q"))
    row = q.select("q.values", V.unpack_int4(V.pack_int4(F.col("q.values")), F.size("q.values")).alias("o")).first()
    assert row["values"] == row.o
    assert one(spark, V.quantize(arr([0, 0])))["scale"] == pytest.approx(1 / 127)


def test_units_dates_and_schedule(spark):
    convert = lambda v, a, b: one(spark, tools.unit_convert(F.lit(v), F.lit(a), F.lit(b)))
    assert convert(1.0, "mi", "km") == pytest.approx(1.609344) and convert(212.0, "f", "c") == pytest.approx(100) and convert(0.0, "c", "k") == pytest.approx(273.15)
    assert convert(1.0, "mi", "kg") is None and convert(1.0, "x", "km") is None and convert(1.0, "c", "km") is None
    assert one(spark, tools.add_days(F.lit("2024-02-28"), F.lit(2))) == "2024-03-01" and one(spark, tools.add_days(F.lit("28.2.24"), F.lit(2))) is None
    assert one(spark, tools.days_between(F.lit("2024-01-01"), F.lit("2023-12-31"))) == -1
    assert one(spark, tools.lr_at(F.lit(0), "cosine", 1.0, 0.1, 10, 100)) == pytest.approx(0.1)
    assert one(spark, tools.lr_at(F.lit(1000), "linear", 1.0, 0.1, 10, 100)) == pytest.approx(0.1)


def test_routing_confidence_and_grounding(spark):
    route = lambda t, s=None: tuple(one(spark, tools.route(F.lit(t), F.lit(s).cast("double"))))
    assert route("  ") == ("ask_clarification", "fast") and route("Hello!") == ("chat", "fast") and route("what is 3 * 4") == ("tool_call", "fast")
    assert route("2024-01-02") == ("chat", "fast") and route("plan my trip and compare") == ("plan", "deep") and route("maybe compare") == ("reason", "verify") and route("weather", 1.2) == ("tool_call", "fast")
    assert one(spark, tools.confidence(F.lit(0.8), F.lit(None).cast("double"))) == 0.8
    assert one(spark, tools.tool_margin(arr([2, 1]))) == 0.5 and one(spark, tools.tool_margin(arr([1]))) == 1.0 and one(spark, tools.tool_margin(arr([0, 0]))) == 0.0
    said = F.lit("Meet on March 05, 2024 in OSLO with 3.5 kg")
    assert [one(spark, tools.grounded_string(F.lit(v), said)) for v in ("OSLO", "Oslo", "2024-03-05", "Rome")] == ["verbatim", "case_insensitive", "date_normalized", None]
    assert one(spark, tools.grounded_number(F.lit(3.5), said)) == "verbatim" and one(spark, tools.grounded_number(F.lit(5.0), said)) is None


def test_scorers(spark):
    def ok(kind, text, expected=None, needles=()):
        parts = F.array(*map(F.lit, needles)) if needles else F.array().cast("array<string>")
        return one(spark, tools.score_text(F.lit(kind), F.lit(text), F.lit(expected).cast("string"), parts))

    assert ok("exact", " a  b ", "a b") and not ok("exact", "a b.", "a b")
    assert ok("contains_ci", "The SUM is 4", None, ["sum", "4"]) and not ok("contains", "The SUM", None, ["sum"])
    assert ok("final_answer", "steps #### 12 apples", "12") and ok("final_answer", "x #### 3 #### 4", "4") and not ok("final_answer", "#### 13", "12")
    assert ok("clarify", "Which one?") and ok("refusal", "I can't do that.") and not ok("no_tool", '{"name": "x"}')
