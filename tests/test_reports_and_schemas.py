import dataclasses
import enum
import json
from typing import Annotated, Literal

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import jsonfns as J, pyground, toolschema
from corpuskit.operators import chat, curriculum, gates, reports


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


REPORT = "scope string, metric string, value double"
ALLOWED = "scope string, metric string, direction string, allowed double"


def test_comparison_within_a_stage(spark):
    allowed = rows(spark, [("own", "loss.val_loss", "up", 0.1), ("own", "grammar.word_like_fraction", "down", 0.05), ("own", "generation.absent", "up", 0.0), ("s0", "grammar.word_like_fraction", "down", 0.02), ("s0", "loss.val_loss", "up", 0.0)], ALLOWED)
    now = rows(spark, [("own", "loss.val_loss", 1.1), ("own", "grammar.word_like_fraction", 0.8), ("s0", "grammar.word_like_fraction", 0.9), ("s0", "loss.val_loss", 9.0)], REPORT)
    then = rows(spark, [("own", "loss.val_loss", 1.0), ("own", "grammar.word_like_fraction", 0.9), ("s0", "grammar.word_like_fraction", 0.91)], REPORT)
    promoted = rows(spark, [("s0", "grammar.word_like_fraction", 0.95)], REPORT)
    got = reports.compare_reports(now, then, allowed, "s1", "s1", promoted)
    ok = {(r.scope, r.against, r.metric): r.ok for r in got.collect()}
    assert ok == {("own", "previous", "loss.val_loss"): True, ("own", "previous", "grammar.word_like_fraction"): False, ("own", "previous", "generation.absent"): True, ("s0", "previous", "grammar.word_like_fraction"): True, ("s0", "promotion", "grammar.word_like_fraction"): False}
    assert tuple(reports.regressed(got).first()) == (True, 5, 2)
    # What was measured at promotion and is what the previous report has is compared once.
    assert {r.against for r in reports.compare_reports(now, then, allowed, "s1", "s1", then.filter("scope = 's0'")).collect()} == {"previous"}
    assert reports.compare_reports(now, None, allowed, "s1").count() == 0


def test_comparison_after_a_change_of_stage(spark):
    allowed = rows(spark, [("own", "loss.val_loss", "up", 0.1), ("own", "loss.text_val_loss", "up", 0.1), ("s0", "generation.mean_repetition", "up", 0.1)], ALLOWED)
    now = rows(spark, [("own", "loss.val_loss", 5.0), ("own", "loss.text_val_loss", 2.0), ("s0", "generation.mean_repetition", 0.5)], REPORT)
    parent = rows(spark, [("own", "loss.val_loss", 1.0), ("own", "loss.text_val_loss", 1.0), ("own", "generation.mean_repetition", 0.1)], REPORT)
    ok = lambda same: {(r.scope, r.metric): r.ok for r in reports.compare_reports(now, parent, allowed, "s1", "s0", same_held_out=same).collect()}
    assert ok(False) == {("s0", "generation.mean_repetition"): False}
    assert ok(True) == {("s0", "generation.mean_repetition"): False, ("own", "loss.text_val_loss"): False}


def test_sections_and_key_metrics(spark):
    checks = rows(spark, [("data.natural_tokens", 10.0, None), ("data.absent", 1.0, None), ("generation.looping_rate", None, 0.2), ("loss.val_loss", None, 2.0)], "metric string, min double, max double")
    metrics = rows(spark, [("data.natural_tokens", 12.0), ("generation.looping_rate", 0.1)], "metric string, value double")
    assert [r.metric for r in reports.data_failures(checks, metrics).collect()] == ["data.absent"]
    assert [r.metric for r in reports.capability_measurements(checks).collect()] == ["generation.looping_rate"] == [r.metric for r in reports.capability_snapshot(metrics).collect()]
    report = {"loss": {"eval": {"loss": 1.5, "perplexity": True}}, "tool_behavior": {"wrong_tool_rate": 0}}
    got = {r.name: r.value for r in reports.key_metrics(rows(spark, [(json.dumps(report),)], "report string")).collect()}
    assert len(got) == 14 and got["held_out_loss"] == 1.5 and got["wrong_tool_rate"] == 0.0 and got["perplexity"] is None


def test_stage_configs(spark):
    for stage in ("words", "reasoning", "assistant"):
        config = reports.stage_config(stage)
        for part in ("gate", "objective"):
            checks = reports.checks_of(spark, config, part)
            assert checks.count() > 1 and checks.filter("min is null and max is null").count() == 0
        assert reports.allowances_of(spark, config).filter("direction not in ('up', 'down')").count() == 0
        mixture = curriculum.stage_mixture(config["mixture"])
        assert sum(mixture.values()) == pytest.approx(1, abs=1e-5) and set(mixture) <= set(curriculum.GROUPS)
    gate = reports.checks_of(spark, reports.stage_config("words"), "gate")
    passed = rows(spark, [("summary.final_validation.val_loss", 1.0), ("eval.capabilities.grammar.accuracy", 0.5)], "metric string, value double")
    assert gates.evaluate_gate(gate, passed, {"stop_reason": "budget"}).first().passed
    with pytest.raises(KeyError):
        reports.stage_config("none")


def test_markdown(spark):
    assert reports.fenced("a ``` b").startswith("````\n") and reports.visible("a\x1b[0m\n\tb") == "a\\x1b[0m\n\tb"
    assert [reports.shown(x) for x in (None, True, 12345, 0.5, "a|b\nc")] == ["-", "yes", "12,345", "0.5000", "a\\|b c"]
    checks = rows(spark, [("m", 1.0, False), ("l", None, True)], "metric string, value double, ok boolean")
    text = reports.render_report("Stage", {"met": False}, checks, None, [("Once", "upon `a` time")])
    assert text.index("| l | - | yes |") < text.index("| m | 1.0000 | no |") and "- met: no" in text and "```\nupon" in text
    with pytest.raises(ValueError):
        reports.render_history(spark.range(11), ["id"], most=10)
    assert reports.render_history(spark.range(2), ["id"]).splitlines() == ["| id |", "| - |", "| 0 |", "| 1 |"]


class Size(enum.Enum):
    SMALL, LARGE = "s", "l"


@dataclasses.dataclass
class Trip:
    """A trip to a city."""

    city: str
    days: Annotated[int, {"minimum": 1}] = 3
    tags: list[str] = dataclasses.field(default_factory=list)


def book(self, trip: Trip, size: Size, way: Literal["train", "ship"], seat: int | None, note: str = "", *rest, **more) -> str:
    """Book a trip
    for somebody.

    Args:
        way: How to travel.
        note (str): What else is wished.
    """


def test_schemas_of_functions_and_classes():
    got = toolschema.schema_of(book)
    p = got["parameters"]["properties"]
    assert got["name"] == "book" and got["description"] == "Book a trip for somebody." and got["parameters"]["required"] == ["trip", "size", "way"]
    assert p["way"] == {"enum": ["train", "ship"], "description": "How to travel."} and p["size"] == {"enum": ["s", "l"]} and p["seat"] == {"type": "integer"} and p["note"]["description"] == "What else is wished."
    assert p["trip"]["required"] == ["city"] and p["trip"]["properties"] == {"city": {"type": "string"}, "days": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "items": {"type": "string"}}}
    assert toolschema.schema_of(Trip)["description"] == "A trip to a city." and toolschema.schema_of({"name": "x"})["parameters"]["type"] == "object"
    for bad in (3, int, {"parameters": {}}):
        with pytest.raises(toolschema.SchemaError):
            toolschema.schema_of(bad)


def test_grounding_modes(spark):
    source = "Send 3 notes to OSLO on March 05, 2024, alarm on please"
    args = {"city": "Oslo", "n": 3.0, "day": "2024-03-05", "alarm": True, "who": "Kim", "more": {"a": 1}, "text": "x" * 40, "m": 4}
    found = {f: (g, how) for f, g, _, how in pyground.grounded_fields(args, source)}
    assert found == {"city": (True, "case_insensitive"), "n": (True, "number_normalized"), "day": (True, "date_normalized"), "alarm": (True, None), "who": (False, None), "more": (False, None), "text": (False, None), "m": (False, None)}
    df = spark.createDataFrame([(json.dumps(a), source) for a in ({"city": "OSLO"}, {"text": "x" * 40}, {"who": "Kim"})] + [("[1]", source), (None, None)], "a string, s string")
    got = {m: [r.g and r.g.blocks for r in df.select(J.grounding(m)("a", "s").alias("g")).collect()] for m in pyground.MODES}
    assert got == {"strict": [False, True, True, None, None], "balanced": [False, False, True, None, None], "permissive": [False, False, False, None, None]}


def test_unique_ids_and_the_older_format(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert chat.unique_ids(df) is df
    with pytest.raises(ValueError, match="'a'"):
        chat.unique_ids(df.unionByName(df.limit(1)))
    m = "messages array<struct<role:string,content:string>>, target_type string, target_text string"
    old = spark.createDataFrame([([("user", "hi"), ("user", "é")], "answer", "yes"), ([("user", "x" * 50)], "tool_call", '{"arguments":{"a":1},"name":"t"}')], m)
    got = old.select(*chat.legacy_tokens(F.col("messages"), F.col("target_type"), F.col("target_text"), 8)).toDF("ids", "text").collect()
    assert got[0].ids == [1, *(b + 4 for b in "hi é".encode())] and got[0].text == "yes"
    assert len(got[1].ids) == 8 and got[1].text == '{"name": "t", "arguments": {"a": 1}}'


def test_groups_keep_their_pools_apart(spark):
    assert curriculum.pools("x", [7]) == ([7], [7])
    with pytest.raises(ValueError):
        curriculum.pools("x", [])
    for g in curriculum.GENERATORS:
        for slot in "abc":
            train, held = curriculum.pools(f"{g.name}:{slot}", list(range(g.low, g.high + 1)))
            assert train and held and not set(train) & set(held)
    assert {n for shares in curriculum.GROUPS.values() for n in shares} <= set(curriculum.BY_NAME)
    train, test = (curriculum.generate_group(spark, "knowledge", 60, s).collect() for s in ("train", "val"))
    assert len(train) == 60 and all(r.prompt and r.answer for r in train + test)
    drawn = {n: sum(r.id.startswith(n) for r in train) for n in curriculum.GROUPS["knowledge"]}
    assert drawn["weeks"] < drawn["difference"] and len({r.prompt for r in test}) == len(test)
    assert not {r.prompt for r in train} & {r.prompt for r in test}
    turns = curriculum.as_messages(curriculum.generate(spark, "call_result", 3)).first()
    assert [m.role for m in turns.messages] == ["user", "tool", "user", "assistant"] and json.loads(turns.meta)["score"] == "contains"


def test_a_stage_is_built_and_written(spark, tmp_path):
    spec = {"examples_per_source": 40, "replay_fraction": 0.2, "primary": {"math": 3.0, "safety": 1.0}, "replay": {"extraction": 1.0}}
    examples, about = curriculum.build_curriculum(spark, spec)
    assert about["mixture"] == {"math": 0.6, "safety": 0.2, "extraction": 0.2} and about["verified_dropped"] == 0
    prompts = {s: {r.prompt for r in examples.filter(F.col("split") == s).collect()} for s in ("train", "val", "test")}
    assert all(prompts.values()) and not prompts["train"] & prompts["val"] and not prompts["test"] & (prompts["train"] | prompts["val"])
    out = curriculum.write_curriculum(examples, about, str(tmp_path / "c"))
    assert out["files"]["test.jsonl"] == out["files"]["eval.jsonl"] and set(out["files"]) >= {"train_math.jsonl", "train_safety.jsonl", "val.jsonl"}
    assert spark.read.json(str(tmp_path / "c/train_math.jsonl")).count() == out["files"]["train_math.jsonl"]["examples"]
    again = curriculum.write_curriculum(*curriculum.build_curriculum(spark, spec), str(tmp_path / "d"))
    assert again["files"] == out["files"]


def test_scored_generations(spark):
    from corpuskit import api

    schema = "id string, category string, scorer string, paraphrase boolean, text string, expected string, needles array<string>, tools array<string>, tool string, arguments string, expr_value bigint, tokens int, finish string"
    call = lambda n, a: json.dumps({"name": n, "arguments": a})
    rows_ = [
        ("1", "tools", "tool_call", False, call("t", {"a": 1, "b": 2}), None, None, ["t"], "t", '{"b": 2, "a": 1}', None, 5, "eos"),
        ("2", "tools", "tool_call", True, call("calculator", {"expr": "2 * 3"}), None, None, None, "calculator", None, 6, 5, "eos"),
        ("3", "tools", "tool_name", None, call("u", {}), None, None, ["t", "u"], "t", None, None, 5, "eos"),
        ("4", "tools", "tool_name", None, call("v", {}), None, None, ["t"], "v", None, None, 5, "eos"),
        ("5", "tools", "tool_call", None, "I would call t", None, None, ["t"], "t", "{}", None, 5, "length"),
        ("6", "other", "json", None, '{"x": [1, 2]}', ' {"x":[1,2]}', None, None, None, None, None, 5, "eos"),
        ("7", "other", "contains", None, "The sun and the moon", None, ["sun", "moon"], None, None, None, None, 5, "eos"),
    ]
    got = api.score_generations(spark.createDataFrame(rows_, schema))
    assert {r.id: r.ok for r in got["rows"].collect()} == {"1": True, "2": True, "3": False, "4": False, "5": False, "6": True, "7": True}
    b = got["tool_behavior"].first()
    assert (b.requests_needing_a_tool, b.correct_tool_rate, b.wrong_tool_rate, b.malformed_call_rate, b.no_call_rate) == (5, 0.4, 0.2, 0.2, 0.2) and b.argument_accuracy == pytest.approx(2 / 3)
    assert got["generation"].first().unterminated_rate == pytest.approx(1 / 7)


def test_objective_reports(spark):
    from corpuskit import api

    checks = rows(spark, [("loss.val_loss", None, 2.0)], "metric string, min double, max double")
    metrics = rows(spark, [("loss.val_loss", 1.0)], "metric string, value double")
    verdict, text = api.objective_report(checks, metrics, stage="words")
    assert verdict.first().met and "- met: yes" in text and "loss.val_loss" in text
    now, then = rows(spark, [("own", "loss.val_loss", 1.0)], REPORT), rows(spark, [("own", "loss.val_loss", 0.5)], REPORT)
    comparison = reports.compare_reports(now, then, rows(spark, [("own", "loss.val_loss", "up", 0.1)], ALLOWED), "words", "words")
    verdict, text = api.objective_report(checks, metrics, comparison, "words")
    assert not verdict.first().met and "- regressed: yes" in text
    assert api.objective_report(checks, metrics)[1] is None and api.curriculum_v2_info("reasoning")["mixture"]["math"] > 0
