import json
import re
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpuskit.functions import pyjson, text as T
from corpuskit.functions.jsonscan import mended, scan
from corpuskit.functions.pytext import alnum_words, reading_text, storable

ODD = ["", "   ", "A b C", "4+5=9", "4 + 5", "“Quoted” 'text'!", "ＡＢＣ １２", "x\x1fy\x1cz", "café CAFÉ", "ﬁne", None, "tab\tnew\nline", "a" * 5000]


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def plain(t):
    t = unicodedata.normalize("NFKC", t).lower()
    t = re.sub("[.,!?;:'\"‘’“”]", "", t)
    return " ".join(re.sub(r"([+\-*/=()<>%])", r" \1 ", t).split())


def test_normalize_text(spark):
    assert column(spark, ODD, T.normalize_text) == [None if v is None else plain(v) for v in ODD]
    assert [reading_text(v) for v in ODD if v is not None] == [plain(v) for v in ODD if v is not None]


def test_words_and_grams(spark):
    texts = ["a b c d", "a b", "", "a b a b a b"]
    assert column(spark, texts, lambda c: T.ngrams(c, 3)) == [["a b c", "b c d"], [], [], ["a b a", "b a b"]]
    assert column(spark, texts, T.words) == [t.split() for t in texts]
    assert column(spark, ["One two three four", "Hi!", "...", ""], T.shingles) == [["one two three", "two three four"], ["hi"], [], []]


def test_repetition_and_diversity(spark):
    def rep(t, n=6):
        t = t.strip()
        g = [t[i : i + n] for i in range(len(t) - n + 1)]
        return 0.0 if len(t) < n + 6 else 1 - len(set(g)) / len(g)

    texts = ["short", "abababababababab", "all the letters differ here", " " * 20, "ü" * 30]
    assert column(spark, texts, T.repetition) == pytest.approx([rep(t) for t in texts])
    assert column(spark, ["a a b", "a", ""], lambda c: T.distinct_n(T.words(c), 2)) == [1.0, 1.0, 0.0]


def test_paragraphs(spark):
    texts = ["one\ntwo\n\nthree", "one\n two \nthree", "  ", "a\r\nb\r\n \r\nc", "x y"]
    assert column(spark, texts, T.paragraphs) == [["one two", "three"], ["one", "two", "three"], [], ["a b", "c"], ["x", "y"]]


def test_addresses_words_and_calls(spark):
    urls = ["https://u:p@Host.org:8/a/b?x=1#y", "file:///tmp/x", "HTTP://A.b", "local/path"]
    assert column(spark, urls, T.redact_url) == ["https://host.org:8/a/b", "file:///tmp/x", "http://a.b", "local/path"]
    tokens = ["“Don’t!”", "x1", "well-known,", "...", "Straße"]
    assert column(spark, tokens, T.is_word) == [True, False, True, False, True]
    assert column(spark, tokens, T.normalize_word)[0] == "don't"
    assert column(spark, [' {"name": 1}', '[{"name"', "{}", "name"], T.looks_like_call) == [True, True, False, False]


def test_heldout_share(spark):
    held = column(spark, [str(i) for i in range(2000)], lambda c: T.heldout("s", c))
    assert 0.15 < sum(held) / 2000 < 0.25


def test_alnum_words_and_storable():
    assert alnum_words("Ab_c, dＥ ½") == ["ab", "c", "de", "1", "2"]
    assert storable("a\ud800b") == "a�b" and storable("\U0001f600") == "\U0001f600"


@settings(max_examples=200, deadline=None)
@given(st.integers(-9, 9), st.sampled_from(["+", "-", "*", "//", "%", "/"]), st.integers(-9, 9), st.sampled_from(["+", "-", "*"]), st.integers(0, 9))
def test_calculator_agrees_with_python(a, op, b, op2, c):
    text = f"({a}) {op} ({b}) {op2} {c}"
    got, error = pyjson.calculate(text)
    try:
        assert got == pytest.approx(eval(text))
    except ZeroDivisionError:
        assert got is None and error


def test_calculator_limits():
    assert pyjson.calculate("2 ** 3 ** 2")[0] == 512 and pyjson.calculate("-2 ** 2")[0] == -4
    for bad in ("2 ** 13", "1 +", "(1", "a", "1 2", "1" * 201, "", "__import__('os')"):
        assert pyjson.calculate(bad)[0] is None
    assert pyjson.integer_value("3 * -4 + 2") == -10 and pyjson.integer_value("1 / 2") is None and pyjson.integer_value("1.5") is None


def test_schema_rules():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 2, "multipleOf": 2}, "b": {"type": "array", "uniqueItems": True, "maxItems": 2, "items": {"enum": ["x", "y"]}}}}
    bad = lambda v: len(pyjson.schema_errors(v, schema))
    assert [bad({"a": 4}), bad({}), bad({"a": True}), bad({"a": 1}), bad({"a": 2, "c": 0}), bad({"a": 2, "b": ["x", "x", "z"]}), bad([])] == [0, 1, 1, 2, 1, 3, 1]
    with pytest.raises(ValueError):
        pyjson.check_schema({"properties": {"a": {"anyOf": []}}})


def test_json_repair_and_prefixes():
    assert pyjson.repaired('{"a": [1, 2,], }') == ('{"a": [1, 2]}', True, True)
    assert pyjson.repaired('{"a": "}[')[1] is False
    assert pyjson.repaired('{"a": [{"b": 1') == ('{"a": [{"b": 1}]}', True, True)
    assert [pyjson.prefix_state(t) for t in ('{"a": "x', '{"a": nu', "{} x", "{}", "", '{"a" 1')] == ["extendable", "extendable", "broken", "complete", "extendable", "broken"]


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text('ab"\\\\,]}é\\n', max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab,}", max_size=2), x, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(VALUES, st.sampled_from([None, 1]))
def test_scanner_agrees_with_the_parser(value, indent):
    text = json.dumps(value, indent=indent, ensure_ascii=False)
    assert scan(text).state == "complete"
    for k in range(len(text)):
        part, whole = text[:k], True
        try:
            json.loads(part)
        except ValueError:
            whole = False
        state = scan(part).state
        # A minus sign or an escape cut short is no lexeme; every other beginning can be continued.
        assert state == ("complete" if whole else "extendable") or part.endswith("-") or "\\" in part[-6:]
        if state == "extendable" and not scan(part).cut and (fixed := mended(part)) is not None:
            json.loads(fixed)


def test_structured_texts():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}
    assert pyjson.structured('{"a": 1,}', schema) == ('{"a":1}', True, True, []) and pyjson.structured('{"a": 1,}', schema, False)[1] is False
    assert pyjson.structured('{"a": "x"', schema)[1:3] == (False, True) and pyjson.structured("no", schema)[0] is None
    assert mended('{"a": ",]", "b": [1,],') is None and mended('{"a": ",]", "b": [1,]') == '{"a": ",]", "b": [1]}' and mended('{"a": 1]') is None


def test_tool_calls_and_examples():
    tools = {"add": pyjson.arguments_schema({"a": "int", "b": "int"})}
    status = lambda t: pyjson.tool_call(t, tools)[0]
    assert [status('{"name": "add", "arguments": {"a": 1, "b": 2}}'), status('{"name": "add", "arguments": {"a": 1, "b": true}}'), status('{"name": "x", "arguments": {}}'), status("hello"), status('{"name": ')] == ["ok", "malformed", "malformed", "none", "malformed"]
    good = {"id": "1", "messages": [{"role": "user", "content": "x"}], "target": {"type": "answer", "content": "y"}}
    assert pyjson.example_errors(good) == []
    assert len(pyjson.example_errors({"messages": [], "target": {"type": "tool_call"}})) == 5
    assert pyjson.example_errors(pyjson.BROKEN) and pyjson.example_errors([])
