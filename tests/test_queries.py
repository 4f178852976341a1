from pathlib import Path

import pytest
import sqlcheck

from corpuskit.plans import catalogue

pytestmark = pytest.mark.skipif(not Path(sqlcheck.SMALL).exists(), reason="the small tables are absent")
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    sqlcheck.same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, sqlcheck.SMALL)
    sqlcheck.joins_have_keys(df)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert set(df.columns) == {"split", "records", "chars", "bytes"} and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_read_the_needed_columns_only(spark):
    plan = QUERIES["bottom_k_sample"](spark, sqlcheck.SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "TakeOrderedAndProject" in plan


def rows(spark, name):
    return QUERIES[name](spark, sqlcheck.SMALL).collect()


def source(spark, name):
    return spark.read.parquet(f"{sqlcheck.SMALL}/{name}.parquet")


def test_chunks_hold_their_documents(spark):
    texts = {r.doc_id: r.text for r in source(spark, "documents").filter("text is not null").collect()}
    whole = {}
    for r in sorted(rows(spark, "chunks")):
        assert len(r.text) <= 600 and r.group_index == r.chunk_index // 8
        whole.setdefault(r.doc_id, []).append(r)
    for doc, parts in whole.items():
        assert [r.chunk_index for r in parts] == list(range(len(parts)))
        assert " ".join(" ".join(r.text for r in parts).split()) == " ".join(texts[doc].split()) or any(len(w) > 600 for w in texts[doc].split())


@pytest.mark.parametrize("name", ["near_dedup_corpus", "near_dedup_examples"])
def test_removed_texts_name_a_kept_one(spark, name):
    got = {r.id: r for r in rows(spark, name)}
    assert len(got) == source(spark, "documents").count()
    for r in got.values():
        assert (r.decision == "kept") == (r.duplicate_of is None)
        assert r.decision == "kept" or got[r.duplicate_of].decision == "kept" and r.duplicate_of < r.id


def test_fates_add_up(spark):
    for r in rows(spark, "prepared_corpus"):
        assert r.chunks == r.short_dropped + r.exact_removed + r.near_removed + r.contaminated + r.beyond_quota + r.chunks_kept
    kept = {r.split: r.records for r in rows(spark, "prepared_splits")}
    assert set(kept) == {"train", "val", "test"} and kept["train"] > 5 * kept["test"]


def test_json_lines_as_they_are(spark):
    import json

    def value(text):
        try:
            return json.loads(text)
        except ValueError:
            return ...

    lines = {(r.record_id, r.raw_json) for r in source(spark, "raw_records").select("record_id", "raw_json").collect()}
    valid = {}
    for key, text in lines:
        valid.setdefault(key, set()).add(value(text) is not ...)
    repaired = rows(spark, "json_repair")
    assert len(repaired) == len(lines) and all(r.repaired or r.valid in valid[r.record_id] for r in repaired)
    assert all((r.prefix == "complete") == (r.valid and not r.repaired) for r in repaired)
    texts = {}
    for key, text in lines:
        texts.setdefault(key, []).append(text)
    for r in rows(spark, "canonical_json"):
        if len(texts[r.record_id]) == 1:
            want = value(texts[r.record_id][0])
            assert (r.canonical is None) == (want is ...) and (want is ... or json.loads(r.canonical) == want)
    assert sum(r.n for r in rows(spark, "validate_examples")) == len(lines)


def test_draws_and_vectors(spark):
    assert all(0 <= r.token < 64 for r in rows(spark, "select_token"))
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in rows(spark, "hash_embedding"))
    assert all(len(r.signature) == 64 and min(r.signature) >= 0 for r in rows(spark, "minhash_signature"))


def test_grammar_metrics_are_shares(spark):
    known = {r.source: r for r in rows(spark, "grammar_metrics")}
    likeness = {r.source: r for r in rows(spark, "language_likeness")}
    assert set(known) == set(likeness)
    for name, r in known.items():
        assert round(r.word_like_fraction, 6) == likeness[name].word_like_fraction and r.n == likeness[name].n
        assert 0 <= r.known_word_fraction <= r.word_like_fraction + 1e-9 and all(c is None or 0 <= c <= 1 for c in (r.sentence_start_capitalized, r.space_after_punctuation))


def test_generated_answers_are_confirmed(spark):
    for r in rows(spark, "math_curriculum_verified"):
        assert r.n == r.n_ok == r.n_recomputed
    stage = rows(spark, "curriculum_stage")
    prompts = {s: {r.prompt for r in stage if r.split == s} for s in ("train", "val", "test")}
    assert all(r.ok for r in stage) and not prompts["train"] & (prompts["val"] | prompts["test"]) and not prompts["val"] & prompts["test"]
