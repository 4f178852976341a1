from pathlib import Path

import pytest
import sqlcheck

from corpuskit.llm import queries as llm_queries, sql as llm_sql

pytestmark = pytest.mark.skipif(not Path(sqlcheck.SMALL).exists(), reason="the small tables are absent")
QUERIES, SQL = llm_queries.queries(), llm_sql.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    sqlcheck.same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, sqlcheck.SMALL)
    sqlcheck.joins_have_keys(df)
    assert df.count() > 0


def test_the_sample_filters_before_its_shuffle(spark):
    plan = QUERIES["p2_sample"](spark, sqlcheck.SMALL)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "chat_examples" in line)
    assert "messages" not in scan and "target_text" not in scan
    assert plan.count("Exchange hashpartitioning(example_id") == 1


def test_the_entry_lists_them():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def rows(spark, name):
    return QUERIES[name](spark, sqlcheck.SMALL).collect()


def source(spark, name):
    return spark.read.parquet(f"{sqlcheck.SMALL}/{name}.parquet")


def test_pieces_are_whole_texts(spark):
    limits = {r.source: (r.chunk_chars or 1000, r.chunk_overlap or 0) for r in source(spark, "dataset_manifest").collect()}
    of = {r.record_id: r.source for r in source(spark, "raw_records").select("record_id", "source").collect()}
    texts = {}
    for r in sorted(rows(spark, "p1_pieces")):
        limit, overlap = limits.get(of[r.record_id], (1000, 0))
        assert len(r.text) == r.end_char - r.start_char <= limit
        before = texts.get(r.record_id, "")
        assert 0 <= len(before) - r.start_char <= overlap and before[r.start_char :] == r.text[: len(before) - r.start_char]
        texts[r.record_id] = before + r.text[len(before) - r.start_char :]
    assert set(texts) == {r.record_id for r in rows(spark, "p1_found")}


def test_families_stay_together(spark):
    splits = rows(spark, "p3_splits")
    of = {}
    for r in splits:
        assert of.setdefault(r.family_no, r.split) == r.split
    pairs = {(r.family_no, r.chunk_no) for r in rows(spark, "p3_found")}
    assert pairs == {(r.family_no, r.chunk_no) for r in splits if r.family_no != r.chunk_no}
    report = {r.split: r for r in rows(spark, "p3_report")}
    assert sum(r.n_rows for r in report.values()) == len(splits) and sum(r.n_families for r in report.values()) == len(of)


def test_reports_agree_with_what_they_count(spark):
    found = rows(spark, "p4_found")
    report = rows(spark, "p4_report")
    assert sum(r.n_pairs for r in report if r.split == "train") == sum(r.n_pairs for r in report if r.split != "train") == len(found)
    assert sum(r.n_overlapping for r in report) == len({x for r in found for x in r})
    leaks = {(r.doc_id, r.item_id) for r in rows(spark, "p6_leaks") if r.exact_windows}
    assert leaks == {tuple(r) for r in rows(spark, "p6_found")}
    assert sum(r.n_docs for r in rows(spark, "p6_report")) == len(leaks)


def test_draws_add_up(spark):
    shares = {(r.mixture, r.source): r for r in rows(spark, "p7_shares")}
    drawn, most = {}, {}
    for r in rows(spark, "p7_mix"):
        key = r.mixture, r.source
        drawn[key] = drawn.get(key, 0) + r.tokens
        most[key] = max(most.get(key, 0), r.copy_no)
    assert {k: r.drawn_tokens for k, r in shares.items() if r.drawn_tokens} == {k: v for k, v in drawn.items() if v}
    assert all(most[k] == shares[k].most_uses <= shares[k].max_repeats for k in most)
    assert {tuple(r) for r in rows(spark, "p7_found")} == {k for k, r in shares.items() if not r.reachable}


def test_scores_and_rates(spark):
    scores, rates = rows(spark, "p8_scores"), rows(spark, "p8_rates")
    assert len(scores) == source(spark, "documents").count() == sum(r.n_docs for r in rates) and all(0 <= r.score <= 1 for r in scores)
    assert sum(r.n_flagged for r in rates) == len(rows(spark, "p8_found"))
