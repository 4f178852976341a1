import hashlib
import io
import json
from urllib.error import HTTPError

import pytest
from pyspark.sql import functions as F

from corpuskit import api
from corpuskit.operators import pipeline
from corpuskit.sources import shards


class Response(io.BytesIO):
    def __init__(self, body, length=None):
        super().__init__(body)
        self.headers = {"Content-Length": str(len(body) if length is None else length)}


def server(*answers):
    """A stand-in for the network: each call takes the next answer (an exception is raised)."""
    left = list(answers)

    def opened(url):
        answer = left.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    return opened, left


def status(code):
    return HTTPError("http://h/x", code, "no", {}, None)


def test_passing_failures_are_tried_again(tmp_path):
    waits, body = [], b"some text\n"
    opened, left = server(status(503), ConnectionResetError(), Response(body, 99), Response(body))
    path, digest, size = shards.fetch_shard("http://h/x.txt", cache_dir=str(tmp_path), allow_download=True, opened=opened, attempts=4, pause=2.0, sleep=waits.append)
    assert (path.read_bytes(), digest, size) == (body, hashlib.sha256(body).hexdigest(), len(body)) and waits == [2.0, 4.0, 6.0] and not left
    # From the cache as long as the content is what is expected; fetched anew otherwise.
    assert shards.fetch_shard("http://h/x.txt", cache_dir=str(tmp_path), allow_download=True, opened=server()[0], expected_sha256=digest)[2] == size
    path.write_bytes(b"altered")
    assert shards.fetch_shard("http://h/x.txt", cache_dir=str(tmp_path), allow_download=True, opened=server(Response(body))[0], expected_sha256=digest)[1] == digest


@pytest.mark.parametrize("code, calls", [(404, 1), (403, 1), (408, 3), (429, 3), (500, 3)])
def test_final_answers_fail_at_once(tmp_path, code, calls):
    opened, left = server(*[status(code)] * 3)
    with pytest.raises(shards.ShardError) as e:
        shards.fetch_shard("https://user:key@h/x?token=1", cache_dir=str(tmp_path), allow_download=True, opened=opened, sleep=lambda s: None)
    assert 3 - len(left) == calls and "key" not in str(e.value) and "token" not in str(e.value)


def test_wrong_hash_and_missing_token(tmp_path, monkeypatch):
    with pytest.raises(shards.ShardError, match="sha256"):
        shards.fetch_shard("http://h/x", cache_dir=str(tmp_path), allow_download=True, opened=server(Response(b"x"))[0], expected_sha256="0" * 64)
    assert not any(tmp_path.iterdir())
    monkeypatch.delenv("NO_SUCH_TOKEN", raising=False)
    with pytest.raises(shards.ShardError, match="NO_SUCH_TOKEN"):
        shards.fetch_shard("http://h/x", cache_dir=str(tmp_path), allow_download=True, auth_env="NO_SUCH_TOKEN", opened=server()[0])


def test_the_token_stays_with_the_first_host(monkeypatch):
    sent = {}
    monkeypatch.setattr(shards, "urlopen", lambda request, timeout: sent.update(kept=dict(request.headers), first=dict(request.unredirected_hdrs)))
    shards.open_url("http://h/x", "secret")
    assert "secret" not in str(sent["kept"]) and sent["first"]["Authorization"] == "Bearer secret"


def test_lines_have_their_physical_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n  \n{"a"\n')
    (tmp_path / "b.txt").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = shards.lines_of(spark, str(tmp_path / "b.txt"))
        assert rows.rdd.getNumPartitions() > 3 and rows.filter(F.concat(F.lit("line "), F.col("line_no").cast("string")) != F.col("line")).count() == 0 and rows.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(Exception, match=r"a.jsonl:4: "):
        shards.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()


def words(k, n=12):
    return " ".join(f"w{k}x{i}" for i in range(n))


def test_quotas_are_spread_over_shards(spark, tmp_path):
    for s in range(3):
        (tmp_path / f"{s}.jsonl").write_text("".join(json.dumps({"text": words(f"{s}y{i}")}) + "\n" for i in range(10)))
    entries = [{"source": "a", "shards": ["0.jsonl", "1.jsonl", "2.jsonl"], "max_records": 5, "supplemental": True}]
    (tmp_path / "m.json").write_text(json.dumps({"datasets": entries}))
    sizes = api.prepare_corpus(spark, str(tmp_path / "m.json"), str(tmp_path / "out"), str(tmp_path)).collect()
    kept = [r.text.split("y")[0] for r in shards.load_corpus(spark, str(tmp_path / "out")).collect()]
    assert sorted((kept.count(f"w{s}")) for s in range(3)) == [1, 2, 2] and kept.count("w2") == 1
    assert sum(r.natural_records for r in sizes) == 0 and sum(r.records for r in sizes) == 5


def test_far_shards_and_long_documents_keep_their_order(spark):
    """Shard 5,000 and a document of more than 2 ** 20 chunks: no two chunks share a place."""
    rows = [(5000 * 2**32 + 1, "s", [words(1)]), (0, "s", [words(1)]), (2**20, "s", [words(3)]), (4096 * 2**32, "s", [words(2)])]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, paragraphs array<string>")
    long = docs.unionByName(spark.range(1).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("t").alias("source"), F.transform(F.sequence(F.lit(0), F.lit(2**20 + 1)), lambda i: F.concat(F.lit("number "), i.cast("string"), F.lit(" stands alone"))).alias("paragraphs")))
    got = pipeline.PreparedCorpus(long, None, pipeline.Settings(chunk_chars=32, min_chars=1, dedup="exact"))
    fates = {(r.doc_id, r.chunk_index): r.fate for r in got.chunks.filter("source = 's'").collect()}
    firsts = {d for (d, _), f in fates.items() if f == "kept"}
    assert firsts == {0, 2**20, 4096 * 2**32}
    per = got.chunks.filter("source = 't'").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ord").alias("d"), F.count_if(F.col("fate") == "kept").alias("k")).first()
    assert per.n == per.d == per.k == 2**20 + 2


def test_lost_characters_are_counted(spark):
    docs = spark.createDataFrame([(0, "s", ["x" * 50, "short one"]), (1, "s", ["a " + "y" * 45 + " b"])], "doc_id bigint, source string, paragraphs array<string>")
    got = pipeline.PreparedCorpus(docs, None, pipeline.Settings(chunk_chars=40, min_chars=1))
    assert got.source_counts().first().characters_lost == 15


def test_prepare_external(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "messages": [{"role": "user", "content": "hi"}]}\n{"text": "plain"}\n')
    for s in range(2):
        (tmp_path / f"{s}.txt").write_text("\n\n".join(words(f"{s}y{i}") for i in range(10)))
    entries = [
        {"source": "legacy", "path": "a.jsonl", "split": "val"},
        {"source": "prose", "shards": ["0.txt", "1.txt"], "chunk_chars": 120, "max_records": 5},
        {"source": "sums", "type": "synthetic", "generator": "arith_direct", "examples": 7, "seed": 3},
    ]
    (tmp_path / "m.json").write_text(json.dumps({"datasets": entries}))
    rows = {r.source: r for r in api.prepare_external(spark, str(tmp_path / "m.json"), str(tmp_path / "out"), str(tmp_path)).collect()}
    assert {s: (r.examples, r.natural) for s, r in rows.items()} == {"legacy": (2, True), "prose": (5, True), "sums": (7, False)}
    assert rows["legacy"].bytes == len("hi") + len("plain") and rows["legacy"].tokens == rows["legacy"].bytes + 4
    again = {r.source: r.identity for r in api.prepare_external(spark, str(tmp_path / "m.json"), str(tmp_path / "again"), str(tmp_path)).collect()}
    assert again == {s: r.identity for s, r in rows.items()}
    assert {r.text.split("y")[0] for r in spark.read.json(str(tmp_path / "out/prose.train")).collect()} == {"w0", "w1"}


def test_workspaces_are_cleaned_up(spark):
    from pathlib import Path

    from corpuskit.session import Workspace, clean_up, shared_dir

    kept = Workspace(spark, "mine").write(spark.range(3), "a")
    assert kept.count() == 3 and any(Path(shared_dir(spark).removeprefix("file://")).glob("mine-*"))
    assert clean_up(spark) > 0 and clean_up(spark) == 0
    assert not any(Path(shared_dir(spark).removeprefix("file://")).glob("mine-*"))
