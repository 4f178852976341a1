"""Corpus shards: formats, acquisition with checksums, scans to documents, written corpora and their verification."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from http.client import HTTPException, IncompleteRead
from pathlib import Path
from urllib.error import HTTPError
from urllib.parse import unquote, urlsplit
from urllib.request import Request, urlopen

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpuskit.functions import text as T
from corpuskit.session import Workspace

RECORD_SUFFIXES = (".jsonl", ".ndjson", ".json")
_BLOCK = 1 << 20


class ShardError(ValueError):
    """A shard can't be used."""


def shard_format(shard: str, declared: str = "") -> str:
    """The declared format, or what the suffix (without .gz) tells: jsonl or text."""
    if declared:
        return declared
    name = shard.lower().removesuffix(".gz")
    return "jsonl" if name.endswith(RECORD_SUFFIXES) else "text"


def shard_format_column(shard: Column, declared: Column) -> Column:
    by_suffix = F.when(F.regexp_replace(F.lower(shard), r"\.gz$", "").rlike(r"\.(jsonl|ndjson|json)$"), "jsonl").otherwise("text")
    return F.when(F.coalesce(declared, F.lit("")) != "", declared).otherwise(by_suffix)


def needs_network(shard: str) -> bool:
    return urlsplit(shard).scheme in ("http", "https")


def file_sha256(path: str | Path) -> tuple[str, int]:
    """The sha256 and size of one file, read in blocks."""
    digest, size = hashlib.sha256(), 0
    with Path(path).open("rb") as handle:
        while block := handle.read(_BLOCK):
            digest.update(block)
            size += len(block)
    return digest.hexdigest(), size


# Answers of a server that are worth another attempt, besides all of 5xx.
PASSING = (408, 429)


def _passing(error: Exception) -> bool:
    """Whether a failed download may succeed when it is tried again."""
    if isinstance(error, HTTPError):
        return error.code in PASSING or error.code >= 500
    return isinstance(error, (OSError, HTTPException)) and not isinstance(error, ValueError)


def open_url(url: str, token: str | None = None, timeout: float = 120.0):
    """A response with read() and headers. The token goes to the first host alone: it is not sent on after a redirect."""
    request = Request(url, headers={"User-Agent": "corpuskit"})
    if token:
        request.add_unredirected_header("Authorization", f"Bearer {token}")
    return urlopen(request, timeout=timeout)


def _download(url: str, target: Path, opened, attempts: int, pause: float, sleep) -> str:
    """Stream ``url`` to ``target``; the sha256. Passing failures and short bodies are tried again, from the start."""
    for attempt in range(1, attempts + 1):
        try:
            digest, size = hashlib.sha256(), 0
            with opened(url) as response, target.open("wb") as out:
                while block := response.read(_BLOCK):
                    digest.update(block)
                    out.write(block)
                    size += len(block)
                promised = response.headers.get("Content-Length")
            if promised and promised.strip().isdigit() and int(promised) != size:
                raise IncompleteRead(b"", int(promised) - size)
            return digest.hexdigest()
        except (OSError, HTTPException, ValueError) as error:
            target.unlink(missing_ok=True)
            if attempt == attempts or not _passing(error):
                raise ShardError(f"{redacted(url)} could not be fetched ({attempt} attempts): {type(error).__name__} {getattr(error, 'code', '')}".rstrip()) from None
            sleep(pause * attempt)
    raise ShardError(f"{redacted(url)}: no attempt was allowed")


def fetch_shard(shard: str, base_dir: str = ".", cache_dir: str | None = None, allow_download: bool = False, expected_sha256: str = "", auth_env: str = "", opened=None, attempts: int = 3, pause: float = 10.0, sleep=time.sleep, hashed: bool = True) -> tuple[Path, str | None, int]:
    """(path, sha256, bytes) of a shard: local files and file:// in place, http(s) through a cache.

    A network shard is refused unless downloads are allowed. What fails in passing (connections, short bodies, 408, 429 and
    5xx) is tried again after a pause that grows with the attempts; other answers are final. ``auth_env`` names the
    environment variable with a bearer token. A hash other than the expected one is an error, and a cached file whose
    content has another is fetched anew. ``opened(url)`` stands in for the network. Without ``hashed`` local files are only
    looked up: ``checksums`` hashes them where they are read.
    """
    if needs_network(shard):
        if not allow_download:
            raise ShardError(f"{redacted(shard)} needs the network, which is not allowed here")
        token = os.environ.get(auth_env, "") if auth_env else ""
        if auth_env and not token:
            raise ShardError(f"{redacted(shard)} needs a token in the environment variable {auth_env}, which is not set")
        path = Path(cache_dir or base_dir) / (hashlib.sha256(redacted(shard).encode()).hexdigest()[:32] + "".join(Path(urlsplit(shard).path).suffixes[-2:]))
        path.parent.mkdir(parents=True, exist_ok=True)
        found = file_sha256(path)[0] if path.is_file() else None
        if found is None or expected_sha256 and found != expected_sha256:
            part = path.with_name(path.name + ".part")
            found = _download(shard, part, opened or (lambda url: open_url(url, token or None)), attempts, pause, sleep)
            if not expected_sha256 or found == expected_sha256:
                part.replace(path)
            else:
                part.unlink()
        size = path.stat().st_size if path.is_file() else 0
    else:
        path = Path(unquote(urlsplit(shard).path)) if shard.startswith("file:") else Path(base_dir) / shard
        if not path.is_file():
            raise ShardError(f"{redacted(shard)} doesn't exist")
        found, size = file_sha256(path) if hashed else (None, path.stat().st_size)
    if expected_sha256 and found is not None and found != expected_sha256:
        raise ShardError(f"{redacted(shard)} has sha256 {found}, not {expected_sha256}")
    return path, found, size


def redacted(url: str) -> str:
    """An address without user, query and fragment."""
    u = urlsplit(url)
    return url if u.scheme not in ("http", "https") else f"{u.scheme}://{(u.netloc.rpartition('@')[2]).lower()}{u.path}"


@dataclass(frozen=True)
class Source:
    """One entry of a dataset manifest."""

    source: str
    shards: Sequence[str] = ()
    sha256: Sequence[str | None] = ()
    shard_format: str = ""
    text_field: str = "text"
    chunk_chars: int = 1000
    min_chars: int = 32
    group_chunks: int = 8
    max_records: int = 0
    supplemental: bool = False
    entry_type: str = "local"
    split: str = "train"
    weight: float = 1.0
    license: str = ""
    auth_env: str = ""
    extra: Mapping[str, object] = field(default_factory=dict)

    def problems(self) -> list[str]:
        out = [] if self.source else ["no source name"]
        out += ["no shards"] * (self.entry_type != "synthetic" and not self.shards)
        out += ["unknown type"] * (self.entry_type not in ("local", "url", "synthetic"))
        out += ["unknown format"] * (self.shard_format not in ("", "text", "jsonl"))
        out += ["unknown split"] * (self.split not in ("train", "val", "test"))
        out += ["as many hashes as shards are needed"] * (bool(self.sha256) and len(self.sha256) != len(self.shards))
        out += ["chunk_chars below 16"] * (self.chunk_chars < 16)
        out += ["min_chars, group_chunks or max_records out of range"] * (self.min_chars < 0 or self.group_chunks < 1 or self.max_records < 0)
        return out + ["a negative weight"] * (self.weight < 0)


def read_manifest(text: str) -> list[Source]:
    """The entries of a manifest given as JSON (under datasets or entries); unknown fields and bad entries are errors."""
    data = json.loads(text)
    entries = data.get("datasets", data.get("entries"))
    if not isinstance(entries, list):
        raise ShardError("a manifest has datasets or entries")
    known = set(Source.__dataclass_fields__) - {"extra"}
    names = {"type": "entry_type", "format": "shard_format", "path": "shards", "url": "shards"}
    out = []
    for e in entries:
        e = {names.get(k, k): v for k, v in e.items()}
        if unknown := set(e) - known - {"description", "generator", "examples", "seed"}:
            raise ShardError(f"unknown fields: {sorted(unknown)}")
        extra = {k: e.pop(k) for k in list(e) if k not in known}
        for k in ("shards", "sha256"):
            if isinstance(e.get(k), str):
                e[k] = [e[k]]
        source = Source(**e, extra=extra)
        if problems := source.problems():
            raise ShardError(f"{source.source}: {', '.join(problems)}")
        out.append(source)
    if len({s.source for s in out}) != len(out):
        raise ShardError("source names must be unique")
    return out


def lines_of(spark: SparkSession, *paths: str) -> DataFrame:
    """path, line_no (from 1, blank lines included), line of text files of any size.

    The lines of a file block are read one after the other, so a line's place in its block is the distance of its running
    id from the block's first; only one row a block is ever shuffled or summed.
    """
    rows = spark.read.text(list(paths)).select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    per = rows.groupBy("path", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = Workspace(spark, "lines").write(per.select("path", "_block", "_first", before.alias("_before")), "blocks")
    return rows.join(per, ["path", "_block"]).select("path", (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("bigint").alias("line_no"), "line")


def read_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """path, value (variant) of the non-blank lines; a line that is no JSON is an error naming the file and the line."""
    rows = lines_of(spark, *paths).withColumn("line", T.strip(F.col("line"))).filter("line <> ''")
    bad = F.raise_error(F.concat(F.lit("no JSON in "), F.col("path"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), F.substring("line", 1, 80)))
    return rows.withColumn("line", F.when(F.try_parse_json("line").isNull(), bad).otherwise(F.col("line"))).select("path", F.parse_json("line").alias("value"))


def iter_examples(spark: SparkSession, *paths: str) -> DataFrame:
    """path, line_no, line, malformed: the non-blank lines with their physical number; malformed ones are marked."""
    rows = lines_of(spark, *paths).withColumn("line", T.strip(F.col("line"))).filter("line <> ''")
    return rows.withColumn("malformed", F.try_parse_json("line").isNull())


def documents(spark: SparkSession, path: str | list[str], fmt: str, text_field: str = "text") -> DataFrame:
    """shard, doc_index, paragraphs of the documents of shards.

    Record shards have a document for each line whose ``text_field`` is a non-blank string; a text shard is one
    document of blank-line paragraphs. Bytes that are no UTF-8 read as U+FFFD; .gz is read through the codec.
    """
    paths = [path] if isinstance(path, str) else path
    if fmt == "text":
        whole = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("shard"), "value")
        blocks = F.transform(F.split("value", r"\n(?:(?U)[\s\x1c-\x1f])*\n", -1), T.squash_lines)
        return whole.select("shard", F.lit(0).cast("bigint").alias("doc_index"), F.filter(blocks, lambda p: p != "").alias("paragraphs"))
    if fmt != "jsonl":
        raise ShardError(f"unknown format {fmt!r}")
    rows = spark.read.text(paths).select(F.input_file_name().alias("shard"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), T.strip(F.col("value")).alias("line")).filter("line <> ''")
    v = F.try_parse_json("line")
    at = f"$['{text_field}']"
    is_text = F.schema_of_variant(F.try_variant_get(v, at, "variant")) == "STRING"
    text = F.when(is_text, F.try_variant_get(v, at, "string"))
    rows = rows.withColumn("text", F.when(v.isNull(), F.raise_error(F.concat(F.lit("no JSON in "), F.col("shard")))).otherwise(text)).filter(T.strip(F.col("text")) != "")
    # Documents are numbered within a file's blocks, and blocks by the running sum of their documents.
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_c")).select("shard", "_block", before.alias("_before"))
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_at")) - 1).join(blocks, ["shard", "_block"])
    return rows.select("shard", (F.col("_before") + F.col("_in")).cast("bigint").alias("doc_index"), T.paragraphs(F.col("text")).alias("paragraphs"))


def _texts_of(v: Column) -> Column:
    """What a record (a variant) says: its text, or each of its messages."""
    contents = F.transform(F.try_variant_get(v, "$.messages", "array<variant>"), lambda m: F.try_variant_get(m, "$.content", "string"))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(F.array_compact(F.array(F.try_variant_get(v, "$.text", "string"))), none), F.coalesce(contents, none))


def record_texts(lines: DataFrame) -> DataFrame:
    """value, text of JSON lines: the text or all message contents together; other lines as they are."""
    v = F.try_parse_json("value")
    return lines.select("value", F.when(v.isNull(), F.col("value")).otherwise(F.array_join(_texts_of(v), "\n")).alias("text"))


def training_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """source, text below files or folders: a record's text or each non-blank message content; other files by line."""
    rows = spark.read.text(list(paths), recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")
    v = F.when(F.col("path").rlike(r"(?i)\.(jsonl|ndjson|json)(\.gz)?$"), F.try_parse_json("value"))
    parts = F.when(v.isNull(), F.array("value")).otherwise(_texts_of(v))
    name = F.regexp_extract("path", r"train_([^/]*?)\.jsonl", 1)
    return rows.select(F.when(name != "", name).alias("source"), F.explode(parts).alias("text")).filter(T.strip(F.col("text")) != "")


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow.fs import FileSystem

    for batch in batches:
        for path in batch["path"].to_pylist():
            files, place = FileSystem.from_uri(path)
            digest, size = hashlib.sha256(), 0
            with files.open_input_stream(place, compression=None) as handle:
                while block := handle.read(_BLOCK):
                    digest.update(block)
                    size += len(block)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()]), pa.array([size], pa.int64())], names=["path", "sha256", "bytes"])


def checksums(spark: SparkSession, *paths: str) -> DataFrame:
    """path, sha256, bytes of files of any size, hashed in blocks on the executors, a task for each file."""
    uris = [p if "://" in p else Path(p).resolve().as_uri() for p in paths]
    rows = spark.createDataFrame([(u,) for u in uris], "path string")
    return rows.repartition(max(1, min(len(uris), 10_000)), "path").mapInArrow(_hash_files, "path string, sha256 string, bytes bigint")


def split_identity(records: DataFrame) -> DataFrame:
    """split, records, identity: a hash of each split's records that doesn't depend on files or row order."""
    row = F.sha2(F.concat_ws("\x1f", "id", "text", "category", "source"), 256)
    return records.groupBy("split").agg(F.count(F.lit(1)).alias("records"), T.table_hash(row).alias("identity"))


def split_sizes(records: DataFrame) -> DataFrame:
    """split, records, tokens (of the byte tokenizer, two marks a text), bytes and identity of each split."""
    row = F.sha2(F.concat_ws("\x1f", "id", "text", "category", "source"), 256)
    size = F.sum(F.octet_length("text")).cast("bigint")
    return records.groupBy("split").agg(F.count(F.lit(1)).alias("records"), (size + 2 * F.count(F.lit(1))).alias("tokens"), size.alias("bytes"), T.table_hash(row).alias("identity"))


def write_corpus(records: DataFrame, folder: str) -> DataFrame:
    """Write records (id, text, category, source, split) as JSON lines by split, and beside them their sizes and identities."""
    records.write.mode("overwrite").partitionBy("split").json(f"{folder}/records")
    sizes = split_sizes(records)
    sizes.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return sizes


def load_corpus(spark: SparkSession, folder: str, verify: bool = True) -> DataFrame:
    """The records of a written corpus; altered, missing or added ones are an error."""
    schema = "id string, text string, category string, source string, split string"
    records = spark.read.schema(schema).json(f"{folder}/records")
    if verify:
        want = spark.read.schema("split string, records bigint, identity string").json(f"{folder}/manifest").select("split", F.struct("records", "identity").alias("want"))
        found = split_identity(records).select("split", F.struct("records", "identity").alias("found"))
        if not found.join(want, "split", "full").filter(~F.col("found").eqNullSafe(F.col("want"))).isEmpty():
            raise ShardError(f"the records in {folder} aren't those of its manifest")
    return records
