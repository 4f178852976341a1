"""What a user calls: one function for each command of a corpus workflow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.functions import text as T, tools
from corpuskit.operators import bpe, chat, contamination, curriculum, evaluation, gates, pipeline, reports, sampling
from corpuskit.sources import shards


def _acquired(spark: SparkSession, manifest: str, base_dir: str, fetch: dict) -> tuple[list[shards.Source], list[tuple]]:
    """The sources of a manifest and, for each shard in order, its number, source, place, format and text field.

    Local shards are hashed on the executors, all at once, and compared to the pinned hashes there are.
    """
    sources = shards.read_manifest(Path(manifest).read_text(encoding="utf-8"))
    found, pinned = [], {}
    for source in sources:
        for i, shard in enumerate(source.shards):
            want = (source.sha256[i] or "") if source.sha256 else ""
            path, _, _ = shards.fetch_shard(shard, base_dir, expected_sha256=want, auth_env=source.auth_env, hashed=False, **fetch)
            uri = path.resolve().as_uri()
            found.append((len(found), source.source, uri, shards.shard_format(shard, source.shard_format), source.text_field))
            if want:
                pinned[uri] = want
    if pinned:
        for row in shards.checksums(spark, *pinned).toLocalIterator():
            if row.sha256 != pinned[row.path]:
                raise shards.ShardError(f"{row.path} has sha256 {row.sha256}, not {pinned[row.path]}")
    return sources, found


def _documents(spark: SparkSession, sources: list[shards.Source], found: list[tuple]) -> DataFrame:
    """doc_id, source, shard, paragraphs, is_text and the sources' sizes: one scan for each format and text field.

    Shards follow each other in the order of the manifest, with room for 2 ** 32 documents each.
    """
    if not found:
        raise shards.ShardError("the manifest has no shards")
    sizes = {s.source: (s.chunk_chars, s.min_chars, s.group_chunks) for s in sources}
    rows = [(*f[:3], *sizes[f[1]]) for f in found]
    # One row per shard of a manifest that was read on the driver: Spark broadcasts it while it is small.
    places = spark.createDataFrame(rows, "shard_no bigint, source string, uri string, chunk_chars int, min_chars int, group_chunks int")
    docs = None
    for fmt, field in sorted({f[3:] for f in found}):
        part = shards.documents(spark, [f[2] for f in found if f[3:] == (fmt, field)], fmt, field).withColumn("uri", F.regexp_replace("shard", "^file:/+", "file:///")).drop("shard")
        part = part.join(places, "uri", "left")
        number = F.when(F.col("shard_no").isNull(), F.raise_error(F.concat(F.lit("no shard of the manifest: "), F.col("uri")))).otherwise(F.col("shard_no"))
        part = part.select((number * 2**32 + F.col("doc_index")).alias("doc_id"), "source", F.col("uri").alias("shard"), "paragraphs", F.lit(fmt == "text").alias("is_text"), "chunk_chars", "min_chars", "group_chunks")
        docs = part if docs is None else docs.unionByName(part)
    return docs


def prepare_corpus(spark: SparkSession, manifest: str, out: str, base_dir: str = ".", evaluation_texts: DataFrame | None = None, settings: pipeline.Settings = pipeline.Settings(), **fetch: object) -> DataFrame:
    """Shards of a manifest file to a written corpus; returns its sizes per split, natural text apart from supplemental.

    Chunk sizes, least lengths, groups and quotas are those of the manifest's sources (or its defaults), not of
    ``settings``. Hashes are checked before the scan. ``fetch``: see ``shards.fetch_shard``.
    """
    sources, found = _acquired(spark, manifest, base_dir, fetch)
    quotas = spark.createDataFrame([(s.source, s.max_records, len(s.shards)) for s in sources], "source string, max_records int, n_shards int")
    corpus = pipeline.PreparedCorpus(_documents(spark, sources, found), evaluation_texts, settings, quotas)
    records = corpus.records()
    shards.write_corpus(records, out)
    corpus.source_counts().coalesce(1).write.mode("overwrite").json(f"{out}/sources")
    return pipeline.split_counts(shards.load_corpus(spark, out, verify=False), [s.source for s in sources if s.supplemental])


def prepare_external(spark: SparkSession, manifest: str, out: str, base_dir: str = ".", **fetch: object) -> DataFrame:
    """Every entry of a manifest as records in ``out``/<source>.<split>, without duplicates removed or splits dealt.

    A synthetic entry is generated; one local record file is copied line by line; other shards become chunks, up to the
    entry's quota, spread evenly over its shards. Returns source, entry_type, split, natural, examples, tokens, bytes and
    identity of each entry, which ``out``/manifest holds as well.
    """
    sources, found = _acquired(spark, manifest, base_dir, fetch)
    written = None
    for source in sources:
        own = [f for f in found if f[1] == source.source]
        copied = source.entry_type == "local" and len(own) == 1 and own[0][3] == "jsonl" and not own[0][2].lower().endswith(".gz")
        folder = f"{out}/{source.source}.{source.split}"
        if source.entry_type == "synthetic":
            made = curriculum.generate(spark, str(source.extra.get("generator")), int(source.extra.get("examples") or 0), source.split, int(source.extra.get("seed") or 0))
            lines = curriculum.as_messages(made).select(F.to_json(F.struct("id", "category", "messages")).alias("value"))
        elif copied:
            lines = spark.read.text(own[0][2]).filter("trim(value) <> ''")
        else:
            lines = pipeline.plain_chunks(_documents(spark, sources, own), source.max_records, len(own)).select(F.to_json(F.struct("id", "text", "category", "source")).alias("value"))
        lines.write.mode("overwrite").text(folder)
        texts = shards.record_texts(spark.read.text(folder))
        size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint")
        row = texts.agg(F.count(F.lit(1)).alias("examples"), (size + 2 * F.count(F.lit(1))).alias("tokens"), size.alias("bytes"), T.table_hash(F.sha2("value", 256)).alias("identity"))
        natural = source.entry_type != "synthetic" and not source.supplemental
        row = row.select(F.lit(source.source).alias("source"), F.lit(source.entry_type).alias("entry_type"), F.lit(source.split).alias("split"), F.lit(natural).alias("natural"), "examples", "tokens", "bytes", "identity")
        written = row if written is None else written.unionByName(row)
    if written is None:
        raise shards.ShardError("the manifest has no entries")
    written.coalesce(1).write.mode("overwrite").json(f"{out}/manifest")
    return spark.read.schema(written.schema).json(f"{out}/manifest")


def tokenizer_sample(natural: DataFrame, supplemental: DataFrame, natural_records: int = 8000, supplemental_records: int = 4000, seed: int = 0) -> DataFrame:
    return sampling.tokenizer_sample(natural, supplemental, natural_records, supplemental_records, seed)


def check_contamination(train: DataFrame, held: DataFrame, allow: bool = False) -> DataFrame:
    """Examples (id, messages, target_text) of both sides; an error when they overlap, unless that is allowed."""
    both = []
    for df in (train, held):
        prompt, full = contamination.prompt_and_full(F.col("messages"), F.col("target_text") if "target_text" in df.columns else None)
        both.append(df.select("id", prompt.alias("prompt"), full.alias("full")))
    return contamination.assert_no_contamination(*both, allow=allow)


def render(examples: DataFrame) -> DataFrame:
    """id, text, n_tokens, n_loss, error of examples in any accepted shape."""
    rows = chat.normalize_examples(examples).withColumn("_s", F.when(F.col("error").isNull(), chat.segments()))
    return rows.select("id", chat.rendered_text(F.col("_s")).alias("text"), chat.token_count(F.col("_s")).alias("n_tokens"), chat.loss_token_count(F.col("_s")).alias("n_loss"), "error")


def build_curriculum(spark: SparkSession, sources: dict[str, float], n: int, seed: int = 0) -> DataFrame:
    return curriculum.verified(curriculum.build_stage(spark, sources, n, seed))


def build_curriculum_v2(spark: SparkSession, stage: str | Mapping[str, object], out: str, seed: int = 0, scale: float = 1.0) -> dict[str, object]:
    """Build a stage of groups (by name, or its mixture) and write it; what is known of it."""
    spec = reports.stage_config(stage)["mixture"] if isinstance(stage, str) else stage
    return curriculum.write_curriculum(*curriculum.build_curriculum(spark, spec, seed, scale), out)


def curriculum_v2_info(stage: str) -> dict[str, object]:
    """The mixture, budget and generators of a stage."""
    spec = reports.stage_config(stage)["mixture"]
    mixture = curriculum.stage_mixture(spec)
    return {"stage": stage, "mixture": mixture, "target_tokens": spec["target_tokens"], "replay_fraction": spec["replay_fraction"], "generators": {g: sorted(curriculum.GROUPS[g]) for g in mixture}}


def score_generations(rows: DataFrame) -> dict[str, DataFrame]:
    """Roll-ups of generated answers: id, category, scorer, paraphrase, text, expected, needles, tools, tool, arguments,
    expr_value, tokens, finish (what a scorer doesn't need may be null)."""
    wants = F.col("scorer").isin(*evaluation.TOOL_SCORERS)
    call = tools.call_score(tools.CALL(F.when(wants, F.col("text"))), F.col("tools"), F.col("tool"), F.col("arguments"), F.col("expr_value"))
    graded = rows.withColumn("_call", F.when(wants, call))
    plain = tools.score_text(F.col("scorer"), F.col("text"), F.col("expected"), F.coalesce("needles", F.array("expected")))
    ok = F.when(F.col("scorer") == "tool_name", F.col("_call.name_ok")).when(wants, F.col("_call.args_ok")).otherwise(F.coalesce(plain, F.lit(False)))
    graded = graded.withColumns({"ok": ok, "status": F.col("_call.status"), "name_ok": F.col("_call.name_ok")}).drop("_call")
    return {"rows": graded, "capabilities": evaluation.capability_accuracy(graded), "tool_behavior": evaluation.tool_behavior(graded), "generation": evaluation.generation_block(graded)}


def eval_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    return evaluation.compare(a, b)


def stage_gate(checks: DataFrame, metrics: DataFrame, **summary: object) -> DataFrame:
    return gates.evaluate_gate(checks, metrics, summary)


def objective_report(checks: DataFrame, metrics: DataFrame, comparison: DataFrame | None = None, stage: str | None = None, **state: bool) -> tuple[DataFrame, str | None]:
    """The verdict (with what the comparison with earlier reports says) and, for a named stage, the report in Markdown."""
    worse = bool(comparison is not None and reports.regressed(comparison).first().regressed)
    verdict = gates.objective_verdict(checks, metrics, **{"regressed": worse} | state)
    text = reports.render_report(f"Stage {stage}", verdict.first().asDict() | {"regressed": worse}, gates.check_metrics(checks, metrics, bound_required=False), comparison) if stage else None
    return verdict, text


def encode(texts: DataFrame, ranks: dict[bytes, int], columns: Sequence[str] = ("text",)) -> DataFrame:
    """``texts`` with ``<column>_ids`` under a public byte-level vocabulary."""
    merges = bpe.merges_from_ranks(ranks)
    return texts.withColumns({f"{c}_ids": bpe.encode(F.col(c), merges) for c in columns})
