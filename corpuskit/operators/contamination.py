"""Overlap of training and evaluation data: word n-grams of evaluation texts, and equal prompts and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.functions import text as T
from corpuskit.session import spread


class ContaminationError(RuntimeError):
    """Evaluation data occurs in training data."""


def eval_ngrams(texts: DataFrame, n: int = 8) -> DataFrame:
    """gram: the distinct word n-grams of the evaluation texts (column text)."""
    plain = texts.select(T.normalize_text(F.col("text")).alias("plain"))
    return plain.select(F.explode(T.ngrams(F.col("plain"), n)).alias("gram")).distinct()


def contaminated(texts: DataFrame, grams: DataFrame, n: int = 8, id_col: str = "id", plain: str | None = None) -> DataFrame:
    """The distinct ids of ``texts`` (``id_col``, text) that have an n-gram among ``grams``.

    Grams are compared by 128-bit hashes, so that no text is exploded or shuffled; the evaluation side is broadcast by
    Spark while it is small, and beyond that both sides are shuffled as pairs of numbers. ``plain`` names a column that
    holds the normalised text already.
    """
    own = spread(texts.select(id_col, plain or "text")).select(id_col, F.col(plain).alias("plain") if plain else T.normalize_text(F.col("text")).alias("plain"))
    own = own.select(id_col, F.explode(T.gram_hashes(T.words(F.col("plain")), n)).alias("g")).select(id_col, "g.a", "g.b")
    asked = grams.select(F.explode(T.gram_hashes(F.split("gram", " "), n)).alias("g")).select("g.a", "g.b")
    return own.join(asked, ["a", "b"], "left_semi").select(id_col).distinct()


def prompt_and_full(messages: Column, target: Column | None = None, text: Column | None = None) -> tuple[Column, Column]:
    """The two texts by which examples are compared: all turns but the assistant's, and all turns with the target.

    Turns are joined by the unit separator. A text record is its own prompt.
    """
    line = lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(":"), F.coalesce(m["content"], F.lit("")))
    prompt = F.array_join(F.transform(F.filter(messages, lambda m: ~m["role"].eqNullSafe("assistant")), line), "\x1f")
    full = F.array_join(F.transform(messages, line), "\x1f")
    if target is not None:
        full = F.when(target.isNotNull(), F.concat(full, F.lit("\x1fassistant:"), target)).otherwise(full)
    if text is not None:
        return F.coalesce(text, prompt), F.coalesce(text, full)
    return prompt, full


KINDS = ("exact_prompt", "exact_full", "normalized_prompt", "normalized_full")


def _keys(df: DataFrame, id_col: str) -> DataFrame:
    sha = lambda c: F.sha2(c, 256)
    return df.select(id_col, sha(F.col("prompt")).alias("exact_prompt"), sha(F.col("full")).alias("exact_full"), sha(T.normalize_text(F.col("prompt"))).alias("normalized_prompt"), sha(T.normalize_text(F.col("full"))).alias("normalized_full"))


def check_overlap(train: DataFrame, evaluation: DataFrame, id_col: str = "id") -> DataFrame:
    """``id_col`` and a flag per kind of overlap for every evaluation example (columns id, prompt, full).

    One shuffle: the kinds are stacked into (kind, key) rows, the training keys made distinct before it.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in KINDS])).alias("k")
    seen = _keys(train, id_col).select(stack).select("k.kind", "k.key").distinct().withColumn("hit", F.lit(True))
    asked = _keys(evaluation, id_col).select(id_col, stack).select(id_col, "k.kind", "k.key").join(seen, ["kind", "key"], "left")
    return asked.groupBy(id_col).agg(*[F.coalesce(F.bool_or(F.when(F.col("kind") == k, F.coalesce("hit", F.lit(False)))), F.lit(False)).alias(k) for k in KINDS])


def overlap_summary(flags: DataFrame) -> DataFrame:
    """How many evaluation examples overlap, by kind, and whether any does."""
    counts = [F.count_if(F.col(k)).alias(f"{k}_overlap") for k in KINDS]
    anything = F.coalesce(F.bool_or(F.col(KINDS[0]) | F.col(KINDS[1]) | F.col(KINDS[2]) | F.col(KINDS[3])), F.lit(False))
    return flags.agg(F.count(F.lit(1)).alias("eval_examples"), *counts, anything.alias("contaminated"))


def assert_no_contamination(train: DataFrame, evaluation: DataFrame, allow: bool = False, id_col: str = "id") -> DataFrame:
    """The summary; an error when anything overlaps, unless that is allowed."""
    summary = overlap_summary(check_overlap(train, evaluation, id_col))
    if not allow and summary.first()["contaminated"]:
        raise ContaminationError("evaluation examples occur in the training data")
    return summary


def cross_split_overlap(texts: DataFrame) -> DataFrame:
    """For each pair of splits, how many distinct normalised texts occur in both (columns split, text)."""
    per = texts.select("split", T.content_key(F.col("text")).alias("key")).groupBy("key").agg(F.sort_array(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)
    # A key is in few splits at most: pairs are of split names.
    pairs = per.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_texts"))


def left_out(candidates: DataFrame, blocked: DataFrame, key: Column) -> DataFrame:
    """Candidates whose key (exact or normalised) does not occur among ``blocked`` (columns prompt)."""
    forms = blocked.select("prompt").select(F.explode(F.array(F.sha2("prompt", 256), F.sha2(T.normalize_text(F.col("prompt")), 256))).alias("_key")).distinct()
    out = candidates.withColumn("_key", F.sha2(key, 256)).join(forms, "_key", "left_anti")
    return out.withColumn("_key", F.sha2(T.normalize_text(key), 256)).join(forms, "_key", "left_anti").drop("_key")
