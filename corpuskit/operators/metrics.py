"""Statistics of generated texts and of language use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.functions import text as T


def generation_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """One row per group ``by`` (all rows without): rates and means over generations (generation, tokens_generated,
    finish_reason). Repetition and diversity count non-empty texts only; what nothing supports is null."""
    text = T.strip(F.coalesce("generation", F.lit("")))
    each = rows.select(*by, "tokens_generated", "finish_reason", F.length(text).alias("chars"), (text != "").alias("full"), T.repetition(text).alias("rep"), T.words(text).alias("w"))
    full = lambda c: F.when(F.col("full"), c)
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("full").cast("int")).alias("non_empty_rate"),
        F.avg(full(F.col("rep"))).alias("mean_repetition"),
        F.avg(full((F.col("rep") > 0.5).cast("int"))).alias("looping_rate"),
        F.avg(full(T.distinct_n(F.col("w"), 1))).alias("mean_distinct_1"),
        F.avg(full(T.distinct_n(F.col("w"), 2))).alias("mean_distinct_2"),
        F.avg("chars").alias("mean_chars"),
        F.avg("tokens_generated").alias("mean_tokens_generated"),
        F.avg(F.coalesce(F.col("finish_reason") == "eos", F.lit(False)).cast("int")).alias("eos_rate"),
    ]
    return each.groupBy(*by).agg(*aggs) if by else each.agg(*aggs)


def lexicon(texts: DataFrame, words: int) -> DataFrame:
    """word, n: the most frequent normalised words of ``texts`` (text), by count, then word."""
    token = T.normalize_word(F.col("token"))
    counts = texts.select(F.explode(T.words(F.col("text"))).alias("token")).filter(T.is_word(F.col("token"))).groupBy(token.alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(words)


_OPEN, _CLOSE = "\"'“‘(\\[", "\"'”’)\\]"
_LETTER = r"[^\W\d_]"


def grammar_metrics(rows: DataFrame, known: DataFrame | None = None, *by: str, key: str = "id") -> DataFrame:
    """Floors on language-likeness over the non-blank texts of ``rows`` (``key``, text), per group ``by``.

    Word shares are means of per-text shares; capitals, spacing, word and sentence lengths are pooled. ``known`` (word)
    adds the share of known words.
    """
    t = T.strip(F.col("text"))
    base = rows.select(key, *by, t.alias("t")).filter("t <> ''").withColumn("tokens", T.words(F.col("t")))
    is_word = lambda w: T.is_word(w)
    words = F.filter("tokens", is_word)
    chars = F.regexp_replace("t", rf"{T.SPACE}", "")
    fine = F.length(F.regexp_replace(chars, r"[^\p{L}.,!?;:'\"\-()’“”]", ""))
    starts = F.regexp_extract_all("t", F.lit(rf"(?U)[.!?][{_CLOSE}]*\s+[{_OPEN}]*({_LETTER})"), F.lit(1))
    # A number's own point or comma is no case of spacing.
    marked = F.regexp_replace("t", r"(?<=\p{Nd})[.,](?=\p{Nd})", "")
    cases = F.regexp_extract_all(marked, F.lit(r"(?s)([,;:.!?])."), F.lit(1))
    good = F.regexp_extract_all(marked, F.lit(r"(?sU)([,;:.!?])[\s\"')\]}”’.,!?;:\-]"), F.lit(1))
    sentences = F.filter(F.split("t", r"[.!?]+"), lambda p: T.strip(p) != "")
    each = base.select(
        key, *by, "tokens", words.alias("words"),
        (F.size(words) / F.size("tokens")).alias("word_like"), (fine / F.length(chars)).alias("alpha"),
        F.size(starts).alias("starts"), F.size(F.filter(starts, lambda c: (F.upper(c) == c) & (F.lower(c) != c))).alias("capitals"),
        F.size(cases).alias("cases"), F.size(good).alias("spaced"), F.col("t").rlike(rf"[.!?][{_CLOSE}]*$").cast("int").alias("ends"),
        F.aggregate(words, F.lit(0), lambda n, w: n + F.length(T.trim_marks(w))).alias("letters"),
        F.size(sentences).alias("n_sentences"), F.aggregate(sentences, F.lit(0), lambda n, s: n + F.size(T.words(s))).alias("sentence_words"),
    )
    known_share: Column = F.lit(None).cast("double")
    if known is not None:
        hits = each.select(key, F.explode("words").alias("w")).select(key, T.normalize_word(F.col("w")).alias("word")).join(known.select("word"), "word").groupBy(key).agg(F.count(F.lit(1)).alias("n_known"))
        each = each.join(hits, key, "left")
        known_share = F.avg(F.coalesce("n_known", F.lit(0)) / F.size("tokens"))
    pooled = lambda a, b: F.try_divide(F.sum(a), F.nullif(F.sum(b), F.lit(0)))
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg("word_like").alias("word_like_fraction"), known_share.alias("known_word_fraction"), F.avg("alpha").alias("alpha_fraction"),
        pooled("capitals", "starts").alias("sentence_start_capitalized"), pooled("spaced", "cases").alias("space_after_punctuation"), F.avg("ends").alias("terminator_fraction"),
        pooled("letters", F.size("words")).alias("mean_word_length"), pooled("sentence_words", "n_sentences").alias("mean_sentence_words"),
    ]
    return each.groupBy(*by).agg(*aggs) if by else each.agg(*aggs)


def length_percentile(rows: DataFrame, length: str, share: float = 0.95) -> DataFrame:
    return rows.agg(F.percentile(length, F.lit(share)).alias(f"p{round(share * 100)}"))
