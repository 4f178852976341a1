"""The pN_ queries: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuskit.llm import families as fam
from corpuskit.llm import records as rec
from corpuskit.llm import leaks, mixing, overlap, sampling, splitting, toxicity
from corpuskit.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _tables(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    def wrap(fn: Callable[..., DataFrame]) -> Query:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*(table(spark, sf_dir, n) for n in names))

        query.__name__, query.__doc__ = fn.__name__, fn.__doc__
        return query

    return wrap


@_tables("raw_records", "dataset_manifest")
def p1_found(records: DataFrame, manifest: DataFrame) -> DataFrame:
    return splitting.oversized(records, manifest)


@_tables("raw_records", "dataset_manifest")
def p1_pieces(records: DataFrame, manifest: DataFrame) -> DataFrame:
    return splitting.split_oversized(records, manifest)


@_tables("chat_examples", "dataset_manifest")
def p2_sample(examples: DataFrame, manifest: DataFrame) -> DataFrame:
    return sampling.stable_sample(examples, manifest)


@_tables("chat_examples", "dataset_manifest")
def p2_rates(examples: DataFrame, manifest: DataFrame) -> DataFrame:
    return sampling.sample_rates(examples, manifest)


@_tables("chat_examples", "dataset_manifest")
def p2_growth(examples: DataFrame, manifest: DataFrame) -> DataFrame:
    return sampling.sample_growth(examples, manifest)


@_tables("corpus_chunks", "dataset_manifest")
def p3_found(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    return fam.family_members(fam.families(chunks, manifest))


@_tables("corpus_chunks", "dataset_manifest", "split_targets")
def p3_splits(chunks: DataFrame, manifest: DataFrame, targets: DataFrame) -> DataFrame:
    return fam.assign_splits(fam.families(chunks, manifest), targets)


@_tables("corpus_chunks", "dataset_manifest", "split_targets")
def p3_report(chunks: DataFrame, manifest: DataFrame, targets: DataFrame) -> DataFrame:
    return fam.split_report(fam.assign_splits(fam.families(chunks, manifest), targets), targets)


@_tables("chat_examples", "dataset_manifest")
def p4_found(examples: DataFrame, manifest: DataFrame) -> DataFrame:
    return overlap.CrossSplitOverlaps(examples, manifest).found()


@_tables("chat_examples", "dataset_manifest")
def p4_report(examples: DataFrame, manifest: DataFrame) -> DataFrame:
    return overlap.CrossSplitOverlaps(examples, manifest).report()


@_tables("raw_records", "dataset_manifest")
def p5_found(records: DataFrame, manifest: DataFrame) -> DataFrame:
    return rec.RecordClasses(records, manifest).members()


@_tables("raw_records", "dataset_manifest")
def p5_records(records: DataFrame, manifest: DataFrame) -> DataFrame:
    return rec.RecordClasses(records, manifest).collapsed()


@_tables("documents", "eval_items")
def p6_found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks.leaked(leaks.leaks(documents, items))


@_tables("documents", "eval_items")
def p6_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks.leaks(documents, items)


@_tables("documents", "eval_items")
def p6_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks.leak_report(leaks.leaks(documents, items), items)


@_tables("documents", "mixture_targets")
def p7_found(documents: DataFrame, targets: DataFrame) -> DataFrame:
    return mixing.Mixture(documents, targets).short()


@_tables("documents", "mixture_targets")
def p7_mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    return mixing.Mixture(documents, targets).mixed()


@_tables("documents", "mixture_targets")
def p7_shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    return mixing.Mixture(documents, targets).shares()


@_tables("documents", "doc_labels")
def p8_found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = toxicity.fit(documents, labels)
    return toxicity.flagged(toxicity.score(documents, model), model)


@_tables("documents", "doc_labels")
def p8_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity.score(documents, toxicity.fit(documents, labels))


@_tables("documents", "doc_labels")
def p8_rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = toxicity.fit(documents, labels)
    return toxicity.rates(toxicity.score(documents, model), model)


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
