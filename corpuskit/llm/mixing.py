"""Mixing sources to target weights (problem 7).

Poisson replication: each document's number of copies is read off a Poisson distribution, whose mean is the source's
target repetition rate, at a point fixed by a hash of mixture and document. Copies are then exploded and shuffled
globally by another hash. Nothing but one row per mixture and source is ever gathered.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from math import exp, lgamma, log, sqrt
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.llm._common import map_rows
from corpuskit.llm.leaks import spread
from corpuskit.session import Workspace

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  #: a public byte-level BPE vocabulary, as ranks or as a .json of the tokenizers library
# Fixed value: the pattern by which byte-level vocabularies of this kind cut texts into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counter(name: str, spec: bytes) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens, from the content of a vocabulary file."""
    if name.endswith(".tiktoken"):
        from base64 import b64decode

        from tiktoken import Encoding

        ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, spec.splitlines())}
        encode = Encoding(name, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [len(encode(t)) for t in texts]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(spec.decode())
    whole.encode_special_tokens = True
    return lambda texts: [len(e.ids) for i in range(0, len(texts), 64) for e in whole.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]


def source_key(source: Column) -> Column:
    return F.regexp_replace(F.lower(source), r"(?U)^\s+|\s+$", "")


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source (trimmed, lower case) and tokens of every document that counts for a source.

    The vocabulary file is read on the driver and broadcast (its size is that of a public vocabulary, a few MB).
    Null and empty texts have no tokens; documents without a source count for none and are left out.
    """
    spec = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sys.__dict__.setdefault("_corpuskit_tokenizers", {})  # outlives the task in a reused worker
        if tokenizer not in held:
            held[tokenizer] = token_counter(tokenizer, spec.value)
        for batch in batches:
            sizes = held[tokenizer]([t or "" for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"].cast(pa.string()), pa.array(sizes, pa.int64())], schema=schema)

    docs = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").filter("doc_id is not null and source is not null and source <> ''")
    return spread(docs).mapInArrow(count, "doc_id bigint, source string, tokens bigint")


_TAIL = 2.0**-60  #: a probability that no 53-bit point tells from 0


def poisson_cdf(mean: float, upto: int) -> tuple[int, np.ndarray]:
    """(first, P(X <= k) for k = first, first + 1, ... below ``upto``).

    What lies outside is 0 (before) or 1 (behind) to within the resolution of the points it is read at, so the length
    grows with the square root of the mean and not with ``upto``.
    """
    reach = 10 * sqrt(mean) + 50
    first, last = max(0, int(mean - reach)), min(upto, int(mean + reach) + 1)
    if first >= last:
        return upto, np.zeros(0)
    k = np.arange(first, last)
    log_k = np.concatenate([[lgamma(first + 1)], np.log(k[1:])]).cumsum()
    upto_k = np.minimum(np.cumsum(np.exp(k * log(mean) - mean - log_k)), 1.0)
    skip = int(np.searchsorted(upto_k, _TAIL))
    keep = int(np.searchsorted(upto_k, 1 - 2.0**-53)) + 1
    return first + skip, upto_k[skip:keep]


def capped_cdf(rate: float, cap: int) -> tuple[int, list[float]]:
    """The distribution function, as above, of a Poisson number cut off at ``cap`` whose mean after the cut is ``rate``.

    With a rate of ``cap`` or more every point gives ``cap``.
    """
    if rate <= 0 or cap <= 0:
        return 0, [1.0]
    if rate >= cap:
        return cap, []

    def cut_mean(log_mean: float) -> float:
        first, upto_k = poisson_cdf(exp(log_mean), cap)
        return first + float((1 - upto_k).sum())

    lo, hi = log(rate), log(rate) + 1
    while cut_mean(hi) < rate and hi < 700:
        lo, hi = hi, 2 * hi - lo
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cut_mean(mid) < rate else (lo, mid)
    first, upto_k = poisson_cdf(exp(lo), cap)
    return first, upto_k.tolist()


def _solve(cols: dict[str, list]) -> dict[str, list]:
    first, cdf = zip(*(capped_cdf(r or 0.0, c) for r, c in zip(cols["rate"], cols["max_repeats"], strict=True)), strict=True)
    return cols | {"fewest": list(first), "cdf": list(cdf)}


class Mixture:
    """A draw of documents for every mixture of ``targets`` (mixture, total_tokens, source, target_share, max_repeats).

    ``documents`` needs doc_id, source and text; other columns are ignored. Sources match whatever their case and outer
    spaces. A null budget or share counts as 0, a null or negative max_repeats as 0 (nothing may be used). Several
    target rows of one mixture and source add their shares and take the least max_repeats. A repeated doc_id counts
    once (with its largest token count). Without documents every positive target is out of reach.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 0):
        self.space, self.seed = Workspace(documents.sparkSession, "mixture"), seed
        sized = count_tokens(documents, tokenizer).groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens"))
        self.sized = self.space.write(sized, "sized")
        self.plan = self.space.write(self._plan(targets), "plan")

    def _plan(self, targets: DataFrame) -> DataFrame:
        supply = self.sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("available_tokens"))
        wanted = targets.filter("mixture is not null and source is not null").select("mixture", source_key(F.col("source")).alias("source"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
        wanted = wanted.groupBy("mixture", "source").agg(F.max("total_tokens").alias("total_tokens"), F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
        plan = wanted.join(supply, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_docs", "available_tokens")})
        plan = plan.withColumn("target_tokens", F.col("total_tokens") * F.col("target_share"))
        plan = plan.withColumn("rate", F.try_divide("target_tokens", "available_tokens")).withColumn("reachable", F.col("available_tokens") * F.col("max_repeats") >= F.col("target_tokens"))
        schema = "source string, mixture string, total_tokens bigint, target_share double, max_repeats int, n_docs bigint, available_tokens bigint, target_tokens double, rate double, reachable boolean, fewest int, cdf array<double>"
        return map_rows(plan, _solve, schema)

    def draws(self) -> DataFrame:
        """mixture, source, doc_id, tokens, copies: how often each document is used; documents not used are absent."""
        u = F.shiftrightunsigned(F.xxhash64("mixture", "doc_id", F.lit(self.seed)), 11) * F.lit(2.0**-53)
        rows = self.sized.join(self.plan.filter("max_repeats > 0").select("source", "mixture", "fewest", "cdf"), "source").withColumn("_u", u)
        copies = F.col("fewest") + F.size(F.filter("cdf", lambda p: p <= F.col("_u")))
        return rows.select("mixture", "source", "doc_id", "tokens", copies.alias("copies")).filter("copies > 0")

    def short(self) -> DataFrame:
        """mixture, source whose draw stays below the target though it uses every document max_repeats times.

        The draw's rate reaches max_repeats exactly where the target asks for all of that and more, and then every point
        of the distribution gives max_repeats; so the draw itself tells which sources are short.
        """
        full = self.draws().join(self.plan.select("mixture", "source", "max_repeats"), ["mixture", "source"]).filter(F.col("copies") == F.col("max_repeats"))
        full = full.groupBy("mixture", "source").agg(F.count(F.lit(1)).alias("docs_full"), F.sum(F.col("tokens") * F.col("copies")).alias("full_tokens"))
        out = self.plan.join(full, ["mixture", "source"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("docs_full", "full_tokens")})
        exhausted = (F.col("docs_full") == F.col("n_docs")) | (F.col("max_repeats") == 0)
        return out.filter(exhausted & (F.col("full_tokens") < F.col("target_tokens"))).select("mixture", "source")

    def mixed(self) -> DataFrame:
        """mixture, source, doc_id, copy_no, tokens: one row for each use, in a global order given by a hash."""
        rows = self.draws().select("mixture", "source", "doc_id", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"), "tokens")
        return rows.withColumn("order_key", F.xxhash64(F.lit(self.seed), F.lit("order"), "mixture", "doc_id", "copy_no")).orderBy("mixture", "order_key", "doc_id", "copy_no")

    def shares(self) -> DataFrame:
        """Per mixture and source: target and reached tokens and shares, documents used and the most uses of one."""
        used = self.draws().groupBy("mixture", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.count(F.lit(1)).alias("docs_used"), F.max("copies").alias("most_uses"))
        out = self.plan.join(used, ["mixture", "source"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("drawn_tokens", "docs_used", "most_uses")})
        drawn = out.groupBy("mixture").agg(F.sum("drawn_tokens").alias("all_tokens"))
        return out.join(drawn, "mixture").select("mixture", "source", "target_share", F.round("target_tokens", 3).alias("target_tokens"), "available_tokens", "max_repeats", "reachable", "drawn_tokens", "docs_used", "most_uses", F.round(F.try_divide("drawn_tokens", "total_tokens"), 6).alias("share_of_budget"), F.round(F.try_divide("drawn_tokens", "all_tokens"), 6).alias("share_of_drawn"))
