"""Functions over arrays of numbers: similarity, sampling filters, token bans, quantisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpuskit.functions.binding import let


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 against a zero vector, whose norm counts as 1."""
    one = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def softmax(logits: Column) -> Column:
    powers = let(F.array_max(logits).cast("double"), lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top)))
    return let(powers, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def apply_temperature(logits: Column, temperature: float) -> Column:
    if temperature < 0:
        raise ValueError("the temperature must not be negative")
    return logits if temperature == 0 else F.transform(logits, lambda x: x.cast("double") / temperature)


def _renormalised(a: Column) -> Column:
    return let(a, lambda v: let(total(v), lambda s: F.when(s > 0, F.transform(v, lambda x: x / s)).otherwise(v)))


def top_k_filter(probs: Column, k: int) -> Column:
    """Zero below the k-th largest probability (ties with it stay), then renormalise."""
    if k <= 0:
        raise ValueError("k must be positive")

    def cut(v: Column) -> Column:
        rest = let(F.get(F.sort_array(v, asc=False), F.lit(k - 1)), lambda least: F.transform(v, lambda p: F.when(p >= least, p).otherwise(0.0)))
        return F.when(F.size(v) <= k, v).otherwise(_renormalised(rest))

    return let(probs, cut)


def top_p_filter(probs: Column, p: float) -> Column:
    """The smallest set of largest probabilities with a sum of at least ``p`` (earlier places first among equals)."""
    if not 0 < p <= 1:
        raise ValueError("p must be in (0, 1]")
    return let(probs, lambda v: _nucleus(v, p))


def _nucleus(probs: Column, p: float) -> Column:
    ranked = F.array_sort(F.transform(probs, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    kept = F.aggregate(
        ranked,
        F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("at")),
        lambda s, e: F.when(s["sum"] < p, F.struct((s["sum"] - e["x"]).alias("sum"), F.concat(s["at"], F.array(e["i"])).alias("at"))).otherwise(s),
        lambda s: s["at"],
    )
    return _renormalised(let(kept, lambda at: F.transform(probs, lambda x, i: F.when(F.array_contains(at, i), x).otherwise(0.0))))


def argmax(values: Column) -> Column:
    """The first place (from 0) of the largest value; null for an empty array."""
    return F.when(F.size(values) > 0, (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def pick(probs: Column, uniform: Column) -> Column:
    """The place (from 0) where the running sum reaches ``uniform`` times the whole; null without positive mass."""
    return let(probs, lambda v: let(uniform * total(v), lambda target: _reach(v, target)))


def _reach(probs: Column, target: Column) -> Column:
    found = F.aggregate(
        probs,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i")),
        lambda s, p: F.when(s["sum"] >= target, s).otherwise(F.struct((s["sum"] + p).alias("sum"), (s["i"] + 1).alias("i"))),
        lambda s: F.greatest(s["i"] - 1, F.lit(0)),
    )
    return F.when(total(probs) > 0, found)


def select_token(logits: Column, uniform: Column, temperature: float = 0.0, top_k: int | None = None, top_p: float | None = None) -> Column:
    """Temperature, softmax, filters, draw; the largest logit at temperature 0."""
    if temperature == 0:
        return argmax(logits)
    probs = softmax(apply_temperature(logits, temperature))
    probs = top_k_filter(probs, top_k) if top_k else probs
    return pick(top_p_filter(probs, top_p) if top_p else probs, uniform)


def repetition_penalty(logits: Column, used: Column, penalty: float) -> Column:
    """Divide positive and multiply other logits of tokens already used."""
    if penalty == 1.0:
        return logits
    return F.transform(logits, lambda x, i: F.when(F.array_contains(used, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


def banned_ngram_tokens(ids: Column, n: int) -> Column:
    """Tokens that would complete an n-gram already present; sorted and distinct."""
    none = F.array().cast("array<int>")
    if n <= 0:
        return none
    last = F.slice(ids, F.greatest(F.size(ids) - (n - 2), F.lit(1)), n - 1) if n > 1 else None
    starts = F.sequence(F.lit(1), F.size(ids) - (n - 1))
    hit = F.filter(starts, lambda i: F.slice(ids, i, n - 1) == last) if n > 1 else starts
    return F.when(F.size(ids) < n, none).otherwise(F.array_sort(F.array_distinct(F.transform(hit, lambda i: F.element_at(ids, i + (n - 1))))))


def _scale(row: Column, most: int) -> Column:
    peak = F.array_max(F.transform(row, lambda x: F.abs(x.cast("float"))))
    return (F.when(peak == 0, F.lit(1.0).cast("float")).otherwise(peak) / F.lit(float(most)).cast("float")).cast("float")


def quantize(row: Column, most: int = 127) -> Column:
    """scale (float) and values (tinyint) of a row: half to even, within ±most; 127 for int8, 7 for int4."""

    def scaled(scale: Column) -> Column:
        q = F.transform(row, lambda x: F.least(F.greatest(F.rint((x.cast("float") / scale).cast("float").cast("double")), F.lit(-float(most))), F.lit(float(most))).cast("tinyint"))
        return F.struct(scale.alias("scale"), q.alias("values"))

    return let(_scale(row, most), scaled)


def dequantize(q: Column) -> Column:
    return F.transform(q["values"], lambda x: (x.cast("float") * q["scale"]).cast("float"))


def pack_int4(values: Column) -> Column:
    """Pairs of values from -8 to 7 as excess-8 nibbles, low nibble first; an odd end is padded with 0."""
    even = F.when(F.size(values) % 2 == 1, F.concat(values, F.array(F.lit(0).cast("tinyint")))).otherwise(values)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest((F.size(even) / 2).cast("int"), F.lit(1))), lambda i: F.lpad(F.hex((F.get(even, i * 2 - 2) + 8) + (F.get(even, i * 2 - 1) + 8) * 16), 2, "0"))
    return F.when(F.size(values) == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(pairs, "")))


def unpack_int4(packed: Column, width: Column) -> Column:
    digits = F.hex(packed)
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: (F.conv(F.substring(digits, (i / 2).cast("int") * 2 + F.when(i % 2 == 0, 2).otherwise(1), F.lit(1)), 16, 10).cast("int") - 8).cast("tinyint"))
