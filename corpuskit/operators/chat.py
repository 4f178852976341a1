"""Chat and text examples: validation to one shape, rendering with a loss mask, byte tokens, overflow rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.functions import jsonfns as J, text as T, types as Y

# Token ids of the byte tokenizer and the label without loss.
PAD, BOS, EOS, UNK, BYTE0, IGNORE = 0, 1, 2, 3, 4, -100
ROLES = ("system", "user", "assistant", "tool")
SEGMENTS = "array<struct<text:string,special:string,trainable:boolean>>"


def normalize_examples(df: DataFrame, id_col: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Examples (``id_col``, category, text, messages, tools, target_type, target_text; absent columns count as null)
    reduced to one shape: id, kind (text or chat), category, text, messages (role, content, train), tools, and ``error``
    (null when the example is usable).

    ``target_text`` becomes a last, trainable assistant turn, unless the messages end with one already. Columns in ``keep``
    come through as they are.
    """
    have = set(df.columns)
    col = lambda c, t: F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    rows = df.select(
        F.col(id_col).alias("id"), F.coalesce(col("category", "string"), F.lit("")).alias("category"), col("text", "string").alias("text"),
        col("messages", "array<struct<role:string,content:string,train:boolean>>").alias("messages"), F.coalesce(col("tools", "array<string>"), F.array().cast("array<string>")).alias("tools"),
        col("target_type", "string").alias("target_type"), col("target_text", "string").alias("target_text"), *keep,
    )
    train = lambda m: F.coalesce(m["train"], m["role"] == "assistant")
    turns = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), train(m).alias("train")))
    ends = F.coalesce(F.element_at(F.col("messages.role"), -1) == "assistant", F.lit(False))
    ends = F.when(F.size("messages") > 0, ends).otherwise(F.lit(False))
    added = F.array(F.struct(F.lit("assistant").alias("role"), F.col("target_text").alias("content"), F.lit(True).alias("train")))
    rows = rows.withColumn("turns", F.when(F.col("target_text").isNotNull() & ~ends, F.concat(turns, added)).otherwise(turns))
    has_text, has_chat = F.col("text").isNotNull(), F.col("messages").isNotNull()
    trained = F.filter("turns", lambda m: m["train"])
    error = (
        F.when(F.col("id").isNull() | (F.col("id").cast("string") == ""), "no id")
        .when(has_text & has_chat, "both text and messages")
        .when(has_text & (T.strip(F.col("text")) == ""), "blank text")
        .when(has_text, F.lit(None))
        .when(~has_chat | (F.size("messages") == 0), "neither text nor messages")
        .when(F.exists("messages", lambda m: m.isNull() | ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)) | m["content"].isNull()), "a message without known role or content")
        .when(F.exists("turns", lambda m: m["train"] & (m["role"] != "assistant")), "a trained turn that isn't the assistant's")
        .when(F.exists("tools", lambda t: t.isNull() | (t == "")), "a tool without name")
        .when(F.size(trained) == 0, "nothing to learn")
        .when(F.exists(trained, lambda m: T.strip(m["content"]) == ""), "an empty trained turn")
    )
    category = F.when((F.col("category") == "") & F.col("target_type").isNotNull() & ~ends & F.col("target_text").isNotNull(), F.col("target_type")).otherwise(F.col("category"))
    return rows.select("id", F.when(has_text, "text").otherwise("chat").alias("kind"), category.alias("category"), "text", F.col("turns").alias("messages"), "tools", error.alias("error"), *keep)


def segments() -> Column:
    """The pieces of an example's training sequence (over the columns of normalize_examples).

    Tools and all system turns come first; loss falls on trained assistant turns and their end marks, or a whole text.
    """
    seg = lambda text, special, train: F.struct((text if isinstance(text, Column) else F.lit(text)).alias("text"), F.lit(special).cast("string").alias("special"), (train if isinstance(train, Column) else F.lit(train)).alias("trainable"))
    start = F.array(seg("", "bos", False))
    tools = F.when(F.size("tools") > 0, F.array(seg(F.concat(F.lit("tools: "), F.array_join("tools", ", "), F.lit("\n")), None, False))).otherwise(F.array().cast(SEGMENTS))
    said = lambda m: F.concat(m["role"], F.lit(":\n"), m["content"], F.lit("\n"))
    system = F.transform(F.filter("messages", lambda m: m["role"] == "system"), lambda m: seg(said(m), None, False))
    answer = lambda m: F.array(seg("assistant:\n", None, False), seg(m["content"], None, m["train"]), seg("", "eos", m["train"]))
    rest = F.transform(F.filter("messages", lambda m: m["role"] != "system"), lambda m: F.when(m["role"] == "assistant", answer(m)).otherwise(F.array(seg(said(m), None, False))))
    whole = F.array(seg("", "bos", False), seg(F.col("text"), None, True), seg("", "eos", True))
    return F.when(F.col("kind") == "text", whole).otherwise(F.concat(start, tools, system, F.flatten(rest)))


def rendered_text(segs: Column) -> Column:
    """The sequence as text, with marks for the special tokens."""
    return F.array_join(F.transform(segs, lambda s: F.when(s["special"].isNotNull(), F.concat(F.lit("<"), F.upper(s["special"]), F.lit(">"))).otherwise(s["text"])), "")


def prompt_text() -> Column:
    """What a model reads before it writes the next assistant turn; null when the last turn is an assistant's."""
    last = F.when(F.size("messages") > 0, F.element_at("messages", -1)["role"])
    return F.when(last != "assistant", F.concat(rendered_text(segments()), F.lit("assistant:\n")))


def _tokens(seg: Column) -> Column:
    return F.when(seg["special"].isNotNull(), F.lit(1)).otherwise(F.octet_length(seg["text"]))


def token_count(segs: Column) -> Column:
    """Byte tokens of the sequence, counted in the JVM."""
    return F.aggregate(segs, F.lit(0), lambda n, s: n + _tokens(s))


def loss_token_count(segs: Column) -> Column:
    return F.aggregate(segs, F.lit(0), lambda n, s: n + F.when(s["trainable"], _tokens(s)).otherwise(0))


@F.pandas_udf(Y.struct(ids=Y.INTS, labels=Y.INTS))
def byte_tokens(segs: pd.Series) -> pd.DataFrame:
    """Token ids and labels (-100 where there is no loss; the first token never has any)."""
    ids, labels = [], []
    for seg in segs:
        row, lab = [], []
        for s in [] if seg is None else seg:
            part = [BOS if s["special"] == "bos" else EOS] if s["special"] else [b + BYTE0 for b in s["text"].encode()]
            row += part
            lab += part if s["trainable"] else [IGNORE] * len(part)
        ids.append(row)
        labels.append([IGNORE, *lab[1:]] if lab else [])
    return pd.DataFrame({"ids": ids, "labels": labels})


@F.pandas_udf(Y.INTS)
def encode_bytes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [b + BYTE0 for b in t.encode()])


@F.pandas_udf(Y.STRING)
def decode_bytes(ids: pd.Series) -> pd.Series:
    """The text of byte tokens; specials vanish, what is no UTF-8 becomes U+FFFD."""
    return ids.map(lambda row: None if row is None else bytes(int(i) - BYTE0 for i in row if i >= BYTE0).decode(errors="replace"))


def before_eos(ids: Column) -> Column:
    """The tokens before the first end mark."""
    at = F.array_position(ids, EOS)
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def apply_overflow(df: DataFrame, max_len: int, policy: str = "error", ids: str = "ids", labels: str = "labels") -> DataFrame:
    """Sequences within ``max_len``, with ``overflow``: null, truncated or dropped (dropped ones keep their row, empty).

    ``error`` raises when the row is read, ``drop`` drops, ``truncate`` cuts and drops what has no loss token left.
    """
    if policy not in ("error", "drop", "truncate"):
        raise ValueError(f"unknown policy {policy!r}")
    long = F.size(ids) > max_len
    cut = F.slice(labels, 1, max_len)
    loss = F.exists(F.slice(cut, 2, max(1, max_len)), lambda x: x != IGNORE)
    state = {"drop": F.when(long, "dropped"), "truncate": F.when(long & loss, "truncated").when(long, "dropped"), "error": F.when(F.when(long, F.raise_error(F.lit(f"a sequence is longer than {max_len} tokens"))).otherwise(F.lit(False)), "error")}[policy]
    out = df.withColumn("overflow", state)
    none = F.array().cast("array<int>")
    for c in (ids, labels):
        out = out.withColumn(f"_{c}", F.when(F.col("overflow") == "dropped", none).otherwise(F.slice(c, 1, max_len)))
    return out.drop(ids, labels).withColumnsRenamed({f"_{ids}": ids, f"_{labels}": labels})


def dataset_stats(df: DataFrame) -> DataFrame:
    """Examples, tokens (sum, least, most, mean to two places) and loss tokens of rows with n_tokens and n_loss."""
    return df.agg(F.count(F.lit(1)).alias("n_examples"), F.sum("n_tokens").cast("bigint").alias("tokens"), F.min("n_tokens").alias("min_tokens"), F.max("n_tokens").alias("max_tokens"), F.bround(F.avg("n_tokens"), 2).alias("mean_tokens"), F.sum("n_loss").cast("bigint").alias("loss_tokens"))


def by_category(df: DataFrame) -> DataFrame:
    """Examples per category; a blank category reads (none)."""
    return df.groupBy(F.when(F.coalesce("category", F.lit("")) == "", "(none)").otherwise(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n_examples"))


def content_hash(df: DataFrame, *order: str, columns: list[str]) -> DataFrame:
    """One hash of all rows with their places in the order, whatever the partitioning."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (*order, *columns)]), 256)
    return df.agg(T.table_hash(row).alias("content_hash"))


def unique_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``df`` itself; an error naming one of them when an id occurs twice. Ids alone are read and shuffled for it."""
    again = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(id_col).limit(1).collect()
    if again:
        raise ValueError(f"the id {again[0][0]!r} occurs more than once")
    return df


def legacy_tokens(messages: Column, target_type: Column, target_text: Column, max_len: int | None = None) -> tuple[Column, Column]:
    """Byte ids of the prompt in the older training format (a start mark and the contents joined by a space, cut to
    ``max_len``) and the text of the target, a call with its name before its arguments."""
    prompt = F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), " ")
    ids = F.concat(F.array(F.lit(BOS)), encode_bytes(prompt))
    target = F.when(target_type == "tool_call", J.legacy_call_text(target_text)).otherwise(F.coalesce(target_text, F.lit("")))
    return (F.slice(ids, 1, max_len) if max_len else ids), target


canonical_json, tool_call_text = J.canonical_json, J.tool_call_text
