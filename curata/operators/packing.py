"""Byte tokens, chat serialization with targets, isolated windows and fixed-length sequences: array expressions only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

# Ids of the byte tokenizer; bytes begin at BYTE.
PAD, BOS, EOS, BYTE, VOCABULARY = 0, 1, 2, 32, 288
ROLE_IDS = {"system": 3, "user": 4, "assistant": 5, "tool": 6}
TURN_END = 7
IGNORE = -100


def byte_tokens(c: Column) -> Column:
    """UTF-8 bytes of a text as token ids: the hex form, cut into pairs in one pass."""
    pairs = F.filter(F.split(F.hex(F.encode(c, "UTF-8")), r"(?<=\G..)"), lambda h: h != "")
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int") + BYTE)


def byte_text(tokens: Column) -> Column:
    """The text of byte tokens; ids below the bytes are left out."""
    hexes = F.transform(F.filter(tokens, lambda t: t >= BYTE), lambda t: F.lpad(F.hex((t - BYTE).cast("long")), 2, "0"))
    return F.decode(F.unhex(F.array_join(hexes, "")), "UTF-8")


def n_bytes(c: Column) -> Column:
    return F.octet_length(c)


def window_counts(tokens: Column, length: int) -> tuple[Column, Column]:
    """Windows and supervised targets of a document of ``tokens`` tokens besides its two ends."""
    return F.ceil((tokens + 1) / (length - 1)).cast("long"), (tokens + 1).cast("long")


def windows(df: DataFrame, key: str, tokens: str, length: int) -> DataFrame:
    """``(key, at, window)``: stretches of ``length`` tokens that overlap by one and never span documents."""
    whole = F.concat(F.array(F.lit(BOS)), F.col(tokens), F.array(F.lit(EOS)))
    d = df.select(key, whole.alias("_w"))
    d = d.select(key, "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - 2, F.lit(length - 1))).alias("at"))
    return d.select(key, "at", F.slice("_w", F.col("at") + 1, F.lit(length)).alias("window"))


def sequence(df: DataFrame, tokens: str, targets: str | None, length: int, pad: int = PAD) -> DataFrame:
    """``df`` with ``input_ids``, ``labels``, ``attention_mask``, ``n_targets`` and ``code``.

    Labels stand with their tokens (the loss shifts once), are ``IGNORE`` outside
    the targets and for the first token; rows of fewer than two or more than
    ``length`` tokens, and rows without a target, get a code.
    """
    t = F.col(tokens)
    fill = lambda v: F.array_repeat(F.lit(v), F.greatest(F.lit(length) - F.size(t), F.lit(0)))
    sup = F.col(targets) if targets else F.transform(t, lambda _: F.lit(True))
    lab = F.zip_with(t, sup, lambda a, b: F.when(b, a).otherwise(IGNORE))
    lab = F.concat(F.array(F.lit(IGNORE)), F.slice(lab, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))))
    d = df.withColumn("input_ids", F.concat(t, fill(pad))).withColumn("labels", F.concat(lab, fill(IGNORE)))
    d = d.withColumn("attention_mask", F.concat(F.transform(t, lambda _: F.lit(1)), fill(0))).withColumn("n_targets", F.size(F.filter("labels", lambda x: x != IGNORE)))
    return d.withColumn("code", F.when(F.size(t) < 2, "TOO_SHORT").when(F.size(t) > length, "TOO_LONG").when(F.col("n_targets") == 0, "NO_TARGET"))


def chat(msgs: Column, answer_prompt: bool = False) -> tuple[Column, Column]:
    """Tokens and targets of a conversation: role id, header of name and call id, content with tool calls, turn end.

    Contents, headers and turn ends of assistants are targets; roles are not.
    """
    ids = F.create_map(*[F.lit(x) for kv in ROLE_IDS.items() for x in kv])

    def one(m):
        named = F.to_json(F.struct(m["name"].alias("name"), m["tool_call_id"].alias("tool_call_id")))
        head = F.when(m["name"].isNotNull() | m["tool_call_id"].isNotNull(), F.concat(named, F.lit("\n"))).otherwise("")
        calls = F.when(F.coalesce(m["tool_calls"], F.lit("")).startswith("["), F.concat(F.lit('\n{"tool_calls":'), m["tool_calls"], F.lit("}"))).otherwise("")
        text = F.concat(head, F.coalesce(m["content"], F.lit("")), calls)
        said = m["role"] == "assistant"
        toks = F.concat(F.array(F.element_at(ids, m["role"])), byte_tokens(text), F.array(F.lit(TURN_END)))
        tgts = F.concat(F.array(F.lit(False)), F.array_repeat(said, F.octet_length(text) + 1))
        return F.struct(toks.alias("t"), tgts.alias("s"))

    parts = F.transform(msgs, one)
    tail = ([F.array(F.lit(ROLE_IDS["assistant"]))], [F.array(F.lit(False))]) if answer_prompt else ([], [])
    t = F.concat(F.array(F.lit(BOS)), F.flatten(F.transform(parts, lambda p: p["t"])), *tail[0])
    s = F.concat(F.array(F.lit(False)), F.flatten(F.transform(parts, lambda p: p["s"])), *tail[1])
    return t, s


def pack_sft(convs: DataFrame, msgs: str, length: int) -> DataFrame:
    """Packed conversations, ended by EOS as a target, with ``aux_position`` on the last turn end."""
    t, s = chat(F.col(msgs))
    d = convs.withColumn("tokens", F.concat(t, F.array(F.lit(EOS)))).withColumn("targets", F.concat(s, F.array(F.lit(True))))
    return sequence(d, "tokens", "targets", length).withColumn("aux_position", F.size("tokens") - 2).drop("tokens", "targets")


def pack_preference(pairs: DataFrame, prompt: str, length: int) -> DataFrame:
    """Chosen and rejected sequences of each row; the prompt is never a target."""
    base, _ = chat(F.col(prompt))
    out = pairs.withColumn("_n", F.size(base))
    for side in ("chosen", "rejected"):
        answer = F.struct(F.lit("assistant").alias("role"), F.col(side).alias("content"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("tool_calls"))
        p = F.transform(F.col(prompt), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["name"].alias("name"), m["tool_call_id"].alias("tool_call_id"), m["tool_calls"].alias("tool_calls")))
        t, s = chat(F.concat(p, F.array(answer)))
        d = out.withColumn("_t", F.concat(t, F.array(F.lit(EOS)))).withColumn("_s", F.concat(F.transform(s, lambda v, i: v & (i >= F.col("_n"))), F.array(F.lit(True))))
        d = sequence(d, "_t", "_s", length)
        for c in ("input_ids", "labels", "attention_mask", "n_targets", "code"):
            d = d.withColumnRenamed(c, f"{side}_{c}")
        out = d.drop("_t", "_s")
    return out.drop("_n")


def pack_rl(rows: DataFrame, prompt: str, length: int) -> DataFrame:
    """Prompts followed by the assistant's role id, padded, with their mask; overflow gets a code."""
    t, _ = chat(F.col(prompt), answer_prompt=True)
    d = rows.withColumn("_t", t)
    room = F.greatest(F.lit(length) - F.size("_t"), F.lit(0))
    d = d.withColumn("input_ids", F.concat("_t", F.array_repeat(F.lit(PAD), room))).withColumn("attention_mask", F.concat(F.transform("_t", lambda _: F.lit(1)), F.array_repeat(F.lit(0), room)))
    return d.withColumn("code", F.when(F.size("_t") > length, "TOO_LONG")).drop("_t")


def auxiliary(df: DataFrame) -> DataFrame:
    """Label arrays with their defaults: missing constraints -1, missing dimensions NaN, missing labels -1."""
    c = F.coalesce("constraint_labels", F.array_repeat(F.lit(None).cast("float"), 4))
    s = F.coalesce("si_dimensions", F.array_repeat(F.lit(None).cast("float"), 7))
    d = df.withColumn("constraint_labels", F.transform(c, lambda v: F.coalesce(v, F.lit(-1.0)).cast("float"))).withColumn("si_dimensions", F.transform(s, lambda v: F.coalesce(v, F.lit(float("nan"))).cast("float")))
    return d.withColumn("domain_label", F.coalesce("domain_label", F.lit(-1))).withColumn("verifier_label", F.coalesce("verifier_label", F.lit(-1.0)).cast("float"))


def record_index(df: DataFrame, order: str, count: str) -> DataFrame:
    """``df`` with ``start``: the number of sequences before each record, as a prefix sum in two levels."""
    d = df.withColumn("_b", F.floor(F.col(order) / 10_000))
    n = d.groupBy("_b").agg(F.sum(count).alias("_n"))
    before = n.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    w = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("_in", F.coalesce(F.sum(count).over(w), F.lit(0))).join(before, "_b").withColumn("start", F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")


def collate(rows: DataFrame, batch: Column, array: str, order: str) -> DataFrame:
    """``(batch, rows)``: the arrays of each batch in order. A batch is a bounded number of rows by its definition."""
    g = rows.groupBy(batch.alias("batch")).agg(F.array_sort(F.collect_list(F.struct(order, array))).alias("r"))
    return g.select("batch", F.transform("r", lambda x: x[array]).alias("rows"))


def right_pad(df: DataFrame, array: str, pad: int, batch: str) -> DataFrame:
    """Arrays padded to the longest of their batch."""
    n = df.groupBy(batch).agg(F.max(F.size(array)).alias("_n"))
    return df.join(n, batch).withColumn(array, F.concat(array, F.array_repeat(F.lit(pad), F.col("_n") - F.size(array)))).drop("_n")


def completion_batch(df: DataFrame, prompt: str, completion: str, length: int) -> DataFrame:
    """Prompt and completion tokens in one sequence, labels on the completion only."""
    d = df.withColumn("_t", F.concat(prompt, completion)).withColumn("_s", F.concat(F.transform(prompt, lambda _: F.lit(False)), F.transform(completion, lambda _: F.lit(True))))
    return sequence(d, "_t", "_s", length).drop("_t", "_s")


def preflight(rows: DataFrame, limit: int, sealed_families: DataFrame | None = None) -> DataFrame:
    """Violations ``(rule, entity, detail)`` of a release batch ``(id, family, n_tokens, sha256)``; release only if empty."""
    from curata.operators.guards import rule, union

    parts = [
        rule("DUPLICATE_ID", rows.groupBy("id").count().filter("count > 1"), F.col("id"), F.col("count")),
        rule("BAD_DIGEST", rows.filter(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))), F.col("id")),
        rule("OVERFLOW", rows.filter(F.col("n_tokens") > limit), F.col("id"), F.col("n_tokens")),
    ]
    if sealed_families is not None:
        parts.append(rule("SEALED_FAMILY", rows.join(sealed_families.select("family").distinct(), "family", "left_semi"), F.col("id"), F.col("family")))
    return union(parts)


_TOKENIZERS: dict[str, object] = {}


def bpe_tokens(c: Column, path: str) -> Column:
    """Token ids of a text under a tokenizer file of the ``tokenizers`` library, loaded once for each worker."""

    def encode(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        if path not in _TOKENIZERS:
            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _TOKENIZERS[path] = t
        got = _TOKENIZERS[path].encode_batch([x or "" for x in s], add_special_tokens=False)
        return pd.Series([None if x is None else e.ids for x, e in zip(s, got)], dtype=object)

    return F.pandas_udf(encode, ArrayType(IntegerType()))(c)
