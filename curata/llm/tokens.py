"""Token budget per source and language (problem 4)."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.runtime import Stage, clean_id, lookup

TOKENIZERS = os.environ.get("CURATA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
PLAUSIBLE = 4.0  # a recorded count is believed within this factor of the counted one
# Fixed value: the published split pattern of the byte-level BPE vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Language codes of three letters.
THREE_LETTERS = {"eng": "en", "deu": "de", "ger": "de", "spa": "es", "fra": "fr", "fre": "fr", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl"}

_CODERS: dict[str, object] = {}


def coder(path: str):
    """The tokenizer of a vocabulary file, loaded once for each Python worker."""
    if path not in _CODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[path]


def text_tokens(texts: DataFrame, path: str | None = None) -> DataFrame:
    """``(digest, n)``: the number of tokens of each distinct text of ``texts(text)``.

    Texts are hashed and deduplicated whole before they are tokenized, so each is
    tokenized once. Null texts are left out; the empty text has none.
    """
    path = path or f"{TOKENIZERS}/{VOCABULARY}"

    def run(batches):
        enc = coder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(s)) for s in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n"])

    d = texts.filter("text is not null").select(F.md5("text").alias("digest"), "text")
    return d.groupBy("digest").agg(F.first("text").alias("text")).mapInArrow(run, "digest string, n long")


def clean_lang(c: Column) -> Column:
    """Language code of two letters without region; ``und`` where it is missing or undetermined."""
    t = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([A-Za-z]+)", 1))
    known = F.create_map(*[F.lit(x) for kv in THREE_LETTERS.items() for x in kv])
    return F.when(t.isin("", "und", "unknown", "null", "none", "mul", "zxx"), F.lit("und")).otherwise(F.coalesce(F.try_element_at(known, t), t))


def clean_name(c: Column) -> Column:
    """A source or domain in lower case with single underscores; ``unknown`` where it is missing."""
    t = F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}_]+", "_")
    return F.when(t.isNull() | t.isin("", "null", "none", "n/a", "unknown"), F.lit("unknown")).otherwise(t)


def _calibrated(rows: DataFrame, known: str, counted: str, out: str) -> DataFrame:
    """``known`` where it is plausible, else ``counted`` times the ratio of both over the rows of the language that are."""
    ok = (F.col(known) > 0) & (F.col(counted) > 0) & (F.col(known) <= PLAUSIBLE * F.col(counted)) & (F.col(counted) <= PLAUSIBLE * F.col(known))
    r = Stage(rows.withColumn("_ok", F.coalesce(ok, F.lit(False))), "counted")
    by = r.df.filter("_ok").groupBy("lang").agg((F.sum(known) / F.sum(counted)).alias("_ratio"), F.sum(known).alias("_k"), F.sum(counted).alias("_c"))
    by = Stage(by, "ratios", k=F.sum("_k"), c=F.sum("_c"))  # one row for each language
    overall = by.seen["k"] / by.seen["c"] if by.seen["c"] else 1.0
    est = F.round(F.col(counted) * F.coalesce("_ratio", F.lit(overall))).cast("long")
    few = by.df.select("lang", "_ratio")
    # hundreds of languages at most: their ratios are sent everywhere; should there be more, hot ones are divided
    x = r.df.join(F.broadcast(few), "lang", "left") if by.rows <= 10_000 else lookup(r.df, few, "lang", "left", rows=r.rows)
    return x.withColumn(out, F.when(F.col("_ok"), F.col(known)).otherwise(est)).withColumn(f"{out}_known", F.col("_ok").cast("long")).drop("_ok", "_ratio")


def _latest(df: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``; a partial aggregate, no window."""
    pick = F.max_by(F.struct(*cols), F.struct(*order, *cols))
    return df.groupBy(key).agg(pick.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def document_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(source, lang, domain, tokens, tokens_known)`` of each document."""
    d = docs.select("doc_id", F.md5("text").alias("digest"), clean_name(F.col("source")).alias("source"), clean_lang(F.col("lang")).alias("lang"), clean_name(F.col("domain")).alias("domain"), "qwen_tokens").distinct()
    d = Stage(d, "documents")
    n = Stage(text_tokens(docs.select("text"), path), "tokens")
    return _calibrated(lookup(d.df, n.df, "digest", rows=d.rows).withColumn("n", F.coalesce("n", F.lit(0))), "qwen_tokens", "n", "tokens")


def candidate_counts(cands: DataFrame, messages: DataFrame, reviews: DataFrame, path: str | None = None) -> DataFrame:
    """``(source, lang, domain, tokens, assistant)`` of each candidate, with flags of what was recorded.

    Of several deliveries of an id, and of several reviews, the latest counts.
    """
    c = cands.select(clean_id(F.col("id")).alias("id"), clean_name(F.col("repository")).alias("source"), clean_lang(F.col("lang")).alias("lang"), "qwen_tokens", "assistant_tokens", "created_at", "received_at").filter("id is not null")
    c = _latest(c, "id", ["received_at", "created_at"], ["source", "lang", "qwen_tokens", "assistant_tokens"])
    r = reviews.select(clean_id(F.col("id")).alias("id"), clean_name(F.col("domain")).alias("domain"), "reviewed_at", "received_at").filter("id is not null")
    r = _latest(r, "id", ["reviewed_at", "received_at"], ["domain"])
    m = Stage(messages.select(clean_id(F.col("id")).alias("id"), "turn", (F.lower(F.trim(F.col("role"))) == "assistant").alias("said"), F.md5("content").alias("digest")).filter("id is not null").distinct(), "turns")
    n = Stage(text_tokens(messages.select(F.col("content").alias("text")), path), "tokens")
    m = lookup(m.df, n.df, "digest", rows=m.rows)
    m = m.groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("said"), F.col("n"))), F.lit(0)).alias("na"))
    x = c.join(r, "id", "left").join(m, "id", "left").withColumn("domain", F.coalesce("domain", F.lit("unknown"))).na.fill(0, ["n", "na"])
    return _calibrated(_calibrated(x, "qwen_tokens", "n", "tokens"), "assistant_tokens", "na", "assistant")


def budget(docs: DataFrame, cands: DataFrame, messages: DataFrame, reviews: DataFrame, path: str | None = None) -> DataFrame:
    """Totals by table, source, language and domain.

    Columns ``origin`` (documents or candidates), ``source``, ``lang``,
    ``domain``, ``n_records``, ``n_recorded`` (records whose recorded count was
    used), ``tokens`` and ``assistant_tokens`` (0 for documents). Recorded counts
    that are missing, not positive or more than ``PLAUSIBLE`` times off are
    estimated: the count under the public tokenizer at ``path``, scaled by the
    ratio of recorded to counted tokens over all records of the language. Rows
    are pre-aggregated before they are shuffled, so a hot source is no hot task.
    Empty tables give no rows.
    """
    key = ["source", "lang", "domain"]
    d = document_counts(docs, path).groupBy(*key).agg(F.count(F.lit(1)).alias("n_records"), F.sum("tokens_known").alias("n_recorded"), F.sum("tokens").alias("tokens"))
    c = candidate_counts(cands, messages, reviews, path).groupBy(*key).agg(F.count(F.lit(1)).alias("n_records"), F.sum("tokens_known").alias("n_recorded"), F.sum("tokens").alias("tokens"), F.sum("assistant").alias("assistant_tokens"))
    d = d.select(F.lit("documents").alias("origin"), *key, "n_records", "n_recorded", "tokens", F.lit(0).cast("long").alias("assistant_tokens"))
    return d.union(c.select(F.lit("candidates").alias("origin"), *key, "n_records", "n_recorded", "tokens", "assistant_tokens"))
