"""Mixing sources to target weights (problem 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.llm.tokens import clean_name, text_tokens
from curata.runtime import Stage, lookup

CELL = 50_000  # documents of one source and size that a task may rank


def sized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, source, tokens)`` of each document with a text; equal texts are tokenized once."""
    d = docs.select("doc_id", clean_name(F.col("source")).alias("source"), F.md5("text").alias("digest")).filter("doc_id is not null and digest is not null").distinct()
    d = Stage(d, "documents")
    n = Stage(text_tokens(docs.select("text"), path), "tokens")
    return lookup(d.df, n.df, "digest", "inner", rows=d.rows).select("doc_id", "source", F.col("n").alias("tokens"))


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """``(source, target_share, max_repeats, available, rate)``: expected copies of each document of a source.

    Without ``total_tokens`` the mix is as large as the caps allow with all
    targets met. With it, a source whose cap is too low for its share gives what
    it can, and the shares reached differ. Sources without a target give
    nothing, targets without a document are left out of the whole; shares are
    normalised over the rest. Null and non-positive shares and caps give nothing.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    t = targets.select(clean_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("double").alias("max_repeats"))
    t = t.filter("target_share > 0 and max_repeats > 0 and not isnan(target_share)").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    x = t.join(have, "source").filter("available > 0")
    # one row for each source; the window runs over that table
    whole = Window.partitionBy()
    x = x.withColumn("w", F.col("target_share") / F.sum("target_share").over(whole))
    size = F.lit(float(total_tokens)) if total_tokens is not None else F.min(F.col("available") * F.col("max_repeats") / F.col("w")).over(whole)
    return x.withColumn("rate", F.least(F.col("w") * size / F.col("available"), F.col("max_repeats"))).select("source", "target_share", "max_repeats", "available", "rate")


def mix(sizes: DataFrame, rate: DataFrame, offset: float | None = None, seed: int = 13, rows: int | None = None) -> DataFrame:
    """``(doc_id, source, tokens, copies)``: systematic sampling within each source.

    Documents of a source stand in the order of their size, then of a seeded
    hash, each with its expected number of copies; the prefix sum of these plus
    one random offset in [0, 1), drawn for each source from the seed, crosses an
    integer ``copies`` times inside a document. ``offset`` sets one for all
    sources instead. Sorting by size keeps the tokens of each source close to its
    share. No document comes more than its source's cap.

    The prefix sum has two levels, so that no source is gathered into one task:
    counts over the sizes of a source, then over bins of the hash inside a size,
    then ranks inside a bin. There are as many bins as ``rows`` (counted if not
    given) fill shares of ``CELL`` rows, so that a source whose documents all
    have one size is divided as well.
    """
    rows = sizes.count() if rows is None else rows
    bits = min(24, max(0, (rows // CELL).bit_length()))
    s = sizes.join(F.broadcast(rate.select("source", "rate")) if _few(rate) else rate.select("source", "rate"), "source")
    s = s.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bin", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    cells = s.groupBy("source", "tokens", "bin").agg(F.count(F.lit(1)).alias("n"))
    # one row for each size of a source, then one for each bin of a size
    each = cells.groupBy("source", "tokens").agg(F.sum("n").alias("gn"))
    g = Window.partitionBy("source").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("source", "tokens", F.coalesce(F.sum("gn").over(g), F.lit(0)).alias("gbefore"))
    w = Window.partitionBy("source", "tokens").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("inside", F.coalesce(F.sum("n").over(w), F.lit(0))).join(each, ["source", "tokens"])
    cells = cells.select("source", "tokens", "bin", (F.col("gbefore") + F.col("inside")).alias("before"))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("source", "tokens", "bin").orderBy("h", "doc_id")))
    at = r.join(cells, ["source", "tokens", "bin"]).withColumn("k", F.col("before") + F.col("rank"))
    start = F.lit(offset) if offset is not None else source_offset(F.col("source"), seed)
    copies = F.floor(F.col("k") * F.col("rate") + start) - F.floor((F.col("k") - 1) * F.col("rate") + start)
    return at.withColumn("copies", copies.cast("int")).filter("copies > 0").select("doc_id", "source", "tokens", "copies")


def source_offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) drawn for each source from the seed: 52 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), source)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _few(rate: DataFrame) -> bool:
    """Whether the sources are few enough to be sent everywhere."""
    return len(rate.select("source").limit(10_001).collect()) <= 10_000


def reached(mixed: DataFrame, rate: DataFrame) -> DataFrame:
    """``(source, target_share, share, tokens, n_documents, repeats)`` of a mix, every source with a target."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("most_copies"))
    x = rate.join(got, "source", "left").na.fill(0, ["tokens", "n_documents", "most_copies"])
    x = x.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 6))
    return x.select("source", "target_share", "share", "tokens", "n_documents", F.round(F.col("tokens") / F.col("available"), 6).alias("repeats"), "most_copies", F.col("max_repeats").cast("int").alias("max_repeats"))
