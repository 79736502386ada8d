"""Roll-ups: counts, pivots, percentages, index percentiles and a redacted catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def code_counts(df: DataFrame, codes: str, name: str = "code") -> DataFrame:
    """Rows by code of an array of codes."""
    return df.select(F.explode(codes).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def pivot_counts(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts by row and column value, absent ones as zero; ``values`` fixes the columns, so no pass finds them."""
    aggs = [F.sum(F.when(F.col(col) == v, 1).otherwise(0)).alias(v) for v in values]
    return df.groupBy(row).agg(F.count(F.lit(1)).alias("total"), *aggs)


def percentage(df: DataFrame, hit: Column) -> DataFrame:
    d = df.agg(F.sum(F.coalesce(hit, F.lit(False)).cast("long")).alias("numerator"), F.count(F.lit(1)).alias("denominator"))
    return d.withColumn("pct", F.round(F.try_divide(F.col("numerator") * 100.0, "denominator"), 6))


def index_percentiles(df: DataFrame, value: str, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Maximum and the values at index floor(n q) of the sorted list, from a histogram: no sort of the rows."""
    h = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    # prefix sums in two levels, over stretches of values and inside each
    h = h.withColumn("_b", F.floor(F.col("v") / 1024))
    b = h.groupBy("_b").agg(F.sum("c").alias("bc"))
    b = b.select("_b", (F.sum("bc").over(Window.orderBy("_b")) - F.col("bc")).alias("before"), F.sum("bc").over(Window.partitionBy()).alias("n"))
    h = h.withColumn("upto", F.sum("c").over(Window.partitionBy("_b").orderBy("v"))).join(b, "_b").withColumn("upto", F.col("upto") + F.col("before"))
    aggs = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("v"))).alias(f"p{round(q * 100)}") for q in qs]
    return h.agg(F.max("v").alias("max"), *aggs, F.max("n").alias("n"))


def redacted(df: DataFrame, status: str, keep: list[str], excluded: str = "excluded") -> DataFrame:
    """Catalogue rows with every column but ``keep`` hidden where the status is ``excluded``."""
    hide = F.col(status) == excluded
    return df.select(*[F.col(c) if c in keep or c == status else F.when(hide, F.lit("[excluded]")).otherwise(F.col(c).cast("string")).alias(c) for c in df.columns])


def reconcile(df: DataFrame, value: str, total: int) -> DataFrame:
    """``(sum, total, ok)`` of a roll-up against a fixed total."""
    s = df.agg(F.coalesce(F.sum(value), F.lit(0)).alias("sum"))
    return s.withColumn("total", F.lit(total)).withColumn("ok", F.col("sum") == total)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small aggregate as a Markdown table."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a table in a report")
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows)])


def seal(df: DataFrame, key: str, row: Column) -> DataFrame:
    """``(n, digest)`` of a table, whatever its partitions and the order of its rows.

    The digest of each row is cut into eight numbers of 32 bits, each is summed
    over the table and the sums are digested: a multiset hash, so that repeated
    rows count, made of partial sums alone; no list of rows is gathered.
    """
    d = df.select(F.sha2(F.to_json(F.struct(F.col(key), row.alias("r"))), 256).alias("d"))
    part = lambda i: F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = d.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(part(i)), F.lit(0)).cast("string").alias(f"s{i}") for i in range(8)])
    return sums.select("n", F.sha2(F.concat_ws(",", *[f"s{i}" for i in range(8)]), 256).alias("digest"))
