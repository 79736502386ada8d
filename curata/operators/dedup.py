"""Exact duplicates with lineage, collisions, near twins and leaks across splits: partial aggregates throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import udfs
from curata.runtime import lookup


def exact_dedup(df: DataFrame, digest: Column, order: list[str], keep: list[str]) -> DataFrame:
    """``(digest, *keep, n_copies)``: the first row of each digest by ``order``."""
    pick = F.min_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(digest.alias("digest")).agg(pick.alias("_r"), F.count(F.lit(1)).alias("n_copies")).select("digest", *[F.col(f"_r.{k}").alias(k) for k in keep], "n_copies")


def origins(df: DataFrame, digest: Column, key: str) -> DataFrame:
    """``(digest, keep, origin)``: every row as an origin of the copy that is kept.

    In long form, so that a text that a third of all rows share is no single row.
    """
    d = df.select(digest.alias("digest"), F.col(key).alias("origin"))
    first = d.groupBy("digest").agg(F.min("origin").alias("keep"))
    return lookup(d, first, "digest", "inner").select("digest", "keep", "origin")


def duplicates(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """``(key, n)`` of keys with more than one row."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def leaks(df: DataFrame, key: Column, split: Column, name: str = "key") -> DataFrame:
    """``(key, n_splits, n)`` of keys in more than one split."""
    g = df.groupBy(key.alias(name)).agg(F.count_distinct(split).alias("n_splits"), F.count(F.lit(1)).alias("n"))
    return g.filter("n_splits > 1")


def group_sizes(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """``(key, n, collides)`` of every group."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).withColumn("collides", F.col("n") > 1)


def near_twins(df: DataFrame, text: str, key: str) -> DataFrame:
    """``(digest, first, n)`` of texts equal after compatibility form, case folding and collapsed white space."""
    d = df.filter(F.col(text).isNotNull()).select(F.sha2(udfs.folded(text), 256).alias("digest"), F.col(key).alias("k"))
    return d.groupBy("digest").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def union_dedup(parts: list[DataFrame], digest: str, order: str) -> DataFrame:
    """Union of tables, first occurrence of each digest in the order of the tables, then of ``order``."""
    u = None
    for k, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(k))
        u = p if u is None else u.unionByName(p)
    cols = [c for c in u.columns if c not in ("_part", digest)]
    return u.groupBy(digest).agg(F.min_by(F.struct(*cols), F.struct("_part", order)).alias("_r"), F.count(F.lit(1)).alias("n_origins")).select(digest, *[F.col(f"_r.{c}").alias(c) for c in cols], "n_origins")
