"""Consolidating pairwise matches into groups (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.operators.graph import contracted, named, number
from curata.runtime import HOT, Stage, clean_id

MIN_SCORE = 0.85


def binding_pairs(edges: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Distinct pairs ``(a, b)``, ``a < b``, that at least one row of ``edges`` binds.

    A row binds if ``anchor`` and ``other`` are present (after trimming) and
    differ in lower case, and ``score`` is a finite number of ``min_score`` or
    more; null, NaN and infinite scores bind nothing. Repeated, reversed and
    rescored rows count once. Other columns are not read.
    """
    e = edges.select(clean_id(F.col("anchor")).alias("x"), clean_id(F.col("other")).alias("y"), F.col("score").cast("double").alias("s"))
    ok = (F.col("s") >= min_score) & ~F.isnan("s") & (F.col("s") < float("inf")) & (F.col("x") != F.col("y"))
    return e.filter(ok).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def consolidate(pairs: DataFrame, hot: int = HOT) -> DataFrame:
    """``(id, group_id)`` for each id in ``pairs(a, b)``; ``group_id`` is the smallest id of the group.

    By tree contraction (:func:`curata.operators.graph.contracted`):
    vertices of degree one are stripped, chains compressed by list ranking, the
    core solved, labels restored. Rows with a null end and self pairs bind
    nothing; an empty table gives an empty result.
    """
    p = Stage(pairs.select("a", "b").filter("a <> b"), "pairs")
    ids, of = number(p.df.select(F.explode(F.array("a", "b")).alias("id")))
    labels = contracted(p.df.select(of(F.col("a")).alias("a"), of(F.col("b")).alias("b")), hot)
    return named(labels, ids, hot).select("id", F.col("root").alias("group_id"))
