"""Duplicates hidden by formatting differences (problem 5)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions import text as T
from curata.runtime import HOT, Stage, clean_id, lookup


def _role(c):
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}]+", ""))


def _digests(batches):
    for b in batches:
        got = [T.content_digest(s) for s in b.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("turn"), b.column("role"), pa.array(got, pa.binary())], ["id", "turn", "role", "leaf"])


def _equal(batches):
    for b in batches:
        ok, last, forms = [], None, None
        for kept, s in zip(b.column("kept").to_pylist(), b.column("content").to_pylist()):
            if forms is None or kept != last:  # copies of one record often follow each other
                last, forms = kept, {T.content_structure(x) for x in kept or ()}
            ok.append(s in (kept or ()) or T.content_structure(s) in forms)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("keep_id"), pa.array(ok, pa.bool_())], ["id", "keep_id", "ok"])


def record_digests(messages: DataFrame) -> DataFrame:
    """``(id, root)``: the Merkle digest of each record of ``messages``.

    Leaves are the contents, normalised to letters and digits; contents that are
    JSON objects are hashed field by field, without regard to their order. The
    root digests roles and leaves in the order of the turns. Null content is
    empty content; repeated rows count once; null ids are left out. The turns of
    one record are one unit and come together in one row.
    """
    m = messages.select(clean_id(F.col("id")).alias("id"), F.col("turn").cast("int").alias("turn"), _role(F.col("role")).alias("role"), "content").filter("id is not null")
    leaves = m.mapInArrow(_digests, "id string, turn int, role string, leaf binary")
    turns = leaves.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "leaf"))).alias("t"))
    node = F.transform("t", lambda x: F.concat_ws(":", x["role"], F.hex(x["leaf"])))
    return turns.select("id", F.unhex(F.md5(F.array_join(node, "|"))).alias("root"))


def copies(messages: DataFrame, hot: int = HOT) -> DataFrame:
    """``(keep_id, copy_id)``: each set of copies as its smallest id with each other id.

    Records are grouped by :func:`record_digests`; every member is then compared
    in full, turn by turn, with the record that is kept. Records whose turns are
    all empty are copies of each other if their roles agree.

    Only texts of members are moved, one row for each distinct turn; a candidate
    and the kept record's turn meet as they are and are brought into their
    canonical form in the same Arrow batch, so no normalised text is shuffled.
    """
    roots = Stage(record_digests(messages), "roots")
    keeps = roots.df.groupBy("root").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = Stage(lookup(roots.df, keeps, "root", "inner", hot, roots.rows).select("id", "keep_id"), "members")
    roots.drop()
    m = messages.select(clean_id(F.col("id")).alias("id"), F.col("turn").cast("int").alias("turn"), _role(F.col("role")).alias("role"), F.coalesce("content", F.lit("")).alias("content"))
    turns = Stage(m.join(members.df, "id").distinct(), "turns")
    members.drop()
    at = F.concat_ws(" ", "keep_id", "turn", "role").alias("at")
    # a turn of one record that stands there in several spellings comes as all of them
    kept = turns.df.filter("id = keep_id").groupBy(at).agg(F.collect_set("content").alias("kept"))
    cand = turns.df.filter("id <> keep_id").select("id", "keep_id", at, "content")
    pairs = lookup(cand, kept, "at", "left", hot, turns.rows).select("id", "keep_id", "content", "kept")
    ok = pairs.mapInArrow(_equal, "id string, keep_id string, ok boolean").groupBy("keep_id", "id").agg(F.min("ok").alias("ok")).filter("ok")
    return ok.select("keep_id", F.col("id").alias("copy_id"))


def collapse(messages: DataFrame, hot: int = HOT) -> DataFrame:
    """``(keep_id, n_copies)``: one row for each distinct record with the number of its copies, itself included."""
    c = copies(messages, hot)
    ids = messages.select(clean_id(F.col("id")).alias("id")).filter("id is not null").distinct()
    kept = ids.join(c.select(F.col("copy_id").alias("id")), "id", "left_anti")
    n = c.groupBy(F.col("keep_id").alias("id")).agg(F.count(F.lit(1)).alias("more"))
    return kept.join(n, "id", "left").select(F.col("id").alias("keep_id"), (F.coalesce("more", F.lit(0)) + 1).alias("n_copies"))
