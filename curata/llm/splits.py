"""Splits that keep related records together (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.operators.graph import frontier_components, number
from curata.runtime import HOT, Stage, clean_id, lookup

# Holders that stand for no holder, compared in lower case without spacing and punctuation.
HOLDER_STAND_INS = ["", "na", "none", "null", "nil", "nan", "unknown", "unspecified", "notstated", "notspecified", "notavailable", "notapplicable", "missing", "tbd", "tba", "todo", "pending", "unassigned", "undefined", "anonymous"]
# Fixed value: sha256 of the empty string.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
# Spellings of the splits in lower case without spacing and punctuation; anything else that is not unset stands for itself.
SPLIT_SPELLINGS = {"train": "train", "training": "train", "trn": "train", "validation": "validation", "valid": "validation", "val": "validation", "dev": "validation", "development": "validation", "test": "test", "testing": "test", "tst": "test"}
MAX_SPLITS = 1000  # targets are read by the driver
UNSET_SPLITS = ["", "unassigned", "none", "null", "na", "unset", "unknown", "tbd", "nan"]


def clean_split(c):
    """A split in its one spelling; null where it is unset."""
    t = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    known = F.create_map(*[F.lit(x) for kv in SPLIT_SPELLINGS.items() for x in kv])
    return F.when(t.isin(UNSET_SPLITS) | t.isNull(), F.lit(None)).otherwise(F.coalesce(F.try_element_at(known, t), t))


def clean_holder(c):
    """A holder in lower case with single spaces; null for stand-ins."""
    t = F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", " "))
    return F.when(~F.regexp_replace(t, r"[^\p{L}\p{N}]+", "").isin(HOLDER_STAND_INS), t)


def clean_digest(c):
    """A sha256 in lower case; null unless it is 64 hex digits of content that is not empty."""
    t = clean_id(c)
    return F.when(t.rlike("^[0-9a-f]{64}$") & (t != EMPTY_SHA256), t)


def related_groups(families: DataFrame, rights: DataFrame, hot: int = HOT) -> DataFrame:
    """``(id, group_id)`` for each record of ``families``.

    Records share a group if they share a family, or if their families share a
    holder or a source digest in ``rights``, and so on through chains. Case and
    spacing of every key don't matter; blank families, stand-in holders, missing
    digests and the digest of empty content bind nothing. A record without a
    family is a group of its own, a record in several families binds them.
    ``group_id`` is the smallest id of the group. Rows of ``rights`` for
    unknown families still carry chains between holders and digests. Null ids
    are left out. Found by breadth-first search from many seeds over families,
    holders and digests (:func:`curata.operators.graph.frontier_components`).
    """
    rec = Stage(families.select(clean_id(F.col("id")).alias("id"), clean_id(F.col("family")).alias("family")).filter("id is not null").distinct(), "records")
    r = rights.select(F.concat(F.lit("f "), clean_id(F.col("family_id"))).alias("a"), F.concat(F.lit("h "), clean_holder(F.col("holder"))).alias("h"), F.concat(F.lit("d "), clean_digest(F.col("sha256"))).alias("d")).filter("a is not null")
    # a record in several families binds them as a star around its first
    many = rec.df.groupBy("id").agg(F.min("family").alias("m"), F.max("family").alias("x")).filter("m < x").select("id", "m")
    linked = rec.df.join(many, "id").filter("family > m").select(F.concat(F.lit("f "), "m").alias("a"), F.concat(F.lit("f "), "family").alias("b"))
    edges = Stage(r.select("a", F.explode(F.array("h", "d")).alias("b")).filter("b is not null").union(linked).distinct(), "bonds")
    ids, of = number(edges.df.select(F.explode(F.array("a", "b")).alias("id")))
    comp = frontier_components(edges.df.select(of(F.col("a")).alias("a"), of(F.col("b")).alias("b")), hot=hot)
    edges.drop()
    families_of = ids.df.filter("id like 'f %'").join(comp, "v").select(F.expr("substring(id, 3)").alias("family"), F.col("root").cast("string").alias("c"))
    # a family that nothing binds is a component of its own, a record without one as well
    key = F.coalesce(F.concat(F.lit("c "), "c"), F.concat(F.lit("f "), "family"), F.concat(F.lit("r "), "id"))
    tagged = Stage(lookup(rec.df, families_of, "family", "left", hot, rec.rows).select("id", key.alias("c")).distinct(), "tagged")
    rec.drop()
    low = tagged.df.groupBy("c").agg(F.min("id").alias("group_id"))
    return lookup(tagged.df, low, "c", "inner", hot, tagged.rows).select("id", "group_id").distinct()


def split_conflicts(families: DataFrame, groups: DataFrame, hot: int = HOT) -> DataFrame:
    """``(id, group_id)`` of all records of each group whose recorded splits disagree.

    Spellings are unified; unset splits are ignored.
    """
    known = families.select(clean_id(F.col("id")).alias("id"), clean_split(F.col("split")).alias("split")).filter("id is not null and split is not null").distinct()
    both = groups.join(known, "id")
    bad = both.groupBy("group_id").agg(F.min("split").alias("s"), F.max("split").alias("t")).filter("s <> t").select("group_id", F.lit(True).alias("bad"))
    return lookup(groups, bad, "group_id", "inner", hot).select("id", "group_id")


def assign_splits(groups: DataFrame, targets: DataFrame, salt: str = "split", hot: int = HOT) -> DataFrame:
    """``(id, group_id, split)``: every group in one split, shares near the targets.

    Groups are laid side by side in the order of a salted md5, each as long as
    it has records; a group gets the split in whose stretch of the whole its
    middle lies. Targets are normalised to sum to one and taken in the order of
    their names; null or non-positive shares take nothing. A group larger than a
    split's share cannot be divided, so the reached share may differ by about
    the size of one group at each boundary.
    """
    sizes = Stage(groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.md5(F.concat(F.lit(f"{salt}:"), "group_id"))), "sizes")
    sizes.df = sizes.df.withColumn("bin", F.substring("h", 1, 3 if sizes.rows < 1 << 28 else 5))
    # prefix sums in two levels: over the first digits of the hash (4,096, or a million for more than 2^28 groups), then inside each bin
    bins = sizes.df.groupBy("bin").agg(F.sum("n").alias("t"))
    over = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("t").over(over), F.lit(0))).withColumn("total", F.sum("t").over(Window.partitionBy()))
    inner = Window.partitionBy("bin").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.df.withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(bins.select("bin", "before", "total"), "bin")
    at = at.withColumn("mid", (F.col("before") + F.col("inside") + F.col("n") / 2.0) / F.col("total"))
    t = targets.select("split", F.col("target_share").cast("double").alias("w")).filter("split is not null and w > 0 and not isnan(w)").groupBy("split").agg(F.max("w").alias("w"))
    want = t.orderBy("split").limit(MAX_SPLITS + 1).collect()  # one row per split
    if not want or len(want) > MAX_SPLITS:
        raise ValueError(f"split targets must name 1 to {MAX_SPLITS} splits with a positive share")
    whole, upto, stretch = sum(x.w for x in want), 0.0, F
    for x in want[:-1]:
        upto += x.w
        stretch = stretch.when(F.col("mid") < upto / whole, x.split)
    split = stretch.otherwise(want[-1].split) if len(want) > 1 else F.lit(want[0].split)
    placed = at.select("group_id", split.alias("split"))
    return lookup(groups.select("id", "group_id"), placed, "group_id", "inner", hot).select("id", "group_id", "split")


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """``(split, n_records, share, target_share)`` reached by an assignment."""
    got = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n_records"))
    total = Window.partitionBy()
    want = targets.groupBy("split").agg(F.max("target_share").alias("target_share"))
    out = want.join(got, "split", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    return out.withColumn("share", F.round(F.col("n_records") / F.sum("n_records").over(total), 6)).select("split", "n_records", "share", "target_share")
