"""Violations tables: every rule gives rows ``(rule, entity, detail)``; :func:`assert_clean` is the only action that raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.identity import blank

SPLITS, KINDS = ["train", "validation", "test"], ["pretrain", "sft", "preference", "verifier", "rl"]
DOMAINS = ["mechatronics", "mathematics", "materials_science", "engineering_conversation", "general_academics"]
BASES = ["owned", "licensed", "permission", "authored"]


class Violations(ValueError):
    """A table that should be clean is not; the message has the counts by rule."""


def rule(name: str, bad: DataFrame, entity: Column, detail: Column | None = None) -> DataFrame:
    return bad.select(F.lit(name).alias("rule"), entity.cast("string").alias("entity"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def counts(violations: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """``(rule, n)``, with zeros for ``rules`` that nothing broke."""
    n = violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    if rules is None:
        return n
    names = violations.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    return names.join(n, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


def assert_clean(violations: DataFrame) -> None:
    """Raises with the counts by rule if there is any violation."""
    got = counts(violations).orderBy("rule").limit(100).collect()
    if got:
        raise Violations(", ".join(f"{r.rule}: {r.n}" for r in got))


def source_violations(sources: DataFrame) -> DataFrame:
    """Rules over manifest rows: enumerations, presence, rights and digest."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    e = F.col("source_id")
    checks = {
        "BLANK_SOURCE_ID": blank(F.col("source_id")),
        "UNKNOWN_SPLIT": no(F.col("split").isin(SPLITS)),
        "UNKNOWN_KIND": no(F.col("kind").isin(KINDS)),
        "UNKNOWN_DOMAIN": no(F.col("domain").isin(DOMAINS)),
        "BLANK_PROVENANCE": blank(F.col("provenance")),
        "BLANK_LICENSE": blank(F.col("license")),
        "RIGHTS_NOT_APPROVED": no(F.col("rights.approved")),
        "UNKNOWN_BASIS": no(F.col("rights.basis").isin(BASES)),
        "BLANK_HOLDER": blank(F.col("rights.holder")),
        "BAD_DIGEST": no(F.col("sha256").rlike("^[0-9a-f]{64}$")),
    }
    hit = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    return sources.select(F.explode(hit).alias("rule"), e.alias("entity"), F.lit("").alias("detail"))


def one_to_one(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("LEFT_ONLY", "RIGHT_ONLY")) -> DataFrame:
    """Keys that only one of two tables has: a full outer join of the distinct keys."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    j = a.join(b, key, "full_outer").filter("_l is null or _r is null")
    return j.select(F.when(F.col("_r").isNull(), names[0]).otherwise(names[1]).alias("rule"), F.col(key).cast("string").alias("entity"), F.lit("").alias("detail"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that occur more often on one side (multisets), with ``side``."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def disjoint_violations(a: DataFrame, b: DataFrame, key: str, name: str = "SHARED") -> DataFrame:
    return rule(name, a.select(key).intersect(b.select(key)), F.col(key))


def contamination(train: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Training rows that share an id, a family or a normalised prompt with held-out rows."""
    parts = [rule(f"SHARED_{k.upper()}", train.join(held.filter(F.col(k).isNotNull()).select(k).distinct(), k, "left_semi"), F.col("id"), F.col(k)) for k in keys]
    return union(parts)


def sealed(rows: DataFrame, sealed_families: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    """Rows outside sealed families, and the violations."""
    s = sealed_families.select(family).distinct()
    return rows.join(s, family, "left_anti"), rows.join(s, family, "left_semi")


def span_violations(spans: DataFrame) -> DataFrame:
    """Rows ``(id, start, stop, length, within_start, within_stop)`` out of order, bounds or parent."""
    bad = ~F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("stop")) & (F.col("stop") <= F.col("length")), F.lit(False))
    out = F.col("within_start").isNotNull() & ((F.col("start") < F.col("within_start")) | (F.col("stop") > F.col("within_stop")))
    hit = F.array_compact(F.array(F.when(bad, F.lit("SPAN_BOUNDS")), F.when(out, F.lit("SPAN_OUTSIDE_PARENT"))))
    return spans.select(F.explode(hit).alias("rule"), F.col("id").cast("string").alias("entity"), F.lit("").alias("detail"))


def two_phase(metadata: DataFrame, content):
    """Runs ``content()`` only if no metadata violation exists; else raises before any content is read."""
    assert_clean(metadata)
    return content()


def duplicate_cycles(links: DataFrame) -> DataFrame:
    """Ids whose chain of ``(id, duplicate_of)`` comes back to themselves: pointers double, keyed joins only, until no chain gets shorter."""
    from curata.runtime import Stage

    cur = Stage(links.filter("duplicate_of is not null").select("id", F.col("duplicate_of").alias("to")).distinct(), "chain")
    while cur.rows:
        nxt = cur.df.select(F.col("id").alias("to"), F.col("to").alias("next"))
        step = Stage(cur.df.join(nxt, "to").select("id", F.col("next").alias("to")), "chain")
        before, cur = cur, step
        done = before.rows == cur.rows
        before.drop()
        if done:
            break
    return cur.df.select("id").distinct()


def metadata_violations(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Missing or unknown columns, blank keys and repeated keys of a metadata table."""
    spark = rows.sparkSession
    odd = sorted(set(fields) ^ set(rows.columns))
    shape = spark.createDataFrame([("FIELDS", c, "missing" if c in fields else "unknown") for c in odd], "rule string, entity string, detail string")
    if key not in rows.columns:
        return shape
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return union([shape, rule("BLANK_KEY", rows.filter(blank(F.col(key).cast("string"))), F.lit("")), rule("DUPLICATE_KEY", again, F.col(key), F.col("n"))])


def declared_violations(rows: DataFrame, key: str, declared: str, names: list[str], values: list[str]) -> DataFrame:
    """Rows whose map ``declared`` has not exactly the given names, or a value outside ``values``."""
    have, want = F.array_sort(F.map_keys(declared)), F.array(*[F.lit(x) for x in sorted(names)])
    ok = F.forall(F.map_values(declared), lambda v: F.coalesce(v.isin(values), F.lit(False)))
    hit = F.array_compact(F.array(F.when(~F.coalesce(have == want, F.lit(False)), F.lit("DECLARATIONS_MISSING")), F.when(~F.coalesce(ok, F.lit(False)), F.lit("DECLARATION_UNKNOWN"))))
    return rows.select(F.explode(hit).alias("rule"), F.col(key).cast("string").alias("entity"), F.lit("").alias("detail"))


def region_violations(regions: DataFrame, selected: DataFrame) -> DataFrame:
    """Checks of regions ``(source, region, start, stop, length, path, sha256)`` against the selected ``(source, region)``.

    Bounds of spans, paths with several digests, and exact coverage both ways.
    """
    bad = ~F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("stop")) & (F.col("stop") <= F.col("length")), F.lit(False))
    at = F.concat_ws("/", "source", "region")
    several = regions.filter("path is not null").groupBy("path").agg(F.count_distinct("sha256").alias("n")).filter("n > 1")
    a, b = selected.select("source", "region").distinct(), regions.select("source", "region").distinct()
    return union(
        [
            rule("SPAN_BOUNDS", regions.filter(bad), at),
            rule("DIGEST_CONFLICT", several, F.col("path"), F.col("n")),
            rule("NOT_COVERED", a.join(b, ["source", "region"], "left_anti"), at),
            rule("NOT_SELECTED", b.join(a, ["source", "region"], "left_anti"), at),
        ]
    )


def pin_violations(rows: DataFrame, key: str, pins: list[str], digest: str, order: str) -> DataFrame:
    """Rows whose pinned fields (as JSON with sorted keys) have another digest, and gaps in the numbering from one."""
    have = F.sha2(F.to_json(F.struct(*sorted(pins))), 256)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi"), F.count_distinct(order).alias("d"))
    gap = n.filter("n > 0 and not (lo = 1 and hi = n and d = n)")
    return union([rule("PIN_CHANGED", rows.filter(~F.coalesce(have == F.col(digest), F.lit(False))), F.col(key)), rule("NUMBERING", gap, F.col("n"), F.col("hi"))])


def staging_violations(candidates: DataFrame, provenance: DataFrame) -> DataFrame:
    """Invariants of a staged pair ``(id, hash, text)`` and ``(id, review_status, issue_codes)``.

    One to one by id, ids that are the prefix of their hash, no repeated ids or
    hashes, no sensitive content, and issues exactly where a record is quarantined.
    """
    from curata.functions.quality import sensitive_codes

    quarantined = F.coalesce(F.col("review_status") == "quarantined", F.lit(False))
    return union(
        [
            one_to_one(candidates, provenance, "id", ("NO_PROVENANCE", "NO_CANDIDATE")),
            rule("ID_NOT_OF_HASH", candidates.filter(~F.coalesce(F.col("id") == F.concat(F.lit("repo-"), F.substring("hash", 1, 24)), F.lit(False))), F.col("id")),
            rule("DUPLICATE_ID", candidates.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), F.col("id"), F.col("n")),
            rule("DUPLICATE_HASH", candidates.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), F.col("hash"), F.col("n")),
            rule("SENSITIVE", candidates.filter(F.size(sensitive_codes(F.coalesce("text", F.lit("")))) > 0), F.col("id")),
            rule("ISSUES_AND_STATUS", provenance.filter(quarantined != (F.size(F.coalesce("issue_codes", F.array().cast("array<string>"))) > 0)), F.col("id")),
        ]
    )


def fingerprint(manifest: dict) -> str:
    """Digest of a manifest or metadata object in canonical JSON."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(manifest, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def audited_together(splits: DataFrame) -> DataFrame:
    """Splits ``(split, stage, manifest_fingerprint)`` that were not audited as one: no fingerprint, or several fingerprints or stages."""
    n = splits.agg(F.count_distinct("manifest_fingerprint").alias("f"), F.count_distinct("stage").alias("s"))
    return union(
        [
            rule("NO_FINGERPRINT", splits.filter("manifest_fingerprint is null"), F.col("split")),
            rule("FINGERPRINTS_DIFFER", n.filter("f > 1"), F.col("f")),
            rule("STAGES_DIFFER", n.filter("s > 1"), F.col("s")),
        ]
    )


def preparation_violations(tables: dict[str, DataFrame], totals: DataFrame, key: str = "id") -> DataFrame:
    """Keys that are not in every one of ``tables``, and totals ``(name, n)`` on record that the tables don't have."""
    n = len(tables)
    at = None
    for name, t in tables.items():
        k = t.select(F.col(key).cast("string").alias("k")).filter("k is not null").distinct().withColumn("t", F.lit(name))
        at = k if at is None else at.union(k)
    have = at.groupBy("k").agg(F.array_sort(F.collect_set("t")).alias("t")).filter(F.size("t") < n)
    count = at.groupBy(F.col("t").alias("name")).agg(F.count(F.lit(1)).alias("have"))
    off = totals.join(count, "name", "left").filter(~F.coalesce(F.col("n") == F.col("have"), F.lit(False)))
    return union([rule("NOT_IN_ALL", have, F.col("k"), F.array_join("t", ",")), rule("TOTAL_DIFFERS", off, F.col("name"), F.col("have"))])
