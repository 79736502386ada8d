"""Similarity matches of prompts against anchors and the families that they bind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions.identity import NUMBER, digest, family_id, shingle_hashes, tokens
from curata.operators.graph import contracted, named, number
from curata.runtime import HOT, HotKeys, Stage, lookup

MIN_SHINGLES, NEAR, CONTAINED = 10, 0.85, 0.95


def features(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, canon, exact, template, sh, n)``: comparison features of each text."""
    # tokens are taken once; the planner does not repeat what is dear and read several times
    d = df.select(F.col(key).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    d = d.select("id", F.array_join("t", " ").alias("canon"), shingle_hashes(F.col("t")).alias("sh"))
    return d.select("id", "canon", digest(F.col("canon")).alias("exact"), digest(F.regexp_replace("canon", NUMBER, "NUM")).alias("template"), "sh", F.size("sh").alias("n"))


def classes(feats: DataFrame) -> tuple[Stage, Stage]:
    """One row for each distinct canonical text, named by its smallest id, and ``(id, cls)`` of all rows.

    Links between classes say all about links between rows, however often a text
    stands in the table.
    """
    low = feats.groupBy("exact").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    # the smallest id of a class brings its features; the rest bring their id alone
    reps = Stage(feats.join(low, ["id", "exact"]).dropDuplicates(["id"]), "classes")
    m = Stage(feats.select("id", "exact"), "rows")
    return reps, Stage(lookup(m.df, reps.df.select("exact", F.col("id").alias("cls")), "exact", "inner", rows=m.rows).select("id", "cls"), "members")


def exact_matches(anchors: DataFrame, others: DataFrame) -> DataFrame:
    """``(anchor, other)`` of equal canonical texts, inputs from :func:`features`."""
    a = anchors.select(F.col("id").alias("anchor"), "exact")
    return a.join(others.select(F.col("id").alias("other"), "exact"), "exact").filter("anchor <> other").select("anchor", "other")


def template_matches(anchors: DataFrame, others: DataFrame) -> DataFrame:
    """``(anchor, other)`` of texts that differ in numbers only; uncertain, yet bound by the reference like every edge."""
    a = anchors.select(F.col("id").alias("anchor"), "template")
    m = a.join(others.select(F.col("id").alias("other"), "template"), "template").filter("anchor <> other").select("anchor", "other")
    return m.join(exact_matches(anchors, others), ["anchor", "other"], "left_anti")


def overlaps(anchors: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """``(anchor, other, common, na, nb)`` of pairs that share at least ``least`` of the anchor's shingles.

    Short texts go before the join. The shingles of an anchor that decide are
    its rarest n - ceil(least n) + 1 (a pair that shares that much must share
    one); candidates found by those are counted over all shingles.
    """
    def taken_apart(d):
        return Stage(d.filter(F.col("n") >= MIN_SHINGLES).select("id", "n", F.explode("sh").alias("s")), "shingles")

    a = taken_apart(anchors)
    b = a if others is anchors else taken_apart(others)
    freq = b.df.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ranked = lookup(a.df, freq, "s", "left", rows=a.rows).groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "s"))).alias("r"))
    pre = ranked.select(F.col("id").alias("anchor"), F.explode(F.slice("r", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)).alias("x"))
    # a shingle that no other text has leads nowhere
    pre = pre.filter(F.col("x.df") > (1 if others is anchors else 0)).select("anchor", "x.s")
    cand = pre.join(b.df.select(F.col("id").alias("other"), "s"), "s").filter("anchor <> other").select("anchor", "other").distinct()
    both = cand.join(anchors.select(F.col("id").alias("anchor"), F.col("sh").alias("sa"), F.col("n").alias("na")), "anchor").join(others.select(F.col("id").alias("other"), F.col("sh").alias("sb"), F.col("n").alias("nb")), "other")
    return both.select("anchor", "other", F.size(F.array_intersect("sa", "sb")).alias("common"), "na", "nb")


def matches(anchors: DataFrame, others: DataFrame, same_prompt: bool = False) -> DataFrame:
    """``(anchor, other, kind, score)``: one label for each pair, the first of exact, template, near copy, contained.

    A template label has no score and is given only for ``same_prompt``. A near
    copy has Jaccard of at least 0.85 over five-token shingles, both sides with
    ten or more; a contained prompt has 0.95 of its shingles and its whole
    canonical text in the other.
    """
    exact = exact_matches(anchors, others).select("anchor", "other", F.lit(0).alias("rank"), F.lit("EXACT_PROMPT").alias("kind"), F.lit(1.0).alias("score"))
    found = exact
    if same_prompt:
        t = template_matches(anchors, others)
        found = found.union(t.select("anchor", "other", F.lit(1), F.lit("NUMERIC_TEMPLATE_UNCERTAIN"), F.lit(None).cast("double")))
    o = overlaps(anchors, others, NEAR)
    jac = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    near = jac >= NEAR
    canon_a, canon_b = anchors.select(F.col("id").alias("anchor"), F.col("canon").alias("ca")), others.select(F.col("id").alias("other"), F.col("canon").alias("cb"))
    far = o.filter(~near & (F.col("common") >= CONTAINED * F.col("na"))).join(canon_a, "anchor").join(canon_b, "other").filter("contains(cb, ca)")
    found = found.union(o.filter(near).select("anchor", "other", F.lit(2), F.lit("LEXICAL_NEAR_COPY_CONSERVATIVE_BIND"), jac))
    found = found.union(far.select("anchor", "other", F.lit(3), F.lit("PROMPT_CONTAINED_IN_SOURCE"), F.col("common") / F.col("na")))
    first = found.groupBy("anchor", "other").agg(F.min(F.struct("rank", "kind", "score")).alias("x"))
    return first.select("anchor", "other", "x.kind", "x.score")


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)``, the smallest id of each component over string edges ``(a, b)``; self pairs give lone ids."""
    e = Stage(edges.select("a", "b").distinct(), "edges")
    ids, of = number(e.df.select(F.explode(F.array("a", "b")).alias("id")))
    lab = contracted(e.df.select(of(F.col("a")).alias("a"), of(F.col("b")).alias("b")))
    return named(lab, ids)


def membership(edges: DataFrame) -> DataFrame:
    """``(id, family)`` with the family named by the digest of its root."""
    return components(edges).select("id", family_id(F.col("root")).alias("family"))


def exact_text_edges(df: DataFrame, key: str, digest_col: str, tokens: str, always: str, least: int = 40) -> DataFrame:
    """``(a, b)``: rows of equal text bound to the first of their group, if long enough or of an ``always`` kind."""
    d = df.filter(F.col(always) | (F.col(tokens) >= least)).select(F.col(key).alias("b"), F.col(digest_col).alias("h"))
    g = d.groupBy("h").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return lookup(d, g.select("h", "a"), "h", "inner").filter("a <> b").select("a", "b")


def uniform_components(members: DataFrame, attributes: list[str]) -> DataFrame:
    """``(root, n)`` of components whose members disagree in ``attributes``."""
    g = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*attributes)).alias("lo"), F.max(F.struct(*attributes)).alias("hi"))
    return g.filter("lo <> hi").select("root", "n")


def tainted(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """``(id)`` of everything that descends from a marked id over edges ``(parent, child)``: frontier by frontier."""
    e = Stage(edges.select("parent", "child"), "taint")
    hubs = HotKeys(e.df, "parent", HOT, e.rows)
    seen = Stage(marked.select("id").distinct(), "taint")
    front = seen
    while front.rows:
        step = lookup(e.df, front.df.select(F.col("id").alias("parent")), "parent", "inner", keys=hubs).select(F.col("child").alias("id")).distinct()
        front = Stage(step.join(seen.df, "id", "left_anti"), "taint")
        if front.rows:
            seen = Stage(seen.df.union(front.df), "taint")
    return seen.df


def assembled(*parts: tuple[str, DataFrame]) -> DataFrame:
    """``(a, b, kind)``: edges of several kinds ``(kind, edges(a, b))`` as one table, the input of :func:`components`.

    Ends compare as strings; edges with a null or equal ends are left out,
    repeated and reversed ones of a kind count once.
    """
    out = None
    for kind, e in parts:
        p = e.select(F.col("a").cast("string").alias("x"), F.col("b").cast("string").alias("y")).filter("x <> y")
        p = p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(kind).alias("kind"))
        out = p if out is None else out.unionByName(p)
    return out.distinct()


def source_edges(rows: DataFrame, key: str, source: str) -> DataFrame:
    """``(a, b)``: each row bound to its source, which is a vertex of its own."""
    return rows.filter(F.col(source).isNotNull()).select(F.col(key).cast("string").alias("a"), F.concat(F.lit("source "), F.col(source)).alias("b"))
