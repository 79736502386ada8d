"""Connected components over edge tables of any size and any skew.

Vertices are longs. No step groups the neighbours of a vertex into one row:
degrees come from partial aggregates, edges are removed and chains are walked by
joins keyed on the edge itself. Sizes are observed while tables are staged, so
no round counts what it has just written.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.runtime import HOT, HotKeys, Stage, lookup

WORTH = 8  # a round of contraction that removes less than an eighth of the edges is the last
CORE = 1 << 20  # edges that one task solves: 16 MB; a larger core goes to the stars


def _two(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def number(ids: DataFrame, col: str = "id") -> tuple[Stage, Callable[[Column], Column]]:
    """Distinct ids with numbers ``v``, and the expression that gives the number of an id.

    The number is the id's 64-bit hash, so that tables of ids are numbered
    without a join. Distinct ids with one hash are looked for; if there are any
    (unlikely below billions of ids), another salt is tried.
    """
    salt = 0
    while True:
        of = lambda c, k=salt: F.xxhash64(c) if not k else F.xxhash64(c, F.lit(k))
        d = ids.select(F.col(col).alias("id")).filter(F.col("id").isNotNull())
        by = d.groupBy(of(F.col("id")).alias("v")).agg(F.min("id").alias("id"), F.max("id").alias("_last"))
        s = Stage(by.select("id", "v", (F.col("id") != F.col("_last")).alias("_clash")), "ids", clashes=F.max("_clash"))
        if not s.seen["clashes"]:
            s.df = s.df.drop("_clash")
            return s, of
        s.drop()
        salt += 1


def named(labels: DataFrame, ids: Stage, hot: int = HOT) -> DataFrame:
    """``(id, root)`` of labels ``(v, root)``: ``root`` becomes the smallest id (by code point) of the component.

    Ids without a label are roots.
    """
    j = Stage(ids.df.join(labels, "v", "left").select("id", F.coalesce("root", "v").alias("c")), "named")
    low = j.df.groupBy("c").agg(F.min("id").alias("root"))
    return lookup(j.df, low, "c", "inner", hot, j.rows).select("id", "root")


def both_ways(edges: DataFrame) -> DataFrame:
    """Arcs ``(u, v)`` of both directions of edges ``(a, b)``."""
    arcs = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return edges.select(F.inline(arcs))


def star_components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """``(v, root)`` with ``root`` the smallest vertex of the component, by large and small stars.

    Alternates the two star operations until the edge set no longer changes.
    Vertices without an edge are not in the result.
    """
    mark = {"mark": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    now = Stage(edges.select(*_two("a", "b")).filter("a <> b").distinct(), "star", **mark)
    last = None
    while last != (now.rows, now.seen["mark"]):
        last = now.rows, now.seen["mark"]
        for large in (True, False):
            arcs = both_ways(now.df) if large else now.df.select(F.col("b").alias("u"), F.col("a").alias("v"))
            low = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            got = lookup(arcs, low, "u", "inner", hot, now.rows * (2 if large else 1))
            got = got.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if large else got.select(
                F.inline(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b"))))
            )
            nxt = Stage(got.filter("a <> b").distinct(), "star", **mark)
            now.drop()
            now = nxt
    # at the fixed point every edge leads from the root of a star to one of its vertices
    out = now.df.select(F.col("b").alias("v"), F.col("a").alias("root"))
    return out.union(now.df.select(F.col("a").alias("v"), F.col("a").alias("root")).distinct())


def _union_find(batches):
    """``(v, root)`` of the edges ``(a, b)`` of all batches: labels and pointers are lowered in turn until they rest."""
    got = [(np.asarray(b.column("a")), np.asarray(b.column("b"))) for b in batches]
    if not sum(len(a) for a, _ in got):
        return
    a, b = (np.concatenate(x) for x in zip(*got))
    names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = code[: len(a)], code[len(a) :]
    root = np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        far = x != y
        if not far.any():
            break
        a, b, x, y = a[far], b[far], x[far], y[far]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], ["v", "root"])


def solve_core(core: Stage, hot: int = HOT, bound: int = CORE) -> DataFrame:
    """``(v, root)`` of a staged edge table: in one task if it has at most ``bound`` edges, else by stars."""
    if core.rows > bound:
        return star_components(core.df, hot)
    return core.df.select("a", "b").coalesce(1).mapInArrow(_union_find, "v long, root long")


def contract_components(edges: DataFrame, hot: int = HOT, bound: int = CORE) -> DataFrame:
    """``(v, root)``, ``root`` the smallest vertex of the component, by :func:`contracted`."""
    e = Stage(edges.select("a", "b").filter("a <> b"), "edges")
    lab = contracted(e.df, hot, bound)
    all_ = e.df.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    label = Stage(all_.join(lab, "v", "left").select("v", F.coalesce("root", "v").alias("root")), "label")
    low = label.df.groupBy("root").agg(F.min("v").alias("low"))
    return lookup(label.df, low, "root", "inner", hot, label.rows).select("v", F.col("low").alias("root"))


def contracted(edges: DataFrame, hot: int = HOT, bound: int = CORE) -> DataFrame:
    """``(v, root)``, some vertex ``root`` for each component, by tree contraction; vertices without a row are roots.

    In each round all vertices of degree one and two go at once. They form
    chains, which list ranking walks in a logarithmic number of steps (each
    makes the pointers four times as long): a chain that ends in a leaf is stripped and hangs
    on its other end; a chain between two ends is compressed to one edge between
    them and hangs on the smaller. Rounds go on while they remove at least
    ``1 / WORTH`` of the edges; :func:`solve_core` labels the rest. Removed
    vertices then take the label of the vertex they hang on, last round first.

    ``edges`` needs columns ``a`` and ``b`` (longs); self pairs, nulls, repeated
    and reversed pairs are harmless. An empty table gives an empty result.
    """
    now = Stage(edges.select(*_two("a", "b")).filter("a <> b").distinct(), "edges")
    removed: list[Stage] = []
    before = None
    while now.rows and (before is None or (before - now.rows) * WORTH >= before):
        before = now.rows
        ends = both_ways(now.df).groupBy("u").agg(F.count(F.lit(1)).alias("deg"), F.min("v").alias("n1"), F.max("v").alias("n2"))
        low = Stage(ends.filter("deg <= 2"), "low")
        if not low.rows:
            low.drop()
            break
        hang = _chains(low)
        around = low.df.select(F.explode(F.array_distinct(F.array(F.struct(*_two("u", "n1")), F.struct(*_two("u", "n2"))))).alias("e")).select("e.a", "e.b").distinct()
        rest = now.df.join(around, ["a", "b"], "left_anti")
        if hang.seen["bridges"]:
            rest = rest.union(hang.df.filter("e1 is not null").select(F.col("e1").alias("a"), F.col("e2").alias("b"))).distinct()
        nxt = Stage(rest, "edges")
        now.drop()
        low.drop()
        now = nxt
        removed.append(hang)
    known: list[Stage] = []
    if now.rows:
        known.append(Stage(solve_core(now, hot, bound), "label"))
    now.drop()
    for part in reversed(removed):
        # an end that lost all its edges has no label: it is the root of what hangs on it
        p = part.df.filter("p is not null").select("p", "v")
        if known:
            to = _union([s.df for s in known]).select(F.col("v").alias("p"), "root")
            p = lookup(p, to, "p", "left", hot, part.rows).select("v", F.coalesce("root", "p").alias("root"))
        known.append(Stage(p.select("v", p["root"] if known else F.col("p").alias("root")), "label"))
        part.drop()
    return _union([s.df for s in known]) if known else edges.select(F.col("a").alias("v"), F.col("a").alias("root")).limit(0)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _chains(low: Stage) -> Stage:
    """``(v, p, e1, e2)``: what each vertex of degree one or two hangs on, and the edge that replaces its chain, if any.

    List ranking: the list nodes are the arcs that leave a vertex of degree one
    or two; an arc's next is the arc that goes on from its head. Pointers become
    four times as long in a round, so a chain of n vertices takes log4(n) rounds;
    all joins are keyed by the arc, of which each is unique. An arc that reaches a leaf, or a vertex of
    higher degree, has found an end of its chain. In a ring no arc does; there
    the smallest vertex spreads until nothing changes.
    """
    S = F.struct
    arc = lambda x, y, nx=None, ny=None: S(F.col(x).alias("x"), F.col(y).alias("y"), *([F.col(nx).alias("nx"), F.col(ny).alias("ny")] if nx else []))
    two = low.df.filter("deg = 2")
    nodes = low.df.filter("deg = 1").select(F.col("u").alias("x"), F.col("n1").alias("y")).union(two.select(F.inline(F.array(arc("u", "n1"), arc("u", "n2")))))
    on = two.select(F.inline(F.array(arc("n1", "u", "u", "n2"), arc("n2", "u", "u", "n1")))).withColumn("leaf", F.lit(False))
    stop = low.df.filter("deg = 1").select(F.col("n1").alias("x"), F.col("u").alias("y"), F.lit(None).cast("long").alias("nx"), F.lit(None).cast("long").alias("ny"), F.lit(True).alias("leaf"))
    start = nodes.join(on.union(stop), ["x", "y"], "left")
    measures = {"open": F.count("nx"), "mark": F.sum(F.when(F.col("nx").isNotNull(), F.col("low")).cast("decimal(38,0)"))}
    cols = ["x", "y", "nx", "ny", "end", "leaf", "low"]
    now = Stage(start.select("x", "y", "nx", "ny", F.when(F.col("nx").isNull(), F.col("y")).alias("end"), F.coalesce("leaf", F.lit(False)).alias("leaf"), F.least("x", F.coalesce("nx", "x")).alias("low")), "rank", **measures)
    last = None
    while now.seen["open"] and last != now.seen:
        last = now.seen
        t = now.df.select(F.col("x").alias("kx"), F.col("y").alias("ky"), F.lit(True).alias("go"), F.col("nx").alias("tx"), F.col("ny").alias("ty"), F.col("end").alias("tend"), F.col("leaf").alias("tleaf"), F.col("low").alias("tlow"))
        step = now.df.filter("nx is not null").select(cols)
        go = F.col("go")
        for k in range(3):  # three hops of the pointers as they stood make one of four times the length
            # arcs that have arrived match nothing and are spread by themselves
            keyed = step.withColumns({"kx": F.coalesce("nx", "x"), "ky": F.coalesce("ny", "y"), "go": F.col("nx").isNotNull()})
            j = keyed.join(t, ["kx", "ky", "go"], "left" if k else "inner")
            step = j.select("x", "y", F.when(go, F.col("tx")).alias("nx"), F.when(go, F.col("ty")).alias("ny"), F.when(go, F.col("tend")).otherwise(F.col("end")).alias("end"), F.when(go, F.col("tleaf")).otherwise(F.col("leaf")).alias("leaf"), F.least("low", "tlow").alias("low"))
        nxt = Stage(now.df.filter("nx is null").select(cols).union(step.select(cols)), "rank", **measures)
        now.drop()
        now = nxt
    # ends that are no leaf come first
    at = F.when(F.col("nx").isNull(), S("leaf", "end"))
    g = now.df.groupBy(F.col("x").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"), F.min(F.when(F.col("nx").isNotNull(), F.col("low"))).alias("ring"))
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    p = (
        F.when(F.col("ring").isNotNull(), F.when(v != F.col("ring"), F.col("ring")))
        .when(~lo["leaf"], lo["end"])
        .when(F.col("n") == 1, F.when(v > lo["end"], lo["end"]))  # a path between two leaves hangs on the smaller
        .otherwise(F.least(lo["end"], hi["end"]))
    )
    bridge = F.col("ring").isNull() & (F.col("n") == 2) & ~hi["leaf"] & (lo["end"] != hi["end"])
    out = g.select("v", p.alias("p"), F.when(bridge, lo["end"]).alias("e1"), F.when(bridge, hi["end"]).alias("e2"))
    hang = Stage(out, "hang", bridges=F.count("e1"))
    now.drop()
    return hang


def frontier_components(edges: DataFrame, salt: int = 0, hot: int = HOT, bound: int = CORE) -> DataFrame:
    """``(v, root)``, one vertex ``root`` for each component, by breadth-first search from many seeds at once.

    Seeds are the vertices whose hash is a minimum among their neighbours, so
    every component has one and most vertices are few steps from one. All
    frontiers expand together over the adjacency, hash-partitioned by the vertex
    (hubs are divided); a vertex that several searches reach keeps the smallest
    label. The arcs whose ends have different labels give the small graph of
    colliding seeds, which :func:`solve_core` merges.
    """
    arcs = Stage(both_ways(edges.filter("a <> b").select(*_two("a", "b")).distinct()), "arcs")
    hubs = HotKeys(arcs.df, "u", hot, arcs.rows)
    h = lambda c: F.struct(F.xxhash64(F.lit(salt), c), F.col(c))
    low = arcs.df.groupBy("u").agg(F.min(h("v")).alias("m"))
    front = Stage(low.filter(h("u") < F.col("m")).select(F.col("u").alias("v"), F.col("u").alias("seed")), "front")
    seen = [front]
    while front.rows:
        step = lookup(arcs.df, front.df.select(F.col("v").alias("u"), "seed"), "u", "inner", hot, keys=hubs).groupBy("v").agg(F.min("seed").alias("seed"))
        front = Stage(step.join(_union([s.df for s in seen]).select("v"), "v", "left_anti"), "front")
        seen.append(front)
    label = _union([s.df for s in seen])
    met = lookup(arcs.df.filter("u < v"), label.select(F.col("v").alias("u"), F.col("seed").alias("a")), "u", "inner", hot, keys=hubs).select("u", "v", "a")
    # arcs stand in both directions: the same vertices are hot among the heads
    met = lookup(met, label.select("v", F.col("seed").alias("b")), "v", "inner", hot, keys=hubs.renamed("v")).filter("a <> b").select(*_two("a", "b")).distinct()
    small = Stage(met, "seeds")
    arcs.drop()
    whole = Stage(label, "seen")
    for s in seen:
        s.drop()
    if not small.rows:
        return whole.df.select("v", F.col("seed").alias("root"))
    merged = Stage(solve_core(small, hot, bound).withColumnRenamed("v", "seed"), "merged")
    small.drop()
    return lookup(whole.df, merged.df, "seed", "left", hot, whole.rows).select("v", F.coalesce("root", "seed").alias("root"))
