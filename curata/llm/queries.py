"""Queries of the training-data problems and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.llm import copies, cuts, groups, leaks, mix, near, pairs, splits, tokens
from curata.runtime import Stage, lookup, table


def p1_found(spark, d):
    return groups.consolidate(groups.binding_pairs(table(spark, d, "edges")))


def p3_found(spark, d):
    f = table(spark, d, "families")
    g = Stage(splits.related_groups(f, table(spark, d, "rights_dispositions")), "groups")
    return splits.split_conflicts(f, g.df)


def p3_splits(spark, d):
    g = Stage(splits.related_groups(table(spark, d, "families"), table(spark, d, "rights_dispositions")), "groups")
    return splits.assign_splits(g.df, table(spark, d, "split_targets"))


def p3_shares(spark, d):
    return splits.split_shares(p3_splits(spark, d), table(spark, d, "split_targets"))


def p5_found(spark, d):
    return copies.copies(table(spark, d, "messages"))


def p5_collapsed(spark, d):
    return copies.collapse(table(spark, d, "messages"))


def p6_found(spark, d):
    return near.near_pairs(table(spark, d, "messages"))


def p6_groups(spark, d):
    """Groups shaped like ``near_twins``: the id of a group is the digest of its members; from :func:`p6_members`."""
    g = p6_members(spark, d)
    out = g.groupBy("group_id").agg(F.sort_array(F.collect_list("id")).alias("record_ids"))
    return out.select(F.sha2(F.array_join("record_ids", ","), 256).alias("group_id"), "record_ids")


def p6_members(spark, d):
    """``(group_id, id)``: near copies, a row for each record, for groups of any size; pairs of units are joined, not of records."""
    good, of = near.near_units(table(spark, d, "messages"))
    bits = lambda c: F.lpad(F.hex(c), 16, "0")
    g = groups.consolidate(good.df.select(bits("a").alias("a"), bits("b").alias("b")))
    m = Stage(of.withColumn("u", bits("unit")).join(g.withColumnRenamed("id", "u"), "u").select(F.col("group_id").alias("g"), "id"), "members")
    low = m.df.groupBy("g").agg(F.min("id").alias("group_id"))
    return lookup(m.df, low, "g", "inner", rows=m.rows).select("group_id", "id")


def p7_found(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_tasks"))


def p7_leaked_items(spark, d):
    """For each item the number of documents that leak it."""
    hits = p7_found(spark, d).groupBy("task_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return table(spark, d, "eval_tasks").select("task_id").distinct().join(hits, "task_id", "left").select("task_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def p9_found(spark, d):
    return cuts.cut_documents(table(spark, d, "documents")).select("doc_id").distinct()


def p9_rates(spark, d):
    docs = table(spark, d, "documents")
    return cuts.cut_rates(docs, cuts.cut_documents(docs))


def p2_found(spark, d):
    return pairs.defects(table(spark, d, "messages"))


def p2_defects(spark, d):
    return p2_found(spark, d).groupBy("defect").agg(F.count(F.lit(1)).alias("n_answers"))


def p4_budget(spark, d):
    return tokens.budget(*[table(spark, d, t) for t in ("documents", "candidates", "messages", "review_completion")])


def _mix(spark, d):
    sizes = Stage(mix.sized(table(spark, d, "documents")), "sizes")
    rate = Stage(mix.rates(sizes.df, table(spark, d, "mix_targets")), "rates").df
    return mix.mix(sizes.df, rate, rows=sizes.rows), rate


def p8_mix(spark, d):
    return _mix(spark, d)[0]


def p8_shares(spark, d):
    return mix.reached(*_mix(spark, d))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


P1_SQL = r"""
WITH RECURSIVE e AS (
  SELECT DISTINCT lower(regexp_replace(anchor, '^\s+|\s+$', '', 'g')) AS x, lower(regexp_replace(other, '^\s+|\s+$', '', 'g')) AS y FROM edges
  WHERE score >= 0.85 AND NOT isnan(score) AND lower(regexp_replace(anchor, '^\s+|\s+$', '', 'g')) <> lower(regexp_replace(other, '^\s+|\s+$', '', 'g'))
    AND trim(anchor) <> '' AND trim(other) <> ''),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(id, seen) AS (SELECT x, x FROM b UNION SELECT r.id, b.y FROM r JOIN b ON b.x = r.seen)
SELECT id, min(seen) AS group_id FROM r GROUP BY id
"""

P3_CTE = r"""
WITH RECURSIVE f AS (SELECT DISTINCT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS id, nullif(lower(regexp_replace(family, '^\s+|\s+$', '', 'g')), '') AS family,
    CASE regexp_replace(lower(split), '[^a-z]+', '', 'g') WHEN 'training' THEN 'train' WHEN 'val' THEN 'validation'
      WHEN '' THEN NULL WHEN 'unassigned' THEN NULL ELSE regexp_replace(lower(split), '[^a-z]+', '', 'g') END AS split FROM families),
r0 AS (SELECT lower(regexp_replace(family_id, '^\s+|\s+$', '', 'g')) AS fam, regexp_replace(lower(regexp_replace(holder, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS holder, lower(regexp_replace(sha256, '^\s+|\s+$', '', 'g')) AS dig FROM rights_dispositions),
e AS (SELECT 'f ' || fam AS x, 'h ' || holder AS y FROM r0 WHERE holder NOT IN ('', '-', 'n/a', 'unknown', 'not stated', 'tbd')
  UNION SELECT 'f ' || fam, 'd ' || dig FROM r0 WHERE regexp_matches(dig, '^[0-9a-f]{64}$')
    AND dig <> 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855'),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(x, seen) AS (SELECT x, x FROM b WHERE x LIKE 'f %' UNION SELECT r.x, b.y FROM reach r JOIN b ON b.x = r.seen),
comp AS (SELECT x, min(seen) AS c FROM reach GROUP BY x),
m AS (SELECT f.id, f.split, coalesce(comp.c, 'f ' || f.family, 'r ' || f.id) AS c FROM f LEFT JOIN comp ON comp.x = 'f ' || f.family),
g AS (SELECT c, min(id) AS group_id, count(DISTINCT split) AS n FROM m GROUP BY c)
"""


P3_SPLITS = P3_CTE + r""", z AS (SELECT group_id, count(DISTINCT id) AS n FROM m JOIN g USING (c) GROUP BY group_id),
t AS (SELECT split, sum(w) OVER (ORDER BY split) / sum(w) OVER () AS upto, row_number() OVER (ORDER BY split DESC) = 1 AS last FROM (SELECT split, max(target_share) AS w FROM split_targets GROUP BY split)),
p AS (SELECT group_id, (sum(n) OVER (ORDER BY md5('split:' || group_id), group_id) - n + n / 2.0) / sum(n) OVER () AS mid FROM z),
o AS (SELECT DISTINCT m.id, g.group_id, (SELECT min(t.split) FROM t WHERE p.mid < t.upto OR t.last) AS split FROM m JOIN g USING (c) JOIN p USING (group_id))
"""

# Letters and digits of a content, or the fields and values of a JSON object in any order.
P5_CTE = r"""
WITH m0 AS (SELECT DISTINCT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS id, turn, lower(regexp_replace(coalesce(role, ''), '\s+', '', 'g')) AS role, coalesce(content, '') AS content FROM messages WHERE id IS NOT NULL),
m1 AS (SELECT *, json_valid(content) AND left(trim(content, E' \n\t\r'), 1) = '{' AS obj FROM m0),
j AS (SELECT content, string_agg(x, '|' ORDER BY x) AS form FROM (SELECT c.content, regexp_replace(lower(t.fullkey), '[^\pL\pN\[\].]+', '', 'g') || '=' || CASE WHEN t.type = 'VARCHAR' THEN regexp_replace(replace(lower(t.value ->> '$'), 'ß', 'ss'), '[^\pL\pN]+', '', 'g') ELSE '#' || t.atom END AS x
    FROM (SELECT DISTINCT content FROM m1 WHERE obj) c, json_tree(c.content) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')) GROUP BY content),
f AS (SELECT DISTINCT id, turn, role, CASE WHEN obj THEN '{' || coalesce(j.form, '') ELSE regexp_replace(replace(lower(m1.content), 'ß', 'ss'), '[^\pL\pN]+', '', 'g') END AS form FROM m1 LEFT JOIN j ON m1.obj AND j.content = m1.content),
r AS (SELECT id, md5(string_agg(turn || ':' || role || ':' || form, '|' ORDER BY turn, role, form)) AS root FROM f GROUP BY id),
k AS (SELECT root, min(id) AS keep_id, count(*) AS n FROM r GROUP BY root)
"""

# All runs of three words of all records against each other.
P6_SQL = P5_CTE + r""", w AS (SELECT id, list(x ORDER BY turn, i) AS w FROM (SELECT id, turn, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM (SELECT DISTINCT id, turn, regexp_extract_all(replace(lower(content), 'ß', 'ss'), '[\pL\pN]+') AS v FROM m0 WHERE role <> 'system')) GROUP BY id),
s AS (SELECT DISTINCT id, hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS s FROM w, range(1, greatest(len(w) - 1, 1)) x(i)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
SELECT p.a AS id_a, p.b AS id_b FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b JOIN r ra ON ra.id = p.a JOIN r rb ON rb.id = p.b WHERE c * 2 >= x.n + y.n - c AND ra.root <> rb.root
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_SQL,
        "p3_found": P3_CTE + "SELECT DISTINCT m.id, g.group_id FROM m JOIN g USING (c) WHERE g.n > 1",
        "p3_splits": P3_SPLITS + "SELECT * FROM o",
        "p3_shares": P3_SPLITS + ", c AS (SELECT split, count(*) AS n FROM o GROUP BY split), y AS (SELECT s.split, coalesce(c.n, 0) AS n, s.target_share FROM (SELECT split, max(target_share) AS target_share FROM split_targets GROUP BY split) s LEFT JOIN c USING (split)) SELECT split, n AS n_records, round(n / sum(n) OVER (), 6) AS share, target_share FROM y",
        "p5_found": P5_CTE + "SELECT k.keep_id, r.id AS copy_id FROM r JOIN k USING (root) WHERE r.id <> k.keep_id",
        "p5_collapsed": P5_CTE + "SELECT keep_id, n AS n_copies FROM k",
        "p6_found": P6_SQL,
    }
