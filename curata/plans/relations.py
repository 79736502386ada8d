"""Queries over records, families and edges: joins, sets, graphs, reports, catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions.identity import family_id
from curata.operators import dedup, families, guards, reports, sampling
from curata.plans.registry import Registry
from curata.runtime import clean_id, table
from curata.sources import latest

QUERIES = query = Registry()
ID = "lower(trim(id))"


def ids(spark, d, name, *more):
    return table(spark, d, name).select(clean_id(F.col("id")).alias("id"), *more)


# ---- joins ------------------------------------------------------------------------------------------------------


@query("j01_lineage_gaps", f"WITH c AS (SELECT DISTINCT {ID} AS id FROM candidates), r AS (SELECT DISTINCT {ID} AS id FROM review_completion) SELECT CASE WHEN r.id IS NULL THEN 'NO_REVIEW' ELSE 'NO_CANDIDATE' END AS rule, coalesce(c.id, r.id) AS entity FROM c FULL JOIN r USING (id) WHERE c.id IS NULL OR r.id IS NULL")
def j01(spark, d):
    return guards.one_to_one(ids(spark, d, "candidates"), ids(spark, d, "review_completion"), "id", ("NO_REVIEW", "NO_CANDIDATE")).select("rule", "entity")


@query("j06_overlay", f"SELECT {ID} AS id, lang FROM candidates c WHERE {ID} IN (SELECT {ID} FROM review_completion WHERE disposition = 'PASS')")
def j06(spark, d):
    ok = ids(spark, d, "review_completion", "disposition").filter("disposition = 'PASS'").select("id")
    return ids(spark, d, "candidates", "lang").join(ok, "id", "left_semi")


@query("j07_manual_hold", f"SELECT {ID} AS id, {ID} IN (SELECT {ID} FROM review_completion WHERE disposition = 'QUARANTINE') AS held FROM candidates")
def j07(spark, d):
    holds = ids(spark, d, "review_completion", "disposition").filter("disposition = 'QUARANTINE'")
    return sampling.hold(ids(spark, d, "candidates"), holds, "id")


@query("j08_unreviewed", f"SELECT DISTINCT {ID} AS id FROM candidates WHERE {ID} NOT IN (SELECT {ID} FROM review_completion WHERE id IS NOT NULL)")
def j08(spark, d):
    return ids(spark, d, "candidates").join(ids(spark, d, "review_completion"), "id", "left_anti").distinct()


@query("j09_prefix_join", "SELECT f.id, f.family, r.path FROM families f JOIN rights_dispositions r ON lower(trim(f.family)) = lower(trim(r.family_id)) AND substr(lower(trim(r.sha256)), 1, 1) = substr(lower(trim(f.family)), 8, 1)")
def j09(spark, d):
    """Join by key with equality of prefixes as a further condition."""
    f = table(spark, d, "families").select("id", "family", F.lower(F.trim("family")).alias("k"))
    f = f.withColumn("p", F.substring("k", 8, 1))
    r = table(spark, d, "rights_dispositions").select(F.lower(F.trim("family_id")).alias("k"), F.substring(F.lower(F.trim("sha256")), 1, 1).alias("p"), "path")
    return f.join(r, ["k", "p"]).select("id", "family", "path")


@query("j14_sealed_families", "WITH s AS (SELECT document_family AS f FROM documents WHERE lower(trim(source)) = 'safety_cards' AND document_family IS NOT NULL) SELECT doc_id FROM documents WHERE document_family IS NULL OR document_family NOT IN (SELECT f FROM s)")
def j14(spark, d):
    t = table(spark, d, "documents")
    s = t.filter("lower(trim(source)) = 'safety_cards' and document_family is not null").select("document_family")
    return guards.sealed(t, s, "document_family")[0].select("doc_id")


@query("j15_metadata_gaps", f"WITH c AS (SELECT DISTINCT {ID} AS id FROM candidates), f AS (SELECT DISTINCT {ID} AS id FROM families WHERE id LIKE '%repo-%' OR id LIKE '%REPO-%'), m AS (SELECT DISTINCT {ID} AS id FROM messages) SELECT 'NO_FAMILY' AS rule, count(*) AS n FROM c ANTI JOIN f USING (id) UNION ALL SELECT 'NO_CANDIDATE', count(*) FROM f ANTI JOIN c USING (id) UNION ALL SELECT 'NO_MESSAGES', count(*) FROM c ANTI JOIN m USING (id) UNION ALL SELECT 'NO_RECORD', count(*) FROM m ANTI JOIN c USING (id)")
def j15(spark, d):
    c, m = ids(spark, d, "candidates"), ids(spark, d, "messages")
    f = ids(spark, d, "families").filter("id like 'repo-%'")
    v = guards.union([guards.one_to_one(c, f, "id", ("NO_FAMILY", "NO_CANDIDATE")), guards.one_to_one(c, m, "id", ("NO_MESSAGES", "NO_RECORD"))])
    return guards.counts(v, ["NO_FAMILY", "NO_CANDIDATE", "NO_MESSAGES", "NO_RECORD"])


@query("j16_reverse_edges", "WITH e AS (SELECT lower(trim(anchor)) AS a, lower(trim(other)) AS b FROM edges WHERE anchor IS NOT NULL AND other IS NOT NULL) SELECT id, count(DISTINCT n) AS n_neighbours FROM (SELECT a AS id, b AS n FROM e UNION SELECT b, a FROM e) WHERE id <> n GROUP BY 1")
def j16(spark, d):
    e = table(spark, d, "edges").select(clean_id(F.col("anchor")).alias("a"), clean_id(F.col("other")).alias("b")).filter("a is not null and b is not null and a <> b")
    both = e.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("n")), F.struct(F.col("b").alias("id"), F.col("a").alias("n"))))).distinct()
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("n_neighbours"))


# ---- graphs -----------------------------------------------------------------------------------------------------

G_SQL = (
    "WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(anchor)) AS x, lower(trim(other)) AS y FROM edges WHERE trim(anchor) <> '' AND trim(other) <> ''), "
    "b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r(id, seen) AS (SELECT x, x FROM b UNION SELECT r.id, b.y FROM r JOIN b ON b.x = r.seen), c AS (SELECT id, min(seen) AS root FROM r GROUP BY id) "
)


def _bound(spark, d):
    """Edges of every kind; ``NUMERIC_TEMPLATE_UNCERTAIN`` binds like the others."""
    e = table(spark, d, "edges")
    return e.select(clean_id(F.col("anchor")).alias("a"), clean_id(F.col("other")).alias("b")).filter("a is not null and b is not null")


@query("g01_components", G_SQL + "SELECT id, root FROM c")
def g01(spark, d):
    return families.components(_bound(spark, d))


@query("g03_family_names", G_SQL + "SELECT 'family-' || substr(sha256(root), 1, 24) AS family, count(*) AS n FROM c GROUP BY 1")
def g03(spark, d):
    return families.membership(_bound(spark, d)).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("g04_refinalized", "WITH RECURSIVE x AS (SELECT doc_id::VARCHAR AS id, document_family AS f, sha256(text) AS h, n_chars FROM documents), e AS (SELECT id AS a, 'f ' || f AS b FROM x WHERE f IS NOT NULL UNION SELECT y.id, z.id FROM x y JOIN x z ON y.h = z.h AND y.id < z.id WHERE y.n_chars >= 400 AND z.n_chars >= 400), b AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), k AS (SELECT x, min(x) AS r FROM b GROUP BY x), r(id, seen) AS (SELECT x, x FROM b UNION SELECT r.id, b.y FROM r JOIN b ON b.x = r.seen) SELECT id, min(seen) AS root FROM r GROUP BY id")
def g04(spark, d):
    """Families made final again: recorded membership and exact texts together."""
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "document_family", F.sha2("text", 256).alias("h"), "n_chars", F.lit(False).alias("always"))
    e = t.filter("document_family is not null").select(F.col("id").alias("a"), F.concat(F.lit("f "), "document_family").alias("b"))
    return families.components(e.union(families.exact_text_edges(t, "id", "h", "n_chars", "always", 400)))


@query("g05_title_groups", r"WITH t AS (SELECT doc_id, lower(trim(regexp_replace(string_split(text, chr(10))[1], '[^\pL\pN]+', ' ', 'g'))) AS title FROM documents) SELECT title, count(*) AS n FROM t WHERE length(title) > 10 GROUP BY 1 HAVING count(*) >= 2")
def g05(spark, d):
    """Titles of several documents: recorded, never merged."""
    t = F.lower(F.trim(F.regexp_replace(F.get(F.split("text", "\n"), F.lit(0)), r"[^\p{L}\p{N}]+", " ")))
    g = table(spark, d, "documents").groupBy(t.alias("title")).agg(F.count(F.lit(1)).alias("n"))
    return g.filter("length(title) > 10 and n >= 2")


@query("g06_split_gate", G_SQL + ", s AS (SELECT DISTINCT lower(trim(id)) AS id, lower(trim(split)) AS split FROM families WHERE trim(split) <> '') SELECT root, count(*) AS n FROM c JOIN s USING (id) GROUP BY root HAVING min(split) <> max(split)")
def g06(spark, d):
    """Components whose members are in more than one split."""
    s = table(spark, d, "families").filter("trim(split) <> ''").select(clean_id(F.col("id")).alias("id"), F.lower(F.trim("split")).alias("split")).distinct()
    return families.uniform_components(families.components(_bound(spark, d)).join(s, "id"), ["split"])


@query("g07_taint", "WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(anchor)) AS p, lower(trim(other)) AS c FROM edges WHERE anchor IS NOT NULL AND other IS NOT NULL), t(id) AS (SELECT DISTINCT lower(trim(id)) FROM candidates WHERE len(issue_codes) > 0 UNION SELECT e.c FROM t JOIN e ON e.p = t.id) SELECT id FROM t")
def g07(spark, d):
    e = table(spark, d, "edges").select(clean_id(F.col("anchor")).alias("parent"), clean_id(F.col("other")).alias("child")).filter("parent is not null and child is not null").distinct()
    return families.tainted(e, ids(spark, d, "candidates", "issue_codes").filter(F.size("issue_codes") > 0))


@query("a20_exact_text_edges", "WITH x AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE n_chars >= 400 OR lower(trim(source)) = 'plc_snippets'), g AS (SELECT h, min(doc_id) AS a FROM x GROUP BY h HAVING count(*) > 1) SELECT a, doc_id AS b FROM x JOIN g USING (h) WHERE a <> doc_id")
def a20(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "n_chars", F.coalesce(F.lower(F.trim("source")) == "plc_snippets", F.lit(False)).alias("always"))
    return families.exact_text_edges(t, "doc_id", "h", "n_chars", "always", 400)


@query("a21_edge_counts", "SELECT kind, count(*) AS n, count(DISTINCT lower(trim(anchor))) AS n_anchors FROM edges GROUP BY kind")
def a21(spark, d):
    return table(spark, d, "edges").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower(F.trim("anchor"))).alias("n_anchors"))


# ---- reports ----------------------------------------------------------------------------------------------------


@query("a09_flagged", "SELECT lower(trim(id)) AS id FROM candidates WHERE list_contains(issue_codes, 'LEGACY_VALIDATION_OVERLAP_REVIEW')")
def a09(spark, d):
    return ids(spark, d, "candidates", "issue_codes").filter(F.exists("issue_codes", lambda c: c == "LEGACY_VALIDATION_OVERLAP_REVIEW")).select("id")


@query("a10_cohorts", "SELECT lower(trim(id)) AS id FROM candidates GROUP BY 1 HAVING bool_and(path = 'val.jsonl')")
def a10(spark, d):
    """Records all of whose deliveries come from one file."""
    return ids(spark, d, "candidates", "path").groupBy("id").agg(F.bool_and(F.col("path") == "val.jsonl").alias("all")).filter("all").select("id")


@query("a11_code_counts", "SELECT code, count(*) AS n FROM (SELECT unnest(issue_codes) AS code FROM candidates) GROUP BY 1")
def a11(spark, d):
    return reports.code_counts(table(spark, d, "candidates"), "issue_codes")


@query("a11_status_counts", "SELECT repository, review_status, count(*) AS n FROM candidates GROUP BY 1, 2")
def a11_status(spark, d):
    return reports.counts(table(spark, d, "candidates"), "repository", "review_status")


@query("a12_percentage", "SELECT count(*) FILTER (WHERE review_status = 'reviewed') AS numerator, count(*) AS denominator, round(count(*) FILTER (WHERE review_status = 'reviewed') * 100.0 / count(*), 6) AS pct FROM candidates")
def a12(spark, d):
    return reports.percentage(table(spark, d, "candidates"), F.col("review_status") == "reviewed")


@query("a13_split_cube", "SELECT lower(trim(split)) AS split, substr(lower(trim(id)), 1, 4) AS kind, count(*) AS n FROM families GROUP BY CUBE (lower(trim(split)), substr(lower(trim(id)), 1, 4))")
def a13(spark, d):
    f = table(spark, d, "families").select(F.lower(F.trim("split")).alias("split"), F.substring(F.lower(F.trim("id")), 1, 4).alias("kind"))
    return f.cube("split", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("a14_domain_status", "SELECT domain, count(*) AS total, count(*) FILTER (WHERE disposition = 'PASS')::BIGINT AS \"PASS\", count(*) FILTER (WHERE disposition = 'QUARANTINE')::BIGINT AS \"QUARANTINE\", count(*) FILTER (WHERE disposition = 'REJECT')::BIGINT AS \"REJECT\" FROM review_completion GROUP BY domain")
def a14(spark, d):
    return reports.pivot_counts(table(spark, d, "review_completion"), "domain", "disposition", ["PASS", "QUARANTINE", "REJECT"])


@query("a15_alias_counts", "SELECT repository, count(DISTINCT lower(trim(id))) AS n FROM candidates GROUP BY 1")
def a15(spark, d):
    """Records by repository; a record of several counts in each."""
    return ids(spark, d, "candidates", "repository").distinct().groupBy("repository").agg(F.count(F.lit(1)).alias("n"))


@query("a16_reconciled", "SELECT sum(n)::BIGINT AS sum, (SELECT count(*) FROM candidates) AS total, sum(n) = (SELECT count(*) FROM candidates) AS ok FROM (SELECT lang, count(*) AS n FROM candidates GROUP BY 1)")
def a16(spark, d):
    c = table(spark, d, "candidates")
    return reports.reconcile(reports.counts(c, "lang"), "n", c.count())


@query("a17_ledger_counts", "SELECT origin, basis, count(*) AS n, count(DISTINCT lower(trim(family_id))) AS n_families FROM rights_dispositions GROUP BY 1, 2")
def a17(spark, d):
    r = table(spark, d, "rights_dispositions")
    return r.groupBy("origin", "basis").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower(F.trim("family_id"))).alias("n_families"))


@query("a18_index_percentiles", "WITH r AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT max(v) AS max, max(v) FILTER (WHERE i = floor(n * 0.5)) AS p50, max(v) FILTER (WHERE i = floor(n * 0.95)) AS p95, max(v) FILTER (WHERE i = floor(n * 0.99)) AS p99, max(n) AS n FROM r")
def a18(spark, d):
    return reports.index_percentiles(table(spark, d, "documents"), "n_chars")


@query("a19_token_totals", "SELECT count(*) AS n, coalesce(sum(qwen_tokens), 0)::BIGINT AS tokens, count(*) FILTER (WHERE qwen_tokens > 400) AS n_over, count(*) FILTER (WHERE qwen_tokens IS NULL) AS n_missing FROM candidates")
def a19(spark, d):
    t = F.col("qwen_tokens")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return table(spark, d, "candidates").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(t), F.lit(0)).alias("tokens"), n(t > 400).alias("n_over"), n(t.isNull()).alias("n_missing"))


@query("a32_components", "SELECT string_split(source_family, '.')[1] AS component, count(*) AS n FROM eval_tasks GROUP BY 1")
def a32(spark, d):
    from curata.operators.kernels import parameter_counts

    return parameter_counts(table(spark, d, "eval_tasks").select("source_family", F.lit(1).alias("one")), "source_family", "one")


@query("snk05_redacted_catalogue", "SELECT id, review_status, CASE WHEN review_status = 'quarantined' THEN '[excluded]' ELSE path END AS path, CASE WHEN review_status = 'quarantined' THEN '[excluded]' ELSE lang END AS lang FROM candidates")
def snk05(spark, d):
    return reports.redacted(table(spark, d, "candidates").select("id", "review_status", "path", "lang"), "review_status", ["id"], "quarantined")


@query("snk08_latest", "SELECT id, lang, review_status FROM (SELECT lower(trim(id)) AS id, lang, review_status, row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY received_at DESC, lang DESC, review_status DESC) AS k FROM candidates) WHERE k = 1")
def snk08(spark, d):
    return latest(ids(spark, d, "candidates", "lang", "review_status", "received_at"), ["id"], ["received_at"]).select("id", "lang", "review_status")


@query("a23_seal", "WITH d AS (SELECT sha256(to_json({'task_id': task_id, 'r': prompt})::VARCHAR) AS d FROM eval_tasks) SELECT count(*) AS n, sha256(" + " || ',' || ".join(f"sum(('0x' || substr(d, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8)) + ") AS digest FROM d")
def a23(spark, d):
    return reports.seal(table(spark, d, "eval_tasks"), "task_id", F.col("prompt"))


# ---- sets -------------------------------------------------------------------------------------------------------


@query("s02_id_equality", f"SELECT 'candidates' AS side, count(*) AS n FROM (SELECT {ID} AS id FROM candidates EXCEPT SELECT {ID} FROM messages) UNION ALL SELECT 'messages', count(*) FROM (SELECT {ID} FROM messages EXCEPT SELECT {ID} FROM candidates)")
def s02(spark, d):
    v = guards.one_to_one(ids(spark, d, "candidates"), ids(spark, d, "messages"), "id", ("candidates", "messages"))
    return guards.counts(v, ["candidates", "messages"]).withColumnRenamed("rule", "side")


@query("s03_disjoint", "SELECT DISTINCT 'SHARED' AS rule, lower(trim(family)) AS entity FROM families WHERE family IS NOT NULL AND lower(trim(split)) = 'train' AND lower(trim(family)) IN (SELECT lower(trim(family)) FROM families WHERE lower(trim(split)) = 'test' AND family IS NOT NULL)")
def s03(spark, d):
    f = table(spark, d, "families").filter("family is not null").select(clean_id(F.col("family")).alias("family"), F.lower(F.trim("split")).alias("split"))
    return guards.disjoint_violations(f.filter("split = 'train'"), f.filter("split = 'test'"), "family").select("rule", "entity")


@query("s04_unknown_codes", "SELECT DISTINCT code FROM (SELECT unnest(issue_codes) AS code FROM candidates) WHERE code NOT IN ('EMBEDDED_CONTROL_TOKEN')")
def s04(spark, d):
    known = F.array(F.lit("EMBEDDED_CONTROL_TOKEN"))
    return table(spark, d, "candidates").select(F.explode(F.array_except("issue_codes", known)).alias("code")).distinct()


@query("s05_multiset_difference", "WITH a AS (SELECT path FROM candidates), b AS (SELECT path FROM rights_dispositions) SELECT path, 'left' AS side FROM (SELECT path FROM a EXCEPT ALL SELECT path FROM b) UNION ALL SELECT path, 'right' FROM (SELECT path FROM b EXCEPT ALL SELECT path FROM a)")
def s05(spark, d):
    return guards.set_difference(table(spark, d, "candidates").select("path"), table(spark, d, "rights_dispositions").select("path"))


@query("w01_first_occurrence", "SELECT id, path, line_no FROM (SELECT lower(trim(id)) AS id, path, line_no, row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY repository, path, line_no) AS k FROM candidates) WHERE k = 1")
def w01(spark, d):
    c = ids(spark, d, "candidates", "repository", "path", "line_no")
    return dedup.exact_dedup(c, F.col("id"), ["repository", "path", "line_no"], ["id", "path", "line_no"]).select("id", "path", "line_no")


@query("w02_ordinals", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY created_at, doc_id) - 1 AS ordinal FROM documents")
def w02(spark, d):
    return sampling.ordinals(table(spark, d, "documents").select("doc_id", "lang", "created_at"), "lang", ["created_at", "doc_id"]).select("doc_id", "ordinal")


@query("g03_family_ids", "SELECT id, 'family-' || substr(sha256(lower(trim(family))), 1, 24) AS family FROM families WHERE family IS NOT NULL")
def g03_ids(spark, d):
    return table(spark, d, "families").filter("family is not null").select("id", family_id(F.lower(F.trim("family"))).alias("family"))
