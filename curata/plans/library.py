"""Queries that run the library's sources, sinks, packers, validators and streams over the given tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from curata import sources, streaming
from curata.functions import quality as Q
from curata.functions.udfs import json_error
from curata.operators import evaluation, families, guards, messages, packing, retrieval, sampling, template
from curata.plans.registry import Registry
from curata.runtime import Stage, clean_id, scratch, table

QUERIES = query = Registry()
LINE = "string_split(text, chr(10))"


def docs(spark, d):
    return table(spark, d, "documents")


def _line(n: int):
    return F.coalesce(F.get(F.split("text", "\n"), F.lit(n)), F.lit(""))


def _folder(spark, name: str) -> str:
    return scratch(spark, f"{name}-{uuid.uuid4().hex}")


# ---- sources and sinks ------------------------------------------------------------------------------------------


@query("src01_json_lines", "SELECT doc_id, sha256(text) AS digest, 1000 AS x FROM documents".replace(", 1000 AS x", ""))
def src01(spark, d):
    """Documents written as JSON lines with sorted keys and read again by line."""
    at = _folder(spark, "lines")
    sources.write_json_lines(docs(spark, d).select("doc_id", "text"), at)
    got = sources.json_lines(spark, at).select(F.from_json("line", "doc_id long, text string").alias("r"))
    return got.select("r.doc_id", F.sha2("r.text", 256).alias("digest"))


@query("src02_line_numbers", "SELECT 1 AS first, count(*) AS last, count(*) AS n FROM documents")
def src02(spark, d):
    """Numbers of the lines of one file, whatever its splits."""
    at = _folder(spark, "lines")
    docs(spark, d).select(F.to_json(F.struct("doc_id")).alias("value")).coalesce(1).write.text(at)
    n = sources.json_lines(spark, at)
    return n.agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count_distinct("line_no").alias("n"))


@query("src03_json_errors", "SELECT CASE WHEN json_valid(content) THEN 'OK' ELSE 'INVALID_JSON' END AS status, count(*) AS n FROM messages WHERE left(content, 1) = '{' GROUP BY 1")
def src03(spark, d):
    m = table(spark, d, "messages").filter(F.startswith("content", F.lit("{")))
    return m.groupBy(F.coalesce(json_error("content"), F.lit("OK")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("src04_paired", "WITH a AS (SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0) SELECT CASE WHEN a.id IS NULL THEN 'RIGHT_ONLY' WHEN b.id IS NULL THEN 'LEFT_ONLY' ELSE 'BOTH' END AS side, count(*) AS n FROM a FULL JOIN b USING (id) GROUP BY 1")
def src04(spark, d):
    """Two files paired by key."""
    t = docs(spark, d).select(F.col("doc_id").alias("id"))
    both, one = sources.paired_lines(t.filter("id % 2 = 0"), t.filter("id % 3 = 0"))
    return both.select(F.lit("BOTH").alias("side")).union(one.select("rule")).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("src09_pinned_files", "SELECT rule, n FROM (VALUES ('CHANGED', 1), ('MISSING', 1), ('UNPINNED', 1)) v(rule, n)")
def src09(spark, d):
    """Three files, of whose pins one is wrong and one absent; a fourth pin has no file."""
    at = _folder(spark, "pins")
    for k in ("kept", "changed", "unpinned"):
        docs(spark, d).groupBy("lang").count().select(F.concat_ws(" ", F.lit(k), "lang").alias("value")).coalesce(1).write.text(f"{at}/{k}")
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).select(F.element_at(F.split("path", "/"), -2).alias("kind"), F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("sha256"))
    pins = b.filter("kind <> 'unpinned'").select("path", F.when(F.col("kind") == "changed", F.repeat(F.lit("0"), 64)).otherwise(F.col("sha256")).alias("sha256"))
    pins = Stage(pins.union(spark.createDataFrame([("absent.txt", "0" * 64)], "path string, sha256 string")), "pins")
    return guards.counts(sources.pinned_files(spark, at, pins.df)[1])


@query("src13_record_lookup", "WITH w AS (SELECT DISTINCT doc_id * 2 AS id FROM documents) SELECT CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'found' END AS side, count(*) AS n FROM w LEFT JOIN documents d ON d.doc_id = w.id GROUP BY 1")
def src13(spark, d):
    t = docs(spark, d).select(F.col("doc_id").alias("record_id"), "text")
    got, bad = sources.lookup_records(t, t.select((F.col("record_id") * 2).alias("record_id")))
    return got.select(F.lit("found").alias("side")).union(bad.select(F.lit("missing"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("snk01_publish", "SELECT doc_id, n_chars FROM documents")
def snk01(spark, d):
    """A dataset published under its fingerprint, opened again with it."""
    at = _folder(spark, "published")
    sources.publish(docs(spark, d).select("doc_id", "n_chars"), at, "f1")
    return sources.prepared(spark, at, "f1")


@query("snk03_release", "SELECT sha256(string_agg(domain || chr(10), '' ORDER BY domain)) AS digest FROM (SELECT DISTINCT domain FROM documents WHERE domain IS NOT NULL)")
def snk03(spark, d):
    """Digest of the bytes of a compressed release file; its lines are the domains."""
    t = docs(spark, d).filter("domain is not null").select("domain").distinct()
    digest = sources.gzip_lines(t, "domain", "domain", _folder(spark, "release") + "/release.gz")
    return spark.createDataFrame([(digest,)], "digest string")


@query("snk06_metrics", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def snk06(spark, d):
    """Metrics appended in two parts."""
    at = _folder(spark, "metrics")
    m = docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sources.append_metrics(m.filter("lang is null or lang < 'e'"), at)
    sources.append_metrics(m.filter("lang >= 'e'"), at)
    return sources.json_lines(spark, at).select(F.from_json("line", "lang string, n long").alias("r")).select("r.lang", "r.n")


@query("snk07_receipts", "WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT source, count(*) AS n FROM documents WHERE doc_id % 100 <> 0 GROUP BY 1) SELECT source, n, 'left' AS side FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) UNION ALL SELECT source, n, 'right' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)")
def snk07(spark, d):
    """Counts by source against a receipt that lacks every hundredth document."""
    n = lambda t: t.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sources.receipt_violations(n(docs(spark, d)), n(docs(spark, d).filter("doc_id % 100 <> 0")))


# ---- messages and records ---------------------------------------------------------------------------------------


@query("prj02_newlines", r"SELECT id, turn, sha256(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM messages WHERE content IS NOT NULL")
def prj02(spark, d):
    return table(spark, d, "messages").filter("content is not null").select("id", "turn", F.sha2(Q.normalize_newlines(F.col("content")), 256).alias("digest"))


@query("prj04_legacy_rows", f"SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'UNSUPPORTED_ROW_SCHEMA' END AS error, CASE doc_id % 4 WHEN 3 THEN NULL WHEN 2 THEN 'the task' || chr(10) || chr(10) || {LINE}[1] ELSE {LINE}[1] END AS first FROM documents")
def prj04(spark, d):
    """First lines as rows of four legacy shapes, brought into one."""
    q, a = _line(0), F.lit("an answer")
    turns = F.array(F.struct(F.lit("user").alias("role"), q.alias("content")), F.struct(F.lit("assistant").alias("role"), a.alias("content")))
    raw = (
        F.when(F.col("doc_id") % 4 == 0, F.to_json(F.struct(turns.alias("messages"))))
        .when(F.col("doc_id") % 4 == 1, F.to_json(F.struct(q.alias("prompt"), a.alias("completion"))))
        .when(F.col("doc_id") % 4 == 2, F.to_json(F.struct(F.lit("the task").alias("instruction"), q.alias("input"), a.alias("output"))))
        .otherwise(F.to_json(F.struct(q.alias("prompt"))))
    )
    r = docs(spark, d).select("doc_id", messages.canonical_row(raw).alias("r"))
    return r.select("doc_id", "r.error", F.get("r.messages", F.lit(0))["content"].alias("first"))


@query("prj06_labelled", f"SELECT doc_id, 2 AS n_messages, sha256(trim({LINE}[1], ' ')) AS asked FROM documents WHERE trim({LINE}[1], ' ') <> ''")
def prj06(spark, d):
    m = messages.labelled_messages(F.concat(F.lit("User: "), _line(0), F.lit("\nAssistant: fine")))
    t = docs(spark, d).filter(F.trim(_line(0)) != "").select("doc_id", m.alias("m"))
    return t.select("doc_id", F.size("m").alias("n_messages"), F.sha2(F.element_at("m", 1)["content"], 256).alias("asked"))


@query("prj07_record_violations", "SELECT rule, count(*) AS n FROM (SELECT 'UNKNOWN_FIELDS' AS rule FROM documents WHERE domain IS NOT NULL UNION ALL SELECT 'BLANK_TEXT' FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'UNKNOWN_KIND' FROM documents WHERE doc_id % 5 = 0) GROUP BY 1")
def prj07(spark, d):
    """Documents as records: domains are no field of theirs, every seventh text blank, every fifth kind unknown."""
    text = F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("text"))
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "document_family", text.alias("text"), "domain"))
    r = docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("id"), F.lit("pretrain").alias("kind"), line.alias("line"))
    odd = docs(spark, d).filter("doc_id % 5 = 0").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.lit("other").alias("kind"), F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text")).alias("line"))
    return messages.record_violations(r.union(odd)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("prj15_active_units", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def prj15(spark, d):
    """Documents as units of files: inactive, of a file that is not current, or of another version by rule."""
    t = docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("content_hash"))
    units = t.select("doc_id", "path", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.substring("content_hash", 1, 20)).alias("version"), (F.col("doc_id") % 3 != 0).alias("active"))
    files = t.select("path", F.when(F.col("doc_id") % 5 == 0, "gone").otherwise("current").alias("status"), "content_hash")
    return sources.active_units(units, files).select("doc_id")


@query("prj18_metadata", "SELECT rule, n FROM (SELECT 'DUPLICATE_KEY' AS rule, count(*) AS n FROM (SELECT id FROM candidates GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'FIELDS', 2) WHERE n > 0")
def prj18(spark, d):
    """Metadata of candidates: one column missing, one unknown, ids delivered again."""
    t = table(spark, d, "candidates").select("id", "lang", "path")
    return guards.counts(guards.metadata_violations(t, "id", ["id", "lang", "licence"]))


@query("prj19_declared", "SELECT rule, n FROM (SELECT 'DECLARATIONS_MISSING' AS rule, count(*) FILTER (WHERE doc_id % 10 = 0) AS n FROM documents UNION ALL SELECT 'DECLARATION_UNKNOWN', count(*) FILTER (WHERE doc_id % 4 = 0) FROM documents)")
def prj19(spark, d):
    value = F.when(F.col("doc_id") % 4 == 0, "maybe").otherwise("yes")
    m = F.when(F.col("doc_id") % 10 == 0, F.create_map(F.lit("checked"), value)).otherwise(F.create_map(F.lit("checked"), value, F.lit("read"), F.lit("yes")))
    return guards.counts(guards.declared_violations(docs(spark, d).withColumn("declared", m), "doc_id", "declared", ["checked", "read"], ["yes", "no"]))


@query("prj20_spans", "SELECT rule, n FROM (SELECT 'SPAN_BOUNDS' AS rule, count(*) FILTER (WHERE doc_id % 6 = 0 OR n_chars <= 10) AS n FROM documents UNION ALL SELECT 'SPAN_OUTSIDE_PARENT', count(*) FILTER (WHERE doc_id % 9 = 0) FROM documents)")
def prj20(spark, d):
    t = docs(spark, d).select(F.col("doc_id").alias("id"), F.lit(10).cast("long").alias("start"), (F.col("n_chars") + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0)).alias("stop"), F.col("n_chars").alias("length"), F.when(F.col("doc_id") % 9 == 0, 11).otherwise(0).alias("within_start"), (F.col("n_chars") + 1).alias("within_stop"))
    return guards.counts(guards.span_violations(t))


@query("prj21_regions", "SELECT rule, n FROM (SELECT 'NOT_COVERED' AS rule, count(*) FILTER (WHERE doc_id % 11 = 0) AS n FROM documents UNION ALL SELECT 'NOT_SELECTED', count(*) FILTER (WHERE doc_id % 13 = 0 AND doc_id % 11 <> 0) FROM documents UNION ALL SELECT 'DIGEST_CONFLICT', count(*) FROM (SELECT document_family FROM documents WHERE document_family IS NOT NULL AND doc_id % 11 <> 0 GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1))")
def prj21(spark, d):
    """Documents as regions of their source; a family stands for a path."""
    t = docs(spark, d).select("doc_id", F.coalesce("source", F.lit("-")).alias("source"), F.col("doc_id").cast("string").alias("region"), F.lit(0).alias("start"), F.col("n_chars").alias("stop"), F.col("n_chars").alias("length"), F.col("document_family").alias("path"), F.sha2("text", 256).alias("sha256"))
    return guards.counts(guards.region_violations(t.filter("doc_id % 11 <> 0"), t.filter("doc_id % 13 <> 0 or doc_id % 11 = 0")))


@query("prj28_pins", "SELECT rule, n FROM (SELECT 'PIN_CHANGED' AS rule, count(*) FILTER (WHERE doc_id % 8 = 0) AS n FROM documents UNION ALL SELECT 'NUMBERING', (min(doc_id) <> 1 OR max(doc_id) <> count(*) OR count(DISTINCT doc_id) <> count(*))::INT FROM documents) WHERE n > 0")
def prj28(spark, d):
    t = docs(spark, d).select("doc_id", "source", "lang")
    have = F.sha2(F.to_json(F.struct("lang", "source")), 256)
    return guards.counts(guards.pin_violations(t.withColumn("pin", F.when(F.col("doc_id") % 8 == 0, "changed").otherwise(have)), "doc_id", ["source", "lang"], "pin", "doc_id"))


@query("s07_cycles", "SELECT doc_id AS id FROM documents WHERE (doc_id // 10) % 2 = 0 AND (doc_id // 10) IN (SELECT doc_id // 10 FROM documents GROUP BY 1 HAVING count(*) = 10)")
def s07(spark, d):
    """Chains of ten documents each; those of even tens come back to their beginning."""
    t = docs(spark, d).select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 10).alias("ten"))
    to = F.when(F.col("id") % 10 < 9, F.col("id") + 1).when(F.col("ten") % 2 == 0, F.col("id") - 9)
    return guards.duplicate_cycles(t.select("id", to.alias("duplicate_of")))


@query("v14_staging", "WITH c AS (SELECT doc_id, 'repo-' || substr(sha256(text), 1, 24) AS id, sha256(text) AS h FROM documents), p AS (SELECT DISTINCT id FROM c WHERE doc_id % 10 <> 0), g AS (SELECT h FROM c GROUP BY h HAVING count(*) > 1) SELECT rule, n FROM (SELECT 'NO_PROVENANCE' AS rule, count(DISTINCT id) AS n FROM c WHERE id NOT IN (SELECT id FROM p) UNION ALL SELECT 'DUPLICATE_HASH', count(*) FROM g UNION ALL SELECT 'DUPLICATE_ID', count(*) FROM g UNION ALL SELECT 'ISSUES_AND_STATUS', count(*) FILTER (WHERE doc_id % 3 = 0 AND doc_id % 10 <> 0) FROM c) WHERE n > 0")
def v14(spark, d):
    """Documents as staged candidates named by their digest; some without provenance, some with issues but no status."""
    c = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("hash")).withColumn("id", F.concat(F.lit("repo-"), F.substring("hash", 1, 24)))
    p = c.filter("doc_id % 10 <> 0").select("id", F.lit("needs_review").alias("review_status"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("CODE"))).otherwise(F.array().cast("array<string>")).alias("issue_codes"))
    return guards.counts(guards.staging_violations(c.select("id", "hash", F.lit("").alias("text")), p))


@query("v15_preparation", "WITH c AS (SELECT DISTINCT lower(trim(id)) AS k FROM candidates WHERE id IS NOT NULL), m AS (SELECT DISTINCT lower(trim(id)) AS k FROM messages WHERE id IS NOT NULL), r AS (SELECT DISTINCT lower(trim(id)) AS k FROM review_completion WHERE id IS NOT NULL), a AS (SELECT k FROM c UNION ALL SELECT k FROM m UNION ALL SELECT k FROM r) SELECT rule, n FROM (SELECT 'NOT_IN_ALL' AS rule, count(*) AS n FROM (SELECT k FROM a GROUP BY k HAVING count(*) < 3) UNION ALL SELECT 'TOTAL_DIFFERS', 1) WHERE n > 0")
def v15(spark, d):
    """Candidates, messages and reviews against each other and against totals, of which one is wrong."""
    t = {n: table(spark, d, n).select(clean_id(F.col("id")).alias("id")) for n in ("candidates", "messages", "review_completion")}
    n = {k: x.filter("id is not null").agg(F.count_distinct("id").alias("n")).select(F.lit(k).alias("name"), (F.col("n") + F.lit(int(k == "messages"))).alias("n")) for k, x in t.items()}
    return guards.counts(guards.preparation_violations(t, guards.union(list(n.values()))))


@query("v08_sealed_sets", "SELECT rule, n FROM (SELECT 'NO_ANSWER' AS rule, count(*) FILTER (WHERE k % 3 = 0) AS n FROM (SELECT row_number() OVER (ORDER BY task_id) AS k FROM eval_tasks) UNION ALL SELECT 'UNKNOWN_TASK', 1 UNION ALL SELECT 'REPEATED_ANSWER', count(*) FILTER (WHERE k % 3 = 1) FROM (SELECT row_number() OVER (ORDER BY task_id) AS k FROM eval_tasks))")
def v08(spark, d):
    """Answers that lack every third task, give every other third twice and one task that is unknown."""
    from pyspark.sql.window import Window

    t = table(spark, d, "eval_tasks").select("task_id", F.row_number().over(Window.orderBy("task_id")).alias("k"))  # a fixed table of some hundred tasks
    a = t.filter("k % 3 <> 0").select("task_id").union(t.filter("k % 3 = 1").select("task_id")).union(spark.createDataFrame([("unknown",)], "task_id string"))
    return evaluation.sealed_evaluation(t.select("task_id"), a)


@query("j18_audited_together", "SELECT 'FINGERPRINTS_DIFFER' AS rule, 1 AS n UNION ALL SELECT 'NO_FINGERPRINT', count(*) FROM split_targets WHERE split = 'test'")
def j18(spark, d):
    s = table(spark, d, "split_targets").select("split", F.lit("sft").alias("stage"), F.when(F.col("split") == "test", F.lit(None)).otherwise(F.sha2("split", 256)).alias("manifest_fingerprint"))
    return guards.counts(guards.audited_together(s))


# ---- packing and templates --------------------------------------------------------------------------------------


def _turn(role: str, content):
    none = F.lit(None).cast("string")
    return F.struct(F.lit(role).alias("role"), content.alias("content"), none.alias("name"), none.alias("tool_call_id"), none.alias("tool_calls"))


@query("k09_preference", f"SELECT doc_id, strlen(coalesce({LINE}[1], '')) + 2 AS chosen, 6 AS rejected FROM documents")
def k09(spark, d):
    """Targets of chosen and rejected answers: their bytes, the end of the turn and the end of the sequence."""
    t = docs(spark, d).select("doc_id", F.array(_turn("user", F.lit("Why?"))).alias("p"), _line(0).alias("chosen"), F.lit("Noòo").substr(1, 3).alias("rejected"))
    p = packing.pack_preference(t, "p", 8192)
    return p.select("doc_id", F.col("chosen_n_targets").cast("long").alias("chosen"), F.col("rejected_n_targets").cast("long").alias("rejected"))


@query("k10_rl_prompts", f"SELECT doc_id, strlen(coalesce({LINE}[1], '')) + 4 AS n_tokens FROM documents")
def k10(spark, d):
    t = docs(spark, d).select("doc_id", F.array(_turn("user", _line(0))).alias("p"))
    p = packing.pack_rl(t, "p", 8192)
    return p.select("doc_id", F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).cast("long").alias("n_tokens"))


@query("k12_chat_template", "WITH m AS (SELECT DISTINCT lower(trim(id)) AS id, turn, lower(trim(role)) AS role, content FROM messages WHERE id IS NOT NULL), x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn, role, content) - 1 AS i, first_value(role) OVER (PARTITION BY id ORDER BY turn, role, content) AS r0, count(*) OVER (PARTITION BY id) AS n FROM m), "
    r"c AS (SELECT id, i, n, role, CASE WHEN NOT coalesce(regexp_matches(content, '[^\s\pZ]'), false) THEN 'INVALID_MESSAGE' WHEN role IS DISTINCT FROM (CASE WHEN r0 = 'system' THEN (CASE WHEN i = 0 THEN 'system' WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END) WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) THEN 'INVALID_TURN_ORDER' "
    "WHEN contains(content, '<|') OR contains(content, '<think>') OR contains(content, '</think>') THEN 'EMBEDDED_CONTROL' END AS code FROM x), f AS (SELECT id, min_by(code, i) FILTER (WHERE code IS NOT NULL) AS code, max_by(role, i) AS last FROM c GROUP BY id) "
    "SELECT coalesce(code, CASE WHEN last <> 'assistant' THEN 'MISSING_ANSWER' END, 'ENCODED') AS status, count(*) AS n FROM f GROUP BY 1")
def k12(spark, d):
    """Conversations by what becomes of them under the template; those that only the tokens refuse count as encoded here."""
    path = os.environ.get("CURATA_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
    c = messages.assemble(table(spark, d, "messages")).select(F.transform("msgs", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("msgs"))
    e = c.select(template.chat_template(F.col("msgs"), path).alias("e"))
    own = F.col("e.code").isin("INVALID_MESSAGE", "INVALID_TURN_ORDER", "EMBEDDED_CONTROL", "MISSING_ANSWER")
    return e.groupBy(F.when(own, F.col("e.code")).otherwise("ENCODED").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("k14_collate", "SELECT doc_id // 32 AS batch, count(*) AS n, sum(strlen(lang))::BIGINT AS n_bytes FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def k14(spark, d):
    t = docs(spark, d).filter("lang is not null").select("doc_id", packing.byte_tokens(F.col("lang")).alias("t"))
    b = packing.collate(t, F.floor(F.col("doc_id") / 32), "t", "doc_id")
    return b.select("batch", F.size("rows").cast("long").alias("n"), F.aggregate("rows", F.lit(0), lambda a, x: a + F.size(x)).cast("long").alias("n_bytes"))


@query("k16_right_pad", "SELECT doc_id, max(strlen(lang)) OVER (PARTITION BY doc_id // 32) AS n FROM documents WHERE lang IS NOT NULL")
def k16(spark, d):
    t = docs(spark, d).filter("lang is not null").select("doc_id", F.floor(F.col("doc_id") / 32).alias("b"), packing.byte_tokens(F.col("lang")).alias("t"))
    return packing.right_pad(t, "t", 0, "b").select("doc_id", F.size("t").cast("long").alias("n"))


@query("k17_completion", f"SELECT doc_id, strlen(coalesce({LINE}[1], '')) + 4 AS n_tokens, 4 AS n_targets FROM documents")
def k17(spark, d):
    t = docs(spark, d).select("doc_id", packing.byte_tokens(_line(0)).alias("p"), packing.byte_tokens(F.lit("Yes.")).alias("c"))
    p = packing.completion_batch(t, "p", "c", 8192)
    return p.select("doc_id", F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).cast("long").alias("n_tokens"), F.col("n_targets").cast("long").alias("n_targets"))


# ---- quality, retrieval, families, evaluation -------------------------------------------------------------------


@query("q23_context_checks", "SELECT code, n FROM (SELECT 'INCOMPLETE_PROBLEM' AS code, count(*) FILTER (WHERE doc_id % 4 = 0) AS n FROM documents UNION ALL SELECT 'LOW_OCR_CONFIDENCE', count(*) FILTER (WHERE doc_id % 3 = 0) FROM documents UNION ALL SELECT 'PROBLEM_NOT_ESTABLISHED', count(*) FILTER (WHERE doc_id % 5 = 0 AND doc_id % 4 = 0 AND NOT regexp_matches(text, '(?im)^\\s*(?:problem|question|exercise)\\b')) FROM documents) WHERE n > 0".replace("\\\\", "\\"))
def q23(spark, d):
    """Detectors that read what is known of a text besides its words (Q23, Q24 and Q27)."""
    i = F.col("doc_id")
    ctx = {"expected_problem": i % 5 == 0, "problem_complete": i % 4 != 0, "ocr_confidence": F.when(i % 3 == 0, 0.5).otherwise(0.95)}
    t = Q.inspect(docs(spark, d), context=ctx, looking=False)
    x = t.select(F.explode("checks").alias("c")).groupBy("c.code").agg(F.count(F.lit(1)).alias("n"))
    return x.filter(F.col("code").isin("INCOMPLETE_PROBLEM", "LOW_OCR_CONFIDENCE", "PROBLEM_NOT_ESTABLISHED"))


@query("r04_verified_results", "SELECT rule, n FROM (SELECT 'SLICE_CHANGED' AS rule, count(*) FILTER (WHERE doc_id % 5 = 0 AND doc_id % 20 = 0) AS n FROM documents UNION ALL SELECT 'NOT_PINNED', count(*) FILTER (WHERE doc_id % 5 = 0 AND doc_id % 7 = 0 AND doc_id % 20 <> 0) FROM documents UNION ALL SELECT 'UNKNOWN_CHUNK', 1 UNION ALL SELECT 'SEALED_FAMILY', count(*) FILTER (WHERE doc_id % 5 = 0 AND document_family = (SELECT min(document_family) FROM documents)) FROM documents) WHERE n > 0")
def r04(spark, d):
    """Every fifth document and one that does not exist, as results of a search, verified again."""
    t = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("document_family").alias("family_id"), "text")
    hits = t.filter("id % 5 = 0").select("id").union(spark.createDataFrame([(-1,)], "id long"))
    pins = t.filter("id % 7 <> 0 or id % 20 = 0").select("id", F.when(F.col("id") % 20 == 0, "changed").otherwise(F.sha2("text", 256)).alias("slice_sha256"))
    return guards.counts(retrieval.result_violations(hits, t, pins, t.agg(F.min("family_id").alias("family_id"))))


@query("n03_result_rates", "WITH h AS (SELECT doc_id // 10 AS q, sha256(text) AS h FROM documents WHERE (doc_id // 10) % 4 <> 0), p AS (SELECT q, count(*) AS n, count(DISTINCT h) AS d FROM h GROUP BY q), a AS (SELECT DISTINCT doc_id // 10 AS q FROM documents) SELECT count(*) AS n_queries, round(avg((n IS NULL)::INT), 6) AS empty_rate, round(sum(n - d) / sum(n), 6) AS duplicate_rate FROM a LEFT JOIN p USING (q)")
def n03_rates(spark, d):
    """Ten documents each as hits of a query; every fourth query has none."""
    t = docs(spark, d).select(F.floor(F.col("doc_id") / 10).alias("query_id"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    return retrieval.result_rates(t.filter("query_id % 4 <> 0").select("query_id", "id"), t, t.select("id", "digest"))


@query("g02_assembled", "WITH s AS (SELECT DISTINCT doc_id::VARCHAR AS a, 'source ' || document_family AS b, 'SOURCE' AS kind FROM documents WHERE document_family IS NOT NULL), x AS (SELECT doc_id, sha256(text) AS h FROM documents), g AS (SELECT h, min(doc_id) AS m FROM x GROUP BY h HAVING count(*) > 1), t AS (SELECT DISTINCT least(m::VARCHAR, doc_id::VARCHAR) AS a, greatest(m::VARCHAR, doc_id::VARCHAR) AS b, 'TEXT' AS kind FROM x JOIN g USING (h) WHERE doc_id <> m), "
    "e AS (SELECT DISTINCT least(lower(trim(anchor)), lower(trim(other))) AS a, greatest(lower(trim(anchor)), lower(trim(other))) AS b, 'LEXICAL' AS kind FROM edges WHERE trim(anchor) <> '' AND trim(other) <> '' AND lower(trim(anchor)) <> lower(trim(other))) SELECT kind, count(*) AS n FROM (SELECT * FROM s UNION ALL SELECT * FROM t UNION ALL SELECT * FROM e) GROUP BY 1")
def g02(spark, d):
    """All kinds of edges as one table: documents and their family, equal texts, pairwise matches."""
    t = docs(spark, d).select("doc_id", "document_family", F.sha2("text", 256).alias("h"), F.lit(1).alias("n"), F.lit(True).alias("always"))
    e = table(spark, d, "edges").select(clean_id(F.col("anchor")).alias("a"), clean_id(F.col("other")).alias("b"))
    whole = families.assembled(("SOURCE", families.source_edges(t, "doc_id", "document_family")), ("TEXT", families.exact_text_edges(t, "doc_id", "h", "n", "always", 1)), ("LEXICAL", e))
    return whole.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("n05_rotation", "WITH f AS (SELECT task_id, category, sha256('rotation' || task_id) AS h, row_number() OVER (PARTITION BY category, source_family ORDER BY sha256('rotation' || task_id), task_id) AS k FROM eval_tasks), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY h, task_id) AS r FROM f WHERE k <= 2) SELECT category, task_id, CASE WHEN r <= 7 THEN 'explain' WHEN r <= 14 THEN 'derive' ELSE 'decline' END AS mode FROM r WHERE r <= 20")
def n05(spark, d):
    return sampling.rotation(table(spark, d, "eval_tasks"), "category", "task_id", {"explain": 7, "derive": 7, "decline": 6}, "source_family")


@query("n06_gate", "WITH b AS (SELECT domain, avg(n_chars) / 10 AS p, max(n_chars) AS l FROM documents WHERE doc_id % 2 = 0 AND domain IS NOT NULL GROUP BY 1), n AS (SELECT domain, avg(n_chars) / 10 AS p, max(n_chars) AS l FROM documents WHERE doc_id % 2 = 1 AND domain IS NOT NULL GROUP BY 1) SELECT domain, round(n.p - b.p, 6) AS change, CASE WHEN b.p - n.p >= 5 OR n.l > 1.25 * b.l OR n.p IS NULL OR b.p IS NULL THEN 'HOLD' ELSE 'PASS' END AS decision FROM b FULL JOIN n USING (domain)")
def n06(spark, d):
    """Lengths of even and odd documents as the points and tails of two arms."""
    t = docs(spark, d).filter("domain is not null")
    arm = lambda k: t.filter(F.col("doc_id") % 2 == k).groupBy("domain").agg((F.avg("n_chars") / 10).alias("points"), F.lit(0).alias("critical"), F.max("n_chars").alias("p95"))
    return evaluation.gate(arm(0), arm(1))


# ---- streams ----------------------------------------------------------------------------------------------------


@query("x01_stream_scan", "SELECT CASE WHEN domain IS NULL THEN 'failed' ELSE 'rows' END AS part, count(*) AS n FROM documents GROUP BY 1")
def x01(spark, d):
    """Documents scanned as a stream of files; those without a domain go to the dead letters. Run twice: the second finds nothing new."""
    s = Stage(docs(spark, d).select("doc_id", "domain"), "stream")
    at, state = _folder(spark, "scanned"), _folder(spark, "state")
    for _ in range(2):
        streaming.scan(spark, s.path, s.df.schema, at, lambda b: b, state, {"version": 1}, F.when(F.col("domain").isNull(), "NO_DOMAIN")).awaitTermination()
    rows = spark.read.schema("doc_id long, domain string").parquet(f"{at}/rows").select(F.lit("rows").alias("part"))
    failed = spark.read.schema("doc_id long, domain string, reason string").parquet(f"{at}/failed").select(F.lit("failed"))
    return rows.union(failed).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("x05_distinct_stream", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def x05(spark, d):
    """Events delivered twice, each kept once, within a watermark longer than the table."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    s = Stage(e.union(e), "stream")
    at, state = _folder(spark, "distinct"), _folder(spark, "state")
    q = streaming.distinct_stream(spark.readStream.schema(s.df.schema).parquet(s.path), ["event_id"], "ts", "36500 days")
    q.writeStream.format("parquet").option("path", at).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(s.df.schema).parquet(at).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
