"""Queries over held-out tasks and answers, and over manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.operators import evaluation, guards
from curata.plans.registry import Registry
from curata.runtime import table

QUERIES = query = Registry()

# Answers made from the tasks by rule: right, a little off, in another action, without assumptions, or missing.
KIND = "CAST('0x' || substr(sha256(task_id), 1, 4) AS INT) % 5"


def tasks(spark, d):
    return table(spark, d, "eval_tasks")


def answers(spark, d):
    k = F.conv(F.substring(F.sha2("task_id", 256), 1, 4), 16, 10).cast("int") % 5
    t = tasks(spark, d).withColumn("k", k).filter("k < 4")
    action = F.create_map(*[F.lit(x) for kv in evaluation.ACTIONS.items() for x in kv])
    status = F.when(F.col("k") == 2, "abstained").otherwise(F.element_at(action, F.col("expected_action")))
    value = F.when(F.col("k") == 1, F.col("reference_value") * 1.5).otherwise(F.col("reference_value"))
    return t.select("task_id", status.alias("status"), value.alias("value"), F.lit("m").alias("unit"), F.when(F.col("k") == 3, F.array().cast("array<string>")).otherwise(F.col("required_assumptions")).alias("assumptions"))


def scored(spark, d):
    return evaluation.score(tasks(spark, d).withColumn("expected_unit", F.lit("m")), answers(spark, d))


SCORE_SQL = (
    "WITH t AS (SELECT *, ('0x' || substr(sha256(task_id), 1, 4))::INT % 5 AS k FROM eval_tasks), "
    "a AS (SELECT *, CASE WHEN k = 4 THEN NULL WHEN k = 2 THEN 'abstained' WHEN expected_action = 'answer' THEN 'answered' WHEN expected_action = 'abstain' THEN 'abstained' ELSE 'out_of_domain' END AS st, "
    "CASE expected_action WHEN 'answer' THEN 'answered' WHEN 'abstain' THEN 'abstained' ELSE 'out_of_domain' END AS want FROM t), "
    "s AS (SELECT task_id, category, expected_action, st IS NOT NULL AS format_valid, coalesce(st = 'answered', false) AS answered, "
    "CASE WHEN st IS NULL THEN 'format' WHEN st <> want THEN 'action' WHEN want <> 'answered' THEN 'correct refusal' WHEN reference_value IS NULL THEN 'unit' WHEN k = 3 AND len(required_assumptions) > 0 THEN 'assumptions' "
    "WHEN k = 1 AND 0.5 * abs(reference_value) > greatest(tolerance.absolute, tolerance.relative * abs(reference_value)) THEN 'tolerance' ELSE 'correct' END AS reason FROM a) "
)


@query("v01_scores", SCORE_SQL + "SELECT reason, count(*) AS n FROM s GROUP BY 1")
def v01(spark, d):
    return scored(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("v02_rewards", SCORE_SQL + "SELECT task_id, (reason LIKE 'correct%')::DOUBLE AS reward FROM s")
def v02(spark, d):
    return evaluation.reward(scored(spark, d))


@query(
    "v03_report",
    SCORE_SQL + ", c AS (SELECT *, reason LIKE 'correct%' AS ok, expected_action = 'answer' AS able FROM s) SELECT count(*) AS task_count, count(*) FILTER (WHERE ok) AS correct_count, count(*) FILTER (WHERE able) AS answerable_count, count(*) FILTER (WHERE able AND answered) AS answered_count, count(*) FILTER (WHERE format_valid) AS format_valid_count, "
    "round(count(*) FILTER (WHERE ok) / count(*), 6) AS overall_accuracy, round(count(*) FILTER (WHERE able AND answered) / nullif(count(*) FILTER (WHERE able), 0), 6) AS coverage, round(count(*) FILTER (WHERE able AND answered AND ok) / nullif(count(*) FILTER (WHERE able AND answered), 0), 6) AS selective_accuracy, round(count(*) FILTER (WHERE able AND answered AND ok) / nullif(count(*) FILTER (WHERE able), 0), 6) AS answerable_accuracy, round(count(*) FILTER (WHERE NOT able AND ok) / nullif(count(*) FILTER (WHERE NOT able), 0), 6) AS refusal_accuracy FROM c",
)
def v03(spark, d):
    return evaluation.report(scored(spark, d))


@query("a22_by_category", SCORE_SQL + "SELECT category, count(*) AS total, count(*) FILTER (WHERE reason LIKE 'correct%') AS correct, round(avg((reason LIKE 'correct%')::INT), 6) AS accuracy FROM s GROUP BY 1")
def a22(spark, d):
    return evaluation.by_category(scored(spark, d))


@query("n01_macro_micro", SCORE_SQL + ", c AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE reason LIKE 'correct%') AS k FROM s GROUP BY 1) SELECT round(avg(k / n), 6) AS macro, round(sum(k) / sum(n), 6) AS micro FROM c")
def n01(spark, d):
    return evaluation.macro_micro(scored(spark, d))


@query("n02_paired", SCORE_SQL + ", y AS (SELECT reason LIKE 'correct%' AS x, ('0x' || substr(sha256(task_id), 5, 2))::INT % 3 <> 0 AS y FROM s) SELECT count(*) FILTER (WHERE x AND NOT y) AS wins, count(*) FILTER (WHERE y AND NOT x) AS losses, count(*) FILTER (WHERE x = y) AS ties FROM y")
def n02(spark, d):
    """The arm against one that is right by a digest of the task."""
    s = scored(spark, d)
    return evaluation.paired(s, s.withColumn("correct", F.conv(F.substring(F.sha2("task_id", 256), 5, 2), 16, 10).cast("int") % 3 != 0))


@query("prj16_task_violations", "SELECT 'NO_REFERENCE' AS rule, count(*) AS n FROM eval_tasks WHERE expected_action = 'answer' AND (reference_value IS NULL OR isnan(reference_value)) UNION ALL SELECT 'DUPLICATE_TASK', count(*) FROM (SELECT task_id FROM eval_tasks GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'UNKNOWN_ACTION', count(*) FROM eval_tasks WHERE expected_action NOT IN ('answer', 'abstain', 'out_of_domain') OR expected_action IS NULL")
def prj16(spark, d):
    rules = ["NO_REFERENCE", "DUPLICATE_TASK", "UNKNOWN_ACTION"]
    return guards.counts(evaluation.task_violations(tasks(spark, d)).filter(F.col("rule").isin(rules)), rules)


@query("prj17_answer_errors", f"SELECT CASE {KIND} WHEN 0 THEN 'OK' WHEN 1 THEN 'ANSWER_KEYS' WHEN 2 THEN 'UNKNOWN_STATUS' WHEN 3 THEN 'BLANK_RESPONSE' ELSE 'NOT_OBJECT' END AS error, count(*) AS n FROM eval_tasks GROUP BY 1")
def prj17(spark, d):
    """Answers in JSON, by rule right, without a key, of an unknown status, with a blank response, or no object."""
    k = F.conv(F.substring(F.sha2("task_id", 256), 1, 4), 16, 10).cast("int") % 5
    one = lambda *fields: F.to_json(F.struct("task_id", *fields))
    text, status, value = F.lit("text").alias("response"), F.lit("answered").alias("status"), F.coalesce("reference_value", F.lit(0.0)).alias("value")
    rest = [F.lit("m").alias("unit"), F.col("required_assumptions").alias("assumptions")]
    js = (
        F.when(k == 0, one(status, text, value, *rest)).when(k == 1, one(status, text, value, rest[1])).when(k == 2, one(F.lit("maybe").alias("status"), text, value, *rest))
        .when(k == 3, one(status, F.lit(" ").alias("response"), value, *rest)).otherwise(F.lit("[1, 2]"))
    )
    return tasks(spark, d).groupBy(F.coalesce(evaluation.answer_error(js), F.lit("OK")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("j11_missing_answers", "SELECT task_id FROM (SELECT *, ('0x' || substr(sha256(task_id), 1, 4))::INT % 5 AS k FROM eval_tasks) WHERE k = 4")
def j11(spark, d):
    return guards.one_to_one(tasks(spark, d), answers(spark, d), "task_id", ("MISSING", "UNKNOWN")).filter("rule = 'MISSING'").select(F.col("entity").alias("task_id"))


@query("v05_overlap", "SELECT 'SHARED_FAMILY' AS rule, d.doc_id::VARCHAR AS entity FROM documents d WHERE document_family IN (SELECT document_family FROM documents WHERE lower(trim(source)) = 'safety_cards')")
def v05(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("document_family").alias("family"), F.lower(F.trim("source")).alias("source"))
    return guards.contamination(t, t.filter("source = 'safety_cards'"), ["family"]).select("rule", "entity")


@query("v07_sealed_grades", "SELECT task_id AS id, ('0x' || substr(sha256(task_id), 1, 4))::INT % 5 IN (0, 2, 3) AS pass FROM eval_tasks WHERE reference_value IS NOT NULL AND reference_value <> 0")
def v07(spark, d):
    k = F.conv(F.substring(F.sha2("task_id", 256), 1, 4), 16, 10).cast("int") % 5
    t = tasks(spark, d).filter("reference_value is not null and reference_value <> 0").withColumn("k", k)
    e = t.select(F.col("task_id").alias("id"), F.lit("x").alias("field"), F.col("reference_value").alias("value"), F.lit("m").alias("unit"), F.lit(1e-6).alias("rtol"), F.lit(0.0).alias("atol"))
    r = t.filter("k < 4").select(F.col("task_id").alias("id"), F.lit("x").alias("field"), F.when(F.col("k") == 1, F.col("reference_value") * 1.01).otherwise(F.col("reference_value")).alias("value"), F.lit("m").alias("unit"))
    return evaluation.grade_fields(e, r).select("id", "pass")


@query("prj08_source_violations", "SELECT rule, n FROM (SELECT 'UNKNOWN_SPLIT' AS rule, count(*) FILTER (WHERE doc_id % 3 = 0) AS n FROM documents UNION ALL SELECT 'UNKNOWN_DOMAIN', count(*) FILTER (WHERE domain IS NULL OR domain NOT IN (" + ", ".join(f"'{x}'" for x in guards.DOMAINS) + ")) FROM documents UNION ALL SELECT 'RIGHTS_NOT_APPROVED', count(*) FILTER (WHERE doc_id % 4 = 0) FROM documents UNION ALL SELECT 'BAD_DIGEST', count(*) FILTER (WHERE doc_id % 5 = 0) FROM documents UNION ALL SELECT 'BLANK_HOLDER', count(*) FILTER (WHERE document_family IS NULL) FROM documents UNION ALL SELECT 'UNKNOWN_KIND', 0)")
def prj08(spark, d):
    """Documents as rows of a manifest, each rule broken by some."""
    i = F.col("doc_id")
    rights = F.struct((i % 4 != 0).alias("approved"), F.lit("owned").alias("basis"), F.col("document_family").alias("holder"))
    s = table(spark, d, "documents").select(i.cast("string").alias("source_id"), F.when(i % 3 == 0, "holdout").otherwise("train").alias("split"), F.lit("sft").alias("kind"), "domain", F.lit("made").alias("provenance"), F.lit("own").alias("license"), rights.alias("rights"), F.when(i % 5 == 0, F.upper(F.sha2("text", 256))).otherwise(F.sha2("text", 256)).alias("sha256"))
    return guards.counts(guards.source_violations(s), ["UNKNOWN_SPLIT", "UNKNOWN_DOMAIN", "RIGHTS_NOT_APPROVED", "BAD_DIGEST", "BLANK_HOLDER", "UNKNOWN_KIND"])
