"""Tasks, answers, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.identity import blank
from curata.operators.guards import rule, union
from curata.operators.tools import convert, is_close, unit_of

ACTIONS = {"answer": "answered", "abstain": "abstained", "out_of_domain": "out_of_domain"}
ANSWER_KEYS = {"answered": ["assumptions", "response", "status", "task_id", "unit", "value"], "abstained": ["reason", "response", "status", "task_id"], "out_of_domain": ["reason", "response", "status", "task_id"]}


def task_violations(tasks: DataFrame) -> DataFrame:
    """Rules over ``(task_id, source_family, category, prompt, reference_value, expected_unit, tolerance, required_assumptions, expected_action)``."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    ans = F.col("expected_action") == "answer"
    fin = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    tol = [F.col("tolerance.absolute"), F.col("tolerance.relative")]
    req = F.col("required_assumptions")
    checks = {
        "BLANK_FIELD": blank(F.col("task_id")) | blank(F.col("source_family")) | blank(F.col("prompt")),
        "UNKNOWN_ACTION": no(F.col("expected_action").isin(list(ACTIONS))),
        "BAD_ASSUMPTIONS": no((F.size(F.array_distinct(req)) == F.size(req)) & ~F.exists(req, blank)),
        "BAD_TOLERANCE": no(fin(tol[0]) & fin(tol[1]) & (tol[0] >= 0) & (tol[1] >= 0)),
        "NO_REFERENCE": ans & ~fin(F.col("reference_value")),
        "REFUSAL_WITH_REFERENCE": ~ans & (F.col("reference_value").isNotNull() | F.col("expected_unit").isNotNull()),
        "REFUSAL_CATEGORY": ans & F.col("category").isin("out_of_domain", "insufficient_information"),
    }
    hit = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
    out = tasks.select(F.explode(hit).alias("rule"), F.col("task_id").alias("entity"), F.lit("").alias("detail"))
    return union([out, rule("DUPLICATE_TASK", tasks.groupBy("task_id").count().filter("count > 1"), F.col("task_id"))])


def answer_error(raw: Column) -> Column:
    """Why an answer's JSON has not exactly the keys of its status; null if it has."""
    status = F.get_json_object(raw, "$.status")
    want = F.create_map(*[x for k, v in ANSWER_KEYS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    need = F.try_element_at(want, status)
    keys = F.array_sort(F.json_object_keys(raw))
    return F.when(keys.isNull(), "NOT_OBJECT").when(need.isNull(), "UNKNOWN_STATUS").when(keys != need, "ANSWER_KEYS").when(blank(F.get_json_object(raw, "$.response")), "BLANK_RESPONSE")


def score(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """One row for each task with its answer's score; missing answers are wrong.

    ``tasks`` as in :func:`task_violations`; ``answers`` is ``(task_id, status,
    value, unit, assumptions)``. The first of format, action, unit and tolerance
    or assumptions that fails is the ``reason``.
    """
    a = answers.select("task_id", F.col("status").alias("a_status"), F.col("value").cast("double").alias("a_value"), F.col("unit").alias("a_unit"), F.col("assumptions").alias("a_assumptions"))
    j = tasks.join(a, "task_id", "left")
    j = convert(j, "a_value", "a_unit", "expected_unit").withColumnRenamed("code", "unit_code")
    exp = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    want = F.element_at(exp, F.col("expected_action"))
    allowed = F.greatest(F.col("tolerance.absolute"), F.col("tolerance.relative") * F.abs("reference_value"))
    j = j.withColumn("format_valid", F.coalesce(F.col("a_status").isin(list(ACTIONS.values())), F.lit(False)))
    j = j.withColumn("answered", F.col("format_valid") & (F.col("a_status") == "answered"))
    j = j.withColumn("assumptions_present", F.coalesce(F.col("answered") & (F.size(F.array_except("required_assumptions", F.coalesce("a_assumptions", F.array().cast("array<string>")))) == 0), F.lit(False)))
    j = j.withColumn("numeric_correct", F.coalesce(F.col("unit_code").isNull() & (F.abs(F.col("converted") - F.col("reference_value")) <= allowed), F.lit(False)))
    reason = (
        F.when(~F.col("format_valid"), "format")
        .when(F.col("a_status") != want, "action")
        .when(want != "answered", "correct refusal")
        .when(F.col("unit_code").isNotNull(), "unit")
        .when(~F.col("assumptions_present"), "assumptions")
        .when(~F.col("numeric_correct"), "tolerance")
        .otherwise("correct")
    )
    j = j.withColumn("reason", reason).withColumn("correct", F.col("reason").startswith("correct"))
    return j.select("task_id", "category", "expected_action", "format_valid", "answered", "assumptions_present", "numeric_correct", "correct", "reason")


def reward(scored: DataFrame) -> DataFrame:
    return scored.select("task_id", F.col("correct").cast("double").alias("reward"))


def report(scored: DataFrame) -> DataFrame:
    """One row of accuracies; null where nothing is in the denominator."""
    able = F.col("expected_action") == "answer"
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    ok = F.col("correct")
    s = scored.agg(F.count(F.lit(1)).alias("task_count"), n(ok).alias("correct_count"), n(able).alias("answerable_count"), n(able & F.col("answered")).alias("answered_count"), n(able & F.col("answered") & ok).alias("_ca"), n(~able).alias("_r"), n(~able & ok).alias("_cr"), n(F.col("format_valid")).alias("format_valid_count"))
    div = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 6)
    return s.select("task_count", "correct_count", "answerable_count", "answered_count", "format_valid_count", div("correct_count", "task_count").alias("overall_accuracy"), div("answered_count", "answerable_count").alias("coverage"), div("_ca", "answered_count").alias("selective_accuracy"), div("_ca", "answerable_count").alias("answerable_accuracy"), div("_cr", "_r").alias("refusal_accuracy"))


def by_category(scored: DataFrame) -> DataFrame:
    return scored.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("correct").cast("long")).alias("correct"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


def macro_micro(scored: DataFrame) -> DataFrame:
    """Mean of the category means, and of the tasks."""
    c = by_category(scored)
    return c.agg(F.round(F.avg(F.col("correct") / F.col("total")), 6).alias("macro"), F.round(F.try_divide(F.sum("correct").cast("double"), F.sum("total")), 6).alias("micro"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Wins, losses and ties of two arms on the same tasks."""
    j = a.select("task_id", F.col("correct").alias("x")).join(b.select("task_id", F.col("correct").alias("y")), "task_id")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return j.agg(n(F.col("x") & ~F.col("y")).alias("wins"), n(~F.col("x") & F.col("y")).alias("losses"), n(F.col("x") == F.col("y")).alias("ties"))


def grade_fields(expected: DataFrame, responses: DataFrame) -> DataFrame:
    """``(id, pass, reason)`` of answers by field: exact fields, exact units, closeness by field.

    ``expected`` is ``(id, field, value, unit, rtol, atol)``, ``responses`` is
    ``(id, field, value, unit)``; every expected id gets a row.
    """
    j = expected.select("id", "field", F.col("value").alias("ev"), F.col("unit").alias("eu"), "rtol", "atol").join(responses.select("id", "field", F.col("value").alias("rv"), F.col("unit").alias("ru"), F.lit(True).alias("_there")), ["id", "field"], "full_outer")
    known = expected.select("id").distinct()
    code = F.when(F.col("eu").isNull() | F.col("_there").isNull(), 1).when(~F.coalesce(F.col("eu") == F.col("ru"), F.lit(False)), 2).when(~F.coalesce(~F.isnan("rv") & is_close(F.col("rv"), F.col("ev"), F.col("rtol"), F.col("atol")), F.lit(False)), 3)
    g = j.withColumn("c", code).groupBy("id").agg(F.min("c").alias("c"))
    reason = F.when(F.col("c") == 1, "ANSWER_KEYS").when(F.col("c") == 2, "ANSWER_UNITS_OR_SHAPE").when(F.col("c") == 3, "ANSWER_NUMERIC").otherwise("FIXED_ORACLE_FIELDS_AND_UNITS")
    return known.join(g, "id").select("id", F.col("c").isNull().alias("pass"), reason.alias("reason"))


def unit_is_known(unit: str) -> bool:
    return unit_of(unit)[3] is None


def gate(base: DataFrame, new: DataFrame, drop: float = 5.0, latency: float = 1.25) -> DataFrame:
    """``(domain, change, decision)`` of two arms ``(domain, points, critical, p95)``: HOLD for a drop, a new critical failure or a slower tail."""
    j = base.select("domain", F.col("points").alias("p0"), F.col("critical").alias("c0"), F.col("p95").alias("l0")).join(new.select("domain", F.col("points").alias("p1"), F.col("critical").alias("c1"), F.col("p95").alias("l1")), "domain", "full_outer")
    bad = (F.col("p0") - F.col("p1") >= drop) | (F.col("c1") > F.col("c0")) | (F.col("l1") > latency * F.col("l0"))
    return j.select("domain", F.round(F.col("p1") - F.col("p0"), 6).alias("change"), F.when(F.coalesce(bad, F.lit(True)), "HOLD").otherwise("PASS").alias("decision"))


def sealed_evaluation(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """``(rule, n)`` before anything is graded: ids that only one side has, and ids that come several times."""
    from curata.operators.guards import counts, one_to_one

    twice = answers.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counts(union([one_to_one(tasks, answers, "task_id", ("NO_ANSWER", "UNKNOWN_TASK")), rule("REPEATED_ANSWER", twice, F.col("task_id"))]), ["NO_ANSWER", "UNKNOWN_TASK", "REPEATED_ANSWER"])
