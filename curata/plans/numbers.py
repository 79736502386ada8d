"""Queries over measurements: statistics, calculators, kernels and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.operators import kernels, stats, tools
from curata.plans.registry import Registry
from curata.runtime import Stage, table

QUERIES = query = Registry()


def lines(spark, d):
    return table(spark, d, "lineitem")


def events(spark, d):
    return table(spark, d, "events")


@query("e02_convert_units", "SELECT l_orderkey, l_linenumber, round(l_quantity * 1e6 / 1e3, 6) AS kpa, round(l_discount + 273.15, 6) AS kelvin FROM lineitem")
def e02(spark, d):
    x = lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.lit("N/mm^2").alias("a"), F.lit("kPa").alias("b"), F.lit("degC").alias("c"), F.lit("K").alias("e"))
    x = tools.convert(x, "l_quantity", "a", "b").withColumn("kpa", F.round("converted", 6)).drop("converted", "code")
    return tools.convert(x, "l_discount", "c", "e").select("l_orderkey", "l_linenumber", "kpa", F.round("converted", 6).alias("kelvin"))


@query("e03_dimensions", "SELECT * FROM (VALUES ('N*m', 'J', true), ('V*A', 'W', true), ('N', 'Pa', false), ('kg*m/s^2', 'N', true), ('parsec', 'm', false)) t(lhs, rhs, same)")
def e03(spark, d):
    rows = [("N*m", "J"), ("V*A", "W"), ("N", "Pa"), ("kg*m/s^2", "N"), ("parsec", "m")]
    x = spark.createDataFrame(rows, "lhs string, rhs string").withColumn("l", tools.parse_unit("lhs")).withColumn("r", tools.parse_unit("rhs"))
    return x.select("lhs", "rhs", F.coalesce(F.col("l.dims") == F.col("r.dims"), F.lit(False)).alias("same"))


@query("e04_axial_stress", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 6) AS stress, round(1e6 / (l_extendedprice / l_quantity), 6) AS safety_factor FROM lineitem")
def e04(spark, d):
    x = lines(spark, d).withColumn("r", tools.axial_stress(F.col("l_extendedprice"), F.col("l_quantity"), F.lit(1e6)))
    return x.select("l_orderkey", "l_linenumber", F.round("r.stress", 6).alias("stress"), F.round("r.safety_factor", 6).alias("safety_factor"))


@query("e05_dc_motor", "SELECT l_orderkey, l_linenumber, round(0.05 * l_quantity, 6) AS torque, round(0.05 * l_quantity * 100, 6) AS mechanical_power, round(l_quantity * l_quantity * l_tax, 6) AS copper_loss, round(0.05 * l_quantity * 100 / (0.05 * l_quantity * 100 + l_quantity * l_quantity * l_tax), 6) AS efficiency FROM lineitem")
def e05(spark, d):
    x = lines(spark, d).withColumn("r", tools.dc_motor(F.lit(0.05), F.col("l_quantity"), F.lit(100.0), F.col("l_tax")))
    return x.select("l_orderkey", "l_linenumber", *[F.round(f"r.{c}", 6).alias(c) for c in ("torque", "mechanical_power", "copper_loss", "efficiency")])


@query("e06_thermal_expansion", "SELECT event_id, round(2.0 * 1.2e-5 * value, 9) AS length_change, round(2.0 + 2.0 * 1.2e-5 * value, 9) AS final_length FROM events WHERE value IS NOT NULL")
def e06(spark, d):
    x = events(spark, d).filter("value is not null").withColumn("r", tools.thermal_expansion(F.lit(2.0), F.lit(1.2e-5), F.col("value")))
    return x.select("event_id", F.round("r.length_change", 9).alias("length_change"), F.round("r.final_length", 9).alias("final_length"))


@query("e07_second_order_step", "SELECT l_orderkey, l_linenumber, round(1 - exp(-0.5 * 2 * l_tax) * (cos(2 * sqrt(0.75) * l_tax) + 0.5 / sqrt(0.75) * sin(2 * sqrt(0.75) * l_tax)), 6) AS response, round(100 * exp(-pi() * 0.5 / sqrt(0.75)), 6) AS overshoot FROM lineitem")
def e07(spark, d):
    x = lines(spark, d).withColumn("r", tools.second_order_step(F.lit(2.0), F.lit(0.5), F.col("l_tax")))
    return x.select("l_orderkey", "l_linenumber", F.round("r.response", 6).alias("response"), F.round("r.overshoot", 6).alias("overshoot"))


@query("e08_series_rlc", "SELECT p_partkey, round(1 / sqrt(p_size * 1e-3) / sqrt(1e-6), 6) AS natural_frequency, round(sqrt(p_size * 1e-3) / sqrt(1e-6) / p_retailprice, 6) AS quality_factor FROM part")
def e08(spark, d):
    x = table(spark, d, "part").withColumn("r", tools.series_rlc(F.col("p_retailprice"), F.col("p_size") * 1e-3, F.lit(1e-6)))
    return x.select("p_partkey", F.round("r.natural_frequency", 6).alias("natural_frequency"), F.round("r.quality_factor", 6).alias("quality_factor"))


@query("e09_quadratic_roots", "WITH x AS (SELECT p_partkey, p_retailprice AS b, p_size::DOUBLE AS c FROM part), r AS (SELECT p_partkey, c, -0.5 * (b + sqrt(b * b - 4 * c)) AS q FROM x WHERE b * b - 4 * c > 0) SELECT p_partkey, round(least(q, c / q), 6) AS low, round(greatest(q, c / q), 6) AS high FROM r")
def e09(spark, d):
    r = tools.quadratic_roots(F.lit(1.0), F.col("p_retailprice"), F.col("p_size").cast("double"))
    x = table(spark, d, "part").select("p_partkey", r.alias("r")).filter(F.size("r") == 2)
    return x.select("p_partkey", F.round(F.get("r", F.lit(0)), 6).alias("low"), F.round(F.get("r", F.lit(1)), 6).alias("high"))


@query("e10_welch", "WITH m AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM m WHERE g = 'A'), b AS (SELECT * FROM m WHERE g = 'R') SELECT round(a.m - b.m, 4) AS difference, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 4) AS df FROM a, b")
def e10(spark, d):
    w = stats.welch(lines(spark, d), "l_returnflag", "l_extendedprice", "A", "R", inference=False)
    return w.select(F.round("difference", 4).alias("difference"), F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query("e10_welch_inference")
def e10_p(spark, d):
    return stats.welch(lines(spark, d), "l_returnflag", "l_extendedprice", "A", "R")


@query("e11_anova", "WITH m AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS grand FROM m) SELECT (k - 1)::BIGINT AS df_between, (s.n - k)::BIGINT AS df_within, round((SELECT sum(m.n * (m.m - grand) ** 2) FROM m) / (k - 1) / ((SELECT sum((m.n - 1) * m.v) FROM m) / (s.n - k)), 5) AS f FROM s")
def e11(spark, d):
    return stats.anova(lines(spark, d), "l_returnflag", "l_quantity", inference=False).withColumn("f", F.round("f", 5))


@query("e12_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1")
def e12(spark, d):
    r = stats.simple_regression(lines(spark, d), "l_returnflag", "l_extendedprice", "l_quantity")
    return r.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r_squared", 6).alias("r_squared"), "n")


@query("e12_two_predictors", "WITH c AS (SELECT covar_samp(l_quantity, l_quantity) AS aa, covar_samp(l_discount, l_discount) AS bb, covar_samp(l_quantity, l_discount) AS ab, covar_samp(l_quantity, l_extendedprice) AS ay, covar_samp(l_discount, l_extendedprice) AS by_, var_samp(l_extendedprice) AS yy, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my FROM lineitem), k AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS b1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM c) SELECT round(my - b1 * ma - b2 * mb, 2) AS intercept, round(b1, 3) AS quantity, round(b2, 2) AS discount, round((b1 * ay + b2 * by_) / yy, 6) AS r_squared FROM k")
def e12_two(spark, d):
    """The general fit with two predictors; its result is one row of numbers from the driver."""
    r = stats.regression(lines(spark, d), "l_extendedprice", ["l_quantity", "l_discount"])
    row = (round(r["intercept"], 2), round(r["coefficients"][0], 3), round(r["coefficients"][1], 2), round(r["r_squared"], 6))
    return spark.createDataFrame([row], "intercept double, quantity double, discount double, r_squared double")


@query("e13_factorial", "SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS run, a, b, c FROM (VALUES (-1), (1)) x(a), (VALUES (-1), (1)) y(b), (VALUES (-1), (1)) z(c)")
def e13(spark, d):
    return stats.factorial_design(spark, ["a", "b", "c"])


@query("e14_out_of_control", "SELECT event_type, count(*) AS n FROM events WHERE abs(value - 20) > 30 GROUP BY 1")
def e14(spark, d):
    return stats.out_of_control(events(spark, d), "value", 20.0, 10.0).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("e16_claims", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN abs(l_extendedprice / l_quantity - 1500) <= greatest(1.0, 0.1 * 1500) THEN 'VERIFIED' ELSE 'CONFLICTING' END AS state FROM lineitem) GROUP BY 1")
def e16(spark, d):
    s = tools.numeric_claim(F.col("l_extendedprice") / F.col("l_quantity"), F.lit(1500.0), F.lit(1.0), F.lit(0.1))
    return lines(spark, d).groupBy(s.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("e18_projection", "SELECT o_orderkey, round(o_totalprice * 1e6 / 3600.0 / 0.85 / 3600, 6) AS hours FROM orders WHERE o_totalprice > 0")
def e18(spark, d):
    x = table(spark, d, "orders").filter("o_totalprice > 0").withColumn("r", tools.training_estimate(F.col("o_totalprice") * 1e6, F.lit(3600.0), F.lit(2.0)))
    return x.select("o_orderkey", F.round("r.hours", 6).alias("hours"))


# ---- kernels ----------------------------------------------------------------------------------------------------


@query("a25_advantages", "SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6), 6) AS advantage FROM events WHERE value IS NOT NULL AND user_id IN (SELECT user_id FROM events WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) > 1) WINDOW w AS (PARTITION BY user_id)")
def a25(spark, d):
    a = kernels.advantages(events(spark, d).filter("value is not null"), "user_id", "value")
    return a.filter("advantage is not null").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("a26_sequence_logprobs", "SELECT user_id, round(sum(-abs(value)) FILTER (WHERE event_type <> 'view'), 6) AS sum_logp, round(avg(-abs(value)) FILTER (WHERE event_type <> 'view'), 6) AS mean_logp, count(*) FILTER (WHERE event_type <> 'view') AS n FROM events GROUP BY 1")
def a26(spark, d):
    t = events(spark, d).select("user_id", (-F.abs("value")).alias("lp"), (F.col("event_type") != "view").alias("m"))
    s = kernels.sequence_logprobs(t, "user_id", "lp", "m")
    return s.select("user_id", F.round("sum_logp", 6).alias("sum_logp"), F.round("mean_logp", 6).alias("mean_logp"), "n")


@query("a27_dpo", "WITH m AS (SELECT 0.1 * ((l_discount * 10 - l_tax * 10) - (l_quantity / 50 - 0.5)) AS m FROM lineitem) SELECT round(avg(greatest(-m, 0) + ln(1 + exp(-abs(m)))), 6) AS loss, round(avg((m > 0)::INT), 6) AS preference_accuracy, round(avg(m), 6) AS preference_margin FROM m")
def a27(spark, d):
    x = lines(spark, d).select((F.col("l_discount") * 10).alias("c"), (F.col("l_tax") * 10).alias("r"), (F.col("l_quantity") / 50).alias("rc"), F.lit(0.5).alias("rr"))
    return kernels.dpo(x, "c", "r", "rc", "rr").select(*[F.round(c, 6).alias(c) for c in ("loss", "preference_accuracy", "preference_margin")])


@query("a28_grpo", "WITH t AS (SELECT l_orderkey, exp(l_tax - l_discount) AS ratio, l_quantity / 50 - 0.5 AS a, 0.04 - l_tax AS d FROM lineitem), p AS (SELECT l_orderkey, -least(ratio * a, greatest(least(ratio, 1.2), 0.8) * a) + 0.02 * (exp(d) - d - 1) AS per FROM t), s AS (SELECT avg(per) AS l FROM p GROUP BY l_orderkey) SELECT round(avg(l), 6) AS loss, count(*) AS n_sequences FROM s")
def a28(spark, d):
    x = lines(spark, d).select("l_orderkey", F.col("l_tax").alias("lp"), F.col("l_discount").alias("old"), F.lit(0.04).alias("ref"), (F.col("l_quantity") / 50 - 0.5).alias("a"), F.lit(True).alias("m"))
    return kernels.grpo(x, "l_orderkey", "lp", "old", "ref", "a", "m").withColumn("loss", F.round("loss", 6))


@query("a29_distillation", "WITH x AS (SELECT l_orderkey AS k, l_discount / 2.0 AS s, l_tax / 2.0 AS t FROM lineitem), z AS (SELECT k, ln(sum(exp(s))) AS zs, ln(sum(exp(t))) AS zt FROM x GROUP BY k), q AS (SELECT sum(exp(t - zt) * ((t - zt) - (s - zs))) AS kl FROM x JOIN z USING (k) GROUP BY k) SELECT round(avg(kl) * 4, 9) AS loss, count(*) AS n_tokens FROM q")
def a29(spark, d):
    return kernels.distillation(lines(spark, d).select("l_orderkey", "l_discount", "l_tax"), "l_orderkey", "l_discount", "l_tax").withColumn("loss", F.round("loss", 9))


@query("a30_masked_losses", "WITH x AS (SELECT value AS x, CASE WHEN event_type = 'click' THEN 1.0 WHEN event_type = 'view' THEN 0.0 ELSE -1.0 END AS y FROM events) SELECT round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))) FILTER (WHERE y <> -1), 6) AS bce, count(*) FILTER (WHERE y <> -1) AS n_bce, round(avg(CASE WHEN abs(x - y) < 1 THEN 0.5 * (x - y) ** 2 ELSE abs(x - y) - 0.5 END), 6) AS smooth_l1, count(*) AS n_l1 FROM x")
def a30(spark, d):
    y = F.when(F.col("event_type") == "click", 1.0).when(F.col("event_type") == "view", 0.0).otherwise(-1.0)
    m = kernels.masked_losses(events(spark, d).select("value", y.alias("y")), "value", "y")
    return m.select(F.round("bce", 6).alias("bce"), "n_bce", F.round("smooth_l1", 6).alias("smooth_l1"), "n_l1")


@query("a31_supervised_targets", "SELECT count(*) FILTER (WHERE l_linenumber > 1 AND l_returnflag <> 'N') AS n FROM lineitem")
def a31(spark, d):
    """Targets under masks, from arrays of the lines of each order."""
    g = lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("l_returnflag") == "N", -100).otherwise(1).alias("y")))).alias("a"))
    x = g.select("l_orderkey", F.explode("a").alias("e"))
    return x.agg(F.sum(kernels.supervised_targets(F.array(F.lit(-100), F.when(F.col("e.l_linenumber") > 1, F.col("e.y")).otherwise(-100)), F.array(F.lit(1), F.lit(1)))).alias("n"))


@query("a33_rollouts", "WITH g AS (SELECT event_type AS step, user_id, sum(value) AS s, count(value) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2) SELECT step, round(sum(s) / sum(n), 6) AS mean, min(lo) AS min, max(hi) AS max, count(*) FILTER (WHERE lo = hi) AS zero_variance_groups FROM g GROUP BY 1")
def a33(spark, d):
    return kernels.rollout_metrics(events(spark, d).withColumnRenamed("event_type", "step"), "step", "user_id", "value").withColumn("mean", F.round("mean", 6))


@query("a34_validation_loss", "SELECT round(sum(l_tax * l_quantity) / sum(l_quantity), 9) AS loss, round(exp(least(sum(l_tax * l_quantity) / sum(l_quantity), 80)), 9) AS perplexity FROM lineitem")
def a34(spark, d):
    v = kernels.validation_loss(lines(spark, d), "l_tax", "l_quantity")
    return v.select(F.round("loss", 9).alias("loss"), F.round("perplexity", 9).alias("perplexity"))


@query("w09_learning_rates", "SELECT i AS step, round(CASE WHEN i < 10 THEN 3e-4 * (i + 1) / 10 ELSE 3e-4 * (0.1 + 0.9 * (1 + cos(pi() * least(1.0, (i - 10) / 89.0))) * 0.5) END, 12) AS lr FROM range(100) r(i)")
def w09(spark, d):
    return kernels.learning_rates(spark, 100, 10, 3e-4).withColumn("lr", F.round("lr", 12))


@query("w04_backward_steps", "SELECT user_id, count(*) AS n FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE value < last GROUP BY 1")
def w04(spark, d):
    from pyspark.sql.window import Window

    last = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events(spark, d).withColumn("last", last).filter("value < last").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("n04_bootstrap")
def n04(spark, d):
    return kernels.bootstrap(events(spark, d).filter("value is not null"), "event_type", "user_id", "value")


@query("x_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x_windows(spark, d):
    """The stream operator's windows over the whole table (an extension)."""
    g = events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


BLOCK = 20_000  # queries of one block; with vectors of some hundred numbers, tens of megabytes


@query("r07_cosine_top", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS k FROM s) SELECT query_id, vec_id, cosine FROM r WHERE k = 1")
def r07(spark, d):
    """Best partner of every hundredth vector by cosine among all (an extension); queries go in blocks of about ``BLOCK``."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = e.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    unit = e.select("vec_id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))
    q = Stage(unit.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "queries")
    blocks = -(-q.rows // BLOCK) or 1
    out = None
    for k in range(blocks):
        block = q.df.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).agg(F.collect_list(F.struct("query_id", "q")).alias("block"))
        scored = unit.join(F.broadcast(block)).select("vec_id", "v", F.explode("block").alias("b")).filter(F.col("b.query_id") != F.col("vec_id"))
        s = F.aggregate(F.zip_with("v", "b.q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        best = scored.groupBy(F.col("b.query_id").alias("query_id")).agg(F.max_by(F.struct("vec_id", F.round(s, 6).alias("cosine")), F.struct(F.round(s, 6), -F.col("vec_id"))).alias("r"))
        out = best if out is None else out.union(best)
    return out.select("query_id", "r.vec_id", "r.cosine")
