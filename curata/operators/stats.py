"""Statistics by group from partial aggregates; distribution functions run on the few aggregated rows."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions.udfs import f_pvalue, t_critical, t_pvalue


def moments(df: DataFrame, group: str, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v)
    return df.filter(ok).groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))


def welch(df: DataFrame, group: str, value: str, a: str, b: str, alpha: float = 0.05, inference: bool = True) -> DataFrame:
    """Difference, t and degrees of freedom of two groups, with p and interval if ``inference``; null where undefined."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    m = moments(df.filter(F.col(group).isin(a, b)), group, value)
    pick = lambda k, c: F.max(F.when(F.col(group) == k, F.col(c)))
    w = m.agg(*[pick(k, c).alias(f"{c}_{s}") for k, s in ((a, "a"), (b, "b")) for c in ("n", "mean", "var")])
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    se = F.sqrt(sa + sb)
    d = F.col("mean_a") - F.col("mean_b")
    df_ = F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1))
    out = w.select(d.alias("difference"), F.try_divide(d, se).alias("t"), df_.alias("df"), se.alias("_se"))
    if inference:
        out = out.withColumn("p_two_sided", t_pvalue("t", "df")).withColumn("_c", t_critical("df", F.lit(1 - alpha)))
        out = out.withColumn("ci_low", F.col("difference") - F.col("_c") * F.col("_se")).withColumn("ci_high", F.col("difference") + F.col("_c") * F.col("_se")).drop("_c")
    return out.drop("_se")


def anova(df: DataFrame, group: str, value: str, inference: bool = True) -> DataFrame:
    """F and degrees of freedom of a one-way layout."""
    m = moments(df, group, value)
    s = m.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"), F.sum((F.col("n") - 1) * F.col("var")).alias("ssw"))
    ssb = F.col("q") - F.col("n") * F.col("grand") * F.col("grand")
    out = s.select((F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"), F.try_divide(ssb / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k"))).alias("f"))
    return out.withColumn("p", f_pvalue("f", F.col("df_between").cast("double"), F.col("df_within").cast("double"))) if inference else out


def regression(df: DataFrame, y: str, xs: list[str]) -> dict:
    """Least squares with intercept: one pass gathers the Gram matrix of centred columns, the driver solves it."""
    cols = [*xs, y]
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    means = d.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols]).first()
    n = means["n"]
    if n <= len(xs) + 1:
        raise ValueError("too few rows for so many predictors")
    cent = {c: F.col(c) - F.lit(means[c]) for c in cols}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    got = d.agg(*[F.sum(cent[a] * cent[b]).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    g = {(a, b): got[i] for i, (a, b) in enumerate(pairs)}
    gram = np.array([[g.get((a, b), g.get((b, a))) for b in xs] for a in xs])
    if np.linalg.matrix_rank(gram) < len(xs):
        raise ValueError("predictors are linearly dependent")
    xy = np.array([g[(a, y)] for a in xs])
    beta = np.linalg.solve(gram, xy)
    sst = g[(y, y)]
    sse = max(0.0, float(sst - beta @ xy))
    return {"intercept": float(means[y] - sum(b * means[x] for b, x in zip(beta, xs))), "coefficients": beta.tolist(), "sse": sse, "r_squared": 1 - sse / sst if sst > 0 else None, "residual_df": n - len(xs) - 1}


def simple_regression(df: DataFrame, group: str, y: str, x: str) -> DataFrame:
    """Slope, intercept and r squared by group."""
    return df.groupBy(group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"), F.regr_count(y, x).alias("n"))


def factorial_design(spark, factors: list[str]) -> DataFrame:
    """The 2^k runs of -1 and 1, at most eight factors."""
    if not 1 <= len(factors) <= 8:
        raise ValueError("one to eight factors")
    rows = [(i, *r) for i, r in enumerate(product((-1, 1), repeat=len(factors)))]
    return spark.createDataFrame(rows, ", ".join(["run int", *[f"`{f}` int" for f in factors]]))


def out_of_control(df: DataFrame, value: str, center: float, sigma: float) -> DataFrame:
    """Rows beyond three known sigmas of a known centre."""
    if not sigma > 0:
        raise ValueError("sigma must be positive")
    return df.filter(F.abs(F.col(value) - center) > 3 * sigma)
