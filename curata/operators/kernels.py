"""Row and group kernels of preference and policy training, as expressions and windows over rows of tokens or rollouts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.runtime import lookup


def advantages(df: DataFrame, group: str, reward: str, epsilon: float = 1e-6) -> DataFrame:
    """``df`` with ``advantage``: reward minus group mean over population deviation; null for groups of fewer than two.

    Group moments are partial aggregates that are joined back, so a hot group is not gathered.
    """
    g = df.groupBy(group).agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s"), F.count(reward).alias("_n"))
    return lookup(df, g, group, "left").withColumn("advantage", F.when(F.col("_n") > 1, (F.col(reward) - F.col("_m")) / (F.col("_s") + epsilon))).drop("_m", "_s", "_n")


def sequence_logprobs(tokens: DataFrame, seq: str, logp: str, mask: str) -> DataFrame:
    """``(seq, sum_logp, mean_logp, n)`` over supervised tokens."""
    m = F.col(mask)
    return tokens.groupBy(seq).agg(F.sum(F.when(m, F.col(logp))).alias("sum_logp"), F.avg(F.when(m, F.col(logp))).alias("mean_logp"), F.sum(m.cast("long")).alias("n"))


def dpo(df: DataFrame, chosen: str, rejected: str, ref_chosen: str, ref_rejected: str, beta: float = 0.1) -> DataFrame:
    """Loss, accuracy and margin of preference pairs; the loss in its stable form."""
    m = beta * ((F.col(chosen) - F.col(rejected)) - (F.col(ref_chosen) - F.col(ref_rejected)))
    loss = F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))
    return df.agg(F.avg(loss).alias("loss"), F.avg((m > 0).cast("double")).alias("preference_accuracy"), F.avg(m).alias("preference_margin"))


def grpo(tokens: DataFrame, seq: str, logp: str, old: str, ref: str, advantage: str, mask: str, clip: float = 0.2, beta: float = 0.02) -> DataFrame:
    """Clipped group-relative objective with the k3 estimate of the divergence: mean over sequences of token means."""
    bound = lambda c: F.greatest(F.least(c, F.lit(20.0)), F.lit(-20.0))
    ratio = F.exp(bound(F.col(logp) - F.col(old)))
    a = F.col(advantage)
    policy = F.least(ratio * a, F.greatest(F.least(ratio, F.lit(1 + clip)), F.lit(1 - clip)) * a)
    d = bound(F.col(ref) - F.col(logp))
    per = -policy + beta * (F.exp(d) - d - 1)
    s = tokens.filter(F.col(mask)).groupBy(seq).agg(F.avg(per).alias("l"))
    return s.agg(F.avg("l").alias("loss"), F.count(F.lit(1)).alias("n_sequences"))


def distillation(logits: DataFrame, token: str, student: str, teacher: str, temperature: float = 2.0) -> DataFrame:
    """Divergence of softened distributions from rows of ``(token, student, teacher)`` logits."""
    s, t = F.col(student) / temperature, F.col(teacher) / temperature
    top = logits.groupBy(token).agg(F.max(s).alias("_ms"), F.max(t).alias("_mt"))
    j = logits.join(top, token)
    z = j.groupBy(token).agg((F.log(F.sum(F.exp(s - F.col("_ms")))) + F.first("_ms")).alias("_zs"), (F.log(F.sum(F.exp(t - F.col("_mt")))) + F.first("_mt")).alias("_zt"))
    k = logits.join(z, token).groupBy(token).agg(F.sum(F.exp(t - F.col("_zt")) * ((t - F.col("_zt")) - (s - F.col("_zs")))).alias("kl"))
    return k.agg((F.avg("kl") * temperature**2).alias("loss"), F.count(F.lit(1)).alias("n_tokens"))


def masked_losses(df: DataFrame, score: str, target: str, ignore: float = -1.0) -> DataFrame:
    """Binary cross entropy of logits over observed targets, smooth L1 over finite ones, and the counts."""
    x, y = F.col(score), F.col(target)
    seen = y.isNotNull() & (y != ignore)
    bce = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    d = F.abs(x - y)
    l1 = F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)
    fin = y.isNotNull() & ~F.isnan(y)
    return df.agg(F.avg(F.when(seen, bce)).alias("bce"), F.sum(seen.cast("long")).alias("n_bce"), F.avg(F.when(fin, l1)).alias("smooth_l1"), F.sum(fin.cast("long")).alias("n_l1"))


def supervised_targets(labels: Column, mask: Column, ignore: int = -100) -> Column:
    """Number of targets under label and attention mask, without the first position."""
    both = F.zip_with(labels, mask, lambda a, b: (a != ignore) & (b == 1))
    return F.size(F.filter(both, lambda v, i: v & (i > 0)))


def parameter_counts(df: DataFrame, name: str, n: str) -> DataFrame:
    return df.groupBy(F.element_at(F.split(name, r"\."), 1).alias("component")).agg(F.sum(n).alias("n"))


def rollout_metrics(df: DataFrame, step: str, group: str, reward: str) -> DataFrame:
    """Mean, least and largest reward of a step and its groups without variance."""
    g = df.groupBy(step, group).agg(F.sum(reward).alias("s"), F.count(reward).alias("n"), F.min(reward).alias("lo"), F.max(reward).alias("hi"))
    return g.groupBy(step).agg((F.sum("s") / F.sum("n")).alias("mean"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum((F.col("lo") == F.col("hi")).cast("long")).alias("zero_variance_groups"))


def validation_loss(df: DataFrame, loss: str, targets: str) -> DataFrame:
    m = F.try_divide(F.sum(F.col(loss) * F.col(targets)), F.sum(targets))
    return df.agg(m.alias("loss")).withColumn("perplexity", F.exp(F.least(F.col("loss"), F.lit(80.0))))


def learning_rates(spark, steps: int, warmup: int, rate: float, least: float = 0.1) -> DataFrame:
    """``(step, lr)``: linear warm-up and cosine decay."""
    s = F.col("step")
    remaining = max(steps - warmup - 1, 1)
    prog = F.least(F.lit(1.0), (s - warmup) / remaining)
    decay = rate * (least + (1 - least) * (1 + F.cos(math.pi * prog)) * 0.5)
    return spark.range(steps).withColumnRenamed("id", "step").withColumn("lr", F.when(s < warmup, rate * (s + 1) / max(warmup, 1)).otherwise(decay))


BLOCK = 500  # resamples that a task draws at once


def bootstrap(df: DataFrame, stratum: str, cluster: str, value: str, resamples: int = 10_000, seed: int = 13) -> DataFrame:
    """Percentile interval of the stratum-mean of means, clusters resampled with replacement by Poisson weights.

    Each cluster draws its weight for each resample from its own hash, so the
    resamples are one explode and two partial aggregates, whatever the rows.
    Blocks of resamples are spread over the tasks.
    """
    d = df.select(F.col(stratum).alias("st"), F.col(cluster).alias("cl"), F.col(value).alias("v"))
    c = d.groupBy("st", "cl").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    blocks = -(-resamples // BLOCK)
    r = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("k")).repartition(blocks, "k")
    r = r.select("st", "cl", "s", "n", F.explode(F.sequence(F.col("k") * BLOCK + 1, F.least((F.col("k") + 1) * BLOCK, F.lit(resamples)))).alias("b"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "b", "st", "cl"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cuts, total, p = [], 0.0, math.exp(-1)
    for k in range(1, 12):
        total += p
        cuts.append(total)
        p /= k
    w = sum((u > x).cast("int") for x in cuts)
    m = r.withColumn("w", w).groupBy("b", "st").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    macro = m.groupBy("b").agg(F.avg("m").alias("m"))
    return macro.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg("m").alias("mean"))


def paired_bootstrap(df: DataFrame, stratum: str, cluster: str, base: str, adapter: str, resamples: int = 10_000, seed: int = 13) -> DataFrame:
    """:func:`bootstrap` of adapter minus base, over the rows that have both."""
    d = df.select(F.col(stratum), F.col(cluster), (F.col(adapter) - F.col(base)).alias("difference")).filter("difference is not null")
    return bootstrap(d, stratum, cluster, "difference", resamples, seed)
