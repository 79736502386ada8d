"""Domain assignment, capability tags, quota samples and review pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.runtime import Stage

# Capability tags by pattern, without regard to case.
TAGS = {
    "motors_drives": r"(?i)\b(?:motor|drive|torque|back[- ]emf)\b",
    "controls": r"(?i)\b(?:PID|feedback|transfer function|stability|damping|controller)\b",
    "plc_ladder": r"(?i)\b(?:PLC|ladder logic|interlock|scan cycle)\b",
    "siemens_tia": r"(?i)\b(?:Siemens|TIA|S7[- ]\d)\b",
    "instrumentation_sensors": r"(?i)\b(?:sensor|instrumentation|transducer|thermocouple|measurement|calibration)\b",
    "statics_strength": r"(?i)\b(?:stress|strain|beam|bending|torsion|statics|factor of safety)\b",
    "troubleshooting": r"(?i)\b(?:troubleshoot|diagnos|fault|failure|malfunction)\w*\b",
    "engineering_data_analysis": r"(?i)\b(?:ANOVA|regression|confidence interval|t[- ]test|SPC|DOE|standard deviation)\b",
    "technical_problem_solving": r"(?i)\b(?:calculate|derive|solve|determine|compute|prove|explain)\b",
}
# Classes of repository paths, first match wins; the last is the default.
PATHS = [
    ("excluded_path", r"(?i)^/|^$|(?:^|/)\.{1,2}(?:/|$)|[:\\]|(?:^|/)(?:va|military)(?:/|$)|password|passwd|credential|secret|(?:^|/)\.env(?:\.|$)|private.?key|api.?key|access.?token|bank.*(?:account|statement)|medical.?record|social.?security|dd.?214"),
    ("local_configuration_or_binary", r"^\.claude/|__pycache__"),
    ("training_log_or_evaluation_artifact", r"^logs.*\.jsonl(?:\.bak)?$"),
    ("candidate_dataset", r"\.jsonl(?:\.bak)?$"),
    ("tokenizer_corpus_not_sft", r"tokenizer_corpus"),
    ("documentation_config_or_code", r"\.(?:json|txt|md|py|yaml|yml|toml|csv|sh|html|js|jsx|css|ipynb)$|^(?:Dockerfile|\.gitignore|\.dockerignore)$"),
]


def path_class(c: Column) -> Column:
    out = F
    for name, p in PATHS:
        out = out.when(F.coalesce(c, F.lit("")).rlike(p), name)
    return out.otherwise("unsupported_or_generated_artifact")


def tags(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in TAGS.items()]))


def first_domain(paths: Column, domains: dict[str, str], fallback: str) -> Column:
    """Domain of the alphabetically first path that has one."""
    known = F.create_map(*[F.lit(x) for kv in domains.items() for x in kv])
    first = F.array_min(F.filter(paths, lambda p: F.map_contains_key(known, p)))
    return F.coalesce(F.try_element_at(known, first), F.lit(fallback))


def in_scope(path: Column, allowed: list[str], denied: list[str]) -> Column:
    """Whether a component of a path is allowed and none is denied, in lower case."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    arr = lambda xs: F.array(*[F.lit(x.lower()) for x in xs])
    return F.arrays_overlap(parts, arr(allowed)) & ~F.arrays_overlap(parts, arr(denied))


def quota_sample(df: DataFrame, group: str, key: str, budgets: DataFrame | None = None, budget: int = 5, salt: str = "salt") -> DataFrame:
    """The first rows of each group in the order of a salted digest, as many as its budget.

    Only keys and digests are ranked; ``budgets`` is ``(group, budget)``, groups without one give nothing.
    """
    k = df.select(group, key).withColumn("_h", F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256))
    r = k.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("_h", key)))
    # the planner turns rank <= n into a limit before the shuffle (window group limit)
    kept = r.filter(F.col("rank") <= budget) if budgets is None else r.join(budgets, group).filter(F.col("rank") <= F.col("budget"))
    return kept.select(group, key, "rank")


def ordinals(df: DataFrame, group: str, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``ordinal``, its place in its group by ``order``, counted from 0, without gathering a group in one task.

    Rows are range-partitioned by group and order, so that a large group spans
    several partitions; their sizes, one row for each group in each partition,
    give where each partition begins.
    """
    s = df.repartitionByRange(parts, group, *order) if parts else df.repartitionByRange(group, *order)
    s = Stage(s.withColumn("_part", F.spark_partition_id()), "ranges")
    n = s.df.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = n.select(F.col(group).alias("_g"), "_part", (F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")).alias("_before"))
    r = s.df.withColumn("_r", F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)))
    j = r.join(before, (r["_part"] == before["_part"]) & r[group].eqNullSafe(before["_g"])).drop(before["_part"])
    return j.withColumn("ordinal", (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_g", "_before", "_r", "_part")


def review_page(df: DataFrame, group: str, order: list[str], offset: int, limit: int, reviewed: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of each group, numbered over the whole group, without those reviewed."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    page = ordinals(df, group, order).filter(F.col("ordinal").between(offset, offset + limit - 1))
    return page if reviewed is None else page.join(reviewed.select(key).distinct(), key, "left_anti")


def hold(df: DataFrame, holds: DataFrame, key: str) -> DataFrame:
    """``df`` with ``held`` for keys in ``holds``."""
    return df.join(holds.select(key).distinct().withColumn("_h", F.lit(True)), key, "left").withColumn("held", F.coalesce("_h", F.lit(False))).drop("_h")


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """``df`` with ``position``: a reproducible shuffle for each epoch (by md5), numbered without gathering the rows in one task."""
    d = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed + epoch}:"), F.col(key).cast("string"))))
    d = d.withColumn("_b", F.substring("_h", 1, 4))
    n = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # at most 65,536 bins stand in this window
    before = n.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    r = d.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    return r.join(before, "_b").withColumn("position", F.col("_before") + F.col("_r") - 1).drop("_h", "_b", "_before", "_r")


def rotation(tasks: DataFrame, domain: str, key: str, quotas: dict[str, int], family: str | None = None, per_family: int = 2, salt: str = "rotation") -> DataFrame:
    """``(domain, key, mode)``: in each domain the modes in turn by their quotas, in the order of a salted digest, at most ``per_family`` tasks of a family."""
    h = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    t = tasks.select(domain, key, *([family] if family else []), h.alias("_h"))
    if family:
        t = t.withColumn("_k", F.row_number().over(Window.partitionBy(domain, family).orderBy("_h", key))).filter(F.col("_k") <= per_family)
    t = t.withColumn("_r", F.row_number().over(Window.partitionBy(domain).orderBy("_h", key))).filter(F.col("_r") <= sum(quotas.values()))
    mode, upto = F, 0
    for name, n in quotas.items():
        upto += n
        mode = mode.when(F.col("_r") <= upto, name)
    return t.select(domain, key, mode.otherwise(F.lit(None)).alias("mode"))
