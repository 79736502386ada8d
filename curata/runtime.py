"""Session, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import copy
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_WRITTEN: set[tuple[str, str]] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; scans stay lazy, so columns and filters are pushed down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` where it is set.

    Only where the session names none (tests, a laptop) a temporary folder of
    this machine is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _FALLBACK[app] = tempfile.mkdtemp(prefix="curata-")
        atexit.register(shutil.rmtree, _FALLBACK[app], True)
    return _FALLBACK[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of this name under :func:`shared_dir`, deleted with the staged tables."""
    path = f"{shared_dir(spark)}/{name}"
    _WRITTEN.add((spark.sparkContext.applicationId, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Spark drops the shuffle files of a query when it ends; what is staged needs them no more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was) if was is not None else spark.conf.unset(key)


class Stage:
    """A table written to the shared folder: its lineage is cut and survives lost executors.

    ``rows`` and the named aggregates ``seen`` are observed while it is written,
    so that no job has to count or look at it afterwards.
    """

    def __init__(self, df: DataFrame, label: str, options: dict[str, str] | None = None, **measures: Column) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        _WRITTEN.add((self.spark.sparkContext.applicationId, self.path))
        aggs = {"rows": F.count(F.lit(1)), **measures}
        watch = Observation()
        with _shuffles_dropped(self.spark):
            df.observe(watch, *[c.alias(k) for k, c in aggs.items()]).write.option("compression", "zstd").options(**options or {}).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        got = watch.get
        if "rows" not in got:  # the planner has found the table empty and measured nothing
            got = self.df.agg(*[c.alias(k) for k, c in aggs.items()]).first().asDict()
        self.rows, self.seen = got.pop("rows"), got

    def bytes(self) -> int:
        """Bytes of its files."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()

    def drop(self) -> None:
        """Deletes the files; no frame may read them afterwards."""
        _WRITTEN.discard((self.spark.sparkContext.applicationId, self.path))
        _delete(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Deletes all tables that this session has staged; no result of an earlier operator may be read afterwards."""
    app = spark.sparkContext.applicationId
    for path in [p for a, p in _WRITTEN if a == app]:
        _WRITTEN.discard((app, path))
        _delete(spark, path)


@atexit.register
def _sweep() -> None:
    live = SparkSession.getActiveSession()
    for app, path in list(_WRITTEN):
        try:
            if live is not None and live.sparkContext.applicationId == app:
                _delete(live, path)
            elif path.startswith("/"):
                shutil.rmtree(path, True)
            elif path.startswith("file:"):
                shutil.rmtree("/" + path[5:].lstrip("/"), True)
        except Exception:  # noqa: BLE001 - the session may already be gone
            continue


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to and read from the shared folder."""
    return Stage(df, label).df


HOT = 200_000  # rows of one key that a task may get
FEW = 1_000_000  # hot keys that are broadcast; beyond that the planner chooses


class HotKeys:
    """The keys with more than ``hot`` rows of ``left``, and how many shares of ``hot`` rows they fill.

    There are at most ``rows / hot`` of them; where ``left`` is known to have no
    more than ``hot`` rows, there are none and nothing is counted. Null keys are
    counted like others.
    """

    def __init__(self, left: DataFrame, key: str, hot: int = HOT, rows: int | None = None) -> None:
        self.key, self.heavy, self.nulls = key, None, 1
        if rows is not None and rows <= hot:
            return
        n = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot)
        s = Stage(n.select(F.col(key), F.ceil(F.col("_n") / hot).cast("int").alias("_salts")), "hot", nulls=F.max(F.when(F.col(key).isNull(), F.col("_salts"))))
        self.nulls = s.seen["nulls"] or 1
        if s.rows == (self.nulls > 1):
            s.drop()
            return
        keys = s.df.filter(F.col(key).isNotNull())
        self.heavy = F.broadcast(keys) if s.rows <= FEW else keys

    def renamed(self, key: str) -> HotKeys:
        """The same keys under another column name."""
        out = copy.copy(self)
        out.key, out.heavy = key, None if self.heavy is None else self.heavy.withColumnRenamed(self.key, key)
        return out

    def salted(self, left: DataFrame) -> DataFrame:
        spread = lambda n: F.pmod(F.xxhash64(*left.columns), n)
        null = F.col(self.key).isNull() & F.lit(self.nulls > 1)
        if self.heavy is None:
            return left.withColumn("_salt", F.when(null, spread(F.lit(self.nulls))).otherwise(F.lit(0)).cast("int"))
        x = left.join(self.heavy, self.key, "left")
        return x.withColumn("_salt", F.when(null, spread(F.lit(self.nulls))).when(F.col("_salts").isNotNull(), spread(F.col("_salts"))).otherwise(F.lit(0)).cast("int")).drop("_salts")

    def repeated(self, right: DataFrame) -> DataFrame:
        if self.heavy is None:
            return right.withColumn("_salt", F.lit(0))
        x = right.join(self.heavy, self.key, "left")
        return x.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_salts")


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: int = HOT, rows: int | None = None, keys: HotKeys | None = None) -> DataFrame:
    """Join of ``left`` with ``right``, whose ``key`` is unique, safe for hot and null keys.

    A key with more than ``hot`` rows of ``left`` counts as hot. Its rows are
    spread over as many salts as they fill shares of ``hot`` rows, and only the
    matching row of ``right`` is repeated per salt, so no task gets more than
    about ``hot`` rows of one key. Null keys match nothing; a left join spreads
    their rows alike. Rows are spread by their hash: ``left`` should have no
    great number of identical rows.

    The hot keys are counted here, by a job over the key column of ``left``,
    which should therefore be staged; no job runs if ``rows``, the known size of
    ``left``, is not above ``hot``, or if ``keys`` brings them.
    """
    found = keys or HotKeys(left if how == "left" else left.filter(F.col(key).isNotNull()), key, hot, rows)
    if found.heavy is None and (found.nulls == 1 or how == "inner"):
        return left.join(right, key, how)
    return found.salted(left).join(found.repeated(right), [key, "_salt"], how).drop("_salt")


def clean_id(c: Column) -> Column:
    """Ids compare trimmed (any white space) and in lower case; blank is null."""
    t = F.lower(F.regexp_replace(c, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))
    return F.when(t != "", t)
