"""Readers and guards of JSON lines, pairs of files, trees and ledgers; sinks that publish once."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.functions.udfs import json_error
from curata.runtime import scratch


def json_lines(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """``(path, line_no, line)`` of JSON-lines files; plain or gzip.

    Line numbers are of the file: lines are numbered inside each split and the
    lines of earlier splits added. ``tolerant`` takes off a byte-order mark and
    skips blank lines.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("line"))
    w = Window.partitionBy("path", "at").orderBy("m")
    n = raw.groupBy("path", "at").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("path", "at", (F.sum("n").over(Window.partitionBy("path").orderBy("at")) - F.col("n")).alias("before"))
    out = raw.withColumn("k", F.row_number().over(w)).join(before, ["path", "at"]).select("path", (F.col("before") + F.col("k")).alias("line_no"), "line")
    if tolerant:
        out = out.withColumn("line", F.regexp_replace("line", "^\\x{FEFF}", "")).filter(F.trim("line") != "")
    return out


def line_violations(lines: DataFrame, strict: bool = True) -> DataFrame:
    """``(rule, entity, detail)`` of lines that are no JSON objects; strict also refuses repeated keys, depth over 64 and non-finite numbers."""
    entity = F.concat_ws(":", "path", "line_no")
    if strict:
        bad = lines.withColumn("rule", F.when(F.trim("line") == "", "BLANK_LINE").otherwise(json_error("line")))
    else:
        v = F.try_parse_json("line")
        obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        bad = lines.withColumn("rule", F.when(F.trim("line") == "", "BLANK_LINE").when(v.isNull(), "INVALID_JSON").when(~obj, "NOT_OBJECT"))
    return bad.filter("rule is not null").select("rule", entity.alias("entity"), F.lit("").alias("detail"))


def paired_lines(a: DataFrame, b: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The inner join of two files by key, never by position, and the keys that only one has."""
    from curata.operators.guards import one_to_one

    return a.join(b, key), one_to_one(a, b, key)


def ledger(spark: SparkSession, path: str, query: str, schema: str, block: int = 100_000) -> DataFrame:
    """Rows of a read-only query on a SQLite ledger, one snapshot.

    The file is read where the driver is, ``block`` rows at a time; each block
    goes to the shared folder, so that a ledger of any size passes through.
    """
    import sqlite3

    at = scratch(spark, f"ledger-{uuid.uuid4().hex}")
    spark.createDataFrame([], schema).write.parquet(at)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        c.execute("BEGIN")
        rows = c.execute(query)
        while got := rows.fetchmany(block):
            spark.createDataFrame(got, schema).write.mode("append").parquet(at)
    return spark.read.schema(schema).parquet(at)


def tree_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha, size)`` of the blobs of a repository tree in JSON; truncated trees are refused."""
    t = spark.read.option("multiLine", True).schema("sha string, truncated boolean, tree array<struct<path string, type string, sha string, size long>>").json(path)
    t = t.withColumn("_ok", F.when(F.coalesce("truncated", F.lit(False)), F.raise_error(F.lit("the tree is truncated"))).otherwise(F.lit(True)))
    return t.filter("_ok").select(F.inline("tree")).filter("type = 'blob'").select("path", "sha", "size")


def blob_sha1(content: Column) -> Column:
    """Git's digest of a file."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content))


def confined(root: str, relative: str) -> Path:
    """A file under ``root`` with no symbolic link on the way and no step outside; raises otherwise."""
    base = Path(root).resolve(strict=True)
    at = base
    parts = Path(relative).parts
    if not parts or Path(relative).is_absolute() or ".." in parts:
        raise ValueError("the path leaves its root")
    for p in parts:
        at = at / p
        if at.is_symlink():
            raise ValueError("the path has a symbolic link")
    if not at.is_file():
        raise ValueError("no such file")
    return at


def pinned_files(spark: SparkSession, path: str, pins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contents ``(path, content)`` of files that match ``pins(path, sha256)``, and the violations; each is read once."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content", F.sha2("content", 256).alias("have"))
    j = b.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(pins.select(F.col("path").alias("name"), "sha256"), "name", "full_outer")
    bad = j.filter("path is null or sha256 is null or have <> sha256")
    code = F.when(F.col("path").isNull(), "MISSING").when(F.col("sha256").isNull(), "UNPINNED").otherwise("CHANGED")
    return j.filter("have = sha256").select("name", "content"), bad.select(code.alias("rule"), F.col("name").alias("entity"), F.lit("").alias("detail"))


def _fs(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path: any store that Spark writes to."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def prepared(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    """A prepared dataset, its schema and number of rows checked against its metadata, the metadata against the fingerprint."""
    meta = json.loads(spark.read.text(f"{path}/metadata.json", wholetext=True).first().value)
    if fingerprint is not None and meta.get("fingerprint") != fingerprint:
        raise ValueError("the dataset has another fingerprint")
    df = spark.read.parquet(f"{path}/data")
    if meta.get("columns") is not None and meta["columns"] != sorted(map(list, df.dtypes)):
        raise ValueError("the dataset has other columns")
    if df.count() != meta["rows"]:
        raise ValueError("the dataset has another number of rows")
    return df


def publish(df: DataFrame, target: str, fingerprint: str = "", partitions: list[str] | None = None) -> None:
    """Writes a dataset beside its target and renames it; an existing target is refused.

    The row count of the written files goes into the metadata before the rename,
    so a failed write is never visible under the final name. All steps go
    through the file system of the target; where a rename is no single step
    there, readers go by the metadata file, which :func:`prepared` reads first.
    """
    spark = df.sparkSession
    fs, to = _fs(spark, target)
    if fs.exists(to):
        raise FileExistsError(target)
    tmp = f"{target}.{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partitions) if partitions else w).parquet(f"{tmp}/data")
    got = spark.read.parquet(f"{tmp}/data")
    meta = json.dumps({"columns": sorted(map(list, got.dtypes)), "fingerprint": fingerprint, "rows": got.count()}, sort_keys=True)
    out = fs.create(_fs(spark, f"{tmp}/metadata.json")[1])
    out.write(bytearray(meta.encode()))
    out.close()
    if not fs.rename(_fs(spark, tmp)[1], to):
        raise FileExistsError(target)


class _Out:
    """A Hadoop output stream as a Python file."""

    def __init__(self, stream) -> None:
        self.stream = stream

    def write(self, data: bytes) -> int:
        self.stream.write(bytearray(data))
        return len(data)

    def flush(self) -> None:
        self.stream.flush()


def gzip_lines(df: DataFrame, column: str, order: str, target: str, limit: int | None = None) -> str:
    """One gzip file with the lines in order and no time stamp, and its digest: the same bytes for the same rows.

    Rows stream through the driver one partition of the sorted table at a time,
    into whatever file system the target is on; an existing file is refused.
    More lines than ``limit``, where one is set, are refused as well.
    """
    fs, to = _fs(df.sparkSession, target)
    out = fs.create(to, False)
    h = hashlib.sha256()
    try:
        with gzip.GzipFile(filename="", fileobj=_Out(out), mode="wb", mtime=0) as f:
            for k, r in enumerate(df.select(order, column).orderBy(order).toLocalIterator()):
                if limit is not None and k >= limit:
                    raise ValueError("more lines than a release file may have")
                line = (r[column] + "\n").encode()
                f.write(line)
                h.update(line)
    finally:
        out.close()
    return h.hexdigest()


def write_json_lines(df: DataFrame, target: str) -> None:
    """Rows as JSON with sorted keys."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("errorifexists").text(target)


def receipt_violations(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows by which a receipt differs from the one on record."""
    from curata.operators.guards import set_difference

    return set_difference(new, old)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert on read: the last row of each key, by partial aggregates."""
    cols = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order, *cols)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])




def lookup_records(index: DataFrame, wanted: DataFrame, key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """The records with the wanted keys, and the keys that the index lacks; a join, not one seek for each record."""
    w = wanted.select(key).distinct()
    from curata.operators.guards import rule

    return index.join(w, key, "left_semi"), rule("NO_RECORD", w.join(index.select(key), key, "left_anti"), F.col(key))


def active_units(units: DataFrame, files: DataFrame, digits: int = 20) -> DataFrame:
    """Active units ``(path, version, active)`` whose file ``(path, status, content_hash)`` is current and whose version is the beginning of its digest."""
    f = files.filter("status = 'current'").select("path", F.substring("content_hash", 1, digits).alias("version"))
    return units.filter("active").join(f, ["path", "version"], "left_semi")


def append_metrics(df: DataFrame, target: str) -> None:
    """Rows of metrics as JSON lines behind those that are there; nothing is overwritten."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("append").text(target)
