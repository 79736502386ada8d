"""Resumable increments on Structured Streaming: contracts, dead letters, idempotent batches, keyed state."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


class ContractChanged(ValueError):
    """A scan was resumed with other inputs or parameters than it was begun with."""


def pin_contract(spark: SparkSession, folder: str, contract: dict) -> None:
    """Stores the contract of a scan beside its checkpoint, in whatever file system that is, or refuses one that differs."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/contract.json")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    text = json.dumps(contract, sort_keys=True)
    if fs.exists(at):
        if spark.read.text(str(at), wholetext=True).first().value != text:
            raise ContractChanged(str(at))
        return
    out = fs.create(at)
    out.write(bytearray(text.encode()))
    out.close()


def scan(spark: SparkSession, source: str, schema, target: str, good: Callable[[DataFrame], DataFrame], folder: str, contract: dict, error=None, files: int = 100) -> StreamingQuery:
    """Scans new files of ``source`` in batches until none is left; resumes where it stopped.

    Rows for which the column ``error`` is not null go to ``target/failed`` with
    their reason, the others through ``good`` to ``target/rows``. Each batch
    writes its own folder by its number and overwrites it when it is replayed.
    """
    pin_contract(spark, folder, contract)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        b = batch.withColumn("reason", error if error is not None else F.lit(None).cast("string")).persist()
        try:
            b.filter("reason is not null").write.mode("overwrite").parquet(f"{target}/failed/batch={number}")
            good(b.filter("reason is null").drop("reason")).write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        finally:
            b.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def distinct_stream(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """First row of each key within the watermark; state is dropped behind it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, key: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and window of event time, late rows beyond the watermark dropped. An extension: the batch reference has none."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), key, "n")
