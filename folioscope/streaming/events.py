"""Structured Streaming: windowed hits, limits, and documents that change by content hash.

Event time is a timestamp with a watermark, so state is bounded by the lateness allowed. Sinks take each batch by its
number, so that a batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, path: str, schema, *, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def timed(events: DataFrame, late: str = "1 hour", key: str = "event_id") -> DataFrame:
    """Events with a watermark; repeated ones within it are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def hits(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by window and type."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def over_limit(events: DataFrame, limit: int, width: str = "1 minute", by: str = "user_id") -> DataFrame:
    """Keys with more events in a window than the limit allows."""
    return events.groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(F.col("w.start").alias("start"), by, "n")


def upsert(batch: DataFrame, path: str, batch_id: int, key: str = "doc_id") -> None:
    """Writes a batch's last row of each key, with its content hash, as that batch's partition of the table."""
    last = batch.withColumn("print", F.sha2("text", 256)).dropDuplicates([key])
    last.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def current(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """The newest row of each key of such a table."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(key, "r.*")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one in local mode where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="folioscope-stream-")


def run(frame: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and gives its rows, which executors write below ``folder``.

    In complete mode each batch replaces the table; in append mode each has a folder of its own, which it replaces.
    """
    spark, out = frame.sparkSession, f"{folder}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    keep(spark.createDataFrame([], frame.schema), -1)
    query = frame.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)
