"""Sinks: versioned tables, ordered matrices, append-only logs, reports. Spark's commit protocol makes each atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def content_version(frame: DataFrame) -> str:
    """Sixteen hex digits that depend on the rows and not on their order: sums of two row hashes, and the count."""
    columns = [F.col(c) for c in sorted(frame.columns)]
    facts = frame.select(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b")).agg(
        F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b"))
    return facts.select(F.substring(F.sha2(F.concat_ws(":", "n", "a", "b"), 256), 1, 16)).first()[0]


def versioned(frame: DataFrame, path: str) -> str:
    """Writes the table below its content's version; the same rows are written once."""
    version = content_version(frame)
    frame.write.mode("ignore").parquet(f"{path}/version={version}")
    return version


def matrix(frame: DataFrame, path: str, *order: str) -> None:
    """Rows range-partitioned and sorted by ``order``, so that readers skip by statistics."""
    frame.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def tsv(frame: DataFrame, path: str, columns: list[str]) -> None:
    """A table with fixed columns; further ones are left out."""
    frame.select(*columns).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append(frame: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose key isn't there yet."""
    spark = frame.sparkSession
    try:
        there = spark.read.schema(frame.schema).parquet(path).select(*keys)
        frame = frame.join(there, keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    frame.write.mode("append").parquet(path)


def changed(frame: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """The rows whose content hash isn't the stored one: all that need be written."""
    old = stored.select(key, F.sha2(text, 256).alias("_old"))
    return frame.join(old, (frame[key] == old[key]) & (F.sha2(frame[text], 256) == old["_old"]), "left_anti")


def report(frame: DataFrame, path: str, order: str, line: str) -> None:
    """The lines of a small report, in order, as one text."""
    rows = F.array_sort(F.collect_list(F.struct(order, line)))
    frame.agg(F.array_join(F.transform(rows, lambda r: r[line]), "\n").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def public_half(frame: DataFrame, path: str, access: str = "access", text: str = "text") -> None:
    """Open rows whole, restricted rows without their text."""
    frame.withColumn(text, F.when(F.col(access) == "open", F.col(text))).write.mode("overwrite").parquet(path)


def json_gzip(frame: DataFrame, path: str, *order: str) -> None:
    """One JSON row a line, gzip-compressed, range-partitioned and sorted: the same rows give the same lines in the same order."""
    frame.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", False).json(path)


def prune(listed: DataFrame, written: DataFrame, key: str = "file") -> DataFrame:
    """What is there and was not written by this build; the caller deletes it."""
    return listed.join(written.select(key), key, "left_anti")


def projected(frame: DataFrame, path: str, columns: dict[str, str], **facts) -> None:
    """Documents' public columns under their index names, and beside them one row of facts (tiers keep their order)."""
    frame.select(*(F.col(c).alias(name) for c, name in columns.items())).write.mode("overwrite").parquet(f"{path}/documents")
    one = frame.sparkSession.range(1).select(*(F.array(*map(F.lit, v)).alias(k) if isinstance(v, (list, tuple)) else F.lit(v).alias(k) for k, v in facts.items()))
    one.write.mode("overwrite").parquet(f"{path}/facts")
