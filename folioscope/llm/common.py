"""What several operators share: tables, the shared work folder, and cutting Arrow batches by bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one step of a Python operator works on; bounds a worker's memory whatever a batch holds.
STEP_BYTES = 2 << 20
#: What operators keep in this Python worker from task to task: by operator, what drops it.
_KEPT: dict[str, Callable[[], None]] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the driver and all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (tests in local mode) a temporary
    folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, so a lost executor costs no recomputation."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keeps(operator: str, drop: Callable[[], None]) -> None:
    """Notes that ``operator`` keeps something in this worker until a task of another operator calls ``drop``."""
    _KEPT[operator] = drop


def settle(operator: str | None = None) -> None:
    """Drops what operators but ``operator`` keep in this worker, and gives memory that is held but unused back to the system.

    Workers serve all stages of a session in turn, and an executor has as many of them as cores beside its JVM.
    """
    for other in [k for k in _KEPT if k != operator]:
        _KEPT.pop(other)()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES, operator: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices with at most ``limit`` bytes in ``column``; a longer single value stands alone.

    The worker is settled before the first and behind the last, ``operator`` keeping what it has.
    """
    settle(operator)
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(ends.searchsorted(base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    batch = ends = None
    settle(operator)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
