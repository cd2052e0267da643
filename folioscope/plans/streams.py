"""Streaming queries over the events; complete mode, so that they give what a batch gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from folioscope.streaming import events as e

from .base import Tables, query


def _run(x: Tables, make, mode: str = "complete") -> DataFrame:
    stream = e.timed(e.read(x.spark, f"{x.sf_dir}/events.parquet*", x.events.schema))
    return e.run(make(stream), f"{e.shared_folder(x.spark)}/stream-{uuid.uuid4().hex}", mode)


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hits_per_day(x: Tables):
    """Tumbling windows over a stream of files."""
    return _run(x, lambda s: e.hits(s, "1 day")).select(F.col("start").cast("string").alias("start"), "event_type", "n")


@query("SELECT user_id, CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 4")
def stream_over_limit(x: Tables):
    """Users above a limit in a window, from a stream."""
    return _run(x, lambda s: e.over_limit(s, 4, "1 day")).select("user_id", F.col("start").cast("string").alias("start"), "n")
