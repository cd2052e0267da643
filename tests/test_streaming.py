from folioscope.streaming import events as e
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_closed_windows_are_those_of_a_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet")
    source = tmp_path / "in"
    for k in range(3):
        batch.where(F.col("event_id") % 3 == k).withColumn("event_id", F.col("event_id")).coalesce(1).write.mode("append").parquet(str(source))
    stream = e.timed(e.read(spark, str(source), batch.schema), "40 days")
    got = e.run(e.hits(stream, "1 day"), f"file://{tmp_path}/a", "complete")
    want = e.hits(batch.withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_upserts_keep_the_newest(spark, tmp_path):
    path = f"{tmp_path}/docs"
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    e.upsert(rows((1, "a"), (2, "b")), path, 0)
    e.upsert(rows((2, "c"), (3, "d")), path, 1)
    e.upsert(rows((2, "c"), (3, "d")), path, 1)  # run again after a failure
    assert sorted((r.doc_id, r.text) for r in e.current(spark, path).collect()) == [(1, "a"), (2, "c"), (3, "d")]
