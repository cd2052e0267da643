"""Nearest pairs: against all pairs, and the memory of one task."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from folioscope.functions import vectors as v


def frame(spark, n, dims, labels=3, seed=1, like=4):
    """Vectors with many equal ones."""
    rng = np.random.default_rng(seed)
    some = rng.normal(size=(max(1, n // like), dims)).astype(np.float32)
    return spark.createDataFrame([(i, some[rng.integers(len(some))].tolist(), int(rng.integers(labels))) for i in range(n)], "vec_id long, embedding array<float>, label int")


def pairs(rows, queries, k, by=False, own=False):
    out = set()
    for q in queries:
        best = {}
        for r in rows:
            if not own or q.label == r.label:
                best.setdefault(r.label if by else 0, []).append((-round(float(np.dot(np.array(q.embedding), np.array(r.embedding))), 9), r.vec_id))
        out |= {(q.vec_id, key, i + 1, *([g] if by else [])) for g, held in best.items() for i, (_, key) in enumerate(sorted(held)[:k])}
    return out


@pytest.mark.parametrize("k", [1, 5, 400])
@pytest.mark.parametrize("by, own", [(False, False), (True, False), (True, True)])
def test_best_pairs_are_those_of_all_pairs(spark, k, by, own):
    rows = frame(spark, 300, 8)
    asked = rows.where("vec_id % 20 = 0")
    got = v.best_pairs(rows.repartition(3), asked, k, by="label" if by else None, block=4, **({"own": True} if own else {}))
    want = pairs(rows.collect(), asked.collect(), k, by, own)
    assert {tuple(r) for r in got.select("query_id", "vec_id", "rank", *(["label"] if by else [])).collect()} == want


def test_tiles_keep_the_best():
    rng = np.random.default_rng(5)
    scores = np.round(rng.normal(size=(7, 900)), 1)
    for k, tile in ((1, 50), (4, 7), (21, 300), (1000, 128)):
        best, keys = v.Nearest(np.arange(7), k), rng.permutation(900)
        for at in range(0, 900, tile):
            best.meet(scores[:, at : at + tile], keys[at : at + tile])
        want = [(q, key) for q in range(7) for _, key in sorted(zip(-scores[q], keys.tolist(), strict=True))[:k]]
        assert list(zip(best.at.tolist(), best.keys.tolist(), strict=True)) == want


@pytest.mark.parametrize("by, labels", [(None, 1), ("label", 10), ("label", 400)])
def test_a_task_holds_tiles(spark, monkeypatch, by, labels):
    """A batch of 10,000 rows against a block of 4,096 queries: all their scores are 330 MB."""
    tasks, dims = [], 8
    kind = type(spark.range(0))
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: (tasks.append(f), real(self, f, *a, **b))[1])
    v.best_pairs(frame(spark, 4096, dims), frame(spark, 4096, dims), 21, by=by)
    rng, n = np.random.default_rng(2), 10_000
    vectors = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dims, pa.array(rng.normal(size=n * dims).astype(np.float32)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), vectors, *([pa.array(np.sort(np.arange(n) % labels), pa.int64())] if by else [])], names=["vec_id", "embedding", "label"][: 3 if by else 2])
    tracemalloc.start()
    given = sum(x.num_rows for x in tasks[0](iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert given == 4096 * min(21, n // labels) * labels and most < 200


def test_equal_rows_are_as_good_as_the_own(spark):
    """Tables repeated with shifted keys: the smaller id of equal rows is the best, but each is its own best too."""
    from types import SimpleNamespace

    from folioscope.plans import search
    from pyspark.sql import functions as F

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 100")
    off = F.transform("embedding", lambda e: (e * 0.9).cast("float")).alias("embedding")
    table = rows.unionByName(rows.withColumn("vec_id", F.col("vec_id") + 100)).unionByName(rows.select(F.col("vec_id") + 200, off, "label").toDF("vec_id", "embedding", "label"))
    assert sorted(x.vec_id for x in search.self_retrieval(SimpleNamespace(embeddings=table)).collect()) == [0, 50, 100, 150]
