"""The packer on Arrow batches: the memory of one task, and the same passages however a batch is cut."""

import tracemalloc

import pyarrow as pa
import pytest

from folioscope.operators import chunking


def task(spark, monkeypatch, **options):
    """What one task does with its batches."""
    tasks, kind = [], type(spark.range(0))
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: (tasks.append(f), real(self, f, *a, **b))[1])
    chunking.passages(spark.createDataFrame([], "doc_id long, seq int, page int, line string, strength int"), **options)
    return tasks[0]


def batch(docs):
    kind = pa.list_(pa.struct([("seq", pa.int32()), ("page", pa.int32()), ("line", pa.string()), ("strength", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs, kind)], names=["doc_id", "rows"])


def lines(n, words):
    return [{"seq": i, "page": i // 4 + 1, "line": "word " * words, "strength": i % 4} for i in range(n)]


def test_a_task_unpacks_few_documents_at_once(spark, monkeypatch):
    run, one = task(spark, monkeypatch, target=128, overlap=16, boundaries=False), batch([lines(60, 12)] * 4000)
    tracemalloc.start()
    given = sum(x.num_rows for x in run(iter([one])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert given == 4000 * 7 and most < 25


@pytest.mark.parametrize("start", [0, 1])
def test_cut_batches_give_the_same(spark, monkeypatch, start):
    docs = [lines(n % 9, n % 40 + 1) for n in range(200)] + [lines(3, 200_000), [], lines(1, 1), []]
    run, whole = task(spark, monkeypatch, target=60, overlap=12), batch(docs).slice(start)
    got = [tuple(r.values()) for b in run(iter([whole])) for r in b.to_pylist()]
    want = []
    for doc, rows in list(enumerate(docs))[start:]:
        items = [tuple(r.values()) for r in rows]
        for i, (carried, at, end) in enumerate(chunking.pack(items, 60, 12)):
            part = items[carried:end]
            want.append((doc, i, "\n".join(p[2] for p in part), sum(len(p[2].split()) for p in part), at, end - 1, sorted({p[1] for p in part})))
    assert got == want
