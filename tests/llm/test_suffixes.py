import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from folioscope.llm import chunks, suffixes as s

from . import brute


def key(r):
    return tuple((x is not None, x) for x in r)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_bytes string, chunk int").repartition(3)
    got = s.remove(df, **options).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute.repeats(rows), key=key)


@pytest.mark.parametrize("hot", [s.HOT, 0, 3])
def test_driver_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(chunks, "CHUNK", 60_000)
    check(spark, duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall(), hot=hot)


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abcdé \n", k=n))
    passage, line = word(300), word(49)
    texts = [None, "", "short", "a" * 400, "ab" * 200, "b" + "a" * 300, passage, passage, passage[3:], passage[:-5], line, line, line + "x", line + "x", "x" + line]
    texts += [word(rng.randrange(90)) + passage[i : rng.randrange(i, 300)] + word(rng.randrange(90)) for i in range(0, 200, 5)]
    texts += ["\0" * 120, "\0" * 49 + "q", "q" + "\0" * 60, word(5000) + passage]
    rows = list(enumerate(texts)) + [(None, passage), (None, None), (7, passage + "tail of the same id"), (6, passage)]
    rng.shuffle(rows)
    check(spark, rows)
    monkeypatch.setattr(chunks, "CHUNK", 300)
    check(spark, rows)
    for hot in (0, 12):
        check(spark, rows, hot=hot)


def test_equal_strings_sample_the_same_place_wherever_they_stand(monkeypatch):
    rng = np.random.default_rng(9)
    text = rng.integers(97, 101, 6000, dtype=np.uint8)
    places, hashes = s.sample(text, np.array([0, 6000]))
    for i, j in ((0, 60), (100, 3000), (2500, 6000)):
        own = s.sample(text[i:j], np.array([0, j - i]))
        whole = [p for p in places.tolist() if i + s.PLACES <= p < j - s.LENGTH]
        assert whole == [p + i for p in own[0].tolist() if i + s.PLACES <= p + i < j - s.LENGTH]
    monkeypatch.setattr(s, "PLACE_BITS", 10)
    tens = [s.sample(text[:1000], np.array([0, 1000])), s.sample(text, np.array([0, 6000]))]
    assert [p for p in tens[1][0].tolist() if p < 900] == [p for p in tens[0][0].tolist() if p < 900]
    covered = np.zeros(6000, bool)
    for p in tens[1][0].tolist():
        covered[max(0, p - s.PLACES + 1) : p + 1] = True
    assert covered[: 6000 - s.LENGTH + 1].all()


def test_empty(spark):
    assert s.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert s.remove(spark.createDataFrame([(1, None)], "doc_id long, text string"), with_text=True).first().kept == b""


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = np.random.default_rng(k)
    runs = [sorted(bytes(rng.integers(97, 99, s.LENGTH, dtype=np.uint8).tolist()) for _ in range(rng.integers(0, 40))) for _ in range(k)]
    runs = [sorted([*r, *r[:3]]) for r in runs]
    shared = lambda a, b: next((i for i in range(s.LENGTH) if a[i] != b[i]), s.LENGTH)
    commons = [[0 if not i else shared(r[i - 1], r[i]) for i in range(len(r))] for r in runs]
    order, common = s.merge(runs, commons)
    flat = [x for r in runs for x in r]
    out = [flat[i] for i in order]
    assert out == sorted(flat) and common == [0 if not i else shared(out[i - 1], out[i]) for i in range(len(out))]


def test_a_chunk_sorts_many_buckets_at_once(monkeypatch):
    rng, buckets = random.Random(4), 500
    word = lambda n: "".join(rng.choices("abcd ", k=n))
    passages = [word(200) for _ in range(60)]
    rows = [(i, word(30) + "".join(rng.sample(passages, 4)) + word(30)) for i in range(80)]
    data = pa.array([chunks.Chunk.dump([i for i, _ in rows], [t.encode() for _, t in rows])], pa.binary())
    one, none = pa.array([0], pa.int64()), pa.array([None], pa.list_(pa.int64()))
    asked = pa.Table.from_batches(s._ask(buckets)(iter([pa.RecordBatch.from_arrays([one, data, none], names=["chunk", "data", "copies"])])))
    answers = [v for b in range(asked.num_rows) for v in s._answer(s.HOT)(asked.slice(b, 1)).column("shared").to_pylist()]
    held = pa.RecordBatch.from_arrays([one, data, none, pa.array([answers], pa.list_(pa.binary()))], names=["chunk", "data", "copies", "answers"])

    def removed(runs):
        spans = [np.zeros(0, np.int64)]
        for b in range(runs.num_rows):
            spans += [chunks.spread(v)[0] for v in s._merged(runs.slice(b, 1)).column("spans").to_pylist()]
        gone = {(doc, at) for doc, i, j in np.concatenate(spans).reshape(-1, 3).tolist() for at in range(i, j)}
        return [sum(doc == i for doc, _ in gone) for i, _ in rows]

    whole = list(s._runs(buckets)(iter([held])))
    assert len(whole) == 1 and whole[0].num_rows > 250
    monkeypatch.setattr(s, "SORTED", 1)
    each = list(s._runs(buckets)(iter([held])))
    assert len(each) == whole[0].num_rows
    cells = [[a.tolist() for v in pa.Table.from_batches(x).column("run").to_pylist() for a in chunks.spread(v)[:8]] for x in (whole, each)]
    assert cells[0] == cells[1]
    assert removed(pa.Table.from_batches(whole)) == removed(pa.Table.from_batches(each)) == [r[2] for r in sorted(brute.repeats(rows))]


def test_chunks_are_wide(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", 1000)
    made = []
    monkeypatch.setattr(s, "pack", lambda *given: made.append(chunks.pack(*given)) or made[0])
    df = spark.createDataFrame([(i, "x" * 100) for i in range(400)], "doc_id long, text string").coalesce(1)
    assert s.remove(df).agg({"n_removed": "sum"}).first()[0] == 39_900 and made[0].count() == 10  # 40 before
