import random

import duckdb
import numpy as np
from folioscope.llm import jaccard as j

from . import brute


def key(r):
    return tuple((x is not None, x) for x in r)


def check(spark, rows, n, percent):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component_id string, root int").repartition(3)
    got = j.join(df, n=n, percent=percent).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute.jaccard(rows, n, percent), key=key)


def test_driver_rows(spark):
    check(spark, duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall(), 4, 85)


def family(rng, base, count, edits):
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        yield " ".join(w)


def test_odd_rows_and_large_groups(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n\t", "a b", "A  B", "a b c d", "a b c d e", "a\xa0b c d", "a b c"] + ["one line that all share " * 40] * 3
    texts += list(family(rng, rng.choices(words, k=80), 120, 6)) + list(family(rng, rng.choices(words, k=30), 40, 3))
    texts += [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(60)]
    texts += ["common passage of many words here " + " ".join(rng.choices(words, k=25)) for _ in range(40)]
    rows = list(enumerate(texts)) + [(None, "a b c d"), (None, None), (12, texts[140]), (3, "a b"), (400, "x " * 30000)]
    rng.shuffle(rows)
    check(spark, rows, 4, 85)
    monkeypatch.setattr(j, "BLOCK", 17)
    check(spark, rows, 5, 80)


def test_a_unit_loses_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 380, replace=False), rng.integers(0, 1 << 62, rng.integers(0, 60), dtype=np.uint64)])) for _ in range(120)]
    sizes, shared = np.array(list(map(len, sets))), set(base.tolist())
    lists = [np.array([e for e in s.tolist() if e in shared], dtype=np.uint64) for s in sets]  # by hash: any order does
    edges = j.linked(list(range(120)), sizes, lists, None, 85)
    _, root = (f := j._forest(120))
    parent = f[0]
    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    links = 0
    for a in range(120):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                assert root(a) == root(b)
    assert links > 50


def test_empty(spark):
    assert j.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
