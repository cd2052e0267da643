import zlib

import numpy as np
from folioscope.llm import quality as q

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = q.score(docs.select("doc_id", "text"), q.fit(docs, labels), keep=["doc_id"]).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_against_a_closed_form_fit(spark):
    """The same model from all rows at once: ridge by least squares over stacked rows, isotonic levels by their min-max form."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.doc_id in docs and r.quality in (0, 1)]
    fold = lambda d: zlib.crc32(str(d).encode()) % 4
    learnt = [(d, y) for d, y in labels if fold(d) != 2]
    x, y = np.stack([q.statistics((docs[d] or "").encode()) for d, _ in learnt]), np.array([float(v) for _, v in learnt])
    folds, mean, scale = np.array([fold(d) for d, _ in learnt]), x.mean(0), np.maximum(x.std(0), 1e-3)
    blank = q.Model(mean, scale)
    cosines = lambda v: np.hstack([np.cos(np.clip((v - mean) / scale, -8, 8) @ blank.directions + blank.phases) * np.sqrt(2 / q.FEATURES), np.ones((len(v), 1))])

    def ridge(z, t):
        return np.linalg.lstsq(np.vstack([z, np.sqrt(q.RIDGE) * np.eye(z.shape[1])]), np.append(t, np.zeros(z.shape[1])), rcond=None)[0]

    z = cosines(x)
    raw = np.zeros(len(y))
    for k in q.FOLDS:
        raw[folds == k] = z[folds == k] @ ridge(z[folds != k], y[folds != k])
    at = np.clip((raw + 1) * (q.BINS / 3), 0, q.BINS - 1).astype(int)
    bins = np.unique(at)
    n, total = np.array([(at == b).sum() for b in bins]), np.array([y[at == b].sum() for b in bins])
    part = lambda a, b: total[a : b + 1].sum() / n[a : b + 1].sum()
    level = [max(min(part(a, b) for b in range(i, len(bins))) for a in range(i + 1)) for i in range(len(bins))]
    whole = ridge(z, y)
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.score for r in q.score(frame, q.fit(frame, spark.read.parquet(f"{DATA}/labels.parquet")), keep=["doc_id"]).collect()}
    every = sorted(docs)
    final = cosines(np.stack([q.statistics((docs[d] or "").encode()) for d in every])) @ whole
    want = np.clip(np.interp(final, (bins + 0.5) * 3 / q.BINS - 1, level), 0, 1)
    assert np.allclose([got[d] for d in every], want, atol=1e-6)


def test_odd_rows(spark):
    rows = [(i, ("good words of plain prose here. " if i % 3 else "BAD!! WORSE!! ") * (1 + i % 7), "clash") for i in range(200)]
    rows += [(None, "x", None), (900, None, None), (901, "", None), (902, "é " * 40000, None), (5, rows[5][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(7, None), (None, 1), (8, 3)], "doc_id long, quality int")
    out = q.score(docs, q.fit(docs, labels)).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "held_out", "score", "predicted"}
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in out if r.doc_id is not None and r.doc_id < 200)
    same = {r.score for r in out if r.doc_id in (900, 901)}
    assert len(same) == 1
    none = q.score(docs, q.fit(docs, labels.limit(0)))
    assert {r.score for r in none.collect()} == {1.0}
    assert q.score(docs.limit(0), q.fit(docs.limit(0), labels)).count() == 0


def test_isotonic():
    rng = np.random.default_rng(0)
    v, w = rng.random(60), rng.integers(1, 5, 60).astype(float)
    out = q.isotonic(v, w)
    best = [max(min(np.average(v[a : b + 1], weights=w[a : b + 1]) for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert (np.diff(out) >= 0).all() and np.allclose(out, best)
