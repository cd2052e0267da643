"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Each whole text is described by ``STATISTICS``. A Gaussian kernel over the standardised statistics is approximated by
``FEATURES`` random cosines; each partition sums its part of the normal equations, by fold, and the sums of the sums are
solved for ridge weights. Raw scores of training rows, each made by the model that didn't see the row's fold, are
counted in ``BINS`` fixed bins and calibrated by pooling adjacent violators. What reaches the driver has a size that
doesn't depend on the input.

Only rows whose crc32(doc_id) mod 4 isn't 2 are learnt from; labels, language, source and id are never inputs of a score.

Defined results: a null or empty text has the statistics of an empty one and a score like any; equal texts have equal
scores; null ids are never learnt from and aren't held out; labels without 0 or 1 take no part; without labels of both
kinds every score is the labels' mean (1.0 without labels: nothing is rejected); extra columns pass through, and those
named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut, steps, texts

STATISTICS = (
    "log_words", "mean_word", "upper", "digits", "spaces", "newlines", "stops", "commas", "exclamations", "pipes", "marks", "other_ascii",
    "beyond_ascii", "repeats", "distinct", "capital_words", "byte_entropy", "repeated_lines",
)
FEATURES, WIDTH, RIDGE, BINS, THRESHOLD = 256, 3.0, 1.0, 3000, 0.7
#: The folds that are learnt from; fold 2 is held out.
FOLDS = (0, 1, 3)
_PARTS = 16
_NAMES = ("held_out", "score", "predicted")


def _classes() -> np.ndarray:
    """For each byte value, one column for each statistic that is a share of bytes."""
    sets = (range(65, 91), range(48, 58), b" ", b"\n", b".?", b",;:", b"!", b"|", b"#$%&*@^~+=<>{}\\", b"\"'()/[]_`-", range(128, 256))
    out = np.zeros((256, len(sets)))
    for k, members in enumerate(sets):
        out[list(members), k] = 1
    return out


_SHARES = _classes()


def statistics(text: bytes) -> np.ndarray:
    """The ``STATISTICS`` of one whole text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, words = max(1, len(text)), text.split()
    n = max(1, len(words))
    share = counts[counts > 0] / size
    lines = [x for x in text.split(b"\n") if x]
    capital = sum(map(bytes.isupper, words))
    whole = (
        np.log1p(len(words)), min(40.0, (size - counts[32] - counts[10]) / n), *(counts @ _SHARES / size),
        sum(map(eq, words, words[1:])) / n, len(set(words)) / n, capital / n, float(-(share * np.log2(share)).sum()), 1 - len(set(lines)) / max(1, len(lines)),
    )
    return np.array(whole)


def _describe(text: str, keep: list[str], then=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text, 8 << 20):
            x = np.stack([statistics(t) for t in texts(batch.column(text))])
            out = then(x) if then else pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out], names=[*keep, "score" if then else "x"])

    return run


class Model:
    """Standardisation, cosines, weights and calibration; a few hundred numbers whatever it was fitted on."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights: dict[int, np.ndarray] = {}
        self.knots = (np.array([0.0]), np.array([1.0]))

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray, fold: int) -> np.ndarray:
        return self.expand(x) @ self.weights[fold]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.knots[1][0])
        return np.clip(np.interp(self.raw(x, -1), *self.knots), 0, 1)


def _normal(model: Model):
    """By fold, this partition's sums of z z' and z y, in ``_PARTS`` pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((FEATURES + 1, FEATURES + 2)) for k in FOLDS}
        for batch in batches:
            x = np.array(batch.column("x").to_pylist())
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for k in FOLDS:
                if (own := fold == k).any():
                    z = model.expand(x[own])
                    sums[k] += z.T @ np.hstack([z, y[own, None]])
        rows = [(k, i, part.tobytes()) for k, s in sums.items() if s.any() for i, part in enumerate(np.array_split(s.ravel(), _PARTS))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["fold", "part", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for key in zip(batch.column("fold").to_pylist(), batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            part = np.frombuffer(key[2])
            total[key[:2]] = total[key[:2]] + part if key[:2] in total else part.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([i for _, i in total], pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["fold", "part", "sums"])


def _bins(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, fold = np.array(batch.column("x").to_pylist()), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            raw = np.zeros(len(y))
            for k in FOLDS:
                if (own := fold == k).any():
                    raw[own] = model.raw(x[own], k)
            at = np.clip((raw + 1) * (BINS / 3), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y)], names=["bin", "y"])

    return run


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted squares: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fold_of(doc_id: str):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model of P(label = 1) from the labelled documents outside the held-out fold."""
    y = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("y"))
    x = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where(F.col("_id").isNotNull() & (fold_of("_id") != 2))
    described = x.mapInArrow(_describe("_text", ["_id"]), T.StructType([x.schema["_id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))
    rows = cut(described.join(y, "_id").select("x", "y", fold_of("_id").alias("fold")), "quality")
    one = lambda k: F.get("x", F.lit(k))
    facts = rows.agg(
        F.count("y").alias("n"), F.avg("y").alias("y"),
        F.array(*(F.avg(one(k)) for k in range(len(STATISTICS)))).alias("mean"), F.array(*(F.stddev_pop(one(k)) for k in range(len(STATISTICS)))).alias("scale"),
    ).first()
    if not facts.n or facts.y in (0.0, 1.0):
        model = Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
        model.knots = (np.array([0.0]), np.array([facts.y if facts.n else 1.0]))
        return model
    model = Model(np.array(facts.mean), np.maximum(np.array(facts.scale), 1e-3))
    kinds = "fold int, part int, sums binary"
    parts = rows.mapInArrow(_normal(model), kinds).repartition(_PARTS, "part").mapInArrow(_add, kinds).collect()
    sums = {k: np.concatenate([np.frombuffer(r.sums) for r in sorted((r for r in parts if r.fold == k), key=lambda r: r.part)]).reshape(FEATURES + 1, FEATURES + 2) for k in {r.fold for r in parts}}
    total = sum(sums.values())
    for k in (*FOLDS, -1):
        s = total - sums.get(k, 0)
        model.weights[k] = np.linalg.solve(s[:, :-1] + RIDGE * np.eye(FEATURES + 1), s[:, -1])
    counted = rows.mapInArrow(_bins(model), "bin int, y double").groupBy("bin").agg(F.count("y").alias("n"), F.sum("y").alias("y")).collect()
    bins = np.array(sorted((r.bin, r.n, r.y) for r in counted), dtype=float)
    level = isotonic(bins[:, 2] / bins[:, 1], bins[:, 1])
    model.knots = ((bins[:, 0] + 0.5) * 3 / BINS - 1, level)
    return model


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (or its columns ``keep``) with held_out, score and predicted."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in _NAMES]
    rows = docs.select(*dict.fromkeys([*names, text]))
    out = rows.mapInArrow(_describe(text, names, lambda x: pa.array(model.score(x))), T.StructType([*(rows.schema[c] for c in names), T.StructField("score", T.DoubleType())]))
    return out.select(*names, F.coalesce(fold_of(doc_id) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
