"""Vector expressions over ARRAY columns, and Arrow paths for many pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE = 127
#: Queries and rows that are multiplied at once, and numbers of best pairs that a task holds: 8 and 32 MB.
TILE, HELD = 1024, 4 << 20


def bound(value: Column, then) -> Column:
    """``then(value)``, which may use the value in a lambda: an array of one row makes it once, not for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Length one; a vector of zeros stays."""
    return bound(v, lambda v: bound(F.greatest(norm(v), F.lit(1e-12)), lambda size: F.transform(v, lambda x: x.cast("double") / size)))


def narrow(v: Column, dims: int) -> Column:
    """The first ``dims`` components, made a unit again; the whole vector for 0 or at least its width."""
    return unit(F.slice(v, 1, dims) if dims else v)


def quantise(v: Column, scale: Column | int = SCALE) -> Column:
    """Integers by a fixed scale: halves go to the even neighbour, the ends are clamped."""
    return F.transform(v, lambda x: F.greatest(F.lit(-SCALE), F.least(F.lit(SCALE), F.rint(x.cast("double") * scale).cast("int"))))


def quantise_query(v: Column) -> Column:
    """A query's integers: halves go up."""
    return F.transform(v, lambda x: F.greatest(F.lit(-SCALE), F.least(F.lit(SCALE), F.floor(x.cast("double") * SCALE + 0.5).cast("int"))))


def round_trip(v: Column, levels: int = SCALE) -> Column:
    """Quantised with the vector's own scale (127 levels for 8 bits, 7 for 4), taken back, and made a unit."""
    back = lambda v, top: F.transform(v, lambda x: F.rint(x.cast("double") / top * levels) * top / levels)
    return unit(bound(v, lambda v: bound(F.greatest(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), F.lit(1e-12)), lambda top: back(v, top))))


def signs(v: Column) -> Column:
    """+1 for a component above zero, else -1, as a unit vector."""
    return bound(v, lambda v: F.transform(v, lambda x: F.when(x > 0, 1.0).otherwise(-1.0) / F.sqrt(F.size(v))))


def stored(v: Column, scheme: str) -> Column:
    """A vector as a scheme keeps it: fp32, int8 (fixed scale), int4 (its own scale) or binary (signs)."""
    schemes = {"fp32": lambda: v, "int8": lambda: quantise(v), "int4": lambda: round_trip(v, 7), "binary": lambda: signs(v)}
    if scheme not in schemes:
        raise ValueError(f"no scheme {scheme!r}; there are {sorted(schemes)}")
    return schemes[scheme]()


def pack(v: Column, bits: int = 64) -> Column:
    """The signs of up to 64 components as one number, the first component highest."""
    return F.aggregate(F.slice(v, 1, bits), F.lit(0).cast("long"), lambda w, x: F.shiftleft(w, 1).bitwiseOR((x > 0).cast("long")))


def asymmetric(packed_signs: Column, query: Column, dims: int) -> Column:
    """A stored sign vector against an integer query: sum of plus or minus the query's components, as a cosine."""
    signed = lambda word: F.transform(query, lambda q, i: F.when(F.getbit(word, (dims - 1 - i).cast("int")) == 1, q).otherwise(-q))
    total = F.aggregate(bound(packed_signs, signed), F.lit(0).cast("long"), lambda s, x: s + x)
    return total / (SCALE * float(np.sqrt(dims)))


def remove_projection(q: Column, axis: Column) -> Column:
    """``q`` without its part along the unit ``axis``, made a unit again."""
    return unit(bound(dot(q, axis), lambda along: F.zip_with(q, axis, lambda x, n: x.cast("double") - along * n.cast("double"))))


def mean(frame: DataFrame, vector: str, *keys: str) -> DataFrame:
    """The component-wise mean of ``vector``, by ``keys``, as ``centre``."""
    parts = frame.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centre"))


class Nearest:
    """The ``k`` best of the rows that some queries have met: scores of nine decimals downwards, then keys upwards; of those with ``least`` alone."""

    def __init__(self, ids: np.ndarray, k: int, least: float = -np.inf):
        self.ids, self.k = ids, k
        self.at, self.keys, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), least - 2e-9)  # what a row's score must reach

    @property
    def size(self) -> int:
        return len(self.least) + 3 * len(self.at)

    def meet(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """``scores``: a row for each query, a column for each key."""
        near = ~(scores < self.least[:, None])
        if np.count_nonzero(near) > 4 * self.k * len(near) and self.k < len(keys):  # among the first rows
            near &= ~(scores < np.partition(scores, -self.k, axis=1)[:, -self.k, None] - 2e-9)
        q, row = np.nonzero(near)
        if not len(q):
            return
        new = scores[q, row]
        new = np.copysign(np.floor(np.abs(new) * 1e9 + 0.5) / 1e9, new)
        at, every, held = np.append(self.at, q), np.append(self.keys, keys[row]), np.append(self.scores, new)
        order = np.lexsort((every, np.where(np.isnan(held), -np.inf, -held), at))
        at, places = at[order], np.arange(len(at))
        place = places - np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1]), places, 0))
        kept = place < self.k
        self.at, self.keys, self.scores = at[kept], every[order[kept]], held[order[kept]]
        last = place[kept] == self.k - 1
        self.least[self.at[last]] = np.nan_to_num(self.scores[last], nan=np.inf, posinf=np.inf, neginf=-np.inf) - 2e-9


def best_pairs(rows: DataFrame, queries: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", by: str | None = None, own: bool = False, block: int = 4096) -> DataFrame:
    """query_id, key and score (of nine decimals) of the ``k`` best inner products for each query, exactly; with ``by``, of
    each of its values (a whole number, which is a result column too), or with ``own`` of the query's own value alone.

    Queries go through the driver in blocks of ``block`` vectors, and one block at a time is broadcast. A task multiplies
    tiles of ``TILE`` queries and rows, and holds no more than one tile and each query's ``k`` best so far, of which it
    gives those left at its end; where values are so many that these are beyond ``HELD`` numbers it gives them before. A
    window merges what tasks give.
    """
    from pyspark.sql import Window

    spark, parts, held = rows.sparkSession, [], []
    names, kinds = ["query_id", key, "score", *([by] if by else [])], f"query_id long, {key} long, score double" + (f", {by} long" if by else "")
    value = [F.col(by).cast("long").alias(by)] if by else []
    source = queries.select(F.col(key).alias("query_id"), vector, *(value if own else []))

    def against(block_rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in block_rows]), np.array([r[1] for r in block_rows], dtype=np.float64), np.array([r[2] for r in block_rows]) if own else None))

        def given(best: dict) -> Iterator[pa.RecordBatch]:
            for (group, _), b in best.items():
                columns = [pa.array(b.ids[b.at]), pa.array(b.keys), pa.array(b.scores)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(np.full(len(b.at), group), pa.int64())] if by else []), names=names)
            best.clear()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, wanted, values = shared.value
            best: dict[tuple[int, int], Nearest] = {}
            size = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                every, matrix = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                groups = batch.column(2).to_numpy(zero_copy_only=False) if by else np.zeros(batch.num_rows, np.int64)
                order = np.argsort(groups, kind="stable")
                for of_group in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
                    group = groups[of_group[0]].item()
                    asked = np.flatnonzero(values == group) if own else np.arange(len(ids))
                    for a in range(0, len(asked), TILE):
                        some = asked[a : a + TILE]
                        b = best.setdefault((group, a), Nearest(ids[some], k))
                        size -= b.size if len(b.at) else 0
                        for c in range(0, len(of_group), TILE):
                            part = of_group[c : c + TILE]
                            b.meet(wanted[some] @ matrix[part].astype(np.float64).T, every[part])
                        size += b.size
                        if size > HELD:
                            yield from given(best)
                            size = 0
            yield from given(best)

        return rows.select(key, vector, *value).mapInArrow(run, kinds)

    for row in source.toLocalIterator():
        held.append(row)
        if len(held) == block:
            parts.append(against(held))
            held = []
    if held or not parts:
        parts.append(against(held) if held else spark.createDataFrame([], kinds))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = Window.partitionBy("query_id", *([by] if by else [])).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
