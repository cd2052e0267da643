"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard, shard results merged.

Rows are dealt by a hash of vec_id over shards of about ``SHARD`` rows, whatever the number of rows. A shard's distinct
vectors are joined into a hierarchical graph, kept as flat neighbour arrays with a list of the ids of each vector, and
written to the shared folder. Vectors get one more component that makes their norms equal, so that the largest inner
product is also the nearest neighbour. Nodes come in random order, up to ``BLOCK`` at once: each walks the graph of those so far
with a beam of ``WIDTH``, is linked to diverse ones of those it meets (and of those that come with it), and full nodes keep
the most diverse of their links, so that early nodes keep long ones.

Queries go to every shard in blocks. A block walks the graph at once: down the levels greedily, then with a beam of
``BEAM`` on the lowest. Each shard's best rows, scored in double precision on the original vectors, are merged by rank.

Defined results: null ids, and vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors are compared with those of equal length only; rows with equal ids and lengths count once, with the smallest vector;
ties go to the smaller id; extra columns take no part; an empty table has no results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut

SHARD, BLOCK = 8192, 512
LINKS, WIDTH, BEAM = 16, 64, 128


def _diverse(near: np.ndarray, sims: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 pads), up to ``keep``: those nearer to the row's node than to any kept
    one first, then the best of the others; -1 pads."""
    held = vectors[near]
    gram = held @ held.transpose(0, 2, 1)
    rows, width = near.shape
    kept = np.zeros((rows, width), bool)
    for j in range(width):
        near_kept = (kept[:, :j] & (gram[:, j, :j] > sims[:, j, None])).any(1)
        kept[:, j] = (near[:, j] >= 0) & ~near_kept & (kept[:, :j].sum(1) < keep)
    order = np.argsort(np.where(near < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")
    return np.take_along_axis(near, order, 1)[:, :keep]


class Graph:
    """Levels of flat neighbour arrays over distinct vectors; ``ids[first[i]:first[i + 1]]`` have vector ``i``."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, seed: int):
        order = np.lexsort((ids,))
        ids, rows = ids[order], rows[order]
        self.vectors, which = np.unique(rows, axis=0, return_inverse=True)
        by = np.argsort(which.ravel(), kind="stable")
        self.ids = ids[by]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(which.ravel(), minlength=len(self.vectors)))])
        norms = (self.vectors.astype(np.float64) ** 2).sum(1)
        top = norms.max()
        self.unit = np.hstack([self.vectors, np.sqrt(np.maximum(top - norms, 0))[:, None]]).astype(np.float32) / np.float32(np.sqrt(top))
        rng = np.random.default_rng(seed)
        n = len(self.unit)
        height = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 6)
        line = rng.permutation(n)
        self.levels = []
        for level in range(height.max() + 1):
            nodes = line[height[line] >= level]
            self.levels.append(self._level(nodes, 2 * LINKS if level == 0 else LINKS))
        self.entry = int(line[height[line] == height.max()][0])

    def _level(self, nodes: np.ndarray, limit: int) -> np.ndarray:
        """The links of one level. Nodes come in their order, some at once: each walks the graph of those before it."""
        links, done = np.full((len(self.unit), limit), -1, np.int32), min(len(nodes), 2 * WIDTH)
        self._insert(links, nodes[:done], self._near(nodes[:done], nodes[:done]), limit)
        while done < len(nodes):
            new = nodes[done : done + min(BLOCK, max(WIDTH, done // 4))]
            found = self._walk(links, np.full(len(new), nodes[0]), self.unit[new], WIDTH)
            own = self._near(new, new)  # those that come at once don't stand in the graph yet
            self._insert(links, new, np.hstack([found, own]), limit)
            done += len(new)
        return links

    def _near(self, new: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Each new node's nearest of a bounded number of nodes."""
        sims = self.unit[new] @ self.unit[seen].T
        sims[new[:, None] == seen] = -np.inf
        width = max(1, min(LINKS, len(seen) - 1))
        best = np.argpartition(-sims, width - 1, 1)[:, :width]
        return np.where(np.isfinite(np.take_along_axis(sims, best, 1)), seen[best], -1)

    def _insert(self, links: np.ndarray, new: np.ndarray, near: np.ndarray, limit: int) -> None:
        """Links new nodes to diverse ones of those found ``near`` them, and these back."""
        sims = np.where(near < 0, -np.inf, np.einsum("nd,nkd->nk", self.unit[new], self.unit[near]))
        order = np.argsort(-sims, 1, kind="stable")[:, :WIDTH]
        near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
        picked = _diverse(near, sims, self.unit, min(limit, LINKS))
        links[new, : picked.shape[1]] = picked
        to, origin = picked.ravel(), np.repeat(new, picked.shape[1])
        origin, to = origin[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        origin, to = origin[order], to[order]
        while len(to):  # some of each node's new links in a round, so that a hub's many don't widen the arrays
            starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            place = np.arange(len(to)) - np.repeat(starts, np.diff(np.append(starts, len(to))))
            now = place < LINKS
            targets, row = to[starts], np.cumsum(np.append(True, to[1:] != to[:-1])) - 1
            near = np.full((len(targets), limit + LINKS), -1, np.int64)
            near[:, :limit] = links[targets]
            fresh = ~(near[row[now], :limit] == origin[now, None]).any(1)
            near[row[now][fresh], limit + place[now][fresh]] = origin[now][fresh]
            sims = np.where(near < 0, -np.inf, np.einsum("nd,nkd->nk", self.unit[targets], self.unit[near]))
            order = np.argsort(-sims, 1, kind="stable")
            near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
            full = (near >= 0).sum(1) > limit
            links[targets[~full]] = near[~full, :limit]
            if full.any():
                links[targets[full]] = _diverse(near[full], sims[full], self.unit, limit)
            origin, to = origin[~now], to[~now]

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """For each query, up to ``beam`` vectors found near it (-1 pads), in no order."""
        n, q = len(self.unit), len(queries)
        wanted = np.hstack([queries, np.zeros((q, 1))]).astype(np.float32)
        sims_of = lambda near: np.where(near < 0, -np.inf, np.einsum("qd,qkd->qk", wanted, self.unit[near]))
        at = np.full(q, self.entry)
        best = np.einsum("qd,qd->q", wanted, self.unit[at])
        for links in self.levels[:0:-1]:
            while True:
                near = links[at]
                sims = sims_of(near)
                top = sims.argmax(1)
                found = sims[np.arange(q), top]
                better = found > best
                if not better.any():
                    break
                at, best = np.where(better, near[np.arange(q), top], at), np.where(better, found, best)
        return self._walk(self.levels[0], at, wanted, min(beam, n))

    def _walk(self, links: np.ndarray, at: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
        """For each row of ``wanted``, up to ``width`` nodes near it that a beam from ``at`` meets over ``links`` (-1 pads)."""
        q, rows = len(wanted), np.arange(len(wanted))
        held, sims, open_ = np.full((q, width), -1, np.int64), np.full((q, width), -np.inf, np.float32), np.zeros((q, width), bool)
        held[:, 0], sims[:, 0], open_[:, 0] = at, np.einsum("qd,qd->q", wanted, self.unit[at]), True
        seen = np.zeros((q, len(self.unit)), bool)
        seen[rows, at] = True
        live = rows
        while len(live):
            pick = np.where(open_[live], sims[live], -np.inf).argmax(1)
            on = open_[live, pick]
            live, pick = live[on], pick[on]
            if not len(live):
                break
            open_[live, pick] = False
            near = links[held[live, pick]].astype(np.int64)
            near[seen[live[:, None], near] & (near >= 0)] = -1
            r, c = np.nonzero(near >= 0)
            seen[live[r], near[r, c]] = True
            more = np.where(near < 0, -np.inf, np.einsum("qd,qkd->qk", wanted[live], self.unit[near]))
            all_held, all_sims = np.hstack([held[live], near]), np.hstack([sims[live], more])
            all_open = np.hstack([open_[live], near >= 0])
            top = np.argpartition(-all_sims, width - 1, 1)[:, :width]
            held[live], sims[live], open_[live] = (np.take_along_axis(x, top, 1) for x in (all_held, all_sims, all_open))
        return np.where(np.isfinite(sims), held, -1)

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, scores) of each query's ``k`` nearest found, its own row left out."""
        found = self.search(queries, max(beam, k + 1))
        for own, query, near in zip(ids.tolist(), queries.astype(np.float64), found, strict=True):
            near = near[near >= 0]
            scores = (self.vectors[near].astype(np.float64) * query).sum(1)
            size = np.minimum(np.diff(self.first)[near], k + 1)  # of equal vectors only the smallest ids can be among k
            rows = np.repeat(self.first[near], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            others, scores = self.ids[rows], np.repeat(scores, size)
            kept = others != own
            others, scores = others[kept], scores[kept]
            order = np.lexsort((others, -scores))[:k]
            yield own, others[order], scores[order]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _graph(table: pa.Table) -> pa.Table:
    """One shard's rows to its graph."""
    ids, rows = table.column("vec_id").to_numpy(), _matrix(table.column("embedding").combine_chunks())
    order = np.lexsort((*rows.T[::-1], ids))
    ids, rows = ids[order], rows[order]
    first = np.append(True, ids[1:] != ids[:-1])
    dims, shard = table.column("dims")[0].as_py(), table.column("shard")[0].as_py()
    data = pickle.dumps(Graph(ids[first], rows[first], shard))
    return pa.table({"dims": pa.array([dims], pa.int32()), "shard": pa.array([shard], pa.int64()), "graph": pa.array([data], pa.binary())})


def _block(table: pa.Table) -> pa.Table:
    """Some queries to one row that holds them."""
    data = pickle.dumps((table.column("vec_id").to_numpy(), _matrix(table.column("embedding").combine_chunks())))
    return pa.table({"dims": pa.array([table.column("dims")[0].as_py()], pa.int32()), "queries": pa.array([data], pa.binary())})


def _searcher(k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, graph = None, None
            for data, queries in zip(batch.column("graph"), batch.column("queries"), strict=True):
                if last is None or data.as_buffer() != last:
                    last, graph = data.as_buffer(), pickle.loads(data.as_buffer())
                ids, rows = pickle.loads(queries.as_buffer())
                for at in range(0, len(ids), BLOCK):
                    found = list(graph.nearest(ids[at : at + BLOCK], rows[at : at + BLOCK], k, beam))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(np.concatenate([f[2] for f in found]), pa.float64())],
                        names=["query_id", "vec_id", "score"],
                    )

    return run


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding and dims of the rows that take part."""
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).withColumn("dims", F.size("embedding"))


def index(rows: DataFrame, *, shard: int = SHARD) -> DataFrame:
    """The graphs of all rows: dims, shard, graph; cut in the shared folder."""
    sound = usable(rows)
    counts = {r.dims: r["count"] for r in sound.groupBy("dims").count().collect()}
    shards = F.coalesce(*(F.when(F.col("dims") == d, F.lit(-(-n // shard))) for d, n in counts.items()), F.lit(1))
    dealt = sound.withColumn("shard", F.pmod(F.xxhash64("vec_id"), shards))
    return cut(dealt.groupBy("dims", "shard").applyInArrow(_graph, "dims int, shard long, graph binary"), "neighbours")


def search(graphs: DataFrame, queries: DataFrame, *, k: int = 20, beam: int = BEAM, block: int = 4 * BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query row's ``k`` nearest rows found in ``graphs``."""
    sound = usable(queries).groupBy("vec_id", "dims").agg(F.min("embedding").alias("embedding"))
    blocks = sound.count() // block + 1
    held = sound.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("dims", "_block").applyInArrow(_block, "dims int, queries binary")
    everywhere = held.join(graphs.groupBy("dims").agg(F.collect_list("shard").alias("_shards")), "dims").withColumn("shard", F.explode("_shards")).drop("_shards")
    pairs = graphs.join(everywhere, ["dims", "shard"]).select("shard", "graph", "queries").sortWithinPartitions("shard")
    found = pairs.mapInArrow(_searcher(k, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
