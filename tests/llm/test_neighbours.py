import numpy as np
from folioscope.llm import neighbours as n


def brute(rows, k):
    """{query: [(rank, id, score)]} over sound rows, smallest vector of each id."""
    best = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = tuple(np.float32(v).tolist())
        best[i] = min(best.get(i, v), v)
    out = {}
    for q, v in best.items():
        if q % 20 == 0:
            scores = sorted((-float((np.array(w) * np.array(v)).sum()), i) for i, w in best.items() if i != q and len(w) == len(v))
            out[q] = [(r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def rows(rng, count, dims=24):
    centres = rng.normal(size=(8, dims))
    return [(i, (centres[i % 8] + rng.normal(size=dims) * 0.7).astype(np.float32).tolist()) for i in range(count)]


def run(spark, data, k=20, shard=n.SHARD):
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<float>, score string")
    out = {}
    for r in n.search(n.index(df, shard=shard), df.where("vec_id % 20 = 0"), k=k).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_recall(spark):
    data = rows(np.random.default_rng(3), 3000)
    got, want = run(spark, data, shard=700), brute(data, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({x[1] for x in got[q]} & {x[1] for x in want[q]}) / 20 for q in want]) > 0.95


def test_odd_rows_ties_and_copies(spark):
    rng = np.random.default_rng(4)
    data = rows(rng, 60, 5)
    data += [(100 + i, data[3][1]) for i in range(150)] + [(None, [1.0] * 5), (400, None), (420, []), (440, [0.0] * 5), (460, [1.0, None, 1.0, 1.0, 1.0]), (480, [float("nan")] * 5), (500, [float("inf")] * 5)]
    data += [(520, [1.0, 2.0]), (521, [2.0, 1.0]), (540, [3.0]), (7, data[8][1]), (7, data[7][1]), (20, data[20][1])]
    got, want = run(spark, data, shard=64), brute(data, 20)
    want = {q: v for q, v in want.items() if v}
    assert {q: [x[:2] for x in v] for q, v in got.items()} == {q: [x[:2] for x in v] for q, v in want.items()}
    assert all(np.allclose([x[2] for x in got[q]], [x[2] for x in want[q]]) for q in want)
    assert run(spark, [(None, None)]) == {}


def test_the_graph_is_reached_by_walking():
    rng = np.random.default_rng(5)
    data = rng.normal(size=(4000, 16)).astype(np.float32)
    graph = n.Graph(np.arange(4000), data, 1)
    seen, todo = {graph.entry}, [graph.entry]
    while todo:
        for x in graph.levels[0][todo.pop()].tolist():
            if x >= 0 and x not in seen:
                seen.add(x)
                todo.append(x)
    assert len(seen) > 0.99 * len(graph.unit)
    best = np.argsort(-(data[:200] @ data.T), 1)[:, 1:11]
    found = {i: set(o.tolist()) for i, o, _ in graph.nearest(np.arange(200), data[:200], 10, n.BEAM)}
    assert np.mean([len(found[i] & set((b if i not in b else b[b != i]).tolist())) / 10 for i, b in enumerate(best)]) > 0.8
