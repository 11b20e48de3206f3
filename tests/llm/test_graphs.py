"""Nearest vectors against brute force: recall, and exact scores and order of what is found."""

import numpy as np
import pytest

from sparkloom.llm import graphs


def brute(rows, asking, k):
    """(query_id, rank, vec_id, score) over all candidates, in plain doubles."""
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    queries = {}
    for i, v in sorted(((i, v) for i, v in ok if asking(i)), reverse=True):
        queries[i] = v
    out = []
    for q, v in queries.items():
        dot = lambda a: sum(float(np.float32(x)) * float(np.float32(y)) for x, y in zip(a, v))
        found = sorted((-dot(w), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, k=20, shard_rows=graphs.SHARD_ROWS, asking="vec_id % 20 = 0", **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, shard string").repartition(3)
    return sorted(tuple(r) for r in graphs.nearest(graphs.write_index(df, shard_rows), df.where(asking), k, **more).collect())


def test_small_and_odd_rows_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(90)]
    rows += [(100, None), (120, []), (140, [0.0] * 4), (160, [1.0, None, 0.0, 0.0]), (180, [float("nan"), 1.0, 1.0, 1.0]), (200, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    rows += [(300 + i, [0.5, 0.5, -0.5, 1.0]) for i in range(60)]  # copies: ties by id
    rows += [(1000 + i, [1.0 + i, 2.0]) for i in range(30)]  # of another length
    rows += [(20, rows[20][1]), (21, rows[21][1])]  # repeated rows
    got, expected = run(spark, rows), brute(rows, lambda i: i % 20 == 0, 20)
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert [r[3] for r in got] == [r[3] for r in expected]


def test_shards_and_blocks_are_merged(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    expected = brute(rows, lambda i: i % 20 == 0, 10)
    got = run(spark, rows, 10, shard_rows=100, block_bytes=600)
    assert [r[:3] for r in got] == [r[:3] for r in expected]


def test_few_candidates_and_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(20, [1.0, 0.0])]) == []
    assert run(spark, [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.1])]) == [(20, 1, 1, 0.5), (20, 2, 2, 0.5)]
    assert run(spark, [(20, [1.0, 0.0]), (1, [1.0, 0.0])], asking="vec_id = 7") == []


@pytest.mark.parametrize("norms", ["equal", "spread"])
def test_recall(norms):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(50, 32))
    vectors = centres[rng.integers(0, 50, 6000)] + rng.normal(size=(6000, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if norms == "spread":
        vectors *= rng.lognormal(0, 0.5, (6000, 1))
    vectors = vectors.astype(np.float32)
    ids = np.arange(6000)
    row = graphs._row(0, ids, vectors).to_pylist()[0]
    found = [np.concatenate(x) for x in zip(*graphs._searched(row, ids[::20], vectors[::20], 20, graphs.EF))]
    scores = vectors[::20].astype(float) @ vectors.astype(float).T
    scores[np.arange(300), ids[::20]] = -np.inf
    truth = np.argsort(-scores, 1)[:, :20]
    assert np.mean([len(set(found[1][found[0] == q]) & set(truth[q])) / 20 for q in range(300)]) >= 0.9


def test_neighbours_are_within_their_layer():
    vectors = np.random.default_rng(3).normal(size=(1500, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    layers = graphs.build(vectors)
    assert sorted(layers[0][0].tolist()) == list(range(1500)) and len(layers) > 1
    for height, (nodes, links) in enumerate(layers):
        assert len(links) == len(nodes) and links.shape[1] >= graphs.M * (2 if height == 0 else 1)
        assert set(links[links >= 0].tolist()) <= set(nodes.tolist())
