import math

import numpy as np
import pytest

from binledger.llm import catalog, hnsw, neighbours


def brute_force(rows):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[i]][:5]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    """Share of true neighbours found, ties at the last place counting alike."""
    hits = total = 0
    for q, near in want.items():
        least = near[-1][1] - 1e-9
        hits += sum(s >= least for _, s in got.get(q, []))
        total += len(near)
    return hits / total


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("shard_rows", [4096, 150])
def test_recall_on_the_table(spark, sf_dir, shard_rows):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute_force([(r.vec_id, r.embedding) for r in table.collect()])
    got = by_query(neighbours.nearest(table, neighbours.F.col("vec_id") % 50 == 0, shard_rows).collect())
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.95
    exact = {(q, v): s for q, near in want.items() for v, s in near}
    assert all(abs(s - exact[q, v]) < 1e-12 for q, near in got.items() for v, s in near if (q, v) in exact)
    if shard_rows == 4096:
        assert by_query(catalog.op5_nearest_neighbours(spark, sf_dir).collect()) == got


def test_recall_of_a_full_shard():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4096, 64)) + rng.normal(size=(10, 64))[rng.integers(0, 10, 4096)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    layers = hnsw.build(x, 1)
    found = hnsw.search(x, layers, x[:200], neighbours.BEAM)[:, :5]
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, true)]) >= 0.95


def test_ties_repeats_and_odd_rows(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 3000)]  # one very common vector
    rows += [(50, [1.0, 0.0, 0.0]), (4000, [0.0, 1.0, 0.0]), (4001, [0.0, 3.0, 0.0]), (4050, [1.0, 1.0])]
    rows += [(5000, None), (5050, [0.0, 0.0, 0.0]), (5100, [1.0, None, 0.0]), (5150, [float("nan"), 1.0, 0.0]), (5200, [math.inf, 1.0, 0.0]), (5250, []), (None, [1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank")
    got = by_query(neighbours.nearest(table, neighbours.F.col("vec_id") % 50 == 0).collect())
    assert set(got) == {*range(0, 3000, 50), 4000}
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for v, _ in got[50]] == [0, 1, 2, 3, 4]
    assert got[4000][0] == (4001, 1.0) and [v for v, _ in got[4000][1:]] == [0, 1, 2, 3]
    assert neighbours.nearest(table.limit(0), neighbours.F.col("vec_id") % 50 == 0).count() == 0
