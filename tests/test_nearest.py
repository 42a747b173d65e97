"""Nearest neighbours by pivots and most similar patterns in blocks, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import joins


def frame(spark, vectors, parts=4, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(parts)


def nearest(queries, rows, k):
    out = {}
    for i, q in queries:
        d = sorted((float(np.sqrt(((np.array(r) - np.array(q)) ** 2).sum())), j) for j, r in rows if j != i and len(r) == len(q))
        out[i] = [(j, x) for x, j in d[:k]]
    return out


@pytest.mark.parametrize("block_rows,query_rows", [(40, 25), (300, 4096), (8192, 4096)])
def test_neighbours_equal_all_pairs(spark, block_rows, query_rows):
    rng = np.random.default_rng(block_rows)
    centres = rng.normal(size=(12, 6)) * 50
    x = [*(centres[rng.integers(0, 12, 500)] + rng.normal(size=(500, 6))), *[centres[0]] * 60, *rng.normal(size=(30, 6)) * 300]
    x = [v.round(2).tolist() for v in x] + [[1.0, 2.0]] * 3 + [[5.0]]
    df = frame(spark, x)
    stats = {}
    got = {}
    for r in joins.knn_join(df, df, "id", "v", 4, query_rows, block_rows, stats).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.neighbor, r.dist)
    want = nearest(list(enumerate(x)), list(enumerate(x)), 4)
    for i, near in want.items():
        mine = [got.get(i, {}).get(n + 1) for n in range(len(near))]
        assert [j for j, _ in near] == [m[0] for m in mine] and np.allclose([d for _, d in near], [m[1] for m in mine]), i
    assert stats["all_pairs"] == 590**2 + 3**2 + 1
    assert stats["pairs"] <= stats["all_pairs"] and (block_rows > 40 or stats["pairs"] < stats["all_pairs"] / 2)


def test_clusters_meet_few_rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 8)) * 100
    x = centres[np.arange(3000) % 30] + rng.normal(size=(3000, 8))
    df, stats = frame(spark, x), {}
    assert joins.knn_join(df.where("id < 300"), df, "id", "v", 3, block_rows=100, stats=stats).count() == 900
    assert stats["all_pairs"] == 900_000 and stats["pairs"] < 90_000


def test_vectors_that_are_not_finite(spark):
    x = [[0.0, 0.0], [1.0, 0.0], [float("nan"), 0.0], [float("inf"), 1.0], [1e200, 0.0], *[[float(i), 9.0] for i in range(40)]]
    df = frame(spark, x)
    got = joins.knn_join(df, df, "id", "v", 1, block_rows=10).collect()
    assert not {2, 3, 4} & ({r.id for r in got} | {r.neighbor for r in got}) and len(got) == 42


@pytest.mark.parametrize("limit", [100_000, 0])
def test_patterns_equal_all_pairs(spark, limit):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(120, 5))
    p[60:] = p[:60] * 2.0  # the same directions: the smaller id wins
    v = np.concatenate([rng.normal(size=(200, 5)), p[:10], np.zeros((1, 5))])
    rows = frame(spark, v).unionByName(spark.createDataFrame([(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None])], "id long, v array<double>"))
    library = frame(spark, p, first=7).withColumnRenamed("id", "pattern_id").unionByName(spark.createDataFrame([(1, None), (2, [0.0] * 5)], "pattern_id long, v array<double>"))
    got = {r.id: r for r in joins.cosine_best_match(rows, library, "id", "v", 0.8, limit=limit, block_rows=50, block_patterns=30).collect()}
    assert set(got) == set(range(211))
    for i, x in enumerate(v[:-1]):
        sim = p @ x / np.linalg.norm(p, axis=1) / np.linalg.norm(x)
        assert np.isclose(got[i].similarity, sim.max()) and got[i].pattern_id - 7 == int(np.flatnonzero(np.isclose(sim, sim.max(), atol=1e-12))[0]) and got[i].matched == (sim.max() >= 0.8)
    assert (got[210].pattern_id, got[210].similarity, got[210].matched) == (2, 0.0, False)


def test_no_pairs_as_rows(spark):
    plan = joins.cosine_best_match(frame(spark, np.eye(3)), frame(spark, np.eye(3)).withColumnRenamed("id", "pattern_id"), "id", "v", limit=0)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    assert joins.cosine_best_match(frame(spark, np.eye(3)).limit(0), frame(spark, np.eye(3)).withColumnRenamed("id", "pattern_id"), "id", "v", limit=0).count() == 0
