"""Sparse traces: equal to traces of all bins, with null entities, hot entities and huge spans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import bursts


def replay(times, width, on):
    """Features of one trace from all its bins."""
    t = np.array(times)
    n_bins = max(1, int(np.ceil((t.max() - t.min()) / width)))
    x = np.bincount(np.minimum(((t - t.min()) / width).astype(int), n_bins - 1), minlength=n_bins)
    flag = x >= on
    edges = np.flatnonzero(np.append(True, flag[1:] != flag[:-1]))
    runs = [(bool(flag[a]), int(a), int(b - a)) for a, b in zip(edges, np.append(edges[1:], n_bins))]
    points = []
    for k in range(2, int(np.log2(n_bins))):
        size, rs = 2**k, []
        for j in range(n_bins // size):
            v = x[j * size : (j + 1) * size]
            if v.std(ddof=1) > 1e-12:
                c = np.cumsum(v - v.mean())
                rs.append((c.max() - c.min()) / v.std(ddof=1))
        if rs:
            points.append((np.log(size), np.log(np.mean(rs))))
    hurst = float(np.polyfit(*zip(*points), 1)[0]) if len(points) > 1 else 0.5
    return x, runs, hurst


@pytest.mark.parametrize("on", [1, 2])
def test_sparse_equals_all_bins(spark, on):
    rng = np.random.default_rng(on)
    traces = {"a": rng.uniform(0, 500, 60), "b": rng.uniform(0, 80, 400), None: rng.uniform(0, 90, 20), "one": np.array([5.0]), "two": np.array([1.0, 300.0]), "even": np.arange(0, 64.5, 0.5)}
    df = spark.createDataFrame([(e, float(t)) for e, v in traces.items() for t in v] + [("a", None)], "e string, t double").repartition(5)
    got = {r.e: r for r in bursts.burst_features(df, "e", "t", 1.0, on).collect()}
    runs = {}
    for r in bursts.sparse_runs(bursts.occupied_bins(df, "e", "t", 1.0), "e", on).collect():
        runs.setdefault(r.e, []).append((r._on == 1, r.start, r.length))
    dense = {}
    for r in bursts.bin_counts(df, "e", "t", 1.0).collect():
        dense.setdefault(r.e, {})[r.bin] = r.n
    assert set(got) == set(traces)
    for e, v in traces.items():
        x, want, hurst = replay(v, 1.0, on)
        assert sorted(runs[e], key=lambda r: r[1]) == want
        assert [dense[e][i] for i in range(len(x))] == x.tolist() and len(dense[e]) == len(x)
        assert np.isclose(got[e].hurst, hurst, atol=1e-9) and got[e].n_bursts == sum(f for f, _, _ in want)
        off = [n for f, _, n in want if not f]
        assert np.isclose(got[e].mean_off, np.mean(off) if off else 0.0) and np.isclose(got[e].arrival_rate, len(v) / len(x))


def test_a_billion_bins(spark):
    df = spark.range(1000).select(F.lit("e").alias("e"), (F.col("id") * 1_000_003.0 + F.when(F.col("id") % 7 == 0, 0.4).otherwise(0.0)).alias("t"))
    r = bursts.burst_features(df, "e", "t", 1.0).first()
    assert r.n_bursts == 1000 and r.mean_on == 1.0 and 900_000 < r.mean_off < 1_100_000 and 0 < r.hurst < 1


def test_runs_of_any_flags(spark):
    flags = ["x", "x", "y", None, None, "x", "y", "y"]
    df = spark.createDataFrame([(e, i, f) for e in ("a", None) for i, f in enumerate(flags)], "e string, bin int, f string").repartition(3)
    got = sorted((r.start, r.f, r.length) for r in bursts.run_lengths(df, "e", "bin", "f").where("e is null").collect())
    assert got == [(0, "x", 2), (2, "y", 1), (3, None, 2), (5, "x", 1), (6, "y", 2)]


def test_empty(spark):
    df = spark.createDataFrame([], "e string, t double")
    assert bursts.burst_features(df, "e", "t", 1.0).count() == 0 and bursts.bin_counts(df, "e", "t", 1.0).count() == 0
