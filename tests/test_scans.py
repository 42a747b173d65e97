"""Linear recursions as scans: equal to their chains, whatever the partitions, and spread over tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import detectors, measurements, scans


def rows_of(n=3000, seed=2):
    """A key with most of the rows, small ones, a null one, nulls in a column, and keys of one row."""
    rng = np.random.default_rng(seed)
    keys = ["hot"] * (n // 2) + [f"k{i % 40}" for i in range(n // 2 - 30)] + [None] * 20 + [f"one{i}" for i in range(10)]
    rows = [(k, i, float(x), float(y)) for i, (k, x, y) in enumerate(zip(keys, rng.normal(50, 20, n), rng.normal(size=n)))]
    bad = next(i for i, r in enumerate(rows) if r[0] == "k3" and i > n // 2 + 400)
    rows[bad] = (*rows[bad][:2], None, 1.0)
    return [rows[i] for i in rng.permutation(len(rows))]


def nan(x):
    return np.nan if x is None else x


def frame(spark, rows, parts):
    return spark.createDataFrame(rows, "u string, t int, x double, y double").repartition(parts)


@pytest.fixture(params=[True, False], ids=["few_ranges", "many_ranges"])
def ranges(spark, request):
    """Small shuffles come together in one range, or stay as they are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_composition_equals_steps():
    rng = np.random.default_rng(0)
    group = np.repeat(np.arange(5), [1, 7, 64, 3, 100])
    a, c = rng.uniform(0, 1, (175, 2)), rng.normal(size=(175, 2))
    got_a, got_c = np.split(scans.composed(np.concatenate([a, c], axis=1), group, scans.affine), 2, axis=1)
    for g in range(5):
        x = np.array([3.0, -1.0])
        for i in np.flatnonzero(group == g):
            x = a[i] * x + c[i]
            assert np.allclose(got_a[i] * np.array([3.0, -1.0]) + got_c[i], x)


@pytest.mark.parametrize("parts,batch", [(1, 10_000), (7, 64)])
def test_baseline_equals_its_chain(spark, ranges, parts, batch):
    rows = rows_of()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.u, r.t): r.score for r in detectors.ema_baseline_score(frame(spark, rows, parts), "u", ["t"], ["x", "y"], {"x": 50.0, "y": 0.0}, 0.2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for u in {r[0] for r in rows}:
        b = np.array([50.0, 0.0])
        for _, t, x, y in sorted((r for r in rows if r[0] == u), key=lambda r: r[1]):
            z = np.array([np.nan if x is None else x, y])
            want = np.sqrt(((z - b) ** 2).mean())
            assert np.isclose(nan(got[u, t]), want, rtol=1e-9, equal_nan=True)
            b = 0.8 * b + 0.2 * z


@pytest.mark.parametrize("options", [{"mode": "frozen"}, {"mode": "frozen", "q": 0.0}, {"mode": "forget", "forgetting": 1.02, "q": 1e-3, "warmup": 3}])
def test_filters_equal_their_chains(spark, ranges, options):
    rows = rows_of(1200, 5)
    df = frame(spark, rows, 5)
    args = (df, "u", ["t"], ["x", "y"], np.array([50.0, 0.0]), np.array([400.0, 1.0]), 3.0)
    got = {(r.u, r.t): r for r in detectors._kalman_scan(*args, **options).collect()}
    want = {(r.u, r.t): r for r in detectors._kalman_chain(*args, **options).collect()}
    assert len(got) == len(want) == len(rows)
    for k, w in want.items():
        assert np.isclose(nan(got[k].score), nan(w.score), rtol=1e-9, equal_nan=True) and got[k].flag == w.flag
        assert np.allclose(list(map(nan, got[k].off)), list(map(nan, w.off)), rtol=1e-9, equal_nan=True)
    assert any(w.flag for w in want.values())


def test_one_key_spreads_over_tasks(spark):
    rows = [("hot", i, float(i), 0.0) for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    seen = scans.affine_scan(frame(spark, rows, 4), "u", ["t"], ["x"], [0.0], lambda z, p: (np.full(z.shape, 0.5), z, {"part": np.full((len(z), 1), float(__import__("pyspark").TaskContext.get().partitionId()))}), ("part",))
    per = [r["count"] for r in seen.groupBy(F.col("part")[0]).count().collect()]
    assert len(per) >= 3 and max(per) < 2500
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    x, last = 0.0, None
    for i in range(4000):
        last, x = x, 0.5 * x + i
    assert np.isclose(seen.where("t = 3999").first().before[0], last)


def test_empty_and_one_row(spark):
    df = frame(spark, [("a", 1, 51.0, 1.0)], 1)
    assert [r.score for r in detectors.ema_baseline_score(df, "u", ["t"], ["x"], {"x": 50.0}).collect()] == [1.0]
    assert detectors.ema_baseline_score(df.limit(0), "u", ["t"], ["x"], {"x": 50.0}).count() == 0
    assert detectors.kalman_by_key(df.limit(0), "u", ["t"], ["x"], [50.0], [400.0], 4.0, mode="frozen").count() == 0


@pytest.mark.parametrize("parts,batch", [(1, 10_000), (7, 64)])
def test_filter_with_matrices_equals_its_chain(spark, ranges, parts, batch):
    rows = rows_of()
    f, h, q, r = np.array([[1.0, 0.1], [0.0, 0.9]]), np.array([[1.0, 0.2], [0.0, 1.0]]), np.array([[0.5, 0.1], [0.1, 0.3]]), np.array([[400.0, 5.0], [5.0, 1.0]])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = measurements.kalman_chi2_by_key(frame(spark, rows, parts), "u", ["t"], ["x", "y"], h, q, r, [50, 0], f=f)
        got = {(x.u, x.t): (x.adi, x.alarm) for x in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for u in {x[0] for x in rows}:
        x, p = np.array([50.0, 0.0]), np.eye(2)
        for _, t, *z in sorted((x for x in rows if x[0] == u), key=lambda x: x[1]):
            x, p = f @ x, f @ p @ f.T + q
            off = np.array([nan(v) for v in z]) - h @ x
            s = np.linalg.inv(h @ p @ h.T + r)
            gain = p @ h.T @ s
            want = off @ s @ off
            adi, alarm = got[u, t]
            assert np.isclose(nan(adi), want, rtol=1e-8, equal_nan=True) and alarm == int(want > -2 * np.log(0.05))
            x, p = x + gain @ off, (np.eye(2) - gain @ h) @ p
    assert found.limit(0).count() == 0
