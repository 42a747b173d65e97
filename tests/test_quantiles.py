"""Exact quantiles through sketched brackets, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import _work, clean, curves

QS = [0.0, 0.05, 0.5, 0.95, 0.9995, 1.0]
INF, NAN = float("inf"), float("nan")


def frame(spark, columns):
    n = max(map(len, columns.values()))
    rows = [tuple(None if i >= len(v) else v[i] for v in columns.values()) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)


def shapes():
    rng = np.random.default_rng(4)
    n = 12_000
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n) * 10)
    return {
        "plain": rng.normal(size=n).tolist(),
        "hot": hot.tolist(),
        "equal": [3.5] * n,
        "few": rng.integers(0, 3, n).astype(float).tolist(),
        "short": [5.0, 1.0],
        "wild": [*rng.normal(size=n - 6).tolist(), INF, INF, -INF, -0.0, 0.0, 1e300],
        "none": [],
    }


def exact(v, qs):
    v, out = sorted(v), []
    for q in qs:
        at = (len(v) - 1) * q
        a, b = v[int(np.floor(at))], v[int(np.ceil(at))]
        out.append(a if a == b else a + (b - a) * (at - np.floor(at)))
    return out


@pytest.mark.parametrize("few,reach,wrong", [(100_000, 0.002, False), (0, 0.002, False), (100_000, 0.0, False), (0, 0.002, True)])
def test_column_quantiles(spark, monkeypatch, few, reach, wrong):
    """Also when the rows within are summed over range partitions, and when brackets are too narrow or off the mark."""
    monkeypatch.setattr(_work, "_FEW", few)
    monkeypatch.setattr(_work, "_REACH", reach)
    if wrong:
        monkeypatch.setattr(_work, "_bracket_of", lambda sketch, q: F.struct(F.lit(100.0).alias("low"), F.lit(101.0).alias("high")))
    columns = shapes()
    got = _work.column_quantiles(frame(spark, columns), list(columns), QS)
    for c, v in columns.items():
        assert got[c] == [None] * len(QS) if not v else np.allclose(got[c], exact(v, QS)), (c, got[c])


def test_nan_ranks_above_numbers(spark):
    df = frame(spark, {"x": [1.0, 2.0, NAN, NAN], "y": [NAN, NAN], "z": [4.0, 3.0]})
    got = _work.column_quantiles(df, ["x", "y", "z"], [0.0, 0.4, 1.0])
    assert got["x"][0] == 1.0 and np.isnan(got["x"][1]) and np.isnan(got["x"][2])
    assert np.isnan(got["y"]).all() and got["z"] == [3.0, 3.4, 4.0]


@pytest.mark.parametrize("wrong", [False, True])
def test_group_quantiles(spark, monkeypatch, wrong):
    if wrong:
        monkeypatch.setattr(_work, "_bracket_of", lambda sketch, q: F.struct(F.lit(100.0).alias("low"), F.lit(101.0).alias("high")))
    columns = {c: v for c, v in shapes().items() if c != "none"} | {None: [1.0, 2.0, 4.0]}
    rows = [(c, x) for c, v in columns.items() for x in v] + [("empty", None), ("nan", NAN), ("nan", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: list(r)[1:] for r in _work.quantiles(df, "v", QS, ["g"]).collect()}
    for c, v in columns.items():
        assert np.allclose(got[c], exact(v, QS)), (c, got[c])
    assert got["empty"] == [None] * len(QS) and got["nan"][0] == 1.0 and np.isnan(got["nan"][-1])
    assert len(got) == len(columns) + 2


def test_only_bracketed_rows_are_sorted(spark, monkeypatch):
    """Under a hundredth of a column whose values differ, and next to nothing of one with a single value."""
    seen = []
    placed = _work._placed
    monkeypatch.setattr(_work, "_placed", lambda g, inside, ranks: (seen.append(g.groupBy("b").agg(F.sum("k").alias("k"), F.count("*").alias("rows")).collect()), placed(g, inside, ranks))[1])
    df = spark.range(400_000).select((F.hash("id") / 1e3).alias("x"), F.lit(2.0).alias("y"))
    got = _work.column_quantiles(df, ["x", "y"], [0.5])
    want = np.quantile([r.x for r in df.select("x").collect()], 0.5)
    assert np.isclose(got["x"][0], want) and got["y"] == [2.0]
    k = {r.b: r for r in seen[0]}
    assert k[0].k < 4000 and k[1].rows == 1


def test_medians_and_thresholds(spark):
    columns = {c: v for c, v in shapes().items() if c in ("plain", "hot", "few")}
    df = frame(spark, columns)
    stats = {r.feature: r for r in clean.column_stats(df, list(columns)).collect()}
    assert all(np.isclose(stats[c].median, np.median(v)) for c, v in columns.items())
    y = (np.array(columns["plain"]) > 1.0).astype(int)
    rng = np.random.default_rng(1)
    score = np.round(np.array(columns["plain"]) + rng.normal(size=len(y)), 1)
    scored = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, score)], "y int, s double").repartition(3)
    qs = [0.5 + 0.4995 * i / 399 for i in range(400)]
    cuts = np.quantile(score, qs)
    f1 = [2 * (y[score >= t] == 1).sum() / ((score >= t).sum() + y.sum()) for t in cuts]
    best = curves.best_f1_threshold(scored, "y", "s").first()
    assert np.isclose(best.f1, max(f1)) and np.isclose(best.threshold, cuts[int(np.argmax(f1))])
    sweep = {round(r.alpha, 2): r for r in curves.prior_threshold_sweep(scored, "y", "s").collect()}
    for a in (0.01, 0.05, 0.4):
        t = np.quantile(score, 1 - a)
        assert np.isclose(sweep[a].threshold, t) and np.isclose(sweep[a].f1, 2 * y[score >= t].sum() / ((score >= t).sum() + y.sum()))
    nothing = scored.limit(0)
    assert list(curves.best_f1_threshold(nothing, "y", "s").first()) == [None, None] and curves.prior_threshold_sweep(nothing, "y", "s").count() == 0
