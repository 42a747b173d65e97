"""Replays, edge cases and properties of the library's operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import labels, scores
from tidewatch.operators import _work, bursts, clean, curves, detectors, joins, measurements, metrics, sampling
from tidewatch.plans.files_streams import replay, run_stream
from tidewatch.sources import captures
from tidewatch.streaming import online


def test_label_family_edges(spark):
    raw = ["﻿BENIGN", "Web Attack – XSS", "Web Attack � Brute Force", "DoS\tHulk", "FTP-Patator", "SSH-Patator", "DoS slowloris", "", None, "New Thing", "DDoS"]
    want = ["BENIGN", "WebAttack", "WebAttack", "DoS", "FTP-Patator", "SSH-Patator", "DoS", "UNKNOWN", "UNKNOWN", "NewThing", "DDoS"]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(labels.label_family(F.col("x"))).collect()] == want


def test_vector_expressions(spark):
    df = spark.createDataFrame([([1.0, -5.0, 2.0, 0.5],)], "v array<double>")
    r = df.select(scores.topk_abs_embedding(F.col("v"), 2), scores.topk_abs_embedding(F.col("v"), 6), scores.reshape_sequence(F.col("v"), 4), scores.inject_bias(F.col("v"), [1], 10.0, F.lit(True))).first()
    assert list(r) == [[-5.0, 2.0], [-5.0, 2.0, 1.0, 0.5, 0.0, 0.0], [[1.0], [-5.0], [2.0], [0.5]], [1.0, 5.0, 2.0, 0.5]]


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_and_prefix_sums_by_any_partitioning(spark, parts):
    df = spark.range(500).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 50).cast("double").alias("s")).repartition(parts)
    split = sampling.stratified_split(df, "y", "id")
    counts = {tuple(r[:2]): r[2] for r in split.groupBy("y", "split").count().collect()}
    assert counts == {(0, "test"): 67, (0, "train"): 266, (1, "test"): 33, (1, "train"): 134}
    a = curves.roc_auc(df, "y", "s").first()[0]
    b = curves.roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first()[0]
    assert abs(a + b - 1) < 1e-9


def test_hurst_and_bursts_replay(spark):
    rng = np.random.default_rng(1)
    x = rng.poisson(3, 70)
    df = spark.createDataFrame([(0, i, int(n)) for i, n in enumerate(x)], "e int, bin int, n long")
    sizes, rs = [], []
    for k in range(2, int(np.floor(np.log2(len(x))))):
        n = 2**k
        v = [np.ptp(np.cumsum(b - b.mean())) / b.std(ddof=1) for b in (x[i * n : (i + 1) * n] for i in range(len(x) // n)) if b.std(ddof=1) > 1e-12]
        sizes.append(n)
        rs.append(np.mean(v))
    assert abs(bursts.hurst_rs(df, "e", "bin", "n").first().hurst - np.polyfit(np.log(sizes), np.log(rs), 1)[0]) < 1e-9


def test_ema_and_kalman_replay(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=60)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k int, t int, v double").repartition(5)
    b, want = 0.0, []
    for v in x:
        want.append(abs(v - b))
        b = 0.9 * b + 0.1 * v
    got = [r.score for r in detectors.ema_baseline_score(df, "k", ["t"], ["v"], {"v": 0.0}, 0.1).orderBy("t").collect()]
    assert np.allclose(got, want)
    m, p, want = 0.0, 1.0, []
    for v in x:
        pred = p + 1e-6
        want.append((v - m) ** 2 / (pred + 1.0))
        g = pred / (pred + 1.0)
        m, p = m + g * (v - m), (1 - g) * pred
    got = [r.score for r in detectors.kalman_by_key(df, "k", ["t"], ["v"], [0.0], [1.0], 4.0, mode="frozen").orderBy("t").collect()]
    assert np.allclose(got, want)


def test_isolation_forest_ranks_outliers(spark):
    rng = np.random.default_rng(3)
    fit = spark.createDataFrame([tuple(map(float, v)) for v in rng.normal(size=(600, 3))], "a double, b double, c double")
    far = spark.createDataFrame([(9.0, 9.0, 9.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    s = [r.score for r in detectors.isolation_forest(fit, far, ["a", "b", "c"], trees=40, psi=128).orderBy(F.desc("a")).collect()]
    assert s[0] > s[1] + 0.1


def test_knn_blocks_and_ties_of_exact_copies(spark):
    rows = [(i, [float(i % 3), 0.5]) for i in range(200)] + [(500, None)]
    for n in (1, 7):
        df = spark.createDataFrame(rows, "id long, v array<double>").orderBy(F.desc("id")).repartition(n)
        got = joins.knn_join(df, df, "id", "v", 4, query_rows=30, block_rows=40)
        near = {}
        for r in got.collect():
            near.setdefault(r.id, {})[r["rank"]] = r.neighbor
        assert near == {i: dict(enumerate([j for j in range(i % 3, 200, 3) if j != i][:4], 1)) for i in range(200)}
    assert joins.knn_join(df.limit(0), df, "id", "v").count() == 0
    far = spark.range(200_001).select("id", F.array(F.lit(9.0), F.lit(9.0)).alias("v"))
    assert joins.knn_join(far, df.where("id < 2"), "id", "v", 1).count() == 200_001


def test_knn_and_pattern_cache(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(80, 3))
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(v)], "id long, v array<double>").repartition(6)
    got = {(r.id, r["rank"]): r.neighbor for r in joins.knn_join(df.where("id < 10"), df, "id", "v", 3).collect()}
    for i in range(10):
        d = np.linalg.norm(v - v[i], axis=1)
        d[i] = np.inf
        assert [got[i, k + 1] for k in range(3)] == np.argsort(d)[:3].tolist()
    t = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [1.0, 0.01]), (0, 2, [0.0, 1.0]), (0, 3, [0.0, 1.0])], "k int, t int, v array<double>")
    assert [(r.pattern_id, r.matched) for r in detectors.pattern_cache(t, "k", ["t"], "v").orderBy("t").collect()] == [(0, True), (0, True), (1, False), (1, True)]


def test_edges(spark):
    empty = spark.createDataFrame([], "y int, s double, id long")
    assert metrics.binary_metrics(empty, "y", "s", 1.0).first().precision_at_1pct in (None, 1.0)
    assert curves.roc_auc(empty, "y", "s").first()[0] is None
    quiet = spark.createDataFrame([(0, 0.1), (1, 0.2)], "y int, s double")
    assert metrics.binary_metrics(quiet, "y", "s", 9.0).first().precision_at_1pct == 1.0
    with pytest.raises(ValueError):
        curves.evt_threshold(quiet, "s")
    with pytest.raises(KeyError):
        detectors.make_detector("none such")
    flat = spark.createDataFrame([(1.0,), (1.0,)], "a double")
    assert [r.a for r in clean.minmax_scale(flat, ["a"], flat).collect()] == [0.0, 0.0]
    assert sampling.quotas({"a": 900, "b": 30}, 100) == {"a": 70, "b": 30}
    assert sampling.quotas({"a": 1000, "b": 1000}, 60) == {"a": 30, "b": 30}
    rng = np.random.default_rng(8)
    for _ in range(200):
        counts = {c: int(n) for c, n in enumerate(rng.integers(1, 400, rng.integers(1, 9)))}
        budget = int(rng.integers(1, 600))
        want = {c: min(n, max(round(n * budget / sum(counts.values())), min(50, n))) for c, n in counts.items()} if sum(counts.values()) > budget else counts
        while sum(want.values()) > max(budget, len(counts)):
            want[max(want, key=lambda c: (want[c], c))] -= 1
        assert sampling.quotas(counts, budget) == want


def _walk(spark, n=120):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i % 3, i, float(v)) for i, v in enumerate(rng.normal(size=n))], "k int, t int, v double").withColumn("ts", F.timestamp_seconds(F.col("t") * 600 + 1_700_006_400))


def _in_batches(spark, df, cuts, transform, tmp):
    """A stream over slices of df by t, one micro-batch each."""
    rows = None
    for i, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, 10**9])):
        df.where(f"t >= {lo} and t < {hi}").coalesce(1).write.mode("append").parquet(f"{tmp}/in")
        out = transform(spark.readStream.schema(df.schema).parquet(f"{tmp}/in"))
        rows = run_stream(out, tmp)
    return rows


def test_streams_in_batches_equal_the_table(spark, tmp_path):
    df = _walk(spark)
    vectors = df.withColumn("x", F.array("v", F.lit(0.5)))
    got = _in_batches(spark, vectors, [50, 51, 90], lambda s: online.stream_pattern_cache(s, "k", "ts", ["t"], "x", cap=4), tmp_path / "p")
    want = detectors.pattern_cache(vectors, "k", ["t"], "x", cap=4)
    of = lambda d: [(r.t, r.pattern_id, round(r.similarity, 9), r.matched, r.n_patterns) for r in d.orderBy("t").collect()]
    assert of(got) == of(want)
    got = _in_batches(spark, df, [50, 51, 90], lambda s: online.stream_kalman(s, "k", "ts", ["t"], ["v"], [0.0], [1.0], 2.0), tmp_path / "k")
    want = detectors.kalman_by_key(df, "k", ["t"], ["v"], [0.0], [1.0], 2.0)
    key = lambda d: [(r.t, round(r.score, 9), r.flag) for r in d.orderBy("t").collect()]
    assert key(got) == key(want)
    got = replay(df, lambda s: online.stream_ema(s, "k", "ts", ["t"], ["v"], {"v": 0.0}))
    want = detectors.ema_baseline_score(df, "k", ["t"], ["v"], {"v": 0.0})
    assert np.allclose([r.score for r in got.orderBy("t").collect()], [r.score for r in want.orderBy("t").collect()])


def test_closed_stream_windows_equal_the_table(spark, tmp_path):
    df = _walk(spark, 600)
    got = _in_batches(spark, df, [200, 400], lambda s: online.burst_windows(s, "k", "ts"), tmp_path)
    want = {tuple(r) for r in online.burst_windows(df, "k", "ts").collect()}
    found = [tuple(r) for r in got.collect()]
    assert found and len(found) == len(set(found)) and set(found) <= want


def test_burst_features_of_arrays_equal_those_of_rows(spark):
    rng = np.random.default_rng(5)
    traces = [[int(n) for n in rng.poisson(rate, size)] for rate, size in ((0.4, 80), (3, 33), (0.2, 16), (2, 7), (1, 1))] + [[0] * 20, [4] * 20]
    rows = spark.createDataFrame([(e, b, n) for e, x in enumerate(traces) for b, n in enumerate(x)], "e int, bin int, n long")
    arrays = spark.createDataFrame([(e, [float(n) for n in x]) for e, x in enumerate(traces)], "e int, x array<double>")
    for width, on in ((1.0, 1), (0.5, 2)):
        of = lambda d: np.array([list(r) for r in d.select("e", *bursts.FEATURES).orderBy("e").collect()], float)
        assert np.allclose(of(bursts.array_features(arrays, "x", width, on)), of(bursts.trace_features(rows, "e", width, on)), rtol=1e-9, atol=1e-9)


def test_captures(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(" f0, Label\n1,DoS \x96 Hulk\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text("Label,f0\nBENIGN,2\n")
    (tmp_path / "c.csv").write_text("f0\n2\n")
    both = captures.read_flow_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert [(r.f0, r.x) for r in both.select("f0", labels.label_family(F.col("Label")).alias("x")).orderBy("f0").collect()] == [("1", "DoS"), ("2", "BENIGN")]
    with pytest.raises(ValueError):
        captures.read_flow_csv(spark, [str(tmp_path / "c.csv")])
    found = {r.name: r.bytes for r in captures.file_inventory(spark, str(tmp_path), "*.csv").collect()}
    assert found["c.csv"] == 5 and len(found) == 3


def test_pca_reconstruction_replay(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 4)) + 0.1 * rng.normal(size=(200, 4))
    cols = list("abcd")
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"{c} double" for c in cols))
    z = (x - x.mean(0)) / x.std(0)
    p = np.linalg.svd(z, full_matrices=False)[2][:2]
    res = z - z @ p.T @ p
    want = sorted(np.mean(res**2 / (res**2).mean(0), axis=1))
    assert np.allclose(sorted(r.score for r in detectors.pca_reconstruction(df, df, cols, latent=2).collect()), want)
    plain = detectors.pca_reconstruction(df, df, cols, latent=2, per_feature=False)
    assert np.allclose(sorted(r.score for r in plain.collect()), sorted(np.mean(res**2, axis=1)))


def test_chains_go_on_from_batch_to_batch(spark):
    rng = np.random.default_rng(9)
    rows = [(k, i, float(v), 1) for k, n in (("a", 500), ("b", 3), (None, 40), ("c", 90)) for i, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "k string, t int, v double, score int").repartition(7)
    ask = {
        "ema": lambda: detectors.ema_baseline_score(df, "k", ["t"], ["v"], {"v": 0.0}, 0.1),
        "kalman": lambda: detectors.kalman_by_key(df, "k", ["t"], ["v"], [0.0], [1.0], 2.0),
        "chi2": lambda: measurements.kalman_chi2_by_key(df, "k", ["t"], ["v"], [[1]], [[1e-3]], [[1]], [0]),
        "adaptive": lambda: measurements.adaptive_kalman_by_key(df, "k", ["t"], ["v"], [[1]], [[1e-3]], [[1]], [0], xi_threshold=1.0),
        "cache": lambda: detectors.pattern_cache(df.withColumn("x", F.array("v", F.lit(0.3))), "k", ["t"], "x"),
    }
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for name, run in ask.items():
            found = []
            for n in ("10000", "7"):
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
                made = run()
                if name == "ema":  # a scan: how rows are put together shows in the last places
                    made = made.withColumn("score", F.round("score", 9))
                found.append(sorted(map(tuple, made.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1])))
            assert len(found[0]) == 633 and found[0] == found[1], name
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    z = np.array([r[2] for r in rows if r[0] == "a"])[:, None]
    want = detectors.kalman_steps(z, np.zeros(1), np.ones(1), 0, [1.0], 2.0)
    got = ask["kalman"]().where("k = 'a'").orderBy("t").collect()
    assert np.allclose([r.score for r in got], want[0]) and [r.flag for r in got] == want[1].tolist()


def test_every_detector_keeps_the_contract(spark):
    rng = np.random.default_rng(4)
    cols = [f"c{i}" for i in range(5)]
    frame = lambda x, y: spark.createDataFrame([(i, y, *map(float, v)) for i, v in enumerate(x)], "id int, y int, " + ", ".join(f"{c} double" for c in cols))
    fit = frame(rng.normal(size=(700, 5)), 0)
    test = frame(rng.normal(size=(200, 5)), 0).unionByName(frame(rng.normal(size=(80, 5)) + 4, 1))
    for name in detectors.list_detectors():
        out = detectors.make_detector(name)(fit, test, cols, k=3)
        if name != "null":
            assert curves.roc_auc(out, "y", "score").first()[0] > 0.95, name
        bad = out.where("score is null or isnan(score) or flag not in (0, 1) or trust is null or trust < 0 or trust > 1 or size(embedding) <> 3 or exists(embedding, x -> x is null or isnan(x))")
        assert bad.count() == 0 and out.count() == 280, name
        with pytest.raises(Exception):
            detectors.make_detector(name)(fit, test.drop("c0"), cols).count() if name != "null" else 1 / 0
    out = detectors.wrap_model(lambda x: np.abs(x).sum(axis=1), fit, test, cols, k=3, flag_fn=lambda x: x[:, 0] > 2, trust_fn=lambda x: x[:, 0], embed_fn=lambda x: x[:, :2])
    r = out.where("id = 5 and y = 1").first()
    assert r.flag == int(r.c0 > 2) and r.trust == min(1.0, max(0.0, r.c0)) and r.embedding == [r.c0, r.c1, 0.0]
    both = detectors.detector_comparison(fit, test, cols, names=("zscore", "isolation_forest", "null"))
    assert {x.detector: x.roc_auc > 0.9 for x in both.collect()} == {"zscore": True, "isolation_forest": True, "null": False}


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [("a", float(x)) for x in rng.normal(size=500)] + [("b", float(x)) for x in rng.integers(0, 4, 300)] + [(None, 2.0), ("n", None), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r.g: list(r)[1:] for r in _work.quantiles(df, "v", qs, ["g"]).collect()}
    for g in ("a", "b"):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g and v is not None], qs))
    assert got[None] == [2.0] * 5 and got["n"] == [None] * 5
    every = [v for _, v in rows if v is not None]
    assert np.allclose(_work.quantile_list(df, "v", qs), np.quantile(every, qs)) and np.allclose(list(_work.quantiles(df, "v", qs).first()), np.quantile(every, qs))
    assert _work.quantile_list(df.limit(0), "v", qs) == [None] * 5


def test_forest_draws_rows_not_values(spark):
    """A row that a third of the fit set repeats has about a third of each tree's draw, and no more than psi rows meet."""
    rows = [(0.0, 0.0)] * 3000 + [(float(x), float(y)) for x, y in np.random.default_rng(3).normal(size=(6000, 2))]
    fit = spark.createDataFrame(rows, "a double, b double").repartition(6)
    test = spark.createDataFrame([(0.0, 0.0), (9.0, -9.0)], "a double, b double")
    got = {r.a: r.score for r in detectors.isolation_forest(fit, test, ["a", "b"], trees=30, psi=64).collect()}
    assert got[0.0] < 0.5 < got[9.0]
