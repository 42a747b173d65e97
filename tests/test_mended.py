"""Labels that aren't benign, classes without a label, intervals, full covariances, spreads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import labels
from tidewatch.operators import detectors, joins, metrics
from tidewatch.operators.measurements import chi2_quantile


def test_only_benign_is_benign(spark):
    raw = ["Benign", " BENIGN ", "﻿BENIGN", "benign-", "normal", "Benign.", "not benign", "be nign", "Bot.", "Bot", "port scan", "PortScan"]
    family = ["BENIGN", "BENIGN", "BENIGN", "BENIGN", "normal", "Benign.", "notbenign", "benign", "Bot.", "Bot", "portscan", "PortScan"]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, x string").orderBy("i")
    got = df.select(labels.label_family(F.col("x")).alias("a"), labels.label_fine(F.col("x")).alias("b"), labels.class_index(labels.label_family(F.col("x"))).alias("c")).collect()
    assert [r.a for r in got] == family
    assert [r.b for r in got][4:8] == ["normal", "Benign.", "not benign", "be nign"] and [r.b for r in got][:4] == ["BENIGN"] * 4
    assert [r.c == 0 for r in got] == [f == "BENIGN" for f in family]


def test_fine_names(spark):
    raw = {"DoS slowloris": "DoS-Slowloris", "DoS Slowhttptest": "DoS-Slowhttptest", "DoS GoldenEye": "DoS-GoldenEye", "DoS Hulk": "DoS-Hulk", "FTP-Patator": "FTP-Patator", "Web Attack – Sql Injection": "WebAttack-SQLi", "Web Attack � XSS": "WebAttack-XSS", "Heartbleed": "Heartbleed", "New – One": "New - One"}
    df = spark.createDataFrame(list(raw.items()), "x string, want string")
    assert df.where(labels.label_fine(F.col("x")) != F.col("want")).count() == 0


def test_rows_without_a_label_stay(spark):
    rows = [("BENIGN", 5), ("A", 4), ("B", 1), ("C", 1), (None, 3), ("Z", 6)]
    df = spark.createDataFrame([(y,) for y, n in rows for _ in range(n)], "y string")
    out, mapping = metrics.merge_rare_classes(df, "y", 2)
    assert out.count() == 20
    got = {(r.y, r.merged): r.class_idx for r in mapping.collect()}
    assert got == {("BENIGN", "BENIGN"): 0, ("A", "A"): 1, ("Z", "Z"): 2, ("B", "Other"): 3, ("C", "Other"): 3, (None, None): 4}
    rare = metrics.merge_rare_classes(df, "y", 4)[0]
    assert rare.count() == 20 and rare.where("y is null and merged = 'Other'").count() == 3


def test_any_number_of_classes(spark):
    df = spark.range(3000).select(F.format_string("c%05d", "id").alias("y"))
    got = [r.class_idx for r in metrics.merge_rare_classes(df, "y", 1)[1].orderBy("merged").collect()]
    assert got == list(range(3000))


def test_pieces_make_up_their_interval():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = int(rng.integers(-5000, 5000))
        b = a + int(rng.integers(0, 9000))
        covered = sorted(x for level, i in joins.aligned_pieces(a, b) for x in range(i << 6 * level, i + 1 << 6 * level))
        assert covered == list(range(a, b))
    assert len(joins.aligned_pieces(-(10**15), 10**15)) < 126 * 9


def test_intervals_overlap_leave_gaps_and_stay_open(spark):
    rng = np.random.default_rng(3)
    segments = [(f"s{i}", int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-3000, 3000, 80), rng.integers(0, 700, 80)))]
    segments += [("before", None, -2900), ("after", 2900, None)]
    steps = [*range(-3600, 3600, 7), None, -(10**17), 10**17]
    df = spark.createDataFrame([(s,) for s in steps], "step long")
    got = {r.step: r.segment for r in joins.tag_scenario(df, segments).collect()}
    for s in steps:
        want = next((n for n, a, b in segments if s is not None and (a is None or a <= s) and (b is None or s < b)), "BENIGN")
        assert got[s] == want
    assert len(got) == len(steps)
    assert {r.segment for r in joins.tag_scenario(df, []).collect()} == {"BENIGN"}


@pytest.mark.parametrize("m", [1, 5])
def test_residual_with_full_covariance(spark, m):
    rng = np.random.default_rng(m)
    a = rng.normal(size=(m, m))
    r = a @ a.T + 0.1 * np.eye(m)
    z, ref = rng.normal(size=(200, m)) * 2, rng.normal(size=(200, m))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(z, ref))] + [(200, None, ref[0].tolist()), (201, [1.0] * (m + 1), [0.0] * (m + 1))], "i int, z array<double>, x array<double>")
    got = detectors.residual_chi2(df, "z", "x", r.tolist(), alpha=0.1).orderBy("i").collect()
    want = [d @ np.linalg.inv(r) @ d for d in z - ref]
    assert np.allclose([g.adi for g in got[:200]], want)
    assert [g.alarm for g in got[:200]] == [int(w >= chi2_quantile(0.9, m)) for w in want]
    assert [(g.adi, g.alarm) for g in got[200:]] == [(None, 0)] * 2
    same = detectors.residual_chi2(df, "z", "x", np.diag(r).tolist(), 3.0).orderBy("i").collect()
    assert np.allclose([g.adi for g in same[:200]], ((z - ref) ** 2 / np.diag(r)).sum(axis=1))


def test_spread_of_medians(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 8.0)], "cls int, median double")
    assert np.isclose(metrics.evidence_spread(df).first().spread, 1.5)
    assert tuple(metrics.evidence_spread(df.limit(1)).first()) == (0.0, 1) and tuple(metrics.evidence_spread(df.limit(0)).first()) == (0.0, 0)
