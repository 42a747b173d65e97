"""Path lengths of a forest against a plain walk; running sums without a shuffle of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import detectors
from tidewatch.operators._work import grouped_sums


@pytest.mark.parametrize("depth", [1, 3, 8])
def test_path_lengths_equal_a_plain_walk(depth):
    rng = np.random.default_rng(depth)
    size = 2 ** (depth + 1) - 1
    features, cuts, lengths = rng.integers(0, 3, (5, size)), rng.normal(size=(5, size)), rng.uniform(size=(5, size))
    x = rng.normal(size=(200, 3))
    x[0, 0], x[1, 1], x[2, :] = np.nan, np.inf, cuts[0, 0]
    want = np.zeros(len(x))
    for r, row in enumerate(x):
        for f, c, n in zip(features, cuts, lengths):
            at = 0
            for _ in range(depth):
                at = 2 * at + (1 if row[f[at]] < c[at] else 2)
            want[r] += n[at]
    assert np.array_equal(detectors._path_lengths(x, features, cuts, lengths, depth), want)


def test_running_sums_stay_where_they_were_sorted(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, None if i % 7 == 0 else int(v), float(v)) for k in ("a", "b", None) for i, v in enumerate(rng.integers(0, 9, 300))]
    df = spark.createDataFrame(rows, "k string, s int, n long, x double")
    out = grouped_sums(df, ["k"], [F.desc("s")], ["n", "x"])
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().toString()
    for k in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1])
        got = sorted((r for r in out.collect() if r.k == k), key=lambda r: -r.s)
        assert [r.cum_n for r in got if r.n is not None] == np.cumsum([r[2] for r in mine if r[2] is not None]).tolist()
        assert np.allclose([r.cum_x for r in got], np.cumsum([r[3] for r in mine])) and got[0].total_n == sum(r[2] or 0 for r in mine)
