"""What a task holds stays bounded, and vectors come straight from Arrow."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidewatch.operators import clustering, joins


def test_queries_meet_cells_in_pieces():
    """10,000 queries and 600 cells: all at once took matrices of hundreds of MB. Results don't depend on the pieces."""
    rng = np.random.default_rng(3)
    pivots = rng.normal(size=(100, 8))
    low = np.tile(np.arange(6) / 2, 100)
    cells = pd.DataFrame({"cell": np.repeat(np.arange(100), 6) * joins._RINGS + np.tile(np.arange(6), 100), "low": low, "high": low + 0.5, "rows": 8000})
    balls = {8: joins._Rings(pivots, cells)}
    q = rng.normal(size=(10_000, 8))
    kth = np.full(len(q), 0.3)
    vectors = pa.ListArray.from_arrays(np.arange(0, q.size + 1, 8, dtype=np.int32), q.ravel())
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), vectors, pa.array(np.full(len(q), 8, np.int32)), pa.array(kth)], ["id", "v", "dim", "kth"])
    tracemalloc.start()
    got = [(i, c) for sent in joins._asking(balls, 5, False)([batch]) for i, c in zip(sent["id"].to_numpy()[:50], sent["cell"].to_numpy()[:50])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    row, col = np.nonzero(balls[8].ask(q[:40], kth[:40], 5, False))
    want = set(zip(row.tolist(), cells["cell"].to_numpy()[col].tolist()))
    assert {(int(i), int(c)) for i, c in got if i < 40} <= want and got


def test_judge_takes_vectors_from_arrow():
    x = np.arange(12.0).reshape(6, 2)
    lists = pa.ListArray.from_arrays(np.arange(0, 13, 2, dtype=np.int32), x.ravel())
    assert np.array_equal(clustering._vectors(pa.RecordBatch.from_arrays([lists], ["v"]).slice(2, 3)), x[2:5])
    with pytest.raises(ValueError):
        clustering._vectors(pa.RecordBatch.from_arrays([pa.array([[1.0], [1.0, 2.0, 3.0]])], ["v"]))
