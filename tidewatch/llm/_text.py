"""Vectorised word splitting and hashing of Arrow text batches, shared by the text operators.

Everything works on the UTF-8 bytes of a slice of rows at once. A slice holds about
``SLICE_BYTES`` of text and at least one row, so memory follows the longest text and
not the batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000

#: Bytes that end a word: white space, or everything but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64
_TABLE = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(n, base, _U)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums p of the polynomial hash: see range_hash."""
    power, _ = powers(len(data) + 1)
    p = np.zeros(len(data) + 1, _U)
    np.cumsum(_TABLE[data] * power[:-1], out=p[1:])
    return p


def range_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end): equal bytes give equal hashes wherever they stand."""
    _, inverse = powers(len(p))
    return mix((p[ends] - p[starts]) * inverse[starts])


class Slice:
    """Rows of a batch: bytes, offsets of the texts and the row number of the first one."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def words(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the index of each text's first word (n + 1 of them)."""
        inside = ~separators[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(len(self.data), bool)
        after = np.zeros(len(self.data), bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def texts(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield Slice(i, raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow with batches of BATCH_ROWS rows, so that long texts don't add up in one batch.

    Spark reads the limit when a plan runs, so it is lowered in the session and stays there.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it."""
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file:///tmp/spark-shared-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Whether Spark removes a query's shuffle files as it ends, and not when the driver collects its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, codec: str | None = None, free: bool = False) -> DataFrame:
    """Write to the shared folder and read back: later steps start there and survive the loss of executors.

    free: the shuffle files that writing takes are removed then.
    """
    spark = df.sparkSession
    where, before = f"{shared_dir(spark)}/{uuid.uuid4().hex}", spark.conf.get(_FREE, "false")
    try:
        spark.conf.set(_FREE, "true" if free else before)
        df.write.parquet(where, compression=codec)
    finally:
        spark.conf.set(_FREE, before)
    out = spark.read.schema(df.schema).parquet(where)
    out._written = where
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that cut wrote and that no later step reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
