"""Detectors on streams. A stream gives the same rows as the batch operators, if each key's rows are taken in order.

Keys are dealt by hash into ``buckets``, each a stateful processor (transformWithState), so the session's state store must be RocksDB. Each call to a
state or timer costs some milliseconds, so a bucket's keys share them, and step side by side. A stream takes rows in one of two ways:

* as they come (``in_order=False``): rows of a key are sorted within a micro-batch, and one that comes in a later micro-batch than its successors
  is taken when it comes. One bucket's rows of a micro-batch must fit in a task.
* in order (``in_order=True``): rows wait in a list state until the watermark has passed them, so that late rows find their place. A timer
  takes those that are due; one bucket's waiting rows must fit in a task. Rows that the watermark hasn't passed at the end of a stream stay in its checkpoint.

Rows later than the watermark are dropped by Spark. A key that is silent for ``idle_ms`` of event time loses its state, by a timer, and begins anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.bursts import FEATURES, array_features
from ..operators.detectors import PatternLibrary, kalman_step, side_by_side

#: The state store that stateful processors need.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Processors that the keys are dealt to, whatever their number. More of them hold fewer rows each.
BUCKETS = 256


def stream_score(sdf: DataFrame, score: Column, threshold: float) -> DataFrame:
    """A fitted row-local score and its flag; no state."""
    return sdf.withColumn("score", score).withColumn("flag", (F.col("score") >= threshold).cast("int"))


def _millis(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[ms]").astype("int64")


class _Recursion(StatefulProcessor):
    """A bucket of keys: for each its last time, when it ends and its recursion's state, as arrays; and the rows that wait for the watermark, packed."""

    def __init__(self, names: list[str], ts: str, order: list[str], cols: list[str], state: str, start: tuple, steps: Callable, kind: type, in_order: bool, idle_ms: int):
        self.names, self.ts, self.order, self.cols, self.kind = names, ts, order, cols, kind
        self.state, self.start, self.steps = state, start, steps
        self.in_order, self.idle_ms = in_order, idle_ms
        self.columns = ["stream_key", *dict.fromkeys([*names, *cols])]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # timer: the one that is set; least: the first time that waits
        self.kept = handle.getValueState("keys", f"timer long, least long, keys array<string>, last array<long>, ends array<long>, {self.state}")
        self.waiting = handle.getListState("waiting", "rows binary") if self.in_order else None

    def _load(self) -> None:
        found = self.kept.get() if self.kept.exists() else None
        self.timer, self.least = found[:2] if found else (None, None)
        keys, last, ends, *state = [list(c) for c in found[2:]] if found else [[] for _ in range(3 + len(self.start))]
        self.place = {k: i for i, k in enumerate(keys)}
        self.last, self.ends, self.now = np.array(last, np.int64), np.array(ends, np.int64), state

    def _save(self, watermark: int) -> None:
        """The state, and a timer for the first row that falls due or the first key that ends."""
        at = min([*self.ends.tolist(), *([] if self.least is None else [self.least + 1])], default=None)
        if at is not None and self.in_order:
            at = max(at, watermark + 1)
        if at != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if at is not None:
                self.handle.registerTimer(at)
        if self.place:
            self.kept.update((at, self.least, list(self.place), self.last.tolist(), self.ends.tolist(), *self.now))
        else:
            self.kept.clear()

    def _seen(self, keys: np.ndarray, times: np.ndarray, watermark: int) -> None:
        """Keys, with those that are new, and the last times of rows that came for them."""
        fresh = [k for k in keys if k not in self.place]
        self.place |= {k: len(self.place) + i for i, k in enumerate(fresh)}
        self.last, self.ends = (np.concatenate([x, np.zeros(len(fresh), np.int64)]) for x in (self.last, self.ends))
        for column, begin in zip(self.now, self.start):
            column += [begin] * len(fresh)
        at = np.array([self.place[k] for k in keys])
        self.last[at] = np.maximum(self.last[at], times)
        self.ends[at] = (self.last[at] if self.in_order else np.maximum(self.last[at], watermark)) + self.idle_ms

    def _taken(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """What the recursions make of rows, in order for each key."""
        group, keys = pd.factorize(pdf["stream_key"])
        pdf = pdf.assign(_group=group).sort_values(["_group", *self.order])
        at = [self.place[k] for k in keys]
        found, after = self.steps(pdf[self.cols].to_numpy(self.kind), pdf["_group"].to_numpy(), tuple([c[i] for i in at] for c in self.now))
        for column, moved in zip(self.now, after):
            for i, x in zip(at, moved):
                column[i] = x
        return pdf[self.names].assign(**found)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        if not self.in_order:
            rows = [pd.concat(list(rows), ignore_index=True)]
        for pdf in rows:  # those that wait go straight to the state, a piece at a time
            at = _millis(pdf[self.ts])
            latest = at.groupby(pdf["stream_key"]).max()
            self._seen(latest.index.to_numpy(), latest.to_numpy(), watermark)
            if self.in_order:
                self.least = int(at.min()) if self.least is None else min(self.least, int(at.min()))
                self.waiting.appendList(_packed(pdf[self.columns]))
            else:
                yield self._taken(pdf)
        self._save(watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        self.timer = None  # Spark has removed the one that went off
        if self.in_order and self.least is not None and self.least < watermark:
            held = pd.concat([_unpacked(r[0]) for r in self.waiting.get()], ignore_index=True)
            at = _millis(held[self.ts])
            due = at < watermark
            yield self._taken(held[due])
            if due.all():
                self.waiting.clear()
                self.least = None
            else:
                self.waiting.put(_packed(held[~due]))
                self.least = int(at[~due].min())
        stay = np.flatnonzero(self.ends > watermark)
        if len(stay) < len(self.ends):
            keys = list(self.place)
            self.place = {keys[i]: n for n, i in enumerate(stay)}
            self.last, self.ends, self.now = self.last[stay], self.ends[stay], [[c[i] for i in stay] for c in self.now]
        self._save(watermark)

    def close(self) -> None:
        pass


def _packed(pdf: pd.DataFrame, rows: int = 10_000) -> list[tuple]:
    """Rows as Arrow streams, some thousands in each."""
    out = []
    for i in range(0, len(pdf), rows):
        batch = pa.RecordBatch.from_pandas(pdf.iloc[i : i + rows], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(blob)).read_all().to_pandas()


def _by_key(sdf: DataFrame, key: str, ts: str, order: list[str], cols: list[str], added: str, state: str, start: tuple, steps: Callable, watermark: str, idle_ms: int, in_order: bool, buckets: int, kind: type = float) -> DataFrame:
    kinds = dict(sdf.dtypes)
    names = [key, *dict.fromkeys([ts, *order])]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", {added}"
    processor = _Recursion(names, ts, order, cols, state, start, steps, kind, in_order, idle_ms)
    rows = sdf.select(*dict.fromkeys([*names, *cols])).withWatermark(ts, watermark)
    own = F.when(F.col(key).isNull(), "null").otherwise(F.concat(F.lit("of "), F.col(key).cast("string")))
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(own), F.lit(buckets)).cast("int"))  # the null key's is its own
    rows = rows.withColumn("stream_key", own).withColumn("stream_bucket", bucket)
    return rows.groupBy("stream_bucket").transformWithStateInPandas(processor, StructType.fromDDL(schema), "append", "eventTime")


def stream_ema(sdf: DataFrame, key: str, ts: str, order: list[str], cols: list[str], start: dict[str, float], ema: float = 0.01, watermark: str = "1 hour", idle_ms: int = 30 * 86_400_000, in_order: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """(key, ts, order, score): the moving baseline's distance, as ``ema_baseline_score``."""

    def step(z, state):
        (b,) = state
        return {"score": np.sqrt(((z - b) ** 2).mean(axis=-1))}, ((1 - ema) * b + ema * z,)

    def steps(x, group, states):
        now = (np.array(states[0], float),)
        return side_by_side(x, group, now, step), [now[0].tolist()]

    return _by_key(sdf, key, ts, order, cols, "score double", "b array<array<double>>", ([float(start[c]) for c in cols],), steps, watermark, idle_ms, in_order, buckets)


def stream_kalman(sdf: DataFrame, key: str, ts: str, order: list[str], cols: list[str], mean: list[float], var: list[float], threshold: float, watermark: str = "1 hour", idle_ms: int = 30 * 86_400_000, in_order: bool = False, buckets: int = BUCKETS, **options) -> DataFrame:
    """(key, ts, order, score, flag): filters as ``kalman_by_key``, with its options."""
    step = kalman_step(var, threshold, **options)

    def steps(x, group, states):
        now = np.array(states[0], float), np.array(states[1], float), np.array(states[2], np.int64)
        found = side_by_side(x, group, now, step)
        return {"score": found["score"], "flag": found["flag"]}, [s.tolist() for s in now]

    begin = ([float(m) for m in mean], [1.0] * len(cols), 0)
    return _by_key(sdf, key, ts, order, cols, "score double, flag int", "x array<array<double>>, p array<array<double>>, seen array<long>", begin, steps, watermark, idle_ms, in_order, buckets)


def stream_pattern_cache(sdf: DataFrame, key: str, ts: str, order: list[str], vec: str, seeds: list[list[float]] | None = None, sim: float = 0.9, sv: float = 1.0, reward: float = 1.0, decay: float = 0.99, evict: float = 0.2, cap: int = 1000, watermark: str = "1 hour", idle_ms: int = 30 * 86_400_000, in_order: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """(key, ts, order, pattern_id, similarity, matched, n_patterns): matching as ``pattern_cache``; a key's library is its state."""
    options = (sim, sv, reward, decay, evict, cap)

    def steps(x, group, states):
        found, after = [], []
        for state, rows in zip(zip(*states), np.split(x[:, 0], np.flatnonzero(np.diff(group)) + 1)):
            library = PatternLibrary(None, *options).restore(*state)
            found += [library.see(np.array(v, float)) for v in rows]
            after.append(library.state())
        return dict(zip(("pattern_id", "similarity", "matched", "n_patterns"), map(list, zip(*found)))), list(zip(*after))

    added = "pattern_id int, similarity double, matched boolean, n_patterns int"
    state = "ids array<array<long>>, life array<array<double>>, unit array<array<array<double>>>, fresh array<long>"
    return _by_key(sdf, key, ts, order, [vec], added, state, PatternLibrary(seeds, *options).state(), steps, watermark, idle_ms, in_order, buckets, object)


def burst_windows(df: DataFrame, entity: str, ts: str, window: str = "1 day", width: str = "1 hour", watermark: str = "1 hour", on: int = 1) -> DataFrame:
    """(entity, start, packets, peak, on_bins, and the burst features) of each tumbling window, for tables and streams.

    Arrivals are counted by bin first, so a window's state is at most one entry for each of its bins, however many
    arrivals there are. A window's trace goes from its first bin with an arrival to its last one, empty ones between them
    included; bins of ``on`` arrivals and more are ON. Durations are in bins. The window must be a multiple of the width. A stream
    gives a window when the watermark has passed it; rows later than that are dropped. Null entities are one entity; null
    times have no window.
    """
    bins = df.withWatermark(ts, watermark).groupBy(entity, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    size = F.unix_micros("w.end") - F.unix_micros("w.start")
    bins = bins.select(entity, "w", F.window_time("w").alias("at"), F.struct((F.unix_micros("w.start") / size).cast("long").alias("b"), "n").alias("bin"))
    each = bins.groupBy(entity, F.window("at", window).alias("o")).agg(F.sort_array(F.collect_list("bin")).alias("s"))
    skipped = lambda x, i: F.when(i > 0, x["b"] - F.element_at("s", F.greatest(i, F.lit(1)))["b"] - 1).otherwise(0)
    trace = F.flatten(F.transform("s", lambda x, i: F.concat(F.array_repeat(F.lit(0.0), skipped(x, i).cast("int")), F.array(x["n"].cast("double")))))
    traces = each.select(entity, F.col("o.start").alias("start"), trace.alias("_trace"))
    found = array_features(traces, "_trace", 1.0, on)
    busy = F.size(F.filter("_trace", lambda n: n >= on)).cast("long").alias("on_bins")
    return found.select(entity, "start", F.col("packets").cast("long").alias("packets"), F.col("peak").cast("long").alias("peak"), busy, *FEATURES)
