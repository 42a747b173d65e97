"""Stateful processors: equal to the table under cuts, late rows and restarts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import detectors
from tidewatch.plans.files_streams import replay_late, run_stream, state_store
from tidewatch.streaming import online

DAY = 86_400


def events(spark, n=240, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(None if i % 4 == 3 else i % 4, i, float(v)) for i, v in enumerate(rng.normal(size=n))]
    return spark.createDataFrame(rows, "k int, t int, v double").withColumn("ts", F.timestamp_seconds(F.col("t") * 600 + 1_700_006_400))


def feed(spark, df, path, parts, transform):
    """One file and one start of the stream for each part, all from one checkpoint."""
    for part in parts:
        df.where(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
        out = run_stream(transform(spark.readStream.schema(df.schema).parquet(f"{path}/in")), path)
    return out


def far(spark, df, seconds):
    return df.limit(1).select(F.lit(9).alias("k"), F.lit(10**6).alias("t"), F.lit(0.0).alias("v"), F.timestamp_seconds(F.lit(1_700_006_400 + seconds)).alias("ts"))


@pytest.mark.parametrize("kind", ["ema", "kalman", "cache"])
def test_late_rows_find_their_place(spark, tmp_path, kind):
    """Parts by hash, so that every one but the first has rows before those of the part before it; each part is a start from the checkpoint."""
    df = events(spark).withColumn("x", F.array("v", F.lit(0.5)))
    late = {"watermark": "10 days", "in_order": True}
    stream, table, cols = {
        "ema": (lambda s: online.stream_ema(s, "k", "ts", ["t"], ["v"], {"v": 0.0}, 0.1, **late), lambda: detectors.ema_baseline_score(df, "k", ["t"], ["v"], {"v": 0.0}, 0.1), ["score"]),
        "kalman": (lambda s: online.stream_kalman(s, "k", "ts", ["t"], ["v"], [0.0], [1.0], 2.0, **late), lambda: detectors.kalman_by_key(df, "k", ["t"], ["v"], [0.0], [1.0], 2.0), ["score", "flag"]),
        "cache": (lambda s: online.stream_pattern_cache(s, "k", "ts", ["t"], "x", cap=4, **late), lambda: detectors.pattern_cache(df, "k", ["t"], "x", cap=4), ["pattern_id", "matched", "n_patterns"]),
    }[kind]
    parts = [F.pmod(F.xxhash64("t"), F.lit(3)) == i for i in range(3)]
    held = feed(spark, df, tmp_path, parts, stream)
    assert held.count() == 0  # nothing is due yet
    end = far(spark, df, 60 * DAY).withColumn("x", F.array("v", F.lit(0.5)))
    end.select(*df.columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = run_stream(stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), tmp_path)
    of = lambda d: sorted((r.t, *[round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols]) for r in d.collect())
    assert of(got) == of(table())


def test_some_rows_are_due_and_some_wait(spark, tmp_path):
    """With a watermark of an hour each start gives the rows that it has passed, once, in order."""
    df = events(spark)
    stream = lambda s: online.stream_ema(s, "k", "ts", ["t"], ["v"], {"v": 0.0}, 0.1, watermark="1 hour", in_order=True)
    counts = []
    for i in range(4):
        got = feed(spark, df, tmp_path, [f"t div 60 = {i}"], stream)
        counts.append(got.count())
    assert counts == sorted(set(counts)) and counts[0] > 0 and counts[-1] < 240
    want = {r.t: r.score for r in detectors.ema_baseline_score(df, "k", ["t"], ["v"], {"v": 0.0}, 0.1).collect()}
    rows = got.collect()
    assert len({r.t for r in rows}) == len(rows) and all(np.isclose(r.score, want[r.t]) for r in rows)


@pytest.mark.parametrize("in_order", [False, True])
def test_a_silent_key_begins_anew(spark, tmp_path, in_order):
    first = events(spark, 40).where("k = 0")
    again = first.withColumn("ts", F.col("ts") + F.expr("interval 40 days")).withColumn("t", F.col("t") + 1000)
    between, end = far(spark, first, 35 * DAY), far(spark, first, 90 * DAY)
    df = first.unionByName(again).unionByName(between.withColumn("t", F.lit(500))).unionByName(end.withColumn("t", F.lit(5000)))
    got = feed(spark, df, tmp_path, ["t < 400", "t = 500", "t between 1000 and 2000", "t = 5000"], lambda s: online.stream_ema(s, "k", "ts", ["t"], ["v"], {"v": 0.0}, 0.5, idle_ms=10 * DAY * 1000, in_order=in_order))
    score = {r.t: r.score for r in got.where("k = 0").collect()}
    assert len(score) == 20 and all(np.isclose(score[t], score[t + 1000]) for t in score if t < 400)


def test_session_is_left_as_it_was(spark):
    old = spark.conf.get(online.ROCKSDB[0], None)
    with state_store(spark):
        assert spark.conf.get(online.ROCKSDB[0]) == online.ROCKSDB[1]
    assert spark.conf.get(online.ROCKSDB[0], None) == old


@pytest.mark.parametrize("in_order", [False, True])
def test_many_keys_share_a_bucket(spark, tmp_path, in_order):
    """Sixty keys, one of them null, in two buckets, and a start from the checkpoint: state rows are of buckets, results of keys."""
    rng = np.random.default_rng(11)
    rows = [(None if i % 60 == 7 else i % 60, i, float(v)) for i, v in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(rows, "k int, t int, v double").withColumn("ts", F.timestamp_seconds(F.col("t") * 600 + 1_700_006_400))
    stream = lambda s: online.stream_kalman(s, "k", "ts", ["t"], ["v"], [0.0], [1.0], 1.0, warmup=3, in_order=in_order, watermark="30 days", buckets=2)
    end = far(spark, df, 90 * DAY).select(*df.columns)
    got = feed(spark, df.unionByName(end), tmp_path, ["t < 300", "t between 300 and 600", "t > 600"], stream)
    of = lambda d: sorted((r.t, round(r.score, 9), r.flag) for r in d.where("t < 600").collect())
    assert of(got) == of(detectors.kalman_by_key(df, "k", ["t"], ["v"], [0.0], [1.0], 1.0, warmup=3))
    held = [q for q in tmp_path.glob("state/commits/*") if q.name.isdigit()]
    first = spark.read.format("statestore").option("batchId", 0).option("stateVarName", "keys").load(f"{tmp_path}/state")
    assert held and first.count() <= 3


def test_parts_of_several_files(spark):
    df = events(spark)
    late = lambda s: online.stream_ema(s, "k", "ts", ["t"], ["v"], {"v": 0.0}, 0.1, watermark="3650 days", in_order=True, idle_ms=10**13)
    got = replay_late(df, late, "ts", file_rows=16)  # five files for each of three parts
    of = lambda d: sorted((r.t, round(r.score, 9)) for r in d.collect())
    assert of(got) == of(detectors.ema_baseline_score(df, "k", ["t"], ["v"], {"v": 0.0}, 0.1))
