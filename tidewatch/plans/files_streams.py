"""Registered queries of readers, writers and streams: tables go out to the shared folder and come back through the operator."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators._work import scratch
from ..sources import captures
from ..streaming import online
from .registry import EMA_SQL, KALMAN_SQL, QUERIES, TRUST_SQL, _fit, _test, add, r, trace_sql


@add("read_flow_csv", f"SELECT id, raw_label, {r('f0', 'f1')} FROM flows", "flows")
def _(v):
    d = v("flows")
    path = scratch(d.sparkSession)
    d.select("id", F.col("raw_label").alias(" Label"), F.col("f0").alias(" f0"), F.col("f1").alias("f1 ")).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = captures.read_flow_csv(d.sparkSession, [path])
    return back.select("id", F.col("Label").alias("raw_label"), F.col("f0").cast("double").alias("f0"), F.col("f1").cast("double").alias("f1"))


@add("read_flow_csv_encodings", "SELECT id, 'Caf' || chr(233) || ' ' || cls AS name FROM flows", "flows")
def _(v):
    """One folder with files of both encodings."""
    spark, path = v("flows").sparkSession, scratch(v("flows").sparkSession)
    for encoding, part in (("UTF-8", "cls < 2"), ("ISO-8859-1", "cls >= 2")):
        rows = v("flows").where(part).select("id", F.concat(F.lit("Caf\u00e9 "), F.col("cls").cast("string")).alias("Label"))
        rows.write.mode("append").csv(path, header=True, encoding=encoding)
    return captures.read_flow_csv(spark, [path]).select("id", F.col("Label").alias("name"))


def _captures(v) -> str:
    """Monday as CSV, the other days as parquet, and a manifest that also names an absent file."""
    spark, path = v("flows").sparkSession, scratch(v("flows").sparkSession)
    flows = v("flows").select("id", F.col("raw_label").alias("Label"), F.col("f0").alias("Flow Size"), "day")
    flows.where("day = 'Monday'").drop("day").write.csv(f"{path}/mon.csv", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    flows.where("day <> 'Monday'").drop("day").write.parquet(f"{path}/rest.parquet")
    files = [("Monday", "mon.csv", "csv", True, 0), ("other", "rest.parquet", "parquet", True, 3), ("Sunday", "sun.csv", "csv", False, 7)]
    spark.createDataFrame([(path, "Label", {"Flow Size": "size"}, files)], captures.MANIFEST).coalesce(1).write.json(f"{path}/manifest")
    return path


@add("read_manifest", f"SELECT id, CASE day WHEN 'Monday' THEN day ELSE 'other' END AS day, {r('f0 AS size')}, CASE trim(raw_label) WHEN 'DoS Hulk' THEN 'DoS-Hulk' WHEN 'benign' THEN 'BENIGN' WHEN 'Web Attack – XSS' THEN 'WebAttack-XSS' ELSE trim(raw_label) END AS label FROM flows", "flows")
def _(v):
    d = captures.read_manifest(v("flows").sparkSession, _captures(v) + "/manifest")
    return d.select("id", "day", F.col("size").cast("double").alias("size"), "label")


@add("manifest_missing", "SELECT day, day || '.csv' AS file, sum(y)::BIGINT AS expected_attacks FROM flows WHERE day <> 'Monday' GROUP BY day", "flows")
def _(v):
    spark, path = v("flows").sparkSession, scratch(v("flows").sparkSession)
    days = v("flows").groupBy("day").agg(F.sum("y").cast("long").alias("expected_attacks"))
    entry = F.struct("day", F.concat("day", F.lit(".csv")).alias("file"), F.lit("csv").alias("format"), (F.col("day") == "Monday").alias("present"), "expected_attacks")
    days.agg(F.collect_list(entry).alias("files")).write.json(f"{path}/manifest")
    return captures.manifest_missing(spark, f"{path}/manifest")


@add("tag_capture_day", "SELECT id, CASE day WHEN 'Monday' THEN 'Monday' ELSE 'rest.parquet' END AS day FROM flows", "flows")
def _(v):
    spark, path = v("flows").sparkSession, scratch(v("flows").sparkSession)
    days = v("flows").select("id", "day")
    days.where("day = 'Monday'").select("id").write.parquet(f"{path}/mon.parquet")
    days.where("day <> 'Monday'").select("id").write.parquet(f"{path}/rest.parquet")
    return captures.tag_capture_day(spark.read.parquet(f"{path}/mon.parquet", f"{path}/rest.parquet"), {"mon.parquet": "Monday"})


def _bundle(v) -> DataFrame:
    d = _fit(v).select("id", "cls", "day", F.lit("fit").alias("split")).unionByName(_test(v).select("id", "cls", "day", F.lit("test").alias("split")))
    path = scratch(d.sparkSession)
    captures.write_bundle(d, {"features": ["f0"]}, path)
    rows, meta = captures.read_bundle(d.sparkSession, path)
    if meta != {"features": ["f0"]}:
        raise ValueError("metadata changed on the way")
    return rows


@add("read_bundle", "SELECT id, cls, CASE WHEN day = 'Monday' THEN 'fit' ELSE 'test' END AS split FROM flows WHERE y = 0 OR day <> 'Monday'", "flows")
def _(v):
    return _bundle(v).select("id", "cls", "split")


@add("bundle_metadata", ", b AS (SELECT cls, day, CASE WHEN day = 'Monday' THEN 'fit' ELSE 'test' END AS split FROM flows WHERE y = 0 OR day <> 'Monday') SELECT split, cls, day, count(*) AS n, grouping_id(split, cls, day)::INT AS level FROM b GROUP BY GROUPING SETS ((split), (split, cls), (split, day))", "flows")
def _(v):
    return captures.bundle_metadata(_bundle(v), "cls", "day")


QUERIES["file_inventory"] = lambda spark, sf_dir: captures.file_inventory(spark, sf_dir, "*.parquet")


@contextmanager
def state_store(spark):
    """The state store that stateful processors need, as long as a stream runs; the session is left as it was."""
    name, value = online.ROCKSDB
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def run_stream(out: DataFrame, path: str) -> DataFrame:
    """All that ``out`` gives from the files that are there, as a table; a further run goes on from its checkpoint."""
    with state_store(out.sparkSession):
        out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{path}/out")


def replay(df: DataFrame, transform) -> DataFrame:
    """What ``transform`` makes of df as a stream: its rows go to files, and the stream ends with the last one."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(f"{path}/in")
    return run_stream(transform(spark.readStream.schema(df.schema).parquet(f"{path}/in")), path)


def replay_late(df: DataFrame, transform, ts: str, files: int = 3, file_rows: int = 250_000) -> DataFrame:
    """As replay, in parts that each hold rows of all times and come one after the other, each of as many files as its rows need; the last one has a row a century on, of no
    key, which takes the watermark past all others and waits for ever."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    cols = [c for c in df.columns if c != ts]
    each = -(-df.count() // (files * file_rows))  # so many files of a part are a micro-batch
    for i in range(files):
        part = df.where(F.pmod(F.xxhash64(*cols), F.lit(files)) == i)
        (part.repartition(each) if each > 1 else part.coalesce(1)).write.mode("append").parquet(f"{path}/in")
    end = df.agg(F.make_dt_interval(F.lit(36_500)).alias("far"), F.max(ts).alias("t")).select((F.col("t") + F.col("far")).alias("t"))
    end.select(*[F.col("t").alias(ts) if c == ts else F.lit(None).cast(t).alias(c) for c, t in df.dtypes]).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, each)).parquet(f"{path}/in")
    return run_stream(transform(stream), path)


def _events(v):
    return v("scored").select("id", "user_id", "score", F.col("ts").cast("timestamp").alias("ts"))


@add("stream_score", f"SELECT id, {r('abs(score - 50) / 10 AS score')}, (abs(score - 50) / 10 >= 3)::INT AS flag FROM scored", "scored")
def _(v):
    return replay(_events(v).select("id", F.col("score").alias("value")), lambda s: online.stream_score(s, F.abs(F.col("value") - 50) / 10, 3.0)).select("id", "score", "flag")


@add("stream_ema", EMA_SQL, "scored")
def _(v):
    return replay(_events(v), lambda s: online.stream_ema(s, "user_id", "ts", ["ts", "id"], ["score"], {"score": 50.0})).select("id", "score")


@add("stream_ema_late", EMA_SQL, "scored")
def _(v):
    late = lambda s: online.stream_ema(s, "user_id", "ts", ["ts", "id"], ["score"], {"score": 50.0}, watermark="3650 days", in_order=True, idle_ms=10**13)
    return replay_late(_events(v), late, "ts").select("id", "score")


@add("stream_kalman", KALMAN_SQL.replace(", 4 AS width", "").replace(TRUST_SQL, ""), "scored")
def _(v):
    return replay(_events(v), lambda s: online.stream_kalman(s, "user_id", "ts", ["ts", "id"], ["score"], [50.0], [400.0], 4.0)).select("id", "score", "flag")


@add("stream_pattern_cache", None)
def _(v):
    s = _events(v).withColumn("x", F.array("score", F.lit(10.0), F.lit(1.0)))
    return replay(s, lambda d: online.stream_pattern_cache(d, "user_id", "ts", ["ts", "id"], "x")).drop("user_id", "ts")


# Keys of windows are texts: user and first hour.
_HOURS = """h AS (SELECT user_id || ' ' || (floor(epoch(ts) / 3600)::BIGINT // 24 * 24) AS user_id, floor(epoch(ts) / 3600)::BIGINT AS h, count(*) AS n FROM scored GROUP BY 1, 2),
    e AS (SELECT user_id, min(h) AS first, max(h) AS last FROM h GROUP BY user_id),
    b AS (SELECT e.user_id, (t.h - e.first)::INT AS bin, coalesce(n, 0) AS n FROM (SELECT *, unnest(range(first, last + 1)) AS h FROM e) t JOIN e USING (user_id) LEFT JOIN h ON h.user_id = e.user_id AND h.h = t.h)"""
_WINDOWS = f"""SELECT split_part(user_id, ' ', 1)::BIGINT AS user_id, split_part(user_id, ' ', 2)::BIGINT AS start_hour, packets::BIGINT AS packets, peak::BIGINT AS peak,
    (SELECT count(*) FROM b WHERE b.user_id = o.user_id AND b.n > 0) AS on_bins, {trace_sql(1.0)[1]} FROM o"""


@add("burst_windows", f", {_HOURS}, {trace_sql(1.0)[0]} {_WINDOWS}", "scored")
def _(v):
    return _windows(online.burst_windows(_events(v), "user_id", "ts"))


def _windows(d):
    return d.withColumn("start_hour", (F.unix_seconds("start") / 3600).cast("long")).drop("start")


@add("stream_burst_windows", None)
def _(v):
    return _windows(replay(_events(v), lambda s: online.burst_windows(s, "user_id", "ts")))
