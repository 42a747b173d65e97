"""Burst features of arrival traces: occupied bins, runs and rescaled range, per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import _same, grouped_sums, stored

EPS = 1e-12


#: Bins that one array holds where all of them are made.
_ARRAY = 4096


def _joined(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a with the other columns of b; nulls are equal."""
    return a.alias("a").join(b.alias("b"), _same(by, "a", "b"), how).select("a.*", *[f"b.{c}" for c in b.columns if c not in by])


def occupied_bins(df: DataFrame, entity: str, ts: str, width: float) -> DataFrame:
    """(entity, n_bins, bin, n): the bins that have arrivals, from the first arrival on; the last edge is closed. ts in the width's unit.

    Null entities are one entity, rows without a time are no arrivals. Empty bins are never made, so a trace may span any time.
    """
    rows = df.select(entity, F.col(ts).cast("double").alias("_t")).where("_t is not null")
    span = rows.groupBy(entity).agg(F.min("_t").alias("_t0"), F.greatest(F.lit(1), F.ceil((F.max("_t") - F.min("_t")) / width)).cast("long").alias("n_bins"))
    at = F.least(F.floor((F.col("_t") - F.col("_t0")) / width).cast("long"), F.col("n_bins") - 1)
    return _joined(rows, span, [entity]).groupBy(entity, "n_bins", at.alias("bin")).agg(F.count("*").alias("n"))


def bin_counts(df: DataFrame, entity: str, ts: str, width: float) -> DataFrame:
    """(entity, bin, n): occupied_bins with the empty bins between them, an entity's bins in pieces."""
    found = occupied_bins(df, entity, ts, width)
    pieces = found.groupBy(entity).agg(F.max("n_bins").alias("n_bins")).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1, F.lit(_ARRAY).cast("long"))))
    every = pieces.select(entity, F.explode(F.sequence("_from", F.least(F.col("_from") + _ARRAY, F.col("n_bins")) - 1)).alias("bin"))
    out = _joined(every, found.select(entity, "bin", "n"), [entity, "bin"], "left")
    return out.select(entity, F.col("bin").cast("int").alias("bin"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _ranked(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """df with its rows' places in their groups from 1, counted over range partitions."""
    return grouped_sums(df.withColumn("_one", F.lit(1).cast("long")), by, [order], ["_one"]).select(*df.columns, F.col("cum__one").alias(name))


def run_lengths(df: DataFrame, entity: str, bin_col: str, flag: str) -> DataFrame:
    """(entity, flag, start, length) of each run of equal flags.

    In a run both a row's place among the entity's rows and that among those of its flag go up by one, so their difference names it:
    no entity is one task's work.
    """
    placed = _ranked(_ranked(df.select(entity, bin_col, flag), [entity], bin_col, "_i"), [entity, flag], bin_col, "_j")
    return placed.groupBy(entity, flag, (F.col("_i") - F.col("_j")).alias("_run")).agg(F.min(bin_col).alias("start"), F.count("*").alias("length")).drop("_run")


def sparse_runs(bins: DataFrame, entity: str, on: int = 1) -> DataFrame:
    """(entity, _on, start, length) of the runs of occupied_bins: bins of ``on`` arrivals and more are ON, all others, empty ones too, OFF.

    ON runs are bins that go up with their place; OFF runs are what lies between one ON run and the next, before the first and after the last.
    """
    busy = _ranked(bins.where(F.col("n") >= on).select(entity, "n_bins", "bin"), [entity], "bin", "_i")
    runs = busy.groupBy(entity, "n_bins", (F.col("bin") - F.col("_i")).alias("_run")).agg(F.min("bin").alias("start"), F.count("*").alias("length")).drop("_run")
    runs = stored(_ranked(runs, [entity], "start", "_k"))
    ends = runs.select(entity, (F.col("_k") + 1).alias("_k"), (F.col("start") + F.col("length")).alias("_end"))
    spans = bins.groupBy(entity).agg(F.max("n_bins").alias("n_bins"))
    last = _joined(spans, runs.groupBy(entity).agg((F.max("_k") + 1).alias("_k")), [entity], "left")
    last = last.select(entity, "n_bins", F.col("n_bins").alias("start"), F.coalesce("_k", F.lit(1).cast("long")).alias("_k"))
    gaps = _joined(runs.select(entity, "start", "_k").union(last.select(entity, "start", "_k")), ends, [entity, "_k"], "left").withColumn("_end", F.coalesce("_end", F.lit(0).cast("long")))
    off = gaps.where("start > _end").select(entity, F.lit(0).alias("_on"), F.col("_end").alias("start"), (F.col("start") - F.col("_end")).alias("length"))
    return runs.select(entity, F.lit(1).alias("_on"), "start", "length").union(off)


def sparse_hurst(bins: DataFrame, entity: str) -> DataFrame:
    """(entity, hurst) of occupied_bins: as hurst_rs.

    In a block's cumulated deviations from its mean each empty bin goes down by the mean, so their ends are at an occupied bin, just before one, or at the
    block's end, where they are 0. What came before a bin is a running sum over range partitions, so no block is one task's work.
    """
    counted = grouped_sums(bins.select(entity, "n_bins", "bin", "n"), [entity], ["bin"], ["n"])
    top = F.floor(F.log2("n_bins")).cast("int") - 1
    sized = counted.where(top >= 2).withColumn("size", F.explode(F.transform(F.sequence(F.lit(2), top), lambda k: F.pow(F.lit(2.0), k).cast("long"))))
    sized = sized.withColumn("block", F.floor(F.col("bin") / F.col("size"))).where((F.col("block") + 1) * F.col("size") <= F.col("n_bins"))
    key = [entity, "size", "block"]
    sums = sized.groupBy(*key).agg(F.min(F.col("cum_n") - F.col("n")).alias("_b"), F.sum("n").alias("_sum"), F.sum(F.col("n") * F.col("n")).alias("_squares"))
    met = _joined(sized, sums, key).withColumn("_m", F.col("_sum") / F.col("size"))
    at = F.col("bin") - F.col("block") * F.col("size")
    after = F.col("cum_n") - F.col("_b") - (at + 1) * F.col("_m")
    before = F.when(at >= 1, F.col("cum_n") - F.col("n") - F.col("_b") - at * F.col("_m"))
    deviation = F.sqrt((F.max("_squares") - F.max("size") * F.max("_m") * F.max("_m")) / (F.max("size") - 1))
    reach = F.greatest(F.max(after), F.max(before), F.lit(0.0)) - F.least(F.min(after), F.min(before), F.lit(0.0))
    rs = met.groupBy(*key).agg(reach.alias("r"), deviation.alias("s")).where(F.col("s") > EPS)
    mean = rs.groupBy(entity, "size").agg(F.log(F.avg(F.col("r") / F.col("s"))).alias("y")).withColumn("x", F.log("size"))
    fit = mean.groupBy(entity).agg(F.when(F.count("*") >= 2, F.regr_slope("y", "x")).otherwise(0.5).alias("hurst"))
    return _joined(bins.select(entity).distinct(), fit, [entity], "left").select(entity, F.coalesce("hurst", F.lit(0.5)).alias("hurst"))


def _sparse(bins: DataFrame, entity: str, bin_col: str, count: str) -> DataFrame:
    """Bins of which all are there as those of occupied_bins; an entity whose bins are all empty keeps its first."""
    spans = bins.groupBy(entity).agg(F.count("*").alias("n_bins"))
    kept = bins.where((F.col(count) > 0) | (F.col(bin_col) == 0)).select(entity, F.col(bin_col).cast("long").alias("bin"), F.col(count).alias("n"))
    return _joined(kept, spans, [entity]).select(entity, "n_bins", "bin", "n")


def hurst_rs(df: DataFrame, entity: str, bin_col: str, count: str) -> DataFrame:
    """(entity, hurst): slope of log mean R/S over log block size, blocks of 4, 8, ... below half the trace; 0.5 under two scales. Bins from 0, all of them."""
    return sparse_hurst(_sparse(df, entity, bin_col, count), entity)


#: The features of a trace of bins, in order.
FEATURES = ["mean_on", "var_on", "mean_off", "var_off", "on_ratio", "idle_ratio", "burst_rate", "arrival_rate", "peak_to_mean", "hurst", "n_bursts"]


def burst_features(df: DataFrame, entity: str, ts: str, width: float, on: int = 1) -> DataFrame:
    """ON and OFF durations, ratios, rates, peak-to-mean, Hurst and number of bursts of each entity, from its occupied bins."""
    return _features(stored(occupied_bins(df, entity, ts, width)), entity, width, on)


def trace_features(bins: DataFrame, entity: str, width: float, on: int = 1) -> DataFrame:
    """The burst features of bins (entity, bin, n) as of bin_counts."""
    return _features(_sparse(bins, entity, "bin", "n"), entity, width, on)


def _features(bins: DataFrame, entity: str, width: float, on: int) -> DataFrame:
    runs = sparse_runs(bins, entity, on).withColumn("d", F.col("length") * width)
    when = lambda v, f: F.coalesce(f(F.when(F.col("_on") == v, F.col("d"))), F.lit(0.0))
    r = runs.groupBy(entity).agg(when(1, F.avg).alias("mean_on"), when(1, F.var_pop).alias("var_on"), when(0, F.avg).alias("mean_off"), when(0, F.var_pop).alias("var_off"), when(1, F.sum).alias("t_on"), when(0, F.sum).alias("t_off"), F.sum("_on").cast("double").alias("n_bursts"))
    c = bins.groupBy(entity).agg(F.sum("n").alias("packets"), F.max("n").alias("peak"), (F.max("n_bins") * width).alias("duration"))
    return _joined(_joined(r, c, [entity]), sparse_hurst(bins, entity), [entity]).select(entity, *_shares(width))


def _shares(width: float) -> list:
    """FEATURES from durations, totals and duration."""
    rate = F.col("packets") / (F.col("duration") + EPS)
    total = F.col("t_on") + F.col("t_off") + EPS
    made = {"on_ratio": F.col("t_on") / total, "idle_ratio": F.col("t_off") / total, "burst_rate": F.col("packets") / (F.col("t_on") + EPS), "arrival_rate": rate, "peak_to_mean": F.col("peak") / (rate * width + EPS)}
    return [made.get(c, F.col(c)).alias(c) for c in FEATURES]


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _block_range(v: Column, size: Column) -> Column:
    """Rescaled range of one block, null where it doesn't vary."""
    mean = _sum(v) / size
    start = F.struct(F.lit(0.0).alias("at"), F.lit(float("inf")).alias("low"), F.lit(float("-inf")).alias("high"), F.lit(0.0).alias("squares"))

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + x - mean
        return F.struct(at.alias("at"), F.least(a["low"], at).alias("low"), F.greatest(a["high"], at).alias("high"), (a["squares"] + (x - mean) * (x - mean)).alias("squares"))

    def finish(a: Column) -> Column:
        s = F.sqrt(a["squares"] / (size - 1))
        return F.when(s > EPS, (a["high"] - a["low"]) / s)

    return F.aggregate(v, start, step, finish)


def _hurst_of(bins: Column) -> Column:
    """hurst_rs of an array of counts."""

    def scale(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(bins) / size).cast("int") - 1), lambda j: _block_range(F.slice(bins, j * size + 1, size), size))
        varied = F.filter(blocks, lambda x: x.isNotNull())
        return F.struct(F.log(size.cast("double")).alias("x"), F.when(F.size(varied) > 0, F.log(_sum(varied) / F.size(varied))).alias("y"))

    top = F.floor(F.log2(F.size(bins))).cast("int") - 1
    points = F.filter(F.transform(F.when(top >= 2, F.sequence(F.lit(2), top)).otherwise(F.array().cast("array<int>")), scale), lambda p: p["y"].isNotNull())
    none = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "x", "y", "xx", "xy")])
    add = lambda a, p: F.struct((a["n"] + 1).alias("n"), (a["x"] + p["x"]).alias("x"), (a["y"] + p["y"]).alias("y"), (a["xx"] + p["x"] * p["x"]).alias("xx"), (a["xy"] + p["x"] * p["y"]).alias("xy"))
    slope = lambda a: F.when(a["n"] >= 2, (a["n"] * a["xy"] - a["x"] * a["y"]) / (a["n"] * a["xx"] - a["x"] * a["x"])).otherwise(0.5)
    return F.aggregate(points, none, add, slope)


def array_features(df: DataFrame, bins: str, width: float, on: int = 1) -> DataFrame:
    """df with the burst features of each row's array of counts (doubles, at least one), by expressions alone, so for streams too."""
    flag = lambda i: F.element_at(bins, i) >= on
    starts = F.filter(F.sequence(F.lit(1), F.size(bins)), lambda i: (i == 1) | (flag(i) != flag(F.greatest(i - 1, F.lit(1)))))
    df = df.withColumn("_starts", starts).withColumn("_ends", F.concat(F.slice("_starts", 2, F.size("_starts")), F.array(F.size(bins) + 1)))
    runs = F.zip_with("_starts", "_ends", lambda a, b: F.struct(flag(a).alias("on"), ((b - a) * width).cast("double").alias("d")))
    df = df.withColumn("_runs", runs)
    for name in ("on", "off"):
        picked = F.filter("_runs", lambda r: r["on"] == (name == "on"))  # noqa: B023
        df = df.withColumn(f"_{name}", F.transform(picked, lambda r: r["d"]))
        n, total = F.size(f"_{name}"), _sum(F.col(f"_{name}"))
        df = df.withColumn(f"t_{name}", total).withColumn(f"mean_{name}", F.when(n > 0, F.col(f"t_{name}") / n).otherwise(0.0))
        spread = _sum(F.transform(f"_{name}", lambda d: (d - F.col(f"mean_{name}")) * (d - F.col(f"mean_{name}"))))
        df = df.withColumn(f"var_{name}", F.when(n > 0, spread / n).otherwise(0.0))
    df = df.withColumn("n_bursts", F.size("_on").cast("double")).withColumn("hurst", _hurst_of(F.col(bins)))
    df = df.withColumn("packets", _sum(F.col(bins))).withColumn("peak", F.array_max(bins)).withColumn("duration", F.size(bins) * width)
    made = dict(zip(FEATURES, _shares(width)))
    return df.select("*", *[made[c] for c in FEATURES if c not in df.columns]).drop("_starts", "_ends", "_runs", "_on", "_off", "t_on", "t_off", "duration")
