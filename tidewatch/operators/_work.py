"""Written intermediate tables and distributed prefix sums."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir; set here only if unset, as in tests)."""
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not kept.isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file:///tmp/spark-shared-{uuid.uuid4().hex}")
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    return f"{kept.get()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Written and read again: one computation, no lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote and that no later step reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _running(sums: list[str]):
    """Rows with cum_<column> for each of sums, running on from batch to batch of a task; null until the first value, as a window's sum is."""

    def run(batches):
        carried, seen = dict.fromkeys(sums, 0), dict.fromkeys(sums, False)
        for batch in batches:
            if not len(batch):
                continue
            added = []
            for c in sums:
                x = batch.column(c)
                x = x.cast(pa.float64() if pa.types.is_floating(x.type) else pa.int64())
                cum = pc.cumulative_sum_checked(pc.fill_null(x, 0), start=pa.scalar(carried[c], x.type))
                carried[c] = cum[-1].as_py()
                if x.null_count and not seen[c]:
                    begun = np.logical_or.accumulate(x.is_valid().to_numpy(zero_copy_only=False))
                    cum = pc.if_else(pa.array(begun), cum, pa.scalar(None, x.type))
                seen[c] |= x.null_count < len(x)
                added.append(cum)
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *[f"cum_{c}" for c in sums]])

    return run


def prefix_sums(df: DataFrame, order: list, sums: list[str]) -> DataFrame:
    """df with cum_<column> for each of sums (whole numbers or doubles), running over ``order`` without a one-task window.

    Rows are range-partitioned and sorted once; each task runs its own sums, batch by batch, and the totals of the
    partitions before it (one row for each, broadcast) are added. Rows equal in order must be grouped before.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    added = ", ".join(f"`cum_{c}` {'double' if kinds[c] in ('float', 'double') else 'long'}" for c in sums)
    parts = stored(dealt.mapInArrow(_running(sums), f"{schema}, {added}"))
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(totals.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums]))
    out = parts.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return out.select(*df.columns, *[(F.col(f"cum_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums])


def _same(by: list[str], a: str, b: str):
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


def grouped_sums(g: DataFrame, by: list[str], order: list, sums: list[str]) -> DataFrame:
    """g with cum_<column>, running over ``order`` within ``by``, and total_<column> of the group, for each of sums (not below 0).

    One running sum over (by, order) is spread over range partitions; what a group begins with is taken off, so no group
    is one task's work. Rows equal in by and order must be grouped before.
    """
    c = prefix_sums(g, [*by, *order], sums)
    sizes = c.groupBy(*by).agg(*[F.sum(x).alias(f"total_{x}") for x in sums], *[F.min(F.col(f"cum_{x}") - F.col(x)).alias(f"_before_{x}") for x in sums])
    sizes = stored(sizes)  # of known size, so Spark broadcasts few groups, and their rows stay where they are
    joined = c.alias("c").join(sizes.alias("s"), _same(by, "c", "s")) if by else c.alias("c").crossJoin(F.broadcast(sizes).alias("s"))
    cums = [(F.col(f"c.cum_{x}") - F.col(f"s._before_{x}")).alias(f"cum_{x}") for x in sums]
    return joined.select(*[F.col(f"c.{x}") for x in g.columns], *cums, *[F.col(f"s.total_{x}") for x in sums])


#: Size of the sketches that bracket quantiles. Their ranks are off by less than about a thousandth; a bracket reaches twice as far.
_SKETCH, _REACH = 4096, 0.002
#: So many bracketed rows may be sorted in the driver; more are sorted in range partitions.
_FEW = 100_000
#: More quantiles than this share their sorted rows instead of having brackets.
_MANY = 16
_INF = float("inf")


def _bracket_of(sketch: Column, q: float) -> Column:
    """(lower, upper) about a quantile by the sketch: null where it is an end of the values."""
    low, high = q - _REACH, q + _REACH
    return F.struct(*[(F.kll_sketch_get_quantile_double(sketch, F.lit(r)) if 0 < r < 1 else F.lit(None).cast("double")).alias(n) for n, r in (("low", low), ("high", high))])


def _sketched(value: Column, qs: list[float]) -> Column:
    """(n, nan, brackets): values, NaN among them, and a bracket for each quantile, null without other values."""
    number = F.when(~F.isnan(value), value)
    brackets = F.array(*[_bracket_of(F.kll_sketch_agg_double(number, _SKETCH), q) for q in qs])
    return F.struct(F.count(value).alias("n"), F.count(F.when(F.isnan(value), 1)).alias("nan"), F.when(F.count(number) > 0, brackets).alias("brackets"))


def _between(values: list[float], ranks: list[int], at: float) -> float:
    """The quantile at the place ``at`` of sorted values, of which those at ``ranks`` are given."""
    found = dict(zip(ranks, values))
    low, high = found[math.floor(at)], found[math.ceil(at)]
    return low if low == high else low + (high - low) * (at - math.floor(at))


def _ranks(n: int, q: float) -> list[int]:
    at = (n - 1) * q
    return sorted({math.floor(at), math.ceil(at)})


def column_quantiles(df: DataFrame, cols: list[str], qs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns, interpolated between the two nearest rows; None for a column without values.

    A mergeable sketch of each column brackets each quantile; one aggregate counts the rows below and within each bracket; only
    rows within are counted by value and sorted, under a hundredth of a column whose values differ, and one row for each task of a value that many rows
    share. A bracket that the counts prove wrong holds all rows. df is read three times: store what is dear to compute.
    NaN ranks above all numbers, nulls take no part.
    """
    if len(qs) > _MANY:
        return {c: _counted_quantiles(df, c, qs) for c in cols}
    named = {f"_x{i}": F.col(c).cast("double") for i, c in enumerate(cols)}
    rows = df.select(*[x.alias(c) for c, x in named.items()])
    first = rows.agg(*[_sketched(F.col(c), qs).alias(c) for c in named]).first()
    wanted = []  # column, quantile, lower and upper end
    for c in named:
        for j in range(len(qs)):
            low, high = first[c]["brackets"][j] if first[c]["brackets"] else (None, None)
            if first[c]["n"] > first[c]["nan"]:
                wanted.append([c, j, -_INF if low is None else low, _INF if high is None else high])
    counted = rows.agg(F.count("*"), *[F.count(F.when(test, 1)) for c, _, low, high in wanted for test in (F.col(c) < low, F.col(c) <= high)]).first() if wanted else []
    inside = 0
    for b, x in enumerate(wanted):
        n, below, upto = first[x[0]]["n"] - first[x[0]]["nan"], counted[2 * b + 1], counted[2 * b + 2]
        ranks = [r for r in _ranks(first[x[0]]["n"], qs[x[1]]) if r < n]
        if ranks and not (below <= ranks[0] and ranks[-1] < upto):
            x[2:], below, upto = [-_INF, _INF], 0, n
        x += [below, ranks if below < upto else []]
        inside += upto - below if x[5] else 0
    live = [(b, x) for b, x in enumerate(wanted) if x[5]]
    found: dict[int, list] = {}
    if live:
        hits = F.array(*[F.when(F.col(c).between(low, high), F.struct(F.lit(b).alias("b"), F.col(c).alias("v"))) for b, (c, _, low, high, _, _) in live])
        g = rows.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).groupBy("h.b", "h.v").agg(F.count("*").alias("k"))
        for b, v, k, cum in _placed(g, inside, {b: [r - x[4] for r in x[5]] for b, x in live}):
            base = wanted[b][4] + cum - k
            found.setdefault(b, []).extend((r, v) for r in wanted[b][5] if base <= r < base + k)
    out: dict[str, list[float | None]] = {c: [None] * len(qs) for c in cols}
    for i, c in enumerate(cols):
        n, nan = first[f"_x{i}"]["n"], first[f"_x{i}"]["nan"]
        for j, q in enumerate(qs if n else []):
            b = next((b for b, x in enumerate(wanted) if x[:2] == [f"_x{i}", j]), None)
            values = dict(found.get(b, []))
            ranks = _ranks(n, q)
            out[c][j] = _between([values.get(r, math.nan) for r in ranks], ranks, (n - 1) * q)
    return out


def _placed(g: DataFrame, inside: int, ranks: dict[int, list[int]]):
    """(b, v, k, cum) of rows counted by bracket and value, at least those that hold the ranks within their bracket."""
    if inside <= _FEW:
        last, cum = None, 0
        for b, v, k in sorted(g.collect()):
            cum = k if b != last else cum + k
            last = b
            yield b, v, k, cum
        return
    c = grouped_sums(g, ["b"], ["v"], ["k"])
    holds = F.lit(False)
    for b, places in ranks.items():
        for r in places:
            holds |= (F.col("b") == b) & (F.col("cum_k") - F.col("k") <= r) & (F.col("cum_k") > r)
    yield from (tuple(x) for x in c.where(holds).select("b", "v", "k", "cum_k").collect())  # two rows for each bracket at most


def quantile_list(df: DataFrame, value: str, qs: list[float]) -> list[float | None]:
    """Exact quantiles of a column, as of column_quantiles."""
    return column_quantiles(df, [value], qs)[value]


def _counted_quantiles(df: DataFrame, value: str, qs: list[float]) -> list[float | None]:
    """Exact quantiles of a column, any number of them, from one running sum over its different values."""
    g = df.select(F.col(value).cast("double").alias("_v")).where("_v is not null").groupBy("_v").agg(F.count("*").alias("k"))
    c = stored(grouped_sums(g, [], ["_v"], ["k"]))
    total = c.agg(F.max("total_k")).first()[0]
    if not total:
        return [None] * len(qs)
    ranks = sorted({r for q in qs for r in _ranks(total, q)})
    before = F.col("cum_k") - F.col("k")
    mine = F.filter(F.array(*[F.lit(x).cast("long") for x in ranks]), lambda x: (x >= before) & (x < F.col("cum_k")))
    near = c.where((F.col("k") > 1) | before.isin(ranks)).select("_v", mine.alias("ranks")).where("size(ranks) > 0")
    found = {x: r["_v"] for r in near.collect() for x in r["ranks"]}  # a row for each rank at most
    return [_between([found[r] for r in _ranks(total, q)], _ranks(total, q), (total - 1) * q) for q in qs]


def quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles of the group, interpolated between the two nearest rows; null where it has no value.

    As column_quantiles, with a sketch and brackets for each group: rows meet their group's brackets (which Spark broadcasts while they are small), and those
    within are counted by value and summed over range partitions, so no group is one task's work. Any number of groups.
    """
    by = list(by or [])
    names = [f"_g{i}" for i in range(len(by))]
    if not by:
        found = quantile_list(df, value, qs)
        return df.sparkSession.createDataFrame([tuple(found)], ", ".join(f"q{i} double" for i in range(len(qs))))
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col(value).cast("double").alias("_v")).where("_v is not null")
    sketched = rows.groupBy(*names).agg(_sketched(F.col("_v"), qs).alias("_s"))
    each = range(len(qs))
    ends = [F.coalesce(F.col("_s.brackets")[j][e], F.lit(x)).alias(f"_{e}{j}") for j in each for e, x in (("low", -_INF), ("high", _INF))]
    brackets = stored(sketched.select(*names, F.col("_s.n").alias("_n"), F.col("_s.nan").alias("_nan"), *ends))
    met = lambda b: rows.alias("r").join(b.alias("b"), _same(names, "r", "b")).select("b.*", "r._v")
    counts = [F.count(F.when(test, 1)).alias(f"_{n}{j}") for j in each for n, test in (("below", F.col("_v") < F.col(f"_low{j}")), ("upto", F.col("_v") <= F.col(f"_high{j}")))]
    counted = met(brackets).groupBy(*brackets.columns).agg(*counts)
    at = lambda j: (F.col("_n") - 1) * F.lit(float(qs[j]))
    sure = lambda j: (F.col(f"_below{j}") <= F.floor(at(j))) & (F.ceil(at(j)) < F.col(f"_upto{j}"))
    fixed = [F.when(sure(j), F.col(f"_{n}{j}")).otherwise(F.lit(x)).alias(f"_{n}{j}") for j in each for n, x in (("low", -_INF), ("high", math.nan), ("below", 0))]
    brackets = stored(counted.select(*names, "_n", *fixed))  # a bracket proved wrong goes up to NaN, the largest double
    hits = F.array(*[F.when((F.col("_v") >= F.col(f"_low{j}")) & (F.col("_v") <= F.col(f"_high{j}")), j) for j in each])
    g = met(brackets).select(*names, "_v", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("_j")).groupBy(*names, "_j", "_v").agg(F.count("*").alias("k"))
    c = grouped_sums(g, [*names, "_j"], ["_v"], ["k"])
    joined = c.alias("c").join(brackets.alias("b"), _same(names, "c", "b")).select("b.*", "c._j", "c._v", "c.k", "c.cum_k")
    parts = []
    for j in each:
        end = F.col("cum_k") + F.col(f"_below{j}")
        holds = lambda place: (F.col("_j") == j) & (end > place) & (end - F.col("k") <= place)  # noqa: B023, E731
        parts += [F.max(F.when(holds(F.floor(at(j))), F.col("_v"))).alias(f"_l{j}"), F.max(F.when(holds(F.ceil(at(j))), F.col("_v"))).alias(f"_h{j}")]
    found = joined.groupBy(*names, "_n").agg(*parts)
    out = []
    for j in each:
        low, high, f = F.col(f"_l{j}"), F.col(f"_h{j}"), at(j) - F.floor(at(j))
        out.append(F.when(low == high, low).otherwise(low + (high - low) * f).alias(f"q{j}"))
    out = found.select(*[F.col(n).alias(c) for n, c in zip(names, by)], *out)
    every = df.select(*by).distinct()  # groups without a value stay, with nulls
    return every.alias("e").join(out.alias("o"), _same(by, "e", "o"), "left").select("e.*", *[f"o.q{i}" for i in each])
