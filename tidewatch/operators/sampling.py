"""Quotas within classes, chosen by md5 order: reproducible in any engine and for any partitioning.

A class can hold most rows, so no window ranks a whole class. ``ranked`` deals each class
into buckets by the md5's first hex digits; bucket counts (a small table) give each bucket its
offset, and only rows of one bucket are ranked together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], id_col: str, seed: int = 42, digits: int = 3) -> DataFrame:
    """df with _rank (from 1) within ``by`` in md5(id, seed) order and _n, the size of ``by``."""
    rows = df.withColumn("_h", F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))).withColumn("_b", F.substring("_h", 1, digits))
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_k"))
    order = Window.partitionBy(*by).orderBy("_b")
    offsets = counts.select(*[F.col(c).alias(f"_o_{c}") for c in by], F.col("_b").alias("_o_b"), (F.sum("_k").over(order) - F.col("_k")).alias("_before"), F.sum("_k").over(Window.partitionBy(*by)).alias("_n"))
    on = F.col("_b") == F.col("_o_b")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    inner = Window.partitionBy(*by, "_b").orderBy("_h", id_col)
    out = rows.join(offsets, on).withColumn("_rank", F.col("_before") + F.row_number().over(inner))
    return out.select(*df.columns, "_rank", "_n")


def _keep(df: DataFrame, by: list[str], id_col: str, seed: int, quota: Column) -> DataFrame:
    return ranked(df, by, id_col, seed).where(F.col("_rank") <= quota).drop("_rank", "_n")


def sample_per_file(df: DataFrame, specs: dict[str, int | None], id_col: str, file_col: str = "file", seed: int = 42) -> DataFrame:
    """At most specs[file] rows of each file; None or a file that isn't named keeps all."""
    pairs = [x for k, v in specs.items() if v is not None for x in (F.lit(k), F.lit(v))]
    quota = F.coalesce(F.element_at(F.create_map(*pairs), F.col(file_col)), F.col("_n")) if pairs else F.col("_n")
    return _keep(df, [file_col], id_col, seed, quota)


def stratified_split(df: DataFrame, y: str, id_col: str, test_size: float = 0.2, eligible: Column | None = None, seed: int = 42, at_least_one: bool = False) -> DataFrame:
    """df with split: round(n * test_size) eligible rows of each class are test, half to even."""
    ok = F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
    marked = df.withColumn("_ok", ok)
    r = ranked(marked, [y, "_ok"], id_col, seed)
    total = marked.groupBy(F.col(y).alias("_y")).agg(F.count("*").alias("_total"))
    r = r.join(total, F.col(y).eqNullSafe(F.col("_y")))  # Spark broadcasts it while it is small
    quota = F.bround(F.col("_total") * F.lit(test_size), 0)
    if at_least_one:
        quota = F.when(F.col("_total") > 1, F.greatest(quota, F.lit(1))).otherwise(0)
    return r.select(*df.columns, F.when(F.col("_ok") & (F.col("_rank") <= quota), "test").otherwise("train").alias("split"))


def balance_benign(df: DataFrame, y: str, id_col: str, ratio: float = 0.30, seed: int = 42) -> DataFrame:
    """All attacks, and at most int(attacks * ratio / (1 - ratio)) benign rows (y = 0)."""
    attacks = df.where(F.col(y) != 0).count()
    return cap_class(df, y, id_col, 0, int(attacks * ratio / (1 - ratio)), seed)


def cap_class(df: DataFrame, y: str, id_col: str, cls, cap: int, seed: int = 42) -> DataFrame:
    capped = _keep(df.where(F.col(y) == cls), [y], id_col, seed, F.lit(cap))
    return df.where(~F.col(y).eqNullSafe(F.lit(cls))).unionByName(capped)


def quotas(counts: dict, max_n: int, floor: int = 50) -> dict:
    """Proportional quotas, rounded half to even, of at least min(floor, n).

    While they are too many, the largest gives one row at a time (of equal ones the last class), and none falls below one. So all end at
    one level: the least at which they are enough, less one row for the last classes at it.
    """
    total = sum(counts.values())
    if total <= max_n:
        return dict(counts)
    q = {c: min(n, max(min(floor, n), round(n * max_n / total))) for c, n in counts.items()}
    held = lambda level: sum(min(v, level) for v in q.values())
    if sum(q.values()) <= max_n:
        return q
    low, high = 1, max(q.values())
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if held(mid) >= max_n else (mid + 1, high)
    over = held(low) - max_n if low > 1 else 0
    at_level = sorted((c for c, v in q.items() if v >= low), reverse=True)
    return {c: min(v, low) - (c in at_level[:over]) for c, v in q.items()}


def stratified_subset(df: DataFrame, y: str, id_col: str, max_n: int, floor: int = 50, seed: int = 42) -> DataFrame:
    counts = {r[0]: r[1] for r in df.where(F.col(y).isNotNull()).groupBy(y).count().collect()}
    q = quotas(counts, max_n, floor)
    table = F.create_map(*[x for c, n in q.items() for x in (F.lit(c), F.lit(n))])
    return _keep(df.where(F.col(y).isNotNull()), [y], id_col, seed, F.element_at(table, F.col(y)))


def equal_per_class(df: DataFrame, y: str, id_col: str, max_n: int, seed: int = 42) -> DataFrame:
    classes = df.select(y).distinct().count()
    return _keep(df, [y], id_col, seed, F.lit(max_n // max(1, classes)))


def class_pool(df: DataFrame, y: str, id_col: str, classes: list, n: int, seed: int = 42) -> DataFrame:
    return _keep(df.where(F.col(y).isin(classes)), [y], id_col, seed, F.lit(n))


def dropped_rows(before: DataFrame, after: DataFrame, id_col: str) -> DataFrame:
    return before.join(after.select(id_col), id_col, "left_anti")


def best_checkpoint(history: DataFrame, metric: str, order: str) -> DataFrame:
    """The row of the largest metric; the first by order on ties."""
    return history.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), order).limit(1)
