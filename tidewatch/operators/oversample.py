"""Adaptive oversampling of rare classes between neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import stored
from .joins import knn_join


def adasyn_quotas(df: DataFrame, id_col: str, vec: str, y: str, minority, beta: float = 1.0, k: int = 5, total: int | None = None) -> DataFrame:
    """(id, crowd, quota) for every row of the minority class.

    crowd counts the rows of other classes among its k nearest. The new rows (``total``, or the difference of the
    class's size to all others' times beta) are dealt in proportion to crowd, or evenly where all are 0, rounded down; what
    is left goes one each to the largest crowds, smallest ids first. Without a difference, quotas are 0.
    """
    rare = df.where(F.col(y) == F.lit(minority))
    n = df.agg(F.count_if(F.col(y) == F.lit(minority)).alias("rare"), F.count_if(F.col(y) != F.lit(minority)).alias("rest")).first()
    total = max(0, round((n["rest"] - n["rare"]) * beta)) if total is None else total
    near = knn_join(rare, df, id_col, vec, k)
    kind = df.select(F.col(id_col).alias("neighbor"), (F.col(y) != F.lit(minority)).cast("long").alias("_far"))
    crowd = stored(near.join(kind, "neighbor").groupBy(id_col).agg(F.sum("_far").alias("crowd")))
    sums = crowd.agg(F.sum("crowd"), F.count("*")).first()
    weight, all_ = ("crowd", sums[0]) if sums[0] else ("1L", max(1, sums[1]))
    dealt = crowd.withColumn("quota", F.expr(f"{weight} * {total}L div {all_}L"))
    left = total - (dealt.agg(F.sum("quota")).first()[0] or 0)
    more = dealt.orderBy(F.desc("crowd"), id_col).limit(int(left)).select(id_col, F.lit(1).alias("_more"))
    return dealt.join(more, id_col, "left").select(id_col, "crowd", (F.col("quota") + F.coalesce("_more", F.lit(0))).alias("quota"))


def adasyn(df: DataFrame, id_col: str, vec: str, y: str, minority, beta: float = 1.0, k: int = 5, seed: int = 42, total: int | None = None) -> DataFrame:
    """New rows (id, vec, y, origin, neighbor) of the minority class, as many from each row as ``adasyn_quotas`` gives.

    Each lies on the line from its origin to one of the origin's k nearest rows of the class, both chosen by a hash of
    origin, number and seed, so that reruns agree. A class of one row gets none. Ids are longs; new ones are hashes.
    Neighbours are found in blocks, for a rare class of any size.
    """
    rare = df.where(F.col(y) == F.lit(minority)).select(id_col, vec)
    quota = adasyn_quotas(df, id_col, vec, y, minority, beta, k, total)
    near = stored(knn_join(rare, rare, id_col, vec, k))
    sizes = near.groupBy(id_col).agg(F.count("*").alias("_k"))
    made = quota.where("quota > 0").join(sizes, id_col).select(F.col(id_col).alias("origin"), "_k", F.explode(F.expr("sequence(1L, quota)")).alias("_n"))
    made = made.withColumn("rank", (F.pmod(F.xxhash64("origin", "_n", F.lit(seed)), F.col("_k")) + 1).cast("int"))
    made = made.join(near.select(F.col(id_col).alias("origin"), "rank", "neighbor"), ["origin", "rank"])
    a = rare.select(F.col(id_col).alias("origin"), F.col(vec).alias("_a"))
    b = rare.select(F.col(id_col).alias("neighbor"), F.col(vec).alias("_b"))
    part = F.pmod(F.xxhash64("origin", "_n", F.lit(seed + 1)), F.lit(1 << 30)) / (1 << 30)
    mixed = made.join(a, "origin").join(b, "neighbor").withColumn("_p", part)
    line = F.zip_with("_a", "_b", lambda p, q: p + F.col("_p") * (q - p))
    return mixed.select(F.xxhash64("origin", "_n", F.lit(seed + 2)).alias(id_col), line.alias(vec), F.lit(minority).cast(df.schema[y].dataType).alias(y), "origin", "neighbor")


def adasyn_multiclass(df: DataFrame, id_col: str, vec: str, y: str, classes: list, beta: float = 1.0, cap: bool = True, k: int = 5, seed: int = 42) -> DataFrame:
    """(id, vec, y) of df and of the new rows of each class in turn, one class against the rest.

    Rows made for one class count for the next. With cap a class grows to the size of the largest class at most. Classes
    without rows, and those with as many rows as the rest, are left alone.
    """
    now = df.select(id_col, vec, y)
    most = df.groupBy(y).count().agg(F.max("count")).first()[0] or 0
    for i, c in enumerate(classes):
        n = now.agg(F.count_if(F.col(y) == F.lit(c)), F.count("*")).first()
        own, rest = n[0], n[1] - n[0]
        total = round(min((rest - own) * beta, most - own)) if cap else round((rest - own) * beta)
        if not own or own >= rest or total <= 0:
            continue
        now = now.unionByName(stored(adasyn(now, id_col, vec, y, c, k=k, seed=seed + 10 * i, total=total).select(id_col, vec, y)))
    return now
