"""Hard negatives by a vertical scan: dimensions are read one after the other, and bounds on the rest rule candidates out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import cut, discard

#: Integer vectors as long as the root of this, or longer, have inner products that may not fit in a long.
_LONGEST = float(1 << 62)


class Columns:
    """The rows of a shard by dimension, with each dimension's least and greatest value."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.columns = np.ascontiguousarray(x.T, np.float64)
        self.low = self.columns.min(axis=1, initial=np.inf)
        self.high = self.columns.max(axis=1, initial=-np.inf)

    def scan(self, q: np.ndarray, bitmap: np.ndarray, passing: Callable, enough: int, step: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, their inner products with q, components read) of the rows of the bitmap that ``passing`` leaves.

        Dimensions are read in the order of q's magnitudes, ``step`` of them at a time. After each, a row's product lies between what it has
        and the least and most that the other dimensions can add; ``passing(lower, upper)`` says which rows stay. Once
        ``enough`` of them or fewer are left, their products are taken whole. Bounds are floats with room for their error, products are integers.
        """
        order = np.argsort(-np.abs(q), kind="stable")
        w = q[order].astype(np.float64)
        ends = np.sort(np.stack([w * self.low[order], w * self.high[order]]), axis=0)
        rest = np.concatenate([np.cumsum(ends[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1))], axis=1)
        slack = (len(q) + 8) * 2.0**-52 * np.abs(ends).max(axis=0, initial=0.0).sum()
        rows = np.flatnonzero(bitmap)
        partial, read = np.zeros(len(rows)), 0
        for at in range(0, len(q), step):
            if len(rows) <= enough:
                break
            dims = order[at : at + step]
            for weight, d in zip(w[at : at + step], dims):
                partial += weight * self.columns[d][rows]
            read += len(dims) * len(rows)
            done = min(at + step, len(q))
            stay = passing(partial + rest[0, done] - slack, partial + rest[1, done] + slack)
            if not stay.all():
                rows, partial = rows[stay], partial[stay]
        return rows, self.x[rows] @ q, read


def _highest(k: int) -> Callable:
    """Rows that may be among the k of the highest products."""

    def passing(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        if len(lower) <= k:
            return np.ones(len(lower), bool)
        return upper >= np.partition(lower, len(lower) - k)[len(lower) - k]

    return passing


def _within(windows: list[tuple[int, int]], k: int) -> Callable:
    """Rows that may be among the k highest of one of the windows [a, b]."""

    def passing(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(lower), bool)
        for a, b in windows:
            may = (upper >= a) & (lower <= b)
            sure = lower[may & (lower >= a) & (upper <= b)]
            if len(sure) > k:
                may &= upper >= np.partition(sure, len(sure) - k)[len(sure) - k]
            stay |= may
        return stay

    return passing


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _codes(asked: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both as numbers."""
    _, code = np.unique(np.array(asked["label"].to_pylist() + rows["label"].to_pylist(), str), return_inverse=True)
    return code[: len(asked)], code[len(asked) :]


def _positives(k: int, step: int):
    """(anchor_id, positive_id, score): each anchor's k best of its own label in one shard."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "positive_id": [], "score": []}
        if len(asked) and len(rows):
            shard, ids = Columns(_matrix(rows["v"])), rows["vec_id"].to_numpy()
            mine, theirs = _codes(asked, rows)
            for q, own, label in zip(_matrix(asked["v"]), asked["anchor_id"].to_numpy(), mine):
                at, score, _ = shard.scan(q, (theirs == label) & (ids != own), _highest(k), 4 * k, step)
                best = _best(score, ids[at], k)
                out["anchor_id"] += [own] * len(best)
                out["positive_id"] += ids[at[best]].tolist()
                out["score"] += score[best].tolist()
        return pa.table({n: pa.array(x, pa.int64()) for n, x in out.items()})

    return run


def _negatives(k: int, low: int, high: int, step: int):
    """(anchor_id, place, negative_id, score): for each of an anchor's positives the k best of its window in one shard."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "place": [], "negative_id": [], "score": []}
        if len(asked) and len(rows):
            shard, ids = Columns(_matrix(rows["v"])), rows["vec_id"].to_numpy()
            mine, theirs = _codes(asked, rows)
            for q, own, label, scores in zip(_matrix(asked["v"]), asked["anchor_id"].to_numpy(), mine, asked["scores"].to_pylist()):
                windows = [(-(-low * s // 100), high * s // 100) for s in scores]
                at, score, _ = shard.scan(q, theirs != label, _within([w for w in windows if w[0] <= w[1]], k), 4 * k, step)
                for place, (a, b) in enumerate(windows):
                    inside = np.flatnonzero((score >= a) & (score <= b))
                    best = inside[_best(score[inside], ids[at[inside]], k)]
                    out["anchor_id"] += [own] * len(best)
                    out["place"] += [place] * len(best)
                    out["negative_id"] += ids[at[best]].tolist()
                    out["score"] += score[best].tolist()
        return pa.table({n: pa.array(x, pa.int64()) for n, x in out.items()})

    return run


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    shard_rows: int = 16384,
    anchor_rows: int = 1024,
    step: int = 4,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its ``positives`` best
    rows of its own label, the ``negatives`` best rows of other labels whose score is low to high percent of the positive's.

    Components become floor(scale * x), a score is the inner product with the anchor; higher scores come first, ties by smaller ids.
    Rows are dealt into shards of about shard_rows, one by one, so that equal rows and rows of one label spread; a task holds a shard
    by dimension and about anchor_rows anchors. For each anchor it reads the dimensions in the order of the anchor's magnitudes, ``step`` at
    a time, and what the unread ones can still add, at least and at most, leaves ever fewer candidates: first among the rows of its label,
    until the best are known, then among all others, until those in the positives' windows are. A positive of negative score has an empty window.

    A row is never its own positive, nor is another of its id. An anchor meets vectors of its own length only. Rows with a null
    id, label or vector, or with null or non-finite components, take no part, nor do vectors without components or of
    a squared length of 2 ** 62 and more in integers, as their scores may not fit in a long. Of anchors that share an id the smallest
    label and vector counts; repeated rows are each a candidate. Other columns are ignored. An empty table gives no rows.
    """

    def clean(df: DataFrame) -> DataFrame:
        whole = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
        odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= _LONGEST))
        named = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
        rows = df.where(named & ~odd).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.size(vector_col).alias("dim"), whole.alias("v"))
        short = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < _LONGEST
        return rows.where(short).withColumn("v", F.transform("v", lambda x: x.cast("long")))

    rows = cut(clean(vectors).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())))
    own = clean(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "dim", "v")).alias("m"))
    asked = cut(own.select(F.col("vec_id").alias("anchor_id"), "m.label", "m.dim", "m.v"))
    parts = lambda df, size, name: df.groupBy("dim").agg(F.ceil(F.count("*") / size).alias(name))
    sizes = cut(parts(asked, anchor_rows, "parts").join(parts(rows, shard_rows, "shards"), "dim"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["dim", "shard", "part"]
    dealt = rows.join(sizes, "dim").withColumn("shard", F.pmod("deal", "shards")).withColumn("part", every("parts")).select(*keys, "vec_id", "label", "v")

    def meet(left: DataFrame, function: Callable, schema: str) -> DataFrame:
        sent = left.join(sizes, "dim").withColumn("part", F.pmod(F.xxhash64("anchor_id"), F.col("parts"))).withColumn("shard", every("shards")).drop("parts", "shards")
        return sent.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(function, schema)

    def first(df: DataFrame, by: list[str], name: str, k: int) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), name))).where(F.col("rank") <= k)

    near = cut(first(meet(asked, _positives(positives, step), "anchor_id long, positive_id long, score long"), ["anchor_id"], "positive_id", positives))
    scores = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("s"))  # at most ``positives`` of them
    paired = asked.join(scores.select("anchor_id", F.transform("s", lambda x: x["score"]).alias("scores")), "anchor_id")
    far = cut(meet(paired, _negatives(negatives, low, high, step), "anchor_id long, place long, negative_id long, score long"))
    discard(rows)
    best = first(far, ["anchor_id", "place"], "negative_id", negatives).select("anchor_id", (F.col("place") + 1).alias("place"), "rank", "negative_id", F.col("score").alias("negative_score"))
    each = near.select("anchor_id", F.col("rank").alias("place"), "positive_id", F.col("score").alias("positive_score"))
    return best.join(each, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
