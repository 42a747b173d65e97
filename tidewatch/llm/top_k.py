"""Exact top-k inner-product search by ball trees, one for each shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import cut, discard, map_batches

_NONE = np.iinfo(np.int64).max
#: Below any score.
LOW = -_NONE
#: Most lengths of vectors that get routes of their own; rows of rarer ones are dealt by hash alone.
_LENGTHS = 8
#: Most routes of a length, and most components of their centres.
_ROUTES, _CENTRE_NUMBERS = 4096, 1 << 18


def _reach(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """(queries, balls): no vector of the ball scores above."""
    along = q @ centres.T
    spread = np.linalg.norm(q, axis=1)[:, None] * radii
    return along + spread + 1e-9 * (np.abs(along) + spread) + 1e-6


class BallTree:
    """Leaves of about ``leaf`` vectors. An inner node parts its vectors by the nearer of two of them."""

    def __init__(self, x: np.ndarray, leaf: int):
        centres, radii, ways, levels, children, rows_of = [], [], [], [], [], []
        stack = [(np.arange(len(x)), -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            node = len(radii)
            if parent >= 0:
                children[parent][side] = node
            centre = x[rows].mean(axis=0)
            far = np.linalg.norm(x[rows] - centre, axis=1)
            centres.append(centre)
            radii.append(far.max())
            children.append([-1, -1])
            rows_of.append(rows)
            a = x[rows[far.argmax()]]
            b = x[rows[np.linalg.norm(x[rows] - a, axis=1).argmax()]]
            ways.append(a - b)
            levels.append((a @ a - b @ b) / 2)
            if len(rows) <= leaf:
                continue
            left = x[rows] @ ways[-1] >= levels[-1]
            if left.all() or not left.any():  # equal vectors: any halves do
                left = np.arange(len(rows)) < len(rows) // 2
            stack += [(rows[left], node, 0), (rows[~left], node, 1)]
        self.centres, self.radii, self.children, self.rows = np.array(centres), np.array(radii), np.array(children), rows_of
        self.ways, self.levels = np.array(ways), np.array(levels)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls in, be it of the tree or not."""
        at = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(self.children[at, 0] >= 0)
        while len(inner):
            node = at[inner]
            left = np.einsum("ij,ij->i", x[inner], self.ways[node]) >= self.levels[node]
            at[inner] = self.children[node, np.where(left, 0, 1)]
            inner = inner[self.children[at[inner], 0] >= 0]
        return at


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, k: int, leaf: int):
    """(scores, ids) of each query's k best in x that reach its floor; ties to smaller ids.

    Queries go down the tree together. At a node each goes first to the child of the larger bound (fewer than an
    eighth of all go with the others); to the other only if that child's bound still reaches the query's kth score, at
    first the floor. Vectors hold whole numbers and scores are exact: products of long vectors are of integers.
    """
    tree = BallTree(x, leaf)
    longest = np.linalg.norm(x, axis=1).max() * np.linalg.norm(q, axis=1).max()
    qs, xs = (q, x) if longest < 2**52 else (q.astype(np.int64), x.astype(np.int64))
    best = np.full((len(q), k), LOW)
    who = np.full((len(q), k), _NONE)
    stack = [(0, np.arange(len(q)), _reach(q, tree.centres[:1], tree.radii[:1])[:, 0])]
    while stack:
        node, live, bound = stack.pop()
        on = bound >= np.maximum(best[live, -1], floor[live])
        live, bound = live[on], bound[on]
        if not len(live):
            continue
        pair = tree.children[node]
        if pair[0] >= 0:
            below = np.minimum(_reach(q[live], tree.centres[pair], tree.radii[pair]), bound[:, None])
            left = below[:, 0] >= below[:, 1]
            if min(left.sum(), (~left).sum()) < len(q) / 8:  # too few to go another way by themselves
                left[:] = 2 * left.sum() >= len(left)
            for side, mine in ((0, left), (1, ~left)):  # the last pushed is visited first
                if mine.any():
                    stack += [(pair[1 - side], live[mine], below[mine, 1 - side]), (pair[side], live[mine], below[mine, side])]
            continue
        rows = tree.rows[node]
        s = (qs[live] @ xs[rows].T).astype(np.int64)
        own = np.broadcast_to(ids[rows], s.shape)
        s = np.where((own == q_ids[live, None]) | (s < np.maximum(best[live, -1], floor[live])[:, None]), LOW, s)
        new = (s > LOW).any(axis=1)  # only these have anything to merge
        live, s = live[new], s[new]
        own = np.where(s == LOW, _NONE, own[new])
        s, own = np.concatenate([best[live], s], axis=1), np.concatenate([who[live], own], axis=1)
        top = np.lexsort((own, -s), axis=1)[:, :k]
        best[live], who[live] = np.take_along_axis(s, top, 1), np.take_along_axis(own, top, 1)
    return best, who


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _search(k: int, leaf: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            q_ids, ids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
            best, who = search(_matrix(right["v"]), ids, _matrix(left["v"]), q_ids, left["floor"].to_numpy(), k, leaf)
            row, col = np.nonzero(who != _NONE)
            out = {"query_id": q_ids[row], "vec_id": who[row, col], "score": best[row, col]}
        return pa.table({n: pa.array(x, pa.int64()) for n, x in out.items()})

    return run


def _lengths(column: pa.Array):
    """(length, row numbers) of the vectors of a batch."""
    dims = column.to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def _routes(trees: dict):
    """(id, dim, v) with the route of each vector and its distance from the route's centre."""

    def run(batches):
        for batch in batches:
            route, far = np.zeros(len(batch), np.int64), np.full(len(batch), np.inf)
            for dim, rows in _lengths(batch.column(1)):
                if dim in trees:
                    x = _matrix(batch.column(2).take(pa.array(rows)))
                    route[rows] = trees[dim].route(x)
                    far[rows] = np.linalg.norm(x - trees[dim].centres[route[rows]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(route), pa.array(far)], ["vec_id", "dim", "v", "route", "far"])

    return run


def _targets(balls: dict):
    """(query, dim, v, floor) for each route whose ball reaches the floor, with its place among the query's routes by bound."""

    def run(batches):
        for batch in batches:
            for dim, rows in _lengths(batch.column(1)):
                mine = batch.take(pa.array(rows))
                floor = mine.column(3).to_numpy()
                if dim in balls:
                    routes, centres, radii = balls[dim]
                else:  # rows of a rare length have one route without a ball
                    routes, centres, radii = np.zeros(1, np.int64), np.zeros((1, dim)), np.full(1, np.inf)
                q = _matrix(mine.column(2))
                bound = _reach(q, centres, radii) if dim in balls else np.full((len(q), 1), np.inf)
                place = np.empty(bound.shape, np.int64)
                np.put_along_axis(place, np.argsort(-bound, axis=1, kind="stable"), np.arange(len(routes))[None, :], 1)
                row, col = np.nonzero(bound >= floor[:, None])
                for i in range(0, len(row), 1000):
                    r, c = row[i : i + 1000], col[i : i + 1000]
                    yield pa.RecordBatch.from_arrays([*mine.take(pa.array(r)).columns, pa.array(routes[c]), pa.array(place[r, c])], ["query_id", "dim", "v", "floor", "route", "place"])

    return run


def _fit(rows: DataFrame, shard_rows: int) -> dict[int, BallTree]:
    """A routing tree for each of the commonest lengths, from about 16 sampled rows for each route, 2,048 at least."""
    trees = {}
    for dim, n in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(_LENGTHS).collect():
        routes = min(-(-n // shard_rows), _ROUTES, max(1, _CENTRE_NUMBERS // dim))
        wanted = max(2048, 16 * routes) if routes > 1 else 1
        drawn = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.5 * wanted / n) * (1 << 30)) + 1)))
        sample = drawn.select("v").limit(wanted).toArrow()["v"]
        if len(sample):  # else the length has one route without a ball
            trees[dim] = BallTree(_matrix(sample), max(1, -(-len(sample) // routes)))
    return trees


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: int = 256,
    shard_rows: int = 8192,
    query_rows: int = 2048,
    leaf: int = 64,
    ahead: int = 4,
) -> DataFrame:
    """(query_id, rank, id, score): each query's k highest inner products, ties to smaller ids.

    Components become floor(scale * x). A tree fitted on a bounded sample (_fit) routes near vectors to one
    route; a route with more than shard_rows rows is parted by hash, so that copies of one vector never fill
    a task. A route's ball holds all its rows. Queries go out in three waves: to one shard of the
    route with the highest bound; to that route's other shards and the next ``ahead`` routes; to all others. Only
    routes whose ball reaches the kth score so far are asked, and each shard's own ball tree is searched from that
    score on. A task holds one shard and about query_rows of the queries that ask it; rows that nobody
    asks are not sent. The sample decides on the way only. Scores are 64-bit integers and exact.

    A query is matched with every row of another id and of as many components (shards hold
    one length). Vectors that are null, or hold null or non-finite components, and
    rows without an id take no part, nor those whose squared length reaches 2**62, as their scores may not fit in a long; a vector without components scores nothing. Of queries that
    share an id the smallest vector counts; repeated rows are each a candidate. Other columns are ignored.
    An empty table gives no rows.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
        odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
        kept = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~odd).select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("dim"), v.alias("v"))
        return kept.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < float(2**62))

    rows = clean(vectors)
    asked = cut(clean(queries).groupBy("vec_id", "dim").agg(F.min("v").alias("v")).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("m")).select(F.col("vec_id").alias("query_id"), "m.dim", "m.v"))
    trees = _fit(rows, shard_rows)
    routed = cut(map_batches(rows, _routes(trees), "vec_id long, dim int, v array<double>, route long, far double"))
    sizes = cut(routed.groupBy("dim", "route").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / shard_rows).alias("shards")))
    balls = {}
    for dim, tree in trees.items():
        held = sizes.where(F.col("dim") == dim).select("route", "radius").toPandas()  # a row for each leaf of the tree at most
        balls[dim] = held["route"].to_numpy(), tree.centres[held["route"]], held["radius"].to_numpy()
    keys = ["dim", "route", "shard"]
    dealt = routed.join(sizes, ["dim", "route"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards"))).select(*keys, "vec_id", "v")

    def wave(number: int, found: DataFrame | None) -> DataFrame:
        nothing = F.lit(LOW)
        if found is None:
            start = asked.withColumn("floor", nothing)
        else:
            ranked = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
            low = ranked.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n"))
            start = asked.join(low, "query_id", "left").withColumn("floor", F.when(F.col("n") >= k, F.col("low")).otherwise(nothing))
        sent = map_batches(start.select("query_id", "dim", "v", "floor"), _targets(balls), "query_id long, dim int, v array<double>, floor long, route long, place long")
        sent = sent.join(sizes, ["dim", "route"]).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
        home = (F.col("place") == 0) & (F.col("shard") == F.pmod(F.xxhash64("query_id", F.lit(3)), F.col("shards")))
        sent = sent.where(F.when(home, 0).when(F.col("place") <= ahead, 1).otherwise(2) == number)
        ready = cut(sent.select("query_id", *keys, "v", "floor"))
        spent.append(ready)
        parts = ready.groupBy(*keys).agg(F.ceil(F.count("*") / query_rows).alias("parts"))
        left = ready.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")))
        right = dealt.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        by = [*keys, "part"]
        met = left.select(*by, "query_id", "v", "floor").groupBy(*by).cogroup(right.select(*by, "vec_id", "v").groupBy(*by))
        return cut(met.applyInArrow(_search(k, leaf), "query_id long, vec_id long, score long"))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    spent: list[DataFrame] = [routed]
    found = wave(0, None)
    if not sizes.groupBy("dim").agg(F.sum("shards").alias("n")).where("n > 1").isEmpty():
        for number in (1, 2):
            found = found.union(wave(number, found))
    discard(*spent)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
