"""Leakage, lookup, scenario and fusion joins; nearest neighbours by pivots; most similar patterns in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import physical_score
from ._work import discard, stored


def _key(cols: list[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def _vectors(fit: DataFrame, cols: list[str]) -> DataFrame:
    return fit.select(*[F.col(c).alias(f"_f_{c}") for c in cols]).distinct().withColumn("_fk", F.xxhash64(*[F.col(f"_f_{c}") for c in cols]))


def _same(cols: list[str]) -> Column:
    on = F.col("_k") == F.col("_fk")
    for c in cols:
        on = on & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
    return on


def leakage_check(test: DataFrame, fit: DataFrame, cols: list[str]) -> DataFrame:
    """(n, leaked, share): evaluation rows whose whole feature vector occurs in the fit rows."""
    marked = test.withColumn("_k", _key(cols)).join(_vectors(fit, cols).withColumn("_hit", F.lit(1)), _same(cols), "left")
    return marked.agg(F.count("*").alias("n"), F.count("_hit").alias("leaked"), F.coalesce(F.count("_hit") / F.count("*"), F.lit(0.0)).alias("share"))


def remove_leakage(test: DataFrame, fit: DataFrame, cols: list[str]) -> DataFrame:
    return test.withColumn("_k", _key(cols)).join(_vectors(fit, cols), _same(cols), "left_anti").drop("_k")


def exclude_fit_source(df: DataFrame, days: list[str], day: str = "day") -> DataFrame:
    return df.where(~F.col(day).isin(days))


def label_lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """df with the value of its key, or default; Spark broadcasts dim while it is small."""
    return df.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


#: An interval is cut into pieces of 64 ** level steps, aligned to their size.
_PIECE_BITS = 6
_EVER = 1 << 62


def aligned_pieces(start: int | None, end: int | None) -> list[tuple[int, int]]:
    """(level, number) of the largest aligned pieces that make up [start, end); None is open."""
    a, b = -_EVER if start is None else max(start, -_EVER), _EVER if end is None else min(end, _EVER)
    out, level, size = [], 0, 1 << _PIECE_BITS
    while a < b:
        up, down = -(-a // size), b // size
        if up >= down:
            out += [(level, i) for i in range(a, b)]
            break
        out += [(level, i) for i in (*range(a, up * size), *range(down * size, b))]
        a, b, level = up, down, level + 1
    return out


def tag_scenario(df: DataFrame, segments: DataFrame | list[tuple[str, int | None, int | None]], step: str = "step", default: str = "BENIGN") -> DataFrame:
    """df with the segment of each step: the first whose [start, end) holds it, else default.

    segments: a table (place, segment, start, end), of which the smallest place comes first (then the name), or a list in order. A null start or end is open; segments may
    overlap, leave gaps, and be any number. Each is cut into aligned pieces of 64 ** level steps, at most 126 of a level, and a row
    meets one piece of each level that occurs by an equal join, which Spark broadcasts while the pieces are few. A null step has no segment.
    """
    if isinstance(segments, list):
        segments = df.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(segments)], "place int, segment string, start long, end long")

    @F.udf("array<struct<level: int, number: long>>")
    def cut(start, end):
        return aligned_pieces(start, end)

    pieces = segments.select("place", "segment", F.explode(cut(F.col("start").cast("long"), F.col("end").cast("long"))).alias("p"))
    first = stored(pieces.groupBy("p.level", "p.number").agg(F.min(F.struct("place", "segment")).alias("s")))
    levels = sorted(r.level for r in first.select("level").distinct().collect())  # 11 at most
    out = df
    for i in levels:
        mine = first.where(F.col("level") == i).select(F.col("number").alias("_number"), F.col("s").alias(f"_s{i}"))
        out = out.join(mine, F.shiftright(F.col(step).cast("long"), _PIECE_BITS * i) == F.col("_number"), "left").drop("_number")
    found = [F.col(f"_s{i}") for i in levels]
    chosen = F.lit(None).cast("string") if not found else (F.least(*found) if len(found) > 1 else found[0])["segment"]
    return out.withColumn("segment", F.coalesce(chosen, F.lit(default))).drop(*[f"_s{i}" for i in levels])


def fuse_layers(phys: DataFrame, net: DataFrame, on: list[str], chi_threshold: float, w_phys: float = 0.5, w_net: float = 0.5, mode: str = "weighted", thr: float = 0.5) -> DataFrame:
    """Physical (adi, phys_alarm) with network (net_label, attack_prob, net_alarm) rows, one decision each; hard alarms always count unless mode is 'and'."""
    j = phys.join(net, on)
    p, n = F.col("phys_alarm") == 1, F.col("net_alarm") == 1
    p_phys = physical_score(F.col("adi"), chi_threshold)
    fused = w_phys * p_phys + w_net * F.col("attack_prob")
    alarm = {"and": p & n, "or": p | n, "weighted": p | n | (fused >= thr)}[mode]
    label = F.when(p & n, F.concat("net_label", F.lit("+FDIA"))).when(p, "FDIA").when(n, F.col("net_label")).otherwise("BENIGN")
    source = F.when(p & n, "BOTH").when(p, "PHYS").when(n, "NET").otherwise("NONE")
    return j.select(*on, "phys_alarm", "net_alarm", "net_label", p_phys.alias("p_phys"), fused.alias("fused"), alarm.cast("int").alias("alarm"), label.alias("label"), source.alias("source"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best_patterns(v: np.ndarray, p: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pattern id, similarity) of the most similar pattern to each row, the smallest id on ties; 0 where either has no direction.

    One matrix product for some rows and patterns at a time leaves out what its error can't make the best; the others are computed one by one.
    """
    size_v, size_p = np.linalg.norm(v, axis=1), np.linalg.norm(p, axis=1)
    unit_v, unit_p = (np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0) for x, n in ((v, size_v), (p, size_p)))
    best, who = np.full(len(v), -np.inf), np.full(len(v), np.iinfo(np.int64).max)
    for s in range(0, len(v), 1024):
        for t in range(0, len(p), 4096):
            rough = unit_v[s : s + 1024] @ unit_p[t : t + 4096].T
            row, col = np.nonzero(rough >= np.maximum(rough.max(axis=1), best[s : s + 1024])[:, None] - 1e-9)
            row, col = row + s, col + t
            sim = np.einsum("ij,ij->i", v[row], p[col]) / np.where(size_v[row] * size_p[col] > 0, size_v[row] * size_p[col], 1.0)
            order = np.lexsort((ids[col], -sim, row))
            row, sim, name = row[order], sim[order], ids[col[order]]
            first = np.append(True, row[1:] != row[:-1])[: len(row)]
            row, sim, name = row[first], sim[first], name[first]
            better = (sim > best[row]) | ((sim == best[row]) & (name < who[row]))
            best[row[better]], who[row[better]] = sim[better], name[better]
    return who, best


def cosine_best_match(df: DataFrame, library: DataFrame, id_col: str, vec: str, thr: float = 0.9, limit: int = 100_000, block_rows: int = 8192, block_patterns: int = 8192) -> DataFrame:
    """(id, pattern_id, similarity, matched): the most similar pattern of the same length; the smallest id on ties. One row for each id.

    Up to ``limit`` patterns go to every task; more are dealt in blocks, as the rows are, and a task multiplies one block of each and keeps each row's best, so pairs are
    never rows. A vector without direction has similarity 0. Rows and patterns that are null, or without components, or hold nulls, take no part.
    """

    def clean(d: DataFrame, name: str) -> DataFrame:
        v = F.col(vec).cast("array<double>")
        return d.select(F.col(name), v.alias("v")).where(F.col(name).isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())).withColumn("dim", F.size("v"))

    kind = dict(df.dtypes)[id_col]
    rows, patterns = clean(df, id_col), stored(clean(library.withColumn("pattern_id", F.col("pattern_id").cast("long")), "pattern_id"))
    schema, names = f"`{id_col}` {kind}, pattern_id long, s double", [id_col, "pattern_id", "s"]
    n = patterns.count()
    if n <= limit:
        held = {}
        for dim in [r.dim for r in patterns.select("dim").distinct().collect()]:
            t = patterns.where(F.col("dim") == dim).toArrow()
            held[dim] = _matrix(t["v"]), t["pattern_id"].to_numpy()

        def near(batches):
            for batch in batches:
                dims = batch.column(2).to_numpy()
                for dim in np.unique(dims):
                    if dim in held:
                        mine = batch.take(pa.array(np.flatnonzero(dims == dim)))
                        who, sim = best_patterns(_matrix(mine.column(1)), *held[dim])
                        yield pa.RecordBatch.from_arrays([mine.column(0), pa.array(who), pa.array(sim)], names)

        each = rows.mapInArrow(near, schema)
    else:
        rows = stored(rows.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())))
        parts, blocks = max(1, -(-rows.count() // block_rows)), -(-n // block_patterns)
        spread = lambda d, c, k: d.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
        keys = ["dim", "part", "block"]
        left = spread(rows.withColumn("part", F.pmod("deal", F.lit(parts))), "block", blocks).drop("deal")
        right = spread(patterns.withColumn("block", F.pmod(F.xxhash64("pattern_id", "v"), F.lit(blocks))), "part", parts)

        def meet(asked: pa.Table, lib: pa.Table) -> pa.Table:
            who, sim = best_patterns(_matrix(asked["v"]), _matrix(lib["v"]), lib["pattern_id"].to_numpy()) if len(asked) and len(lib) else (np.zeros(0, np.int64), np.zeros(0))
            return pa.table([asked[id_col].slice(0, len(who)), pa.array(who), pa.array(sim)], names)

        each = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
    best = each.groupBy(id_col).agg(F.max(F.struct("s", (-F.col("pattern_id")).alias("i"))).alias("b"))
    return best.select(id_col, (-F.col("b.i")).alias("pattern_id"), F.col("b.s").alias("similarity"), (F.col("b.s") >= thr).alias("matched"))


def _nearest(q, q_ids, x, ids, k: int):
    """(query, row, squared distance) of each query's k nearest rows of other ids, by (distance, id): distances from one matrix
    product only leave out rows that its error can't make one of them."""
    out = []
    with np.errstate(invalid="ignore", over="ignore"):
        size_x = (x**2).sum(axis=1)
        for s in range(0, len(q), 256):
            part = q[s : s + 256]
            size = (part**2).sum(axis=1)[:, None] + size_x
            rough, slack = size - 2 * (part @ x.T), 1e-9 * size
            usable = np.isfinite(rough) & (ids[None, :] != q_ids[s : s + 256, None])
            low = np.where(usable, rough - slack, np.inf)
            high = np.where(usable, rough + slack, np.inf)
            kth = np.partition(high, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(part), np.inf)
            for i in range(len(part)):
                at = np.flatnonzero(usable[i] & (low[i] <= kth[i]))
                d = ((x[at] - part[i]) ** 2).sum(axis=1)
                best = np.lexsort((ids[at], d))[:k]
                out += [(s + i, at[b], d[b]) for b in best]
    return out


#: Most lengths of vectors whose rows are parted by pivots, most pivots of a length, and most components of all pivots of a length.
_LENGTHS, _PIVOTS, _PIVOT_NUMBERS = 8, 4096, 1 << 18


def _pivots(rows: DataFrame, block_rows: int) -> dict[int, np.ndarray]:
    """Pivots of the commonest lengths, about one for block_rows rows: drawn from a bounded sample by their squared distance to those before."""
    out = {}
    for dim, n in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(_LENGTHS).collect():
        k = min(-(-n // block_rows), _PIVOTS, max(1, _PIVOT_NUMBERS // max(1, dim)))
        if k < 2:
            continue
        share = int(min(1.0, 24 * k / n) * (1 << 30)) + 1
        drawn = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("deal", F.lit(5)), F.lit(1 << 30)) < share)).select("v").limit(16 * k).toArrow()["v"]
        x = _matrix(drawn)
        x = x[(np.abs(x) < 1e100).all(axis=1)]  # squares and their sums stay finite
        if not len(x):
            continue
        rng = np.random.default_rng(k)
        chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(chosen) < k and far.max() > 0:
            chosen.append(int(rng.choice(len(x), p=far / far.sum())))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        out[dim] = x[chosen]
    return out


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, pivots) distances and their possible error."""
    with np.errstate(invalid="ignore", over="ignore"):
        size = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)
        return np.sqrt(np.maximum(size - 2 * (x @ pivots.T), 0.0)), 1e-7 * np.sqrt(size)


def _of_lengths(batch: pa.RecordBatch, dims: np.ndarray):
    for dim in np.unique(dims):
        yield int(dim), batch.take(pa.array(np.flatnonzero(dims == dim)))


#: Most numbers of a matrix of queries and cells (or rows and pivots) that a task holds at once.
_MEETING = 1 << 20


def _cut(batch: pa.RecordBatch, columns: dict[int, int]):
    """(length, rows): the rows of each length, in pieces of as many as may meet the length's cells or pivots at once."""
    for dim, mine in _of_lengths(batch, batch.column(2).to_numpy()):
        step = max(1, _MEETING // max(1, columns.get(dim, 1)))
        for i in range(0, len(mine), step):
            yield dim, mine.slice(i, step)


#: Rings of a cell: the rows whose distance from the pivot lies between a power of the root of 2 and the next.
_RINGS = 4096


def _celled(pivots: dict):
    """Rows with their cell, a ring about their nearest pivot, and the least and most that they can be from it."""

    def run(batches):
        for batch in batches:
            for dim, mine in _cut(batch, {d: len(p) for d, p in pivots.items()}):
                cell, near, far = np.zeros(len(mine), np.int64), np.zeros(len(mine)), np.full(len(mine), np.inf)
                if dim in pivots:
                    d, error = _to_pivots(_matrix(mine.column(1)), pivots[dim])
                    d = np.where(np.isfinite(d), d, np.inf)
                    own = d.argmin(axis=1)[:, None]
                    d, error = np.take_along_axis(d, own, 1)[:, 0], np.take_along_axis(error, own, 1)[:, 0]
                    ring = np.where(np.isfinite(d), np.floor(2 * np.log2(np.clip(d, 1e-300, 1e300))), 0) + _RINGS // 2
                    cell, near, far = own[:, 0] * _RINGS + ring.astype(np.int64), np.maximum(d - error, 0.0), d + error
                yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(cell), pa.array(near), pa.array(far)], [*mine.schema.names, "cell", "near", "far"])

    return run


class _Rings:
    """The cells of one length: where they are, and how many rows they hold."""

    def __init__(self, pivots: np.ndarray, cells: pd.DataFrame):
        self.cells, self.pivots = cells["cell"].to_numpy(), pivots[cells["cell"] // _RINGS]
        self.low, self.high, self.rows = (cells[c].to_numpy() for c in ("low", "high", "rows"))

    def ask(self, q: np.ndarray, kth: np.ndarray, k: int, home: bool) -> np.ndarray:
        """(queries, cells): the cell that each begins with; or all others that a row within its kth distance may be in.

        The kth distance is also at most that of the far ends of the nearest cells with k + 1 rows together.
        """
        d, error = _to_pivots(q, self.pivots)
        gap = np.maximum(np.maximum(d - error - self.high, self.low - d - error), 0.0)
        gap = np.where(np.isfinite(gap), gap, np.inf)
        end = np.where(np.isfinite(d), d + error + self.high, np.inf)
        first = np.where(gap <= gap.min(axis=1, keepdims=True), end, np.inf).argmin(axis=1)
        begins = np.arange(len(self.cells)) == first[:, None]
        if home:
            return begins
        order = np.argsort(end, axis=1)
        enough = np.cumsum(self.rows[order], axis=1) > k
        bound = np.where(enough[:, -1], np.take_along_axis(np.take_along_axis(end, order, 1), enough.argmax(axis=1)[:, None], 1)[:, 0], np.inf)
        return ~begins & (gap <= np.minimum(kth * (1 + 1e-9), bound)[:, None])


def _asking(balls: dict, k: int, home: bool):
    """(id, v, dim, cell): the queries with the cells that they ask."""

    def run(batches):
        for batch in batches:
            for dim, mine in _cut(batch, {d: len(b.cells) for d, b in balls.items()}):
                if dim in balls:
                    cells, wanted = balls[dim].cells, balls[dim].ask(_matrix(mine.column(1)), mine.column(3).to_numpy(), k, home)
                else:  # one cell without a place
                    cells, wanted = np.zeros(1, np.int64), np.full((len(mine), 1), home)
                row, col = np.nonzero(wanted)
                for i in range(0, len(row), 1000):
                    sent = mine.take(pa.array(row[i : i + 1000]))
                    yield pa.RecordBatch.from_arrays([*sent.columns[:3], pa.array(cells[col[i : i + 1000]])], ["id", "v", "dim", "cell"])

    return run


def knn_join(left: DataFrame, right: DataFrame, id_col: str, vec: str, k: int = 5, query_rows: int = 4096, block_rows: int = 8192, stats: dict | None = None) -> DataFrame:
    """(id, rank, neighbor, dist): the k rows of right nearest to each row of left, itself excluded; ties to smaller ids.

    Rows of right go to the nearest of some pivots from a bounded sample, and there to rings by their distance from it. Such a cell knows the least and greatest of these
    distances, and one of many rows is dealt in blocks of about block_rows. A query first meets the cell that it lies in, and then only
    cells that by the triangle inequality may hold a row within its kth distance so far. A task holds one block and about query_rows queries, and keeps its own k nearest for each. A query meets
    vectors of its own length only. Rows with a null id or vector take no part, nor do distances that aren't finite; no queries give no rows.
    With ``stats`` its ``pairs`` and ``all_pairs`` say how many distances were taken, and how many there are.
    """

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id is not null and v is not null").withColumn("dim", F.size("v"))

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if len(asked) and len(rows) and asked["dim"][0].as_py():
            q_ids, ids = asked["id"].to_numpy(), rows["id"].to_numpy()
            found = [(q_ids[i], ids[j], np.sqrt(d)) for i, j, d in _nearest(_matrix(asked["v"]), q_ids, _matrix(rows["v"]), ids, k)]
        a, b, c = zip(*found) if found else ((), (), ())
        return pa.table({"id": pa.array(a, pa.int64()), "neighbor": pa.array(b, pa.int64()), "dist": pa.array(c, pa.float64())})

    asked = stored(clean(left))
    rows = stored(clean(right).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())))
    pivots = _pivots(rows, block_rows)
    celled = stored(rows.mapInArrow(_celled(pivots), "id long, v array<double>, dim int, deal long, cell long, near double, far double"))
    cells = stored(celled.groupBy("dim", "cell").agg(F.min("near").alias("low"), F.max("far").alias("high"), F.count("*").alias("rows"), F.ceil(F.count("*") / block_rows).alias("blocks")))
    balls = {}
    for dim, p in pivots.items():
        balls[dim] = _Rings(p, cells.where(F.col("dim") == dim).toPandas())  # some rows for each pivot
    dealt = celled.join(cells.select("dim", "cell", "blocks"), ["dim", "cell"]).withColumn("block", F.pmod("deal", "blocks")).select("dim", "cell", "block", "id", "v")
    keys = ["dim", "cell", "block"]
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    w = Window.partitionBy("id").orderBy("dist", "neighbor")
    pairs = []

    def wave(found: DataFrame | None) -> DataFrame:
        if found is None:
            start = asked.withColumn("kth", F.lit(0.0))
        else:
            ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("id").agg(F.max("dist").alias("d"), F.count("*").alias("n"))
            start = asked.join(ranked, "id", "left").withColumn("kth", F.when(F.col("n") >= k, F.col("d")).otherwise(F.lit(float("inf")))).select("id", "v", "dim", "kth")
        sent = start.mapInArrow(_asking(balls, k, found is None), "id long, v array<double>, dim int, cell long").join(cells.drop("low", "high"), ["dim", "cell"])
        sent = stored(sent.withColumn("block", every("blocks")))
        if stats is not None:
            pairs.append(sent.where("block = 0").agg(F.sum("rows")).first()[0] or 0)
        parts = sent.groupBy(*keys).agg(F.ceil(F.count("*") / query_rows).alias("parts"))
        asks = sent.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")))
        held = dealt.join(parts, keys).withColumn("part", every("parts"))
        by = [*keys, "part"]
        met = asks.select(*by, "id", "v").groupBy(*by).cogroup(held.select(*by, "id", "v").groupBy(*by)).applyInArrow(meet, "id long, neighbor long, dist double")
        return stored(met)

    near = wave(None)
    if balls:
        near = near.union(wave(near))
    discard(rows, celled)
    if stats is not None:
        per = asked.groupBy("dim").count().alias("a").join(cells.groupBy("dim").agg(F.sum("rows").alias("rows")).alias("b"), "dim")
        stats.update(pairs=sum(pairs), all_pairs=per.agg(F.sum(F.col("count") * F.col("rows"))).first()[0] or 0)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("id").alias(id_col), "rank", "neighbor", "dist")
