"""K-means from a population of centre sets; every set is judged on all rows, in one pass for each generation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import discard, stored


def assignment_cost(cost: np.ndarray) -> float:
    """The least total of a one-to-one matching of rows and columns of a square matrix, by augmenting paths with potentials."""
    n = len(cost)
    row_price, col_price = np.zeros(n), np.zeros(n)
    owner = np.full(n, -1)
    for start in range(n):
        reach, via = np.full(n, np.inf), np.full(n, -1)
        done, last, row = np.zeros(n, bool), -1, start
        while row >= 0:
            better = cost[row] - row_price[row] - col_price
            closer = ~done & (better < reach)
            reach[closer], via[closer] = better[closer], last
            last = int(np.where(done, np.inf, reach).argmin())
            step = reach[last]
            row_price[start] += step
            row_price[owner[done]] += step
            col_price[done] -= step
            reach[~done] -= step
            done[last] = True
            row = owner[last]
        while last >= 0:
            before = via[last]
            owner[last] = owner[before] if before >= 0 else start
            last = before
    return float(cost[owner, np.arange(n)].sum())


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    """Vectors of one length as rows, straight from Arrow's buffer; other lengths are an error."""
    if len(batch.column(0).value_lengths().unique()) > 1:
        raise ValueError("vectors of different lengths")
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(batch), -1)


def judge(df: DataFrame, vec: str, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, inertia) of every centre set over all rows; tasks return sums, the driver gets one row for each centre's component."""

    def run(batches):
        sums, counts, inertia = np.zeros(sets.shape), np.zeros(sets.shape[:2]), np.zeros(len(sets))
        for batch in batches:
            if not len(batch):
                continue
            x = _vectors(batch)
            size = (x**2).sum(1)[:, None]
            for c, centres in enumerate(sets):
                d = np.maximum(size + (centres**2).sum(1) - 2 * x @ centres.T, 0)
                near = d.argmin(axis=1)
                inertia[c] += d[np.arange(len(x)), near].sum()
                counts[c] += np.bincount(near, minlength=len(centres))
                order = np.argsort(near, kind="stable")
                named, first = np.unique(near[order], return_index=True)
                sums[c][named] += np.add.reduceat(x[order], first, axis=0)
        flat = np.concatenate([sums.ravel(), counts.ravel(), inertia])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], ["at", "v"])

    flat = np.zeros(sets.size + sets.shape[0] * sets.shape[1] + len(sets))
    found = df.select(vec).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # the sets' own size, in one job
    flat[found["at"].to_numpy()] = found["v"].to_numpy()
    a, b = sets.size, sets.size + sets.shape[0] * sets.shape[1]
    return flat[:a].reshape(sets.shape), flat[a:b].reshape(sets.shape[:2]), flat[b:]


def far_rows(df: DataFrame, id_col: str, vec: str, centres: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n rows drawn without replacement, each by its squared distance to the nearest centre: those with the least -log(u) / distance.

    u is a hash of id and vector, so reruns agree. A task keeps its n least, so one pass does and the driver gets n rows.
    """

    def run(batches):
        keys, held = np.zeros(0), np.zeros((0, centres.shape[1]))
        for batch in batches:
            if not len(batch):
                continue
            x = _vectors(batch)
            d = np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T, 0).min(axis=1)
            own = np.full(len(x), np.inf)
            apart = d > 1e-12 * (x**2).sum(1)
            own[apart] = -np.log(batch.column(1).to_numpy()[apart]) / d[apart]
            keys, held = np.concatenate([keys, own]), np.concatenate([held, x])
            least = np.argsort(keys, kind="stable")[:n]
            least = least[np.isfinite(keys[least])]
            keys, held = keys[least], held[least]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(held.tolist(), pa.list_(pa.float64()))], ["k", "v"])

    u = (F.pmod(F.xxhash64(id_col, vec, F.lit(seed)), F.lit(1 << 50)) + F.lit(0.5)) / F.lit(float(1 << 50))
    found = df.select(vec, u.alias("u")).mapInArrow(run, "k double, v array<double>").orderBy("k", "v").limit(n).select("v")
    return np.array([row[0] for row in found.collect()], float).reshape(-1, centres.shape[1])


def candidates(df: DataFrame, id_col: str, vec: str, k: int, rounds: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, weights): at most 1 + 2 * k * rounds distinct rows to start k centres from, and how many rows are nearest to each.

    As k-means|| does it: rounds of 2 * k rows, drawn from all by their squared distance to those drawn before, so that a small group far from the others is
    found. Each round, and the weighing, is one pass.
    """
    first = df.orderBy(F.xxhash64(id_col, vec, F.lit(seed)), vec).limit(1).select(vec).collect()
    found = np.array([row[0] for row in first], float)
    for number in range(rounds if len(found) else 0):
        more = far_rows(df, id_col, vec, found, 2 * k, seed + number + 1)
        if not len(more):
            break
        found = np.unique(np.concatenate([found, more]), axis=0)
    weights = judge(df, vec, found[None])[1][0] if len(found) else np.zeros(0)
    return found, weights


def evolutionary_kmeans(df: DataFrame, id_col: str, vec: str, k: int, population: int = 10, generations: int = 50, alpha: float = 0.5, mutation: float = 0.1, restarts: int = 2, patience: int = 8, tol: float = 1e-4, refine: int = 100, seed: int = 42, rounds: int = 5) -> tuple[list[list[float]], float]:
    """(centres, inertia): the fittest of many centre sets, then plain k-means steps from it.

    In a generation every set takes one k-means step and, with probability ``mutation``, swaps a centre for a candidate;
    ``restarts`` fresh sets join. Fitness is alpha * quality (inertia scaled over the generation) + (1 - alpha) *
    stability (exp of minus the mean shift of matched centres, over the mean distance between rows; 0 for fresh sets).
    It ends after ``patience`` generations without a gain of ``tol``.

    Inertia, sums and counts are of all rows, and so are the weighted ``candidates`` that centres start from. Only the mean distance between rows is
    of 500 of them, the first by a hash. Null vectors take no part; vectors have one length. Fewer than two rows: an error.
    """
    rows = df.where(F.col(vec).isNotNull()).select(id_col, F.col(vec).cast("array<double>").alias(vec))
    rows = stored(rows)  # cast once: every generation is a pass over them
    some = np.array([r[0] for r in rows.orderBy(F.xxhash64(id_col, vec, F.lit(seed)), vec).limit(500).select(vec).collect()], float)
    if len(some) < 2:
        raise ValueError("fewer than two rows")
    pool, weights = candidates(rows, id_col, vec, k, rounds, seed)
    share = weights / weights.sum()
    rng = np.random.default_rng(seed)
    far = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    scale = far(some, some).mean() + 1e-12
    drawn = lambda n: pool[rng.choice(len(pool), size=n, p=share)]

    def fresh() -> np.ndarray:
        centres = drawn(1)
        while len(centres) < k:
            d = share * (far(pool, centres) ** 2).min(axis=1)
            centres = np.vstack([centres, pool[[rng.choice(len(pool), p=d / d.sum())]] if d.sum() > 0 else drawn(1)])
        return centres

    def moved(sums, counts):
        centres = sums / np.maximum(counts, 1)[:, None]
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            centres[empty] = drawn(len(empty))
        return centres

    sets = np.array([fresh() for _ in range(population)])
    sums, counts, _ = judge(rows, vec, sets)
    best, stale = np.inf, 0
    for _ in range(generations):
        young = [moved(s, c) for s, c in zip(sums, counts)]
        for centres in young:
            if rng.random() < mutation:
                centres[rng.integers(k)] = drawn(1)[0]
        stable = [np.exp(-assignment_cost(far(a, b)) / k / scale) for a, b in zip(sets, young)] + [0.0] * restarts
        every = np.array(young + [fresh() for _ in range(restarts)])
        sums, counts, inertia = judge(rows, vec, every)
        span = inertia.max() - inertia.min()
        quality = 1 - (inertia - inertia.min()) / span if span > 0 else np.ones(len(inertia))
        order = np.argsort(-(alpha * quality + (1 - alpha) * np.array(stable)), kind="stable")[:population]
        sets, sums, counts = every[order], sums[order], counts[order]
        top = inertia[order[0]]
        best, stale = (top, 0) if best - top > tol * best or best == np.inf else (best, stale + 1)
        if stale >= patience:
            break
    centres, last = sets[:1], np.inf
    s, c = sums[:1], counts[:1]
    for _ in range(refine):
        centres = moved(s[0], c[0])[None]
        s, c, inertia = judge(rows, vec, centres)
        if last - inertia[0] < tol:
            break
        last = inertia[0]
    else:
        s, c, inertia = judge(rows, vec, centres)
    discard(rows)
    return centres[0].tolist(), float(inertia[0])
