"""Detectors: fitted on benign rows, scored at scale; flag = score >= threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from ..functions.scores import topk_abs_embedding, trust_score
from ._work import discard, quantile_list, stored
from .clean import moments
from .scans import affine_scan, spread_after

_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(*names: str) -> Callable:
    def add(function):
        for n in names:
            _REGISTRY[n] = function
        return function

    return add


def make_detector(name: str) -> Callable[..., DataFrame]:
    if name not in _REGISTRY:
        raise KeyError(f"no detector {name!r}; there are {', '.join(list_detectors())}")
    return _REGISTRY[name]


def list_detectors() -> list[str]:
    return sorted(_REGISTRY)


def _mean_square(parts: list[Column]) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return total / len(parts)


def _number(c: Column) -> Column:
    """Null for NaN, as for null."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def _threshold(scored: DataFrame, alpha: float) -> float:
    found = quantile_list(scored, "score", [1 - alpha])[0]
    return float("inf") if found is None else float(found)


def _judged(fit_scored: DataFrame, df: DataFrame, score: Column, z: list[Column], alpha: float, k: int, slope: float = 1.0) -> DataFrame:
    """df with score, flag (at the benign 1 - alpha quantile), trust by the benign scores' mean and deviation, and as embedding the k
    largest standardised deviations."""
    held = stored(fit_scored.select("score"))  # scored once
    thr = _threshold(held, alpha)
    s = held.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
    discard(held)
    out = df.withColumn("score", score).withColumn("flag", (F.col("score") >= thr).cast("int"))
    out = out.withColumn("trust", trust_score(F.col("score"), F.col("flag"), float(s.m or 0.0), float(s.s or 0.0) + 1e-8, slope))
    return out.withColumn("embedding", topk_abs_embedding(F.array(*z), k))


def _standardised(fit_df: DataFrame, cols: list[str]) -> list[Column]:
    return [(F.col(c) - m) / max(s, 1e-8) for c, (m, s) in moments(fit_df, cols).items()]


@register("zscore", "zscore_demo")
def zscore_detector(fit_df: DataFrame, df: DataFrame, cols: list[str], alpha: float = 0.05, k: int = 4) -> DataFrame:
    """Root mean square of standardised features; trust is half the score over the threshold, held to [0, 1]."""
    stats = moments(fit_df, cols)
    z = [(F.col(c) - m) / max(s, 1e-8) for c, (m, s) in stats.items()]
    score = F.sqrt(_mean_square(z))
    held = stored(fit_df.select(score.alias("score")))
    thr = _threshold(held, alpha)
    discard(held)
    out = df.withColumn("score", score).withColumn("flag", (F.col("score") >= thr).cast("int"))
    trust = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / max(thr, 1e-8) / 2))
    return out.withColumn("trust", trust).withColumn("embedding", topk_abs_embedding(F.array(*z), k))


@register("kalman_frozen")
def kalman_frozen_nis(fit_df: DataFrame, df: DataFrame, cols: list[str], alpha: float = 0.05, k: int = 4, p0: float = 1.0) -> DataFrame:
    """Normalised innovation against a baseline that does not move: mean of (x - mean)^2 / (p0 + variance); the embedding has the largest innovations."""
    stats = moments(fit_df, cols)
    z = [(F.col(c) - m) / float(np.sqrt(p0 + max(s * s, 1e-8))) for c, (m, s) in stats.items()]
    score = _mean_square(z)
    return _judged(fit_df.select(score.alias("score")), df, score, z, alpha, k, 0.5)


@register("null")
def null_detector(fit_df: DataFrame | None, df: DataFrame, cols: list[str] | None = None, alpha: float = 0.05, k: int = 4) -> DataFrame:
    """Constant output, for ablation; nothing is fitted."""
    return df.withColumns({"score": F.lit(0.0), "flag": F.lit(0), "trust": F.lit(0.5), "embedding": F.array_repeat(F.lit(0.0), k)})


Model = Callable[[np.ndarray], np.ndarray]


def wrap_model(score_fn: Model, fit_df: DataFrame, df: DataFrame, cols: list[str], alpha: float = 0.05, k: int = 4, flag_fn: Model | None = None, trust_fn: Model | None = None, embed_fn: Model | None = None, load: bool = False) -> DataFrame:
    """A user's vectorised functions of the (rows, features) matrix: the score, calibrated on benign rows, and, instead of the
    calibrated ones, flag, trust and embedding (any width, padded or cut to k).

    All functions see a batch's matrix in one pass. With ``load`` they are makers of such functions without arguments, called once in each task, so
    that a model is loaded where it is used.
    """
    given = {"score": score_fn, "flag": flag_fn, "trust": trust_fn, "embedding": embed_fn}
    shapes = {"score": lambda x: x.astype(float), "flag": lambda x: x.astype(int), "trust": lambda x: np.clip(x.astype(float), 0.0, 1.0), "embedding": lambda x: list(x.reshape(len(x), -1).astype(float))}
    kinds = {"score": "double", "flag": "int", "trust": "double", "embedding": "array<double>"}

    def applied(names: list[str]) -> Column:
        def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            models = {n: given[n]() if load else given[n] for n in names}
            for xs in parts:
                x = np.column_stack([c.to_numpy(float) for c in xs])
                yield pd.DataFrame({n: pd.Series(shapes[n](np.asarray(f(x)))) for n, f in models.items()})

        schema = ", ".join(f"{n} {kinds[n]}" for n in names)
        return F.pandas_udf(run, schema, PandasUDFType.SCALAR_ITER)(*cols)

    own = [n for n, f in given.items() if f]
    fit = fit_df.select(applied(["score"]).alias("_m")).select("_m.score")
    out = _judged(fit, df.withColumn("_m", applied(own)), F.col("_m.score"), _standardised(fit_df, cols), alpha, k)
    for n in own[1:]:
        out = out.withColumn(n, F.slice(F.concat("_m.embedding", F.array_repeat(F.lit(0.0), k)), 1, k) if n == "embedding" else F.col(f"_m.{n}"))
    return out.drop("_m")


def residual_chi2(df: DataFrame, z: str, z_ref: str, r: list[float] | list[list[float]], threshold: float | None = None, alpha: float = 0.05) -> DataFrame:
    """adi = d' R^-1 d of the residual d = z - z_ref; alarm from the threshold on, or from the (1 - alpha) quantile of the chi-squared distribution.

    r has the variances, or the whole covariance R: its Cholesky factor is taken once, and each row is whitened by the factor's inverse with array
    expressions. A null, or another length than r's, gives a null adi and no alarm.
    """
    from .measurements import chi2_quantile

    r = np.array(r, float)
    m = len(r)
    limit = chi2_quantile(1 - alpha, m) if threshold is None else threshold
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    d = F.zip_with(z, z_ref, lambda a, b: a.cast("double") - b.cast("double"))
    if r.ndim == 1:
        white = F.zip_with(d, F.array(*map(F.lit, (1 / np.sqrt(r)).tolist())), lambda e, w: e * w)
    else:
        rows = np.linalg.inv(np.linalg.cholesky(r))
        white = F.transform(F.array(*[F.array(*map(F.lit, row)) for row in rows.tolist()]), lambda row: total(F.zip_with(row, d, lambda w, e: w * e)))
    sized = (F.size(z) == m) & (F.size(z_ref) == m)
    out = df.withColumn("adi", F.when(sized, total(F.transform(white, lambda w: w * w))))
    return out.withColumn("alarm", F.coalesce((F.col("adi") >= limit).cast("int"), F.lit(0)))


def calibrate_residual_threshold(df: DataFrame, xi: str, pct: float = 99.5, k: float = 3.0) -> DataFrame:
    """The larger of a quantile and mean plus k deviations; null without rows."""
    return df.agg(F.greatest(F.lit(quantile_list(df, xi, [pct / 100])[0]).cast("double"), F.avg(xi) + k * F.stddev_pop(xi)).alias("threshold"))


def kmeans_assign(df: DataFrame, vec: str, centers: list[list[float]]) -> DataFrame:
    """df with cluster (the first nearest centre) and dist (squared)."""
    each = [F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in centers]
    d = F.array(*each)
    return df.withColumn("_d", d).withColumn("cluster", (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).withColumn("dist", F.array_min("_d")).drop("_d")


def kmeans_summary(assigned: DataFrame) -> DataFrame:
    """(cluster, n, inertia): rows and summed squared distances of each cluster of kmeans_assign."""
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("dist").alias("inertia"))


#: The detectors by one name each.
DETECTORS = ("zscore", "kalman_frozen", "null", "pca_reconstruction", "isolation_forest")


def scored_by_all(fit_df: DataFrame, test_df: DataFrame, cols: list[str], keep: list[str], alpha: float = 0.05, names: tuple[str, ...] = DETECTORS) -> DataFrame:
    """(detector, keep, flag, score): test rows as each detector named judges them, written once."""
    made = [make_detector(n)(fit_df, test_df, cols, alpha).select(F.lit(n).alias("detector"), *keep, F.col("flag").cast("int").alias("flag"), F.col("score").cast("double").alias("score")) for n in names]
    return stored(reduce(DataFrame.unionByName, made))


def detector_comparison(fit_df: DataFrame, test_df: DataFrame, cols: list[str], y: str = "y", alpha: float = 0.05, names: tuple[str, ...] = DETECTORS, scored: DataFrame | None = None) -> DataFrame:
    """One row for each registered detector named: threshold metrics by its own flag, and ROC and PR areas of its score. ``scored``: rows of
    scored_by_all, if they are there already."""
    from .curves import curve_areas
    from .metrics import binary_metrics

    out, by = scored or scored_by_all(fit_df, test_df, cols, [y], alpha, names), ["detector"]
    return binary_metrics(out.withColumn("flag", F.col("flag").cast("double")), y, "flag", 0.5, by).join(curve_areas(out, y, "score", by), by)


def class_rates(scored: DataFrame, names: str = "detector", y: str = "cls", flag: str = "flag") -> DataFrame:
    """(detector, class, n, alarms, rate) of rows scored by several detectors."""
    from .metrics import class_detection_rate

    return class_detection_rate(scored, y, flag, [names])


def side_by_side(z: np.ndarray, group: np.ndarray, state: tuple[np.ndarray, ...], step: Callable[[np.ndarray, tuple], tuple[dict, tuple]]) -> dict[str, np.ndarray]:
    """What ``step`` makes of each row, the rows of a group one after the other; ``state`` has a row for each group and moves with them.

    Groups are numbered from 0 and lie one after the other. All step together: ``step`` gets one row of each that has one left, as a matrix, and their states.
    """
    n = len(group)
    place = np.arange(n) - np.flatnonzero(np.diff(group, prepend=-1))[group]
    rows = np.argsort(place, kind="stable")
    ends = np.cumsum(np.bincount(place))
    found: dict[str, np.ndarray] = {}
    for a, b in zip(np.append(0, ends[:-1]), ends):
        at = rows[a:b]
        got, after = step(z[at], tuple(s[group[at]] for s in state))
        for name, x in got.items():
            if name not in found:
                found[name] = np.empty((n, *x.shape[1:]), x.dtype)
            found[name][at] = x
        for s, x in zip(state, after):
            s[group[at]] = x
    return found


def _in_order(df: DataFrame, key: str, order: list[str], cols: list[str], added: str, start: Callable[[int], tuple], step: Callable[[np.ndarray, tuple], tuple[dict, tuple]]) -> DataFrame:
    """df's key and order with the columns ``added``: a recursion over each key's rows in order.

    Rows are dealt and sorted by key and order, and come in batches: a task holds one batch and the state of the last key, so a key
    may have any number of rows. In a batch all keys step side by side (see side_by_side), from states as ``start`` makes them.
    """
    names = [c.split()[0] for c in added.split(", ")]

    def run(batches):
        carried, last = None, None
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            k = pdf[key]
            new = ((k != k.shift()) & ~(k.isna() & k.shift().isna())).to_numpy()
            new[0] = True
            begins = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            state = start(len(begins))
            first = k.iloc[0]
            if carried is not None and (first == last or (pd.isna(first) and pd.isna(last))):
                for s, c in zip(state, carried):
                    s[0] = c
            found = side_by_side(pdf[cols].to_numpy(float), group, state, step)
            carried, last = tuple(s[-1] for s in state), k.iloc[-1]
            yield pdf[[key, *order]].assign(**{c: list(found[c]) if found[c].ndim > 1 else found[c] for c in names})

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [key, *order]) + f", {added}"
    return df.select(key, *order, *[c for c in cols if c not in (key, *order)]).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def ema_baseline_score(df: DataFrame, key: str, order: list[str], cols: list[str], start: dict[str, float], ema: float = 0.01) -> DataFrame:
    """df's key, order and score: distance to a moving baseline before it follows the row, in order for each key.

    The baseline is a linear recursion, so keys are scans: one with any share of the rows spreads over tasks (see affine_scan). A null
    or NaN makes its key's scores null from there on.
    """

    def steps(z: np.ndarray, _place: np.ndarray) -> tuple:
        return np.full(z.shape, 1 - ema), ema * z, {}

    out = affine_scan(df, key, order, cols, [start[c] for c in cols], steps)
    off = [_number(F.col(c)) - F.col("before")[j] for j, c in enumerate(cols)]
    return out.select(key, *order, F.sqrt(_mean_square(off)).alias("score"))


def _kalman_row(z: np.ndarray, x: np.ndarray, p: np.ndarray, seen, r: np.ndarray, threshold: float, mode: str = "decay", q: float = 1e-6, track: float = 0.01, warmup: int = 20, forgetting: float = 1.0) -> tuple:
    """(score, flag, standardised innovation, x, p) of one row of each filter, whose features are the last axis."""
    pred = (forgetting**2 if mode == "forget" else 1.0) * p + q
    s = np.maximum(pred + r, 1e-12)
    innovation = z - x
    score = np.mean(innovation**2 / s, axis=-1)
    flag = ((np.asarray(seen) >= warmup) & (score >= threshold)).astype(np.int32)
    gain = pred / s
    x, p = x + gain * innovation, (1 - gain) * pred
    if mode == "decay":
        x = x + (track * np.where(flag == 1, 0.05, 1.0))[..., None] * innovation
    return score, flag, innovation / np.sqrt(s), x, p


def kalman_step(var: list[float], threshold: float, **options) -> Callable[[np.ndarray, tuple], tuple[dict, tuple]]:
    """One row of each filter, as ``side_by_side`` takes it, from states (x, p, rows seen); options as of ``kalman_steps``."""
    r = np.maximum(np.array(var, float), 1e-8)

    def step(z: np.ndarray, state: tuple) -> tuple[dict, tuple]:
        x, p, seen = state
        score, flag, off, x, p = _kalman_row(z, x, p, seen, r, threshold, **options)
        return {"score": score, "flag": flag, "off": off}, (x, p, seen + 1)

    return step


def kalman_steps(z: np.ndarray, x: np.ndarray, p: np.ndarray, seen: int, var: list[float], threshold: float, mode: str = "decay", q: float = 1e-6, track: float = 0.01, warmup: int = 20, forgetting: float = 1.0) -> tuple:
    """(score, flag, x, p, seen): rows in order, from a state and the rows seen before it."""
    r = np.maximum(np.array(var), 1e-8)
    score, flag = np.empty(len(z)), np.zeros(len(z), np.int32)
    for i, row in enumerate(z):
        score[i], flag[i], _, x, p = _kalman_row(row, x, p, seen + i, r, threshold, mode, q, track, warmup, forgetting)
    return score, flag, x, p, seen + len(z)


def kalman_by_key(df: DataFrame, key: str, order: list[str], cols: list[str], mean: list[float], var: list[float], threshold: float, benign: tuple[float, float] | None = None, k: int = 4, **options) -> DataFrame:
    """(key, order, score, flag, trust, embedding): per-dimension Kalman filters in order for each key; options as of ``kalman_steps``.

    mode 'frozen' only corrects, 'decay' also follows the row by ``track`` (a twentieth of it on an alarm), 'forget'
    inflates the covariance by the squared forgetting factor. No alarms during the warm-up. trust is by the ``benign`` scores' mean and
    deviation (those of a right model, 1 and sqrt(2 / features), if None); the embedding has the k largest standardised innovations.
    Gains of 'frozen' and 'forget' depend on no data, so their keys spread over tasks as scans; a key of 'decay' is one chain, in batches.
    """
    r, x0 = np.maximum(np.array(var, float), 1e-8), np.array(mean, float)
    mu, sd = benign or (1.0, float(np.sqrt(2 / len(cols))))
    if options.get("mode", "decay") in ("frozen", "forget"):
        out = _kalman_scan(df, key, order, cols, x0, r, threshold, **options)
    else:
        out = _kalman_chain(df, key, order, cols, x0, r, threshold, **options)
    trust = trust_score(F.col("score"), F.col("flag"), mu, sd, 0.5)
    return out.withColumn("trust", trust).withColumn("embedding", topk_abs_embedding(F.col("off"), k)).drop("off")


def _kalman_scan(df: DataFrame, key: str, order: list[str], cols: list[str], x0: np.ndarray, r: np.ndarray, threshold: float, mode: str, q: float = 1e-6, warmup: int = 20, forgetting: float = 1.0, track: float = 0.0) -> DataFrame:
    """Filters whose gains depend on a row's place in its key alone: the mean is a scan."""
    growth = forgetting**2 if mode == "forget" else 1.0

    def steps(z: np.ndarray, place: np.ndarray) -> tuple:
        ahead = growth * spread_after(place, 1.0, r, q, growth) + q
        whole = np.maximum(ahead + r, 1e-12)
        gain = ahead / whole
        return 1 - gain, gain * z, {"_s": whole}

    out = affine_scan(df, key, order, cols, x0.tolist(), steps, ("_s",), placed=True)
    off = F.array(*[(_number(F.col(c)) - F.col("before")[j]) / F.sqrt(F.col("_s")[j]) for j, c in enumerate(cols)])
    out = out.withColumn("off", off).withColumn("score", _mean_square([F.col("off")[j] for j in range(len(cols))]))
    flag = (F.col("_place") >= warmup) & F.coalesce(F.col("score") >= threshold, F.lit(False))
    return out.select(key, *order, "score", flag.cast("int").alias("flag"), "off")


def _kalman_chain(df: DataFrame, key: str, order: list[str], cols: list[str], x0: np.ndarray, r: np.ndarray, threshold: float, **options) -> DataFrame:
    """Filters that follow rows by their flags: one chain for each key."""

    def start(n: int) -> tuple:
        return np.tile(x0, (n, 1)), np.ones((n, len(cols))), np.zeros(n, np.int64)

    return _in_order(df, key, order, cols, "score double, flag int, off array<double>", start, kalman_step(r, threshold, **options))


@register("pca_reconstruction")
def pca_reconstruction(fit_df: DataFrame, df: DataFrame, cols: list[str], alpha: float = 0.05, k: int = 4, latent: int = 2, per_feature: bool = True) -> DataFrame:
    """df with score, flag, trust and embedding: mean squared residual of standardised features after projection on the first components
    of the benign rows, each residual over its own benign energy (if ``per_feature``, else as it is). Statistics are one aggregate and one Gramian."""
    from pyspark.ml.feature import PCA, VectorAssembler

    stats = moments(fit_df, cols)
    unit = lambda d: d.select("*", *[((F.col(c) - m) / max(s, 1e-8)).alias(f"_z{i}") for i, (c, (m, s)) in enumerate(stats.items())])
    zs = [f"_z{i}" for i in range(len(cols))]
    packed = VectorAssembler(inputCols=zs, outputCol="_v", handleInvalid="skip").transform(unit(fit_df).select(*zs))
    pc = PCA(k=min(latent, len(cols)), inputCol="_v", outputCol="_p").fit(packed).pc.toArray()
    keep = pc @ pc.T
    vector = F.array(*zs)
    residual = F.array(*[F.col(z) - F.aggregate(F.zip_with(vector, F.array(*map(F.lit, keep[i].tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for i, z in enumerate(zs)])
    with_residual = lambda d: unit(d).withColumn("_r", residual)
    energy = with_residual(fit_df).agg(*[F.avg(F.col("_r")[i] * F.col("_r")[i]) for i in range(len(cols))]).first() if per_feature else [1.0] * len(cols)
    each = [F.col("_r")[i] / float(np.sqrt(max(e or 0.0, 1e-8))) for i, e in enumerate(energy)]
    benign = with_residual(fit_df).select(_mean_square(each).alias("score"))
    return _judged(benign, with_residual(df), _mean_square(each), each, alpha, k).drop("_r", *zs)


@register("isolation_forest")
def isolation_forest(fit_df: DataFrame, df: DataFrame, cols: list[str], alpha: float = 0.05, k: int = 4, trees: int = 200, psi: int = 256, seed: int = 42, id_col: str | None = None) -> DataFrame:
    """df with score, flag, trust and embedding: 2 ** (-mean path length / c(psi)).

    Each tree takes psi benign rows: those with the smallest hashes among about twice as many, drawn by a hash of the row (its id, which should be
    its own, or else its columns and place) and the tree, and cut to psi before they meet. A row draws the few numbers of its trees, so
    no row meets all trees. Trees are built by tree id; the forest (trees * 2 * psi nodes) is broadcast for scoring.
    """
    spark = fit_df.sparkSession
    n = max(1, fit_df.count())
    feature = F.array(*[F.col(c).cast("double") for c in cols])
    row = F.xxhash64(F.col(id_col), F.lit(seed)) if id_col else F.xxhash64(*fit_df.columns, F.monotonically_increasing_id(), F.lit(seed))
    unit = lambda *x: F.pmod(F.xxhash64(*x), F.lit(1 << 30)) / (1 << 30)
    base = fit_df.select(feature.alias("x"), row.alias("row"))
    if n <= 2 * psi:
        pick = base.select("x", "row", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    else:
        draws = F.floor(F.lit(2 * psi * trees / n) + unit("row", F.lit(1))).cast("int")
        pick = base.withColumn("draws", draws).where("draws > 0").select("x", "row", F.explode(F.sequence(F.lit(1), F.col("draws"))).alias("draw"))
        pick = pick.select("x", "row", F.pmod(F.xxhash64("row", "draw"), F.lit(trees)).cast("int").alias("tree")).distinct()
    pick = pick.withColumn("u", F.xxhash64("row", "tree", F.lit(2)))
    nearest = Window.partitionBy("tree").orderBy("u", "x")
    pick = pick.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= psi)
    depth = int(np.ceil(np.log2(max(2, psi))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf.tree.iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = np.stack(pdf.sort_values("place").x.to_numpy())
        nodes = []

        def grow(rows, level):
            me = len(nodes)
            nodes.append([tree, me, -1, 0.0, -1, -1, float(level + _c(len(rows)))])
            lo, hi = rows.min(axis=0), rows.max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if level < depth and len(rows) > 1 and len(usable):
                f = int(rng.choice(usable))
                cut = float(rng.uniform(lo[f], hi[f]))
                left = rows[:, f] < cut
                if left.any() and not left.all():
                    nodes[me][2:6] = [f, cut, grow(rows[left], level + 1), grow(rows[~left], level + 1)]
            return me

        grow(x, 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "low", "high", "length"])

    made = pick.groupBy("tree").applyInPandas(build, "tree int, node int, feature int, cut double, low int, high int, length double").toPandas()
    kept = [g.sort_values("node")[["feature", "cut", "low", "high", "length"]].to_numpy() for _, g in made.groupby("tree")]
    feature_of, cuts, lengths = _as_heaps(kept, depth)
    shared = spark.sparkContext.broadcast((feature_of, cuts, lengths))

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        features, cuts, lengths = shared.value
        total = _path_lengths(np.column_stack([s.to_numpy(float) for s in xs]), features, cuts, lengths, depth)
        return pd.Series(2.0 ** (-(total / max(1, len(features))) / max(_c(psi), 1e-12)))

    value = score(*cols)
    return _judged(fit_df.select(value.alias("score")), df, value, _standardised(fit_df, cols), alpha, k)


def _path_lengths(x: np.ndarray, features: np.ndarray, cuts: np.ndarray, lengths: np.ndarray, depth: int, top: int = 3) -> np.ndarray:
    """Each row's path lengths summed over trees given as heaps.

    One small tree at a time, all rows of the batch together. On the ``top`` levels, which have few nodes, every row is compared with every node, a column at a
    time, and the outcomes as bits of a number tell its node there; only the levels below look a node up for each row.
    """
    top = min(top, depth)
    codes = np.arange(1 << (2**top - 1))
    entry = np.zeros(len(codes), np.int64)
    for _ in range(top):
        entry = 2 * entry + 2 - (codes >> entry & 1)
    columns, flat = np.ascontiguousarray(x.T), np.ascontiguousarray(x).ravel()
    own = np.arange(len(x)) * x.shape[1]
    code, bit, less = np.empty(len(x), np.uint8), np.empty(len(x), np.uint8), np.empty(len(x), bool)  # 7 bits are enough for 3 levels
    at, place, value, cut, total = np.empty(len(x), np.int64), np.empty(len(x), np.int64), np.empty(len(x)), np.empty(len(x)), np.zeros(len(x))
    for f, c, n in zip(features, cuts, lengths):
        code[:] = 0
        for i in range(2**top - 1):
            np.less(columns[f[i]], c[i], out=less)
            np.left_shift(less.view(np.uint8), i, out=bit)
            np.bitwise_or(code, bit, out=code)
        np.take(entry, code, out=at, mode="clip")
        for _ in range(depth - top):
            np.add(np.take(f, at, out=place, mode="clip"), own, out=place)
            np.less(np.take(flat, place, out=value, mode="clip"), np.take(c, at, out=cut, mode="clip"), out=less)
            np.add(at, at, out=at)
            np.add(at, 2, out=at)
            np.subtract(at, less, out=at)
        total += np.take(n, at, out=value, mode="clip")
    return total


def _as_heaps(trees: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, cuts, lengths) of each tree as a full one: the children of node i are 2 * i + 1 and 2 * i + 2. All below a leaf have its length."""
    features = np.zeros((len(trees), 2 ** (depth + 1) - 1), np.int64)
    cuts, lengths = np.full(features.shape, np.inf), np.zeros(features.shape)
    for t, nodes in enumerate(trees):
        place = np.zeros(features.shape[1], np.int64)
        for i in range(features.shape[1]):
            feature, cut, low, high, length = nodes[place[i]]
            lengths[t, i] = length
            if feature >= 0:
                features[t, i], cuts[t, i] = int(feature), cut
            if 2 * i + 2 < features.shape[1]:
                place[2 * i + 1], place[2 * i + 2] = (int(low), int(high)) if feature >= 0 else (place[i], place[i])
    return features, cuts, lengths


def _c(n: int) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class PatternLibrary:
    """Patterns of one key, matched by cosine; all survival values decay with each vector."""

    def state(self) -> tuple:
        """Plain lists, as a stream keeps them."""
        return self.ids.tolist(), self.life.tolist(), self.unit.tolist(), self.fresh

    def restore(self, ids: list, life: list, unit: list, fresh: int) -> PatternLibrary:
        self.ids, self.life, self.unit, self.fresh = np.array(ids, int), np.array(life, float), np.array(unit, float), fresh
        return self

    def __init__(self, seeds: list | None, sim: float, sv: float, reward: float, decay: float, evict: float, cap: int):
        self.ids = np.arange(len(seeds or []))
        self.life = np.full(len(self.ids), sv)
        self.unit = np.array([self._unit(np.array(s, float)) for s in seeds or []])
        self.fresh = len(self.ids)
        self.sim, self.sv, self.reward, self.decay, self.evict, self.cap = sim, sv, reward, decay, evict, cap

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / (np.sqrt(x.dot(x)) + 1e-12)

    def see(self, x: np.ndarray) -> tuple[int, float, bool, int]:
        """(pattern, similarity, matched, patterns left)."""
        u = self._unit(x)
        self.life = self.life * self.decay
        sims = self.unit @ u if len(self.ids) else np.zeros(0)
        best = int(np.argmax(sims)) if len(sims) else -1
        near = float(sims[best]) if len(sims) else 1.0
        hit = best < 0 or near >= self.sim
        if best >= 0 and hit:
            self.life[best] += self.reward
            mine = int(self.ids[best])
        else:
            mine = self.fresh
            self._add(mine, u)
        self._drop(mine)
        return mine, near, hit, len(self.ids)

    def _add(self, mine: int, u: np.ndarray) -> None:
        self.ids, self.life, self.fresh = np.append(self.ids, mine), np.append(self.life, self.sv), mine + 1
        self.unit = np.vstack([self.unit, u]) if len(self.unit) else u[None]

    def _drop(self, mine: int) -> None:
        """Patterns below evict go, but not the one just seen; of more than cap the weakest, then the oldest, go too."""
        stay = np.flatnonzero((self.life >= self.evict) | (self.ids == mine))
        if len(stay) > self.cap:
            weakest = np.lexsort((self.ids[stay], self.life[stay]))[: len(stay) - self.cap]
            stay = np.delete(stay, weakest)
        if len(stay) < len(self.ids):
            self.ids, self.life, self.unit = self.ids[stay], self.life[stay], self.unit[stay]


def pattern_cache(df: DataFrame, key: str, order: list[str], vec: str, seeds: list[list[float]] | None = None, sim: float = 0.9, sv: float = 1.0, reward: float = 1.0, decay: float = 0.99, evict: float = 0.2, cap: int = 1000) -> DataFrame:
    """(key, order, pattern_id, similarity, matched, n_patterns): online cosine matching for each key, in order.

    All survival values decay; the first vector of an empty library is normal; a hit is rewarded, a miss registers a
    new pattern and is an anomaly; patterns below ``evict`` and the weakest beyond ``cap`` go. A task holds a batch of rows and
    the library of one key, whatever the key's number of rows.
    """

    def run(batches):
        library, last = None, None
        for pdf in batches:
            rows = []
            for name, x in zip(pdf[key], pdf[vec]):
                if library is None or not (name == last or (pd.isna(name) and pd.isna(last))):
                    library, last = PatternLibrary(seeds, sim, sv, reward, decay, evict, cap), name
                rows.append(library.see(np.array(x, float)))
            columns = zip(*rows) if rows else [[], [], [], []]
            yield pdf[[key, *order]].assign(**dict(zip(("pattern_id", "similarity", "matched", "n_patterns"), map(list, columns))))

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [key, *order]) + ", pattern_id int, similarity double, matched boolean, n_patterns int"
    return df.select(key, *order, vec).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
