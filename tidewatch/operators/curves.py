"""Ranking metrics and thresholds: grouped by distinct score, then distributed prefix sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import grouped_sums, prefix_sums, quantile_list, quantiles, stored


def _cumulative(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by, s, tp, fp, pos, neg) for every distinct score, from the largest down, with the group's totals p and n."""
    g = df.where(F.col(score).isNotNull()).groupBy(*(by or []), F.col(score).alias("s")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))
    c = grouped_sums(g, by or [], [F.desc("s")], ["pos", "neg"])
    return c.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp", "total_pos": "p", "total_neg": "n"})


def _areas() -> dict[str, Column]:
    """Both areas of the rows of _cumulative."""
    roc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / (F.max("p") * F.max("n"))
    pr = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("p")
    return {"roc_auc": roc.alias("roc_auc"), "pr_auc": pr.alias("pr_auc")}


def roc_auc(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, of each group if ``by`` is given, ties by trapezoid; null with one class only."""
    return _cumulative(df, y, score, by).groupBy(*(by or [])).agg(_areas()["roc_auc"])


def pr_auc(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Average precision over distinct scores, of each group if ``by`` is given."""
    return _cumulative(df, y, score, by).groupBy(*(by or [])).agg(_areas()["pr_auc"])


def curve_areas(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by, roc_auc, pr_auc) from one set of running sums."""
    return _cumulative(df, y, score, by).groupBy(*(by or [])).agg(*_areas().values())


def score_orientation(df: DataFrame, y: str, score: str) -> DataFrame:
    """(auc, flipped, oriented_auc): scores that rank the wrong way are negated."""
    return roc_auc(df, y, score).select(F.col("roc_auc").alias("auc"), (F.col("roc_auc") < 0.5).alias("flipped"), F.greatest(F.col("roc_auc"), 1 - F.col("roc_auc")).alias("oriented_auc"))


def roc_pr_curve(df: DataFrame, y: str, score: str, k: int = 300) -> DataFrame:
    """(place, s, tpr, fpr, precision) at k evenly spaced places of the distinct scores, ends included."""
    c = stored(_cumulative(df, y, score).withColumn("one", F.lit(1).cast("long")))
    c = prefix_sums(c, [F.desc("s")], ["one"])
    m = c.count()
    wanted = sorted({(i * (m - 1)) // max(1, min(k, m) - 1) for i in range(min(k, m))})
    picked = c.withColumn("place", F.col("cum_one") - 1).where(F.col("place").isin(wanted) if wanted else F.lit(False))
    return picked.select("place", "s", (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def best_f1_exhaustive(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, f1) of the best F1 over every distinct score; the largest score on ties."""
    c = _cumulative(df, y, score).withColumn("f1", 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p")))
    return c.agg(F.max(F.struct("f1", "s")).alias("b")).select(F.col("b.s").alias("threshold"), "b.f1")


def _at_quantiles(df: DataFrame, y: str, score: str, qs: list[float]) -> list[tuple[float, int, int, int]]:
    """(threshold, tp, fp, positives) at each of the score's quantiles, all from one running sum over its different values.

    The rows with a score of a threshold or above are those down to the first value not below it. The driver gets the few values at the quantiles' ranks.
    """
    c = stored(_cumulative(df, y, score))
    top = c.agg(F.max("p"), F.max("n")).first()
    total = (top[0] or 0) + (top[1] or 0)
    if not total:
        return []
    at = [(total - 1) * q for q in qs]
    ranks = sorted({f(x) for x in at for f in (math.floor, math.ceil)})
    before = F.lit(total) - F.col("tp") - F.col("fp")
    held = F.filter(F.array(*[F.lit(x).cast("long") for x in ranks]), lambda x: (x >= before) & (x < before + F.col("pos") + F.col("neg")))
    found = {rank: (r["s"], r["tp"], r["fp"]) for r in c.select("s", "tp", "fp", held.alias("ranks")).where("size(ranks) > 0").collect() for rank in r["ranks"]}
    out = []
    for x in at:
        low, high = found[math.floor(x)], found[math.ceil(x)]
        part = x - math.floor(x)
        out.append((low[0] + (high[0] - low[0]) * part if part and high[0] != low[0] else low[0], *(high if part else low)[1:], top[0]))
    return out


def _f1(tp: int, fp: int, p: int) -> float | None:
    return 2 * tp / (tp + fp + p) if tp + fp + p else None


def best_f1_threshold(df: DataFrame, y: str, score: str, lo: float = 0.5, hi: float = 0.9995, n: int = 400) -> DataFrame:
    """(threshold, f1): the first best of n quantiles as thresholds. Uses labels: an optimistic bound."""
    found = [(t, _f1(tp, fp, p)) for t, tp, fp, p in _at_quantiles(df, y, score, [lo + (hi - lo) * i / (n - 1) for i in range(n)])]
    best = max((x for x in found if x[1] is not None), key=lambda x: x[1], default=(None, None))
    return df.sparkSession.createDataFrame([best], "threshold double, f1 double")


def prior_threshold_sweep(df: DataFrame, y: str, score: str, alphas: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2, 0.3, 0.4)) -> DataFrame:
    """(alpha, threshold, f1): the score's 1 - alpha quantile as threshold; no rows without scores."""
    found = zip(alphas, _at_quantiles(df, y, score, [1 - a for a in alphas]))
    return df.sparkSession.createDataFrame([(float(a), t, _f1(tp, fp, p)) for a, (t, tp, fp, p) in found], "alpha double, threshold double, f1 double")


def benign_quantile_threshold(df: DataFrame, score: str, alpha: float = 0.05, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(by, threshold): the 1 - alpha quantile, exact and spread, or by a sketch."""
    if exact:
        return quantiles(df, score, [1 - alpha], by).withColumnRenamed("q0", "threshold")
    return df.groupBy(*(by or [])).agg(F.percentile_approx(score, 1 - alpha, 10_000).alias("threshold"))


def robust_scale(df: DataFrame, score: str) -> DataFrame:
    """IQR / 1.349, or the population deviation where that is 0."""
    low, high = quantile_list(df, score, [0.25, 0.75])
    spread = F.lit((high - low) / 1.349) if low is not None and high > low else F.stddev_pop(score)
    return df.agg(spread.cast("double").alias("scale"))


def evt_threshold(df: DataFrame, score: str, alpha: float = 0.05, tail: float = 0.10, gap: float = 0.03) -> DataFrame:
    """(threshold, u, xi, beta, n_exceed, fallback): peaks over the 1 - tail quantile.

    The shape is half of 1 minus the second raw moment over the squared mean, held to 0.25 either
    way. Falls back to the plain quantile under 10 exceedances, for a threshold that is not
    positive and finite, or one whose empirical quantile is off by more than gap. Under 50 finite scores is an error.
    """
    base = df.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")))
    n = base.count()
    if n < 50:
        raise ValueError(f"{n} scores are too few for a tail fit")
    u, plain = quantile_list(base, score, [1 - tail, 1 - alpha])
    e = F.when(F.col(score) > u, F.col(score) - u)
    k, m1, m2 = base.agg(F.count(e), F.avg(e), F.avg(e * e)).first()
    xi, beta, thr, fallback = 0.0, 1e-12, plain, True
    if k >= 10:
        xi = max(-0.25, min(0.25, 0.5 * (1 - m2 / (m1 * m1)))) if m1 > 1e-12 else 0.0
        beta = max(m1 * (1 - xi), 1e-12)
        ratio = alpha / (k / n)
        found = u + (beta * math.log(1 / ratio) if abs(xi) < 1e-6 else beta / xi * (ratio**-xi - 1))
        share = base.agg(F.avg((F.col(score) <= found).cast("double"))).first()[0]
        if math.isfinite(found) and found > 0 and abs(share - (1 - alpha)) <= gap:
            thr, fallback = found, False
        else:
            xi, beta = 0.0, 1e-12
    return df.sparkSession.createDataFrame([(float(thr), float(u), float(xi), float(beta), int(k), fallback)], "threshold double, u double, xi double, beta double, n_exceed long, fallback boolean")


def ks_drift(a: DataFrame, b: DataFrame, cols: list[str], p: float = 0.01) -> DataFrame:
    """(feature, ks, p_value, drifted): two-sample Kolmogorov-Smirnov with the asymptotic p-value."""
    long = lambda d, side: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("x.feature", "x.v", F.lit(side).alias("side")).where("v is not null")
    g = long(a, 0).union(long(b, 1)).groupBy("feature", "v").agg(F.sum((F.col("side") == 0).cast("long")).alias("na"), F.sum((F.col("side") == 1).cast("long")).alias("nb"))
    c = grouped_sums(g, ["feature"], ["v"], ["na", "nb"]).withColumnsRenamed({"cum_na": "ca", "cum_nb": "cb", "total_na": "ta", "total_nb": "tb"})
    d = c.groupBy("feature").agg(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("ks"), F.max("ta").alias("ta"), F.max("tb").alias("tb"))
    lam = (F.sqrt(F.col("ta") * F.col("tb") / (F.col("ta") + F.col("tb")))) * F.col("ks")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, j: s + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * j * j * lam * lam))
    pv = F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    return d.select("feature", "ks", pv.alias("p_value"), (pv < p).alias("drifted"))


def spearman_topk(df: DataFrame, cols: list[str], score: str, k: int = 15) -> DataFrame:
    """(feature, rho) of the k features of largest |Spearman| with the score, average ranks for ties."""
    rows = df.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("_s"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("_s", "x.feature", "x.v").where("v is not null")

    def ranks(c: str, name: str) -> DataFrame:
        g = rows.groupBy("feature", c).agg(F.count("*").alias("k"))
        return grouped_sums(g, ["feature"], [c], ["k"]).select("feature", c, (F.col("cum_k") - (F.col("k") - 1) / 2).alias(name))

    r = rows.join(ranks("v", "rv"), ["feature", "v"]).join(ranks("_s", "rs"), ["feature", "_s"])
    return r.groupBy("feature").agg(F.corr("rv", "rs").alias("rho")).orderBy(F.desc(F.abs("rho")), "feature").limit(k)
