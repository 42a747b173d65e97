"""Coercion, imputation, scaling and feature selection; statistics come from one wide aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import column_quantiles, discard, stored


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to double; what fails, and infinite and NaN values, become null."""
    x = lambda c: F.col(c).try_cast("double")
    return df.withColumns({c: F.when(~F.isnan(x(c)) & (F.abs(x(c)) != float("inf")), x(c)) for c in cols})


def _one_row(df: DataFrame, stats: dict[str, Column]) -> dict:
    return df.agg(*[v.alias(k) for k, v in stats.items()]).first().asDict()


def impute_median(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Rows without any feature go; other nulls become the column's median, or 0 if it has none."""
    rows = df.where(F.coalesce(*[F.col(c) for c in cols]).isNotNull())
    if exact:
        held = stored(rows.select(*[F.col(c).cast("double").alias(c) for c in cols]))  # coercion from text is dear
        found = {c: q[0] for c, q in column_quantiles(held, cols, [0.5]).items()}
        discard(held)
    else:
        found = _one_row(rows, {c: F.percentile_approx(c, 0.5, 10_000) for c in cols})
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(float(found[c] or 0.0))) for c in cols})


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    return coerce_numeric(df, cols).na.drop(subset=cols)


def fill_constants(df: DataFrame, cols: list[str], nan: float = 0.0, pos: float = 1e6, neg: float = -1e6) -> DataFrame:
    x = lambda c: F.col(c).cast("double")
    return df.withColumns({c: F.when(F.isnan(x(c)) | x(c).isNull(), nan).when(x(c) == float("inf"), pos).when(x(c) == float("-inf"), neg).otherwise(x(c)) for c in cols})


def select_features(df: DataFrame, drop: list[str], label: str = "label") -> DataFrame:
    """Identifiers as they are, label, and features array<double> in name order."""
    cols = sorted(c for c in df.columns if c not in (*drop, label))
    return df.select(*drop, label, F.array(*[F.col(c).cast("double") for c in cols]).alias("features"))


def filter_benign_fit(df: DataFrame, day: str = "Monday", label_col: str = "label", day_col: str = "day") -> DataFrame:
    return df.where((F.col(label_col) == "BENIGN") & (F.col(day_col) == day))


def minmax_scale(df: DataFrame, cols: list[str], fit_df: DataFrame) -> DataFrame:
    """To [0, 1] by the fit rows' minimum and range; a range under 1e-12 counts as 1."""
    s = _one_row(fit_df, {f"{f}_{c}": getattr(F, f)(c) for c in cols for f in ("min", "max")})
    out = {}
    for c in cols:
        low, high = float(s[f"min_{c}"] or 0.0), float(s[f"max_{c}"] or 0.0)
        span = high - low if high - low >= 1e-12 else 1.0
        out[c] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - low) / span))
    return df.withColumns(out)


def moments(fit_df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    s = _one_row(fit_df, {f"{n}_{c}": f(c) for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))})
    return {c: (float(s[f"m_{c}"] or 0.0), float(s[f"s_{c}"] or 0.0)) for c in cols}


def zscore_scale(df: DataFrame, cols: list[str], fit_df: DataFrame, eps: float = 1e-8) -> DataFrame:
    stats = moments(fit_df, cols)
    return df.withColumns({c: (F.col(c) - m) / (s if s >= eps else 1.0) for c, (m, s) in stats.items()})


def log1p_zscore(df: DataFrame, cols: list[str], fit_df: DataFrame) -> DataFrame:
    logged = lambda d: d.withColumns({c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in cols})
    stats = moments(logged(fit_df), cols)
    return logged(df).withColumns({c: (F.col(c) - m) / max(s, 1e-6) for c, (m, s) in stats.items()})


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """A row for each feature: min, max, mean, population std and variance, exact median."""
    medians = column_quantiles(df, cols, [0.5])
    parts = [F.struct(F.lit(c).alias("feature"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.var_pop(c).alias("variance"), F.lit(medians[c][0]).cast("double").alias("median")) for c in cols]
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def topk_variance_features(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """(place, feature, variance) of the k features of largest variance, in column order."""
    parts = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature"), F.var_pop(c).alias("variance")) for i, c in enumerate(cols)]
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s")).orderBy(F.desc("variance"), "place").limit(k)


def dedup_exact(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropDuplicates(cols)


def duplicate_rate(df: DataFrame, cols: list[str]) -> DataFrame:
    """(n, n_distinct, rate): rows, different vectors, and the share of rows that dedup_exact drops (0 without rows)."""
    counts = df.groupBy(*cols).agg(F.count("*").alias("k"))
    n, d = F.coalesce(F.sum("k"), F.lit(0)), F.count("*")
    return counts.agg(n.alias("n"), d.alias("n_distinct"), F.when(n > 0, 1 - d / n).otherwise(0.0).alias("rate"))


def feature_attribution(df: DataFrame, resid_cols: list[str], k: int = 15) -> DataFrame:
    """(feature, energy): the k features of largest mean squared residual."""
    parts = [F.struct(F.lit(c).alias("feature"), F.avg(F.col(c) * F.col(c)).alias("energy")) for c in resid_cols]
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s")).orderBy(F.desc("energy"), "feature").limit(k)
