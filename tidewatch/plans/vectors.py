"""Registered queries of the vector functions, lookups, comparisons and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import clean, curves, detectors, joins, metrics, sampling, sets
from .registry import COLS, _FIT, _fit, _test, add, r

_X = "x AS (SELECT id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM vectors)"


def _vectors(v):
    return v("vectors").withColumn("vec", F.col("embedding").cast("array<double>")).drop("embedding")


@add("topk_abs_embedding", f", {_X}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(v) DESC, i) AS k FROM x) SELECT id, (k - 1)::INT AS place, {r('v')} FROM t WHERE k <= 4", "vectors")
def _(v):
    return _vectors(v).select("id", F.posexplode(scores.topk_abs_embedding(F.col("vec"), 4)).alias("place", "v"))


@add("reshape_sequence", f", {_X} SELECT id, (i // 4)::INT AS t, {r('sum(v) AS total')} FROM x GROUP BY id, i // 4", "vectors")
def _(v):
    rows = _vectors(v).select("id", F.posexplode(scores.reshape_sequence(F.col("vec"), 64)).alias("t", "s"))
    return rows.select("id", "t", F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("total"))


@add("inject_bias", f", {_X} SELECT id, i::INT AS i, {r('v + CASE WHEN i IN (1, 3) AND label = 1 THEN 0.5 ELSE 0 END AS v')} FROM x", "vectors")
def _(v):
    return _vectors(v).select("id", F.posexplode(scores.inject_bias(F.col("vec"), [1, 3], 0.5, F.col("label") == 1)).alias("i", "v"))


@add("residual_chi2", f", {_X}, s AS (SELECT id, sum(v * v / 0.5) AS adi FROM x GROUP BY id) SELECT id, {r('adi')}, (adi >= 3)::INT AS alarm FROM s", "vectors")
def _(v):
    d = _vectors(v).withColumn("ref", F.array_repeat(F.lit(0.0), 64))
    return detectors.residual_chi2(d, "vec", "ref", [0.5] * 64, 3.0).select("id", "adi", "alarm")


@add("residual_chi2_full", f", {_X}, s AS (SELECT id, sum(42.25 * v * v) / 0.5 - 0.1 / (0.5 * 6.9) * sum(6.5 * v) * sum(6.5 * v) AS adi FROM x GROUP BY id) SELECT id, {r('adi')}, (adi >= 83.67526074272097)::INT AS alarm FROM s", "vectors")
def _(v):
    """R is 0.5 on the diagonal and 0.1 everywhere besides."""
    d = _vectors(v).withColumn("vec", F.transform("vec", lambda x: 6.5 * x)).withColumn("ref", F.array_repeat(F.lit(0.0), 64))
    full = [[0.1 + (0.5 if i == j else 0.0) for j in range(64)] for i in range(64)]
    return detectors.residual_chi2(d, "vec", "ref", full).select("id", "adi", "alarm")


_NAMES = ["BENIGN", "DDoS", "PortScan", "Bot", "DoS"]


@add("class_from_probs", f"SELECT id, {str(_NAMES)}[cls + 1] AS label, {r('1 - CASE WHEN cls = 0 THEN 0.6 ELSE 0.1 END AS attack_prob')}, (cls <> 0)::INT AS alarm FROM scored", "scored")
def _(v):
    p = F.array(*[F.when(F.col("cls") == i, 0.6).otherwise(0.1) for i in range(5)])
    return v("scored").select("id", scores.class_from_probs(p, _NAMES).alias("x")).select("id", "x.*")


@add("fill_constants", f", d AS (SELECT id, try_cast(t0 AS DOUBLE) AS t0 FROM dirty) SELECT id, {r('CASE WHEN t0 IS NULL OR isnan(t0) THEN 0 WHEN isinf(t0) AND t0 > 0 THEN 1e6 WHEN isinf(t0) THEN -1e6 ELSE t0 END AS t0')} FROM d", "dirty")
def _(v):
    return clean.fill_constants(v("dirty").select("id", F.col("t0").try_cast("double").alias("t0")), ["t0"])


@add("select_features", f"SELECT id, raw_label, {r('f0 AS a', 'f1 AS b')} FROM flows", "flows")
def _(v):
    d = clean.select_features(v("flows").select("f1", "id", "raw_label", "f0"), ["id"], "raw_label")
    return d.select("id", "raw_label", F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))


_ENERGY = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({e} * {e}) AS energy FROM flows" for c, e in (("f0", "f0"), ("f1", "(f1 / 1000)"), ("f2", "f2"), ("f3", "f3")))


@add("feature_attribution", f", e AS ({_ENERGY}) SELECT feature, {r('energy')} FROM e ORDER BY e.energy DESC LIMIT 2", "flows")
def _(v):
    return clean.feature_attribution(v("flows").withColumn("f1", F.col("f1") / 1000), COLS, 2)


@add("best_checkpoint", f", h AS (SELECT day, round(avg(flag), 9) AS value FROM scored GROUP BY day), b AS (SELECT * FROM h ORDER BY value DESC, day LIMIT 1) SELECT day, {r('value')} FROM b", "scored")
def _(v):
    return sampling.best_checkpoint(v("scored").groupBy("day").agg(F.round(F.avg("flag"), 9).alias("value")), "value", "day")


@add("label_lookup", "SELECT id, CASE trim(raw_label) WHEN 'DoS Hulk' THEN 'DoS' WHEN 'DDoS' THEN 'DDoS' ELSE 'Other' END AS family FROM flows", "flows")
def _(v):
    d = v("flows").select("id", F.trim("raw_label").alias("name"))
    dim = d.sparkSession.createDataFrame([("DoS Hulk", "DoS"), ("DDoS", "DDoS")], "name string, family string")
    return joins.label_lookup(d, dim, "name", "family", "Other").select("id", "family")


@add("join_daily_threshold", f", t AS (SELECT day, quantile_cont(score, 0.95) AS threshold FROM scored WHERE y = 0 GROUP BY day) SELECT id, {r('threshold')} FROM scored JOIN t USING (day)", "scored")
def _(v):
    t = curves.benign_quantile_threshold(v("scored").where("y = 0"), "score", by=["day"])
    return metrics.join_daily_threshold(v("scored"), t, "day").select("id", "threshold")


@add("knn_join", f", d AS (SELECT a.id, b.id AS neighbor, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM vectors a JOIN vectors b ON a.id <> b.id WHERE a.label = 0), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, neighbor)::INT AS rank FROM d) SELECT id, rank, neighbor, {r('dist')} FROM k WHERE rank <= 3", "vectors")
def _(v):
    return joins.knn_join(_vectors(v).where("label = 0"), _vectors(v), "id", "vec", 3)


@add("cosine_best_match", f", {_X}, m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY label, i), c AS (SELECT label AS pattern_id, list(v ORDER BY i) AS p FROM m GROUP BY label), s AS (SELECT id, pattern_id, list_cosine_similarity(embedding::DOUBLE[], p) AS s FROM vectors, c), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, pattern_id) AS k FROM s) SELECT id, pattern_id, {r('s AS similarity')}, s >= 0.5 AS matched FROM k WHERE k = 1", "vectors")
def _(v):
    d = _vectors(v)
    each = d.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    library = each.groupBy(F.col("label").alias("pattern_id")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).select("pattern_id", F.transform("s", lambda e: e["x"]).alias("vec"))
    return joins.cosine_best_match(d, library, "id", "vec", 0.5)


_DAILY = "m AS (SELECT day AS metric, avg(score) AS value FROM scored GROUP BY day)"


@add("reconcile_metrics", f", {_DAILY}, j AS (SELECT metric, round(value, 4) + CASE metric WHEN '2024-01-02' THEN 0.001 ELSE 0 END AS reported, CASE WHEN metric <> '2024-01-03' THEN value END AS actual FROM m) SELECT metric, {r('reported', 'actual')}, CASE WHEN actual IS NULL THEN 'missing' ELSE 'differs' END AS status FROM j WHERE actual IS NULL OR abs(reported - actual) > 5e-5", "scored")
def _(v):
    m = v("scored").groupBy(F.col("day").alias("metric")).agg(F.avg("score").alias("value"))
    reported = m.withColumn("value", F.round("value", 4) + F.when(F.col("metric") == "2024-01-02", 0.001).otherwise(0.0))
    return metrics.reconcile_metrics(reported, m.where("metric <> '2024-01-03'"))


@add("compare_runs", f"SELECT day, {r('avg(flag) AS a', 'avg((score >= 60)::INT) AS b', 'avg((score >= 60)::INT) - avg(flag) AS delta')} FROM scored GROUP BY day", "scored")
def _(v):
    a = v("scored").groupBy("day").agg(F.avg("flag").alias("value"))
    b = v("scored").groupBy("day").agg(F.avg((F.col("score") >= 60).cast("double")).alias("value"))
    return metrics.compare_runs(a, b, ["day"])


@add("class_vocabulary", f", {_FIT}, c AS (SELECT raw_label AS class FROM fit UNION SELECT raw_label FROM test) SELECT class, (row_number() OVER (ORDER BY class) - 1)::INT AS idx FROM c", "flows")
def _(v):
    return sets.class_vocabulary(_fit(v), _test(v), "raw_label")


@add("union_days", f", {_FIT} SELECT id FROM fit UNION ALL SELECT id FROM test", "flows")
def _(v):
    return sets.union_days([_fit(v), _test(v)]).select("id")


@add("pca_reconstruction", None)
def _(v):
    return detectors.pca_reconstruction(_fit(v), _test(v), COLS).select("id", "score", "flag", "trust", F.size("embedding").alias("width"))
