"""Registered queries of decision rules, oversampling, filters with full matrices and given networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import clustering, decisions, detectors, measurements, oversample, sets
from .registry import COLS, _FIT, _fit, _test, add, r
from .vectors import _vectors

_CLASSES = ["BENIGN", "Click", "Signup", "Purchase", "Error"]
_MODE = "m AS (SELECT cls AS top FROM scored WHERE cls > 0 GROUP BY cls ORDER BY count(*) DESC, cls LIMIT 1)"


@add("decision_rules", f", {_MODE} SELECT id, agent::INT AS agent, CASE WHEN flag = 1 THEN top ELSE 0 END::INT AS detector, CASE WHEN flag = 1 THEN 1 + agent % 4 ELSE 0 END::INT AS specialist, 0::INT AS benign_only FROM scored, m, range(6) AS t(agent)", "scored")
def _(v):
    team = decisions.agent_assignment(6, _CLASSES)
    return decisions.decision_rules(v("scored"), v("scored"), team).select("id", "agent", *decisions.RULES)


@add(
    "agent_assignment",
    ", l AS (SELECT DISTINCT CASE trim(raw_label) WHEN 'DoS Hulk' THEN 'DoS' WHEN 'benign' THEN 'BENIGN' WHEN 'Web Attack – XSS' THEN 'WebAttack' ELSE trim(raw_label) END AS class FROM flows),"
    " i AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS idx FROM l), p AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS place, count(*) OVER () AS n FROM i WHERE class NOT IN ('BENIGN', 'Other'))"
    " SELECT agent, 'agent_' || class || CASE WHEN agent >= n THEN '_' || (agent // n + 1) ELSE '' END AS name, idx::INT AS focus FROM range(11) AS t(agent) JOIN p ON place = agent % n",
    "flows",
)
def _(v):
    each = v("flows").select(labels.label_family(F.col("raw_label")).alias("class"))
    return decisions.assigned_agents(sets.class_vocabulary(each, each, "class"), 11)


_NEAR = (
    "d AS (SELECT a.id, (b.label <> 0)::BIGINT AS far, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.id) AS k"
    " FROM vectors a JOIN vectors b ON a.id <> b.id WHERE a.label = 0), c AS (SELECT id, sum(far)::BIGINT AS crowd FROM d WHERE k <= 5 GROUP BY id),"
    " g AS (SELECT (count(*) FILTER (label <> 0) - count(*) FILTER (label = 0))::BIGINT AS total FROM vectors), s AS (SELECT sum(crowd)::BIGINT AS crowds FROM c),"
    " q AS (SELECT id, crowd, crowd * total // crowds AS q, total, row_number() OVER (ORDER BY crowd DESC, id) AS place FROM c, g, s)"
)


@add("adasyn_quotas", f", {_NEAR} SELECT id, crowd, (q + CASE WHEN place <= total - (SELECT sum(q) FROM q) THEN 1 ELSE 0 END)::BIGINT AS quota FROM q", "vectors")
def _(v):
    d = _vectors(v).withColumn("y", (F.col("label") == 0).cast("int"))
    return oversample.adasyn_quotas(d, "id", "vec", "y", 1)


@add("adasyn", None)
def _(v):
    d = _vectors(v).withColumn("y", (F.col("label") == 0).cast("int"))
    return oversample.adasyn(d, "id", "vec", "y", 1).select("id", "origin", "neighbor", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))


@add("adasyn_multiclass", ", n AS (SELECT label, count(*) AS n FROM vectors GROUP BY label) SELECT label, CASE WHEN label IN (0, 1) THEN (SELECT max(n) FROM n) ELSE n END::BIGINT AS n FROM n", "vectors")
def _(v):
    return oversample.adasyn_multiclass(_vectors(v), "id", "vec", "label", [0, 1]).groupBy("label").agg(F.count("*").alias("n"))


# The recursion with two measurements and the identity for h: a is the covariance ahead, s that of the innovation e.
_FILTER = f""", o AS (SELECT id, user_id, score AS z1, cls * 10.0 AS z2, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS k FROM scored),
    g AS (SELECT * FROM (WITH RECURSIVE w AS (
        SELECT DISTINCT -1::BIGINT AS id, user_id, 0::BIGINT AS k, 50.0::DOUBLE AS x1, 20.0::DOUBLE AS x2, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS p12, 1.0::DOUBLE AS p22, 0.0::DOUBLE AS adi FROM o
        UNION ALL SELECT id, user_id, k, x1 + g11 * e1 + g12 * e2, x2 + g21 * e1 + g22 * e2, a11 - g11 * a11 - g12 * a12, a12 - g11 * a12 - g12 * a22, a22 - g21 * a12 - g22 * a22, adi
        FROM (SELECT *, (a11 * s22 - a12 * s12) / det AS g11, (a12 * s11 - a11 * s12) / det AS g12, (a12 * s22 - a22 * s12) / det AS g21, (a22 * s11 - a12 * s12) / det AS g22,
            (s22 * e1 * e1 - 2 * s12 * e1 * e2 + s11 * e2 * e2) / det AS adi
        FROM (SELECT *, s11 * s22 - s12 * s12 AS det
        FROM (SELECT o.id, o.user_id, o.k, x1, x2, z1 - x1 AS e1, z2 - x2 AS e2, p11 + 1 AS a11, p12 + 0.1 AS a12, p22 + 1 AS a22, p11 + 401 AS s11, p12 + 0.1 AS s12, p22 + 101 AS s22
            FROM w JOIN o ON o.user_id IS NOT DISTINCT FROM w.user_id AND o.k = w.k + 1))))
        SELECT * FROM w WHERE k > 0))
    SELECT id, {r('adi')}, CASE WHEN adi > -2 * ln(0.05) THEN 1 ELSE 0 END AS alarm FROM g"""


@add("kalman_chi2_by_key", _FILTER, "scored")
def _(v):
    d = v("scored").withColumn("c", F.col("cls") * 10.0)
    found = measurements.kalman_chi2_by_key(d, "user_id", ["ts", "id"], ["score", "c"], [[1, 0], [0, 1]], [[1, 0.1], [0.1, 1]], [[400, 0], [0, 100]], [50, 20])
    return found.select("id", "adi", "alarm")


_RESID = {"f0": "f0 / 25", "f1": "f1 / 30000", "f2": "f2", "f3": "f3"}
_LONG = " UNION ALL ".join(f"SELECT id, y, day, '{c}' AS feature, {e} AS v FROM flows" for c, e in _RESID.items())


@add("residual_embedding", f", l AS ({_LONG}), e AS (SELECT feature, row_number() OVER (ORDER BY avg(v * v) DESC, feature) AS k FROM l WHERE y = 0 AND day = 'Monday' GROUP BY feature) SELECT id, {r('max(CASE WHEN k = 1 THEN v END) AS first', 'max(CASE WHEN k = 2 THEN v END) AS second')} FROM l JOIN e USING (feature) WHERE day <> 'Monday' GROUP BY id", "flows")
def _(v):
    fit, test = (d.withColumns({c: F.expr(e) for c, e in _RESID.items()}) for d in (_fit(v), _test(v)))
    energy = fit.agg(*[F.avg(F.col(c) * F.col(c)).alias(c) for c in COLS]).first().asDict()
    two = measurements.residual_embedding({c: e or 0.0 for c, e in energy.items()}, 2)
    return test.withColumn("x", two).groupBy("id").agg(F.max(F.col("x")[0]).alias("first"), F.max(F.col("x")[1]).alias("second"))


_SCALED = "z AS (SELECT id, y, day, " + ", ".join(f"{e} AS z{i}" for i, e in enumerate(_RESID.values())) + " FROM flows)"
_MID = "b AS (SELECT " + ", ".join(f"avg(z{i}) AS m{i}, var_pop(z{i}) AS v{i}" for i in range(4)) + " FROM z WHERE y = 0 AND day = 'Monday')"
_NORM = ", ".join(f"(z{i} - m{i}) / sqrt(v{i} + 1e-5) AS x{i}" for i in range(4))


@add(
    "mlp_reconstruction_score",
    f", {_SCALED}, {_MID}, n AS (SELECT z.*, {_NORM} FROM z, b WHERE day <> 'Monday'), h AS (SELECT *, x0 + 0.5 * x2 AS a, x1 + 0.5 * x3 AS c FROM n),"
    " k AS (SELECT *, CASE WHEN a >= 0 THEN a ELSE 0.2 * a END AS p, CASE WHEN c >= 0 THEN c ELSE 0.2 * c END AS q FROM h)"
    f" SELECT id, {r('((z0 - p) ** 2 + (z1 - q) ** 2 + (z2 - 0.5 * p) ** 2 + (z3 - 0.5 * q) ** 2) / 4 AS score')} FROM k",
    "flows",
)
def _(v):
    fit, test = (d.withColumns({c: F.expr(e) for c, e in _RESID.items()}) for d in (_fit(v), _test(v)))
    m = fit.agg(*[f(c).alias(f"{n}{c}") for c in COLS for n, f in (("m", F.avg), ("v", F.var_pop))]).first()
    mean, var = ([m[f"{n}{c}"] or 0.0 for c in COLS] for n in "mv")
    w = [[1, 0, 0.5, 0], [0, 1, 0, 0.5]]
    back = [list(x) for x in zip(*w)]
    layers = [("batch_norm", mean, var, [1] * 4, [0] * 4, 1e-5), ("linear", w, [0, 0]), ("leaky_relu", 0.2), ("linear", back, [0] * 4)]
    return measurements.mlp_reconstruction_score(test, COLS, layers).select("id", "score")


@add("adaptive_kalman_by_key", None)
def _(v):
    d = v("scored").withColumn("c", F.col("cls") * 10.0)
    found = measurements.adaptive_kalman_by_key(d, "user_id", ["ts", "id"], ["score", "c"], [[1, 0], [0, 1]], [[1, 0.1], [0.1, 1]], [[400, 0], [0, 100]], [50, 20])
    return found.select("id", "adi", "alarm", "xi", "adapted")


@add("evolutionary_kmeans", None)
def _(v):
    d = _vectors(v)
    centres, _inertia = clustering.evolutionary_kmeans(d, "id", "vec", 10)
    return detectors.kmeans_assign(d, "vec", centres).drop("vec")
