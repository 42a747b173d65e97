"""The registered queries of the library and their SQL. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, scores
from ..operators import bursts, clean, curves, detectors, joins, metrics, sampling
from .views import view, with_views

COLS = ["f0", "f1", "f2", "f3"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places; a negative zero becomes zero."""
    return df.select(*[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def add(name: str, sql: str | None, *views: str):
    def keep(function):
        def query(spark, sf_dir):
            return rounded(function(lambda v: view(spark, sf_dir, v)))

        QUERIES[name] = query
        if sql:
            SQL[name] = with_views(sql, *views)
        return function

    return keep


def r(*names: str) -> str:
    return ", ".join(f"round({n.rsplit(' AS ', 1)[0]}, 6) + 0.0 AS {n.rsplit(' AS ', 1)[-1]}" for n in names)


_FIT = "fit AS (SELECT * FROM flows WHERE y = 0 AND day = 'Monday'), test AS (SELECT * FROM flows WHERE day <> 'Monday')"


def _fit(v):
    return v("flows").where("y = 0 and day = 'Monday'")


def _test(v):
    return v("flows").where("day <> 'Monday'")


# -- labels and row-local functions


@add("label_family", "SELECT id, CASE trim(raw_label) WHEN 'DoS Hulk' THEN 'DoS' WHEN 'benign' THEN 'BENIGN' WHEN 'Web Attack – XSS' THEN 'WebAttack' ELSE trim(raw_label) END AS label FROM flows", "flows")
def _(v):
    return v("flows").select("id", labels.label_family(F.col("raw_label")).alias("label"))


@add("label_fine", "SELECT id, CASE trim(raw_label) WHEN 'DoS Hulk' THEN 'DoS-Hulk' WHEN 'benign' THEN 'BENIGN' WHEN 'Web Attack – XSS' THEN 'WebAttack-XSS' ELSE trim(raw_label) END AS label FROM flows", "flows")
def _(v):
    return v("flows").select("id", labels.label_fine(F.col("raw_label")).alias("label"))


@add("class_index", "SELECT id, CASE cls WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 5 END AS idx FROM flows", "flows")
def _(v):
    return v("flows").select("id", labels.class_index(labels.label_family(F.col("raw_label"))).alias("idx"))


@add("response_bin", "SELECT id, CASE WHEN score / 50 - 1 < -1.0 / 3 THEN 0 WHEN score / 50 - 1 < 1.0 / 3 THEN 1 ELSE 2 END AS bin FROM scored", "scored")
def _(v):
    return v("scored").select("id", scores.response_bin(F.col("score") / 50 - 1).alias("bin"))


@add("decision_reward", f"""SELECT id, agent, {r("c AS class_reward", "q AS response_reward")} FROM (
    SELECT id, agent, CASE WHEN pred = cls THEN 1.0 ELSE -1.0 END + CASE WHEN pred = cls AND cls = agent THEN 0.5 ELSE 0 END AS c,
    CASE WHEN cls = 0 THEN CASE id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN -0.25 ELSE -1.0 END ELSE CASE id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.75 ELSE 1.0 END END
    + CASE WHEN (pred <> 0) = (flag = 1) THEN 0.2 ELSE -0.2 END AS q FROM decisions)""", "decisions")  # fmt: skip
def _(v):
    x = scores.decision_reward(F.col("pred"), (F.col("id") % 3).cast("int"), F.col("cls"), F.col("flag"), F.col("agent"))
    return v("decisions").select("id", "agent", x.alias("x")).select("id", "agent", "x.*")


@add("trust_score", f"SELECT id, {r('CASE WHEN flag = 1 THEN p ELSE 1 - p END AS trust')} FROM (SELECT id, flag, 1 / (1 + exp(-greatest(-30, least(30, (score - 50) / 10)))) AS p FROM scored)", "scored")
def _(v):
    return v("scored").select("id", scores.trust_score(F.col("score"), F.col("flag"), 50.0, 10.0).alias("trust"))


@add("physical_score", f"SELECT id, {r('(score / 20) / (1 + score / 20) AS p')} FROM scored", "scored")
def _(v):
    return v("scored").select("id", scores.physical_score(F.col("score"), 20.0).alias("p"))


@add("pack_signal", f"SELECT id, {r('score + flag + 0.5 + f AS total')}, 7 AS width FROM (SELECT id, score, flag, score / 2 AS f FROM scored)", "scored")
def _(v):
    s = scores.pack_signal(F.col("score"), F.col("flag"), F.lit(0.5), F.array(F.col("score") / 2), 4)
    return v("scored").select("id", F.aggregate(s, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(s).alias("width"))


# -- cleaning and scaling

_NUM = "CASE WHEN isfinite(try_cast({0} AS DOUBLE)) THEN try_cast({0} AS DOUBLE) END"


@add("coerce_numeric", f"SELECT id, {r(_NUM.format('t0') + ' AS t0', _NUM.format('t1') + ' AS t1')} FROM dirty", "dirty")
def _(v):
    return clean.coerce_numeric(v("dirty"), ["t0", "t1"])


@add("impute_median", f""", x AS (SELECT id, {_NUM.format('t0')} AS t0, {_NUM.format('t1')} AS t1 FROM dirty), k AS (SELECT * FROM x WHERE coalesce(t0, t1) IS NOT NULL),
    m AS (SELECT median(t0) AS m0, median(t1) AS m1 FROM k) SELECT id, {r('coalesce(t0, m0) AS t0', 'coalesce(t1, m1) AS t1')} FROM k, m""", "dirty")  # fmt: skip
def _(v):
    return clean.impute_median(clean.coerce_numeric(v("dirty"), ["t0", "t1"]), ["t0", "t1"])


@add("drop_incomplete", f", x AS (SELECT id, {_NUM.format('t0')} AS t0, {_NUM.format('t1')} AS t1 FROM dirty) SELECT id, {r('t0', 't1')} FROM x WHERE t0 IS NOT NULL AND t1 IS NOT NULL", "dirty")
def _(v):
    return clean.drop_incomplete(v("dirty"), ["t0", "t1"])


@add("minmax_scale", f", {_FIT}, s AS (SELECT {', '.join(f'min({c}) AS a{c}, max({c}) AS b{c}' for c in COLS)} FROM fit) SELECT id, {r(*[f'greatest(0, least(1, ({c} - a{c}) / (b{c} - a{c}))) AS {c}' for c in COLS])} FROM test, s", "flows")
def _(v):
    return clean.minmax_scale(_test(v).select("id", *COLS), COLS, _fit(v))


@add("zscore_scale", f", {_FIT}, s AS (SELECT {', '.join(f'avg({c}) AS a{c}, stddev_pop({c}) AS b{c}' for c in COLS)} FROM fit) SELECT id, {r(*[f'({c} - a{c}) / b{c} AS {c}' for c in COLS])} FROM test, s", "flows")
def _(v):
    return clean.zscore_scale(_test(v).select("id", *COLS), COLS, _fit(v))


@add("log1p_zscore", f", {_FIT}, s AS (SELECT {', '.join(f'avg(ln(1 + greatest({c}, 0))) AS a{c}, stddev_pop(ln(1 + greatest({c}, 0))) AS b{c}' for c in COLS)} FROM fit) SELECT id, {r(*[f'(ln(1 + greatest({c}, 0)) - a{c}) / b{c} AS {c}' for c in COLS])} FROM test, s", "flows")
def _(v):
    return clean.log1p_zscore(_test(v).select("id", *COLS), COLS, _fit(v))


def _stats_sql(c: str) -> str:
    x = "(f2 * 1000)" if c == "f2" else c  # a mean of f2 may lie between two sixth places
    return f"SELECT '{c}' AS feature, {r(f'min({x}) AS min', f'max({x}) AS max', f'avg({x}) AS mean', f'stddev_pop({x}) AS std', f'var_pop({x} / 1000) AS variance', f'median({x}) AS median')} FROM flows"


@add("column_stats", " UNION ALL ".join(map(_stats_sql, COLS)), "flows")
def _(v):
    return clean.column_stats(v("flows").withColumn("f2", F.col("f2") * 1000), COLS).withColumn("variance", F.col("variance") / 1e6)


@add("topk_variance_features", f"SELECT place, feature, {r('variance')} FROM ({' UNION ALL '.join(f"SELECT {i} AS place, '{c}' AS feature, var_pop({c if c != 'f1' else 'f1 / 1000'}) AS variance FROM flows" for i, c in enumerate(COLS))}) ORDER BY variance DESC, place LIMIT 2", "flows")
def _(v):
    return clean.topk_variance_features(v("flows").withColumn("f1", F.col("f1") / 1000), COLS, 2)


@add("filter_benign_fit", "SELECT id FROM flows WHERE y = 0 AND day = 'Monday'", "flows")
def _(v):
    return clean.filter_benign_fit(v("flows").withColumn("label", labels.label_family(F.col("raw_label")))).select("id")


@add("dedup_exact", f"SELECT DISTINCT {r(*COLS)} FROM flows", "flows")
def _(v):
    return clean.dedup_exact(v("flows").select(*COLS), COLS)


@add("duplicate_rate", f"SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT f0, f2, f3 FROM flows)) AS n_distinct, {r('1 - (SELECT count(*) FROM (SELECT DISTINCT f0, f2, f3 FROM flows)) / count(*) AS rate')} FROM flows", "flows")
def _(v):
    return clean.duplicate_rate(v("flows"), ["f0", "f2", "f3"])


# -- sampling

_RANK = "SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id) AS k, count(*) OVER (PARTITION BY {by}) AS n FROM {t}"


@add("sample_per_file", f", x AS ({_RANK.format(by='day', t='scored')}) SELECT id FROM x WHERE k <= CASE day WHEN '2024-01-01' THEN 20 WHEN '2024-01-02' THEN 50 ELSE n END", "scored")
def _(v):
    return sampling.sample_per_file(v("scored"), {"2024-01-01": 20, "2024-01-02": 50, "2024-01-03": None}, "id", "day").select("id")


@add("stratified_split", f""", t AS (SELECT cls AS c, count(*) AS total FROM scored GROUP BY cls), x AS ({_RANK.format(by="cls, day <> '2024-01-01'", t='scored')})
    SELECT id, CASE WHEN day <> '2024-01-01' AND k <= round_even(total * 0.2, 0) THEN 'test' ELSE 'train' END AS split FROM x JOIN t ON cls = c""", "scored")  # fmt: skip
def _(v):
    return sampling.stratified_split(v("scored"), "cls", "id", eligible=F.col("day") != "2024-01-01").select("id", "split")


@add("stratified_split_min1", f", x AS ({_RANK.format(by='user_id', t='scored')}) SELECT id, CASE WHEN n > 1 AND k <= greatest(1, round_even(n * 0.2, 0)) THEN 'test' ELSE 'train' END AS split FROM x", "scored")
def _(v):
    return sampling.stratified_split(v("scored"), "user_id", "id", at_least_one=True).select("id", "split")


@add("balance_benign", f", a AS (SELECT floor(count(*) * 0.1 / 0.9) AS q FROM scored WHERE cls <> 0), x AS ({_RANK.format(by='cls', t='scored')}) SELECT id FROM x, a WHERE cls <> 0 OR k <= q", "scored")
def _(v):
    return sampling.balance_benign(v("scored"), "cls", "id", ratio=0.1).select("id")


@add("cap_class", f", x AS ({_RANK.format(by='cls', t='scored')}) SELECT id FROM x WHERE cls <> 2 OR k <= 100", "scored")
def _(v):
    return sampling.cap_class(v("scored"), "cls", "id", 2, 100).select("id")


@add("equal_per_class", f", x AS ({_RANK.format(by='cls', t='scored')}) SELECT id FROM x WHERE k <= 100", "scored")
def _(v):
    return sampling.equal_per_class(v("scored"), "cls", "id", 500).select("id")


@add("class_pool", f", x AS ({_RANK.format(by='cls', t='scored')}) SELECT id FROM x WHERE k <= 40 AND cls IN (1, 3)", "scored")
def _(v):
    return sampling.class_pool(v("scored"), "cls", "id", [1, 3], 40).select("id")


@add("stratified_subset", f""", x AS ({_RANK.format(by='cls', t='scored')}), c AS (SELECT cls, count(*) AS n, sum(count(*)) OVER () AS total FROM scored GROUP BY cls),
    q AS (SELECT cls, CASE WHEN total <= 300 THEN n ELSE least(n, greatest(round_even(n * 300.0 / total, 0)::BIGINT, least(50, n))) END AS q FROM c),
    lv AS (SELECT min(range) AS lv FROM (SELECT range, (SELECT sum(least(q, range)) FROM q) AS held FROM range(1, 301)) WHERE held >= least(300, (SELECT sum(q) FROM q))),
    t AS (SELECT cls, q, lv, (SELECT sum(least(q, lv)) FROM q, lv) - 300 AS over, count(*) FILTER (q >= lv) OVER (ORDER BY cls DESC) AS place FROM q, lv),
    f AS (SELECT cls AS c, least(q, lv) - CASE WHEN q >= lv AND lv > 1 AND place <= over THEN 1 ELSE 0 END AS quota FROM t)
    SELECT id, cls FROM x JOIN f ON cls = c WHERE k <= quota""", "scored")
def _(v):
    return sampling.stratified_subset(v("scored"), "cls", "id", 300).select("id", "cls")


@add("dropped_rows", f", x AS ({_RANK.format(by='cls', t='scored')}) SELECT id FROM x WHERE cls = 2 AND k > 100", "scored")
def _(v):
    return sampling.dropped_rows(v("scored"), sampling.cap_class(v("scored"), "cls", "id", 2, 100), "id").select("id")


# -- leakage and joins


@add("leakage_check", f", {_FIT}, u AS (SELECT DISTINCT f0, f1, f2, f3 FROM fit) SELECT count(*) AS n, count(u.f0) AS leaked, {r('count(u.f0) / count(*) AS share')} FROM test LEFT JOIN u ON test.f0 = u.f0 AND test.f1 = u.f1 AND test.f2 = u.f2 AND test.f3 = u.f3", "flows")
def _(v):
    return joins.leakage_check(_test(v), _fit(v), COLS)


@add("remove_leakage", f", {_FIT}, u AS (SELECT DISTINCT f0, f1, f2, f3 FROM fit) SELECT id FROM test WHERE NOT EXISTS (SELECT 1 FROM u WHERE test.f0 = u.f0 AND test.f1 = u.f1 AND test.f2 = u.f2 AND test.f3 = u.f3)", "flows")
def _(v):
    return joins.remove_leakage(_test(v), _fit(v), COLS).select("id")


@add("exclude_fit_source", "SELECT id FROM flows WHERE day NOT IN ('Monday')", "flows")
def _(v):
    return joins.exclude_fit_source(v("flows"), ["Monday"]).select("id")


_SEG = [("FDIA", 1000, 3000), ("DoS", 3000, 5000), ("COMBINED", 8000, 9000)]
_SEG_SQL = "CASE WHEN id >= 1000 AND id < 3000 THEN 'FDIA' WHEN id >= 3000 AND id < 5000 THEN 'DoS' WHEN id >= 8000 AND id < 9000 THEN 'COMBINED' ELSE 'BENIGN' END"


@add("tag_scenario", f"SELECT id, {_SEG_SQL} AS segment FROM scored", "scored")
def _(v):
    return joins.tag_scenario(v("scored"), _SEG, "id").select("id", "segment")


@add("tag_scenario_table", "SELECT id, CASE WHEN id < 100 THEN 'START' WHEN id >= 1000 AND id < 3000 THEN 'FDIA' WHEN id >= 1500 AND id < 5000 THEN 'DoS' WHEN id >= 2000 AND id < 2010 THEN 'INNER' WHEN id >= 7000 THEN 'LAST' ELSE 'BENIGN' END AS segment FROM scored", "scored")
def _(v):
    rows = [(1, "FDIA", 1000, 3000), (0, "START", None, 100), (2, "DoS", 1500, 5000), (4, "LAST", 7000, None), (3, "INNER", 2000, 2010), (3, "NONE", 6000, 6000)]
    table = v("scored").sparkSession.createDataFrame(rows, "place int, segment string, start long, end long")
    return joins.tag_scenario(v("scored"), table, "id").select("id", "segment")


@add("segment_rates", f"SELECT layer, segment, {r('avg(a) AS rate')}, count(*) AS n FROM (SELECT 'net' AS layer, {_SEG_SQL} AS segment, flag AS a FROM scored UNION ALL SELECT 'phys', {_SEG_SQL}, CASE WHEN score >= 80 THEN 1 ELSE 0 END FROM scored) GROUP BY layer, segment", "scored")
def _(v):
    s = joins.tag_scenario(v("scored"), _SEG, "id").withColumn("p", (F.col("score") >= 80).cast("int"))
    return metrics.segment_rates(s, {"net": "flag", "phys": "p"})


@add("fuse_layers", f"""SELECT id, p AS phys_alarm, n AS net_alarm, l AS net_label, {r('pp AS p_phys', '0.5 * pp + 0.5 * a AS fused')}, CASE WHEN p = 1 OR n = 1 OR 0.5 * pp + 0.5 * a >= 0.5 THEN 1 ELSE 0 END AS alarm,
    CASE WHEN p = 1 AND n = 1 THEN l || '+FDIA' WHEN p = 1 THEN 'FDIA' WHEN n = 1 THEN l ELSE 'BENIGN' END AS label, CASE WHEN p = 1 AND n = 1 THEN 'BOTH' WHEN p = 1 THEN 'PHYS' WHEN n = 1 THEN 'NET' ELSE 'NONE' END AS source
    FROM (SELECT id, CASE WHEN score >= 80 THEN 1 ELSE 0 END AS p, y AS n, CASE WHEN y = 1 THEN 'DoS' ELSE 'BENIGN' END AS l, (score / 80) / (1 + score / 80) AS pp, 0.25 * cls AS a FROM scored)""", "scored")  # fmt: skip
def _(v):
    s = v("scored")
    phys = s.select("id", F.col("score").alias("adi"), (F.col("score") >= 80).cast("int").alias("phys_alarm"))
    net = s.select("id", F.when(F.col("y") == 1, "DoS").otherwise("BENIGN").alias("net_label"), (0.25 * F.col("cls")).alias("attack_prob"), F.col("y").alias("net_alarm"))
    return joins.fuse_layers(phys, net, ["id"], 80.0)


# -- threshold metrics and breakdowns


def _rates(where: str = "score >= 50") -> str:
    n = lambda a, b: f"sum(CASE WHEN {a} AND {b} THEN 1 ELSE 0 END)::BIGINT"
    return f"{n(where, 'y = 1')} AS tp, {n(where, 'y = 0')} AS fp, {n(f'NOT ({where})', 'y = 1')} AS fn, {n(f'NOT ({where})', 'y = 0')} AS tn"


_BINARY = r(
    "coalesce(tp / nullif(tp + fp, 0), 0) AS precision", "coalesce(tp / nullif(tp + fn, 0), 0) AS recall", "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1",
    "(tp + tn) / (tp + fp + fn + tn) AS accuracy", "coalesce(fp / nullif(fp + tn, 0), 0) AS fpr", "1 - coalesce(fp / nullif(fp + tn, 0), 0) AS specificity",
    "(coalesce(tp / nullif(tp + fn, 0), 0) + 1 - coalesce(fp / nullif(fp + tn, 0), 0)) / 2 AS balanced_accuracy", "1000 * coalesce(fp / nullif(fp + tn, 0), 0) AS fp_per_1000",
    "CASE WHEN tp + fp = 0 THEN 1 ELSE coalesce(0.01 * tp / nullif(tp + fn, 0), 0) / (coalesce(0.01 * tp / nullif(tp + fn, 0), 0) + 0.99 * coalesce(fp / nullif(fp + tn, 0), 0)) END AS precision_at_1pct",
    "CASE WHEN tp + fp = 0 THEN 1 ELSE coalesce(0.001 * tp / nullif(tp + fn, 0), 0) / (coalesce(0.001 * tp / nullif(tp + fn, 0), 0) + 0.999 * coalesce(fp / nullif(fp + tn, 0), 0)) END AS precision_at_01pct",
)


@add("binary_metrics", f", c AS (SELECT day, {_rates()} FROM scored GROUP BY day) SELECT day, tp, fp, fn, tn, {_BINARY} FROM c", "scored")
def _(v):
    return metrics.binary_metrics(v("scored"), "y", "score", 50.0, ["day"])


_CM = "cm AS (SELECT y.range::INT AS y, p.range::INT AS p, (SELECT count(*) FROM decisions d WHERE d.cls = y.range AND d.pred = p.range) AS n FROM range(5) y, range(5) p)"
_REP = f"{_CM}, e AS (SELECT y AS cls, sum(n) FILTER (y = p) AS tp, (SELECT sum(n) FROM cm c2 WHERE c2.p = cm.y) AS pred, sum(n) AS support FROM cm GROUP BY y), rep AS (SELECT cls, coalesce(tp / nullif(pred, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(pred + support, 0), 0) AS f1, support::BIGINT AS support FROM e)"


def _cm(v):
    return metrics.confusion_matrix(v("decisions"), "cls", "pred", 5)


@add("confusion_matrix", f", {_REP} SELECT * FROM cm", "decisions")
def _(v):
    return _cm(v)


@add("classification_report", f", {_REP} SELECT cls, {r('precision', 'recall', 'f1')}, support FROM rep", "decisions")
def _(v):
    return metrics.classification_report(_cm(v))


@add("report_summary", f""", {_REP}, t AS (SELECT sum(n) AS a, sum(n) FILTER (y = p) AS r FROM cm), c AS (SELECT sum(a.n * b.n) AS x FROM (SELECT y, sum(n) AS n FROM cm GROUP BY y) a JOIN (SELECT p, sum(n) AS n FROM cm GROUP BY p) b ON a.y = b.p)
    SELECT {r('r / a AS accuracy', '(SELECT avg(f1) FROM rep WHERE cls <> 0) AS macro_f1', '(SELECT sum(f1 * support) / sum(support) FROM rep) AS weighted_f1', '(r / a - x / (a * a)) / (1 - x / (a * a)) AS kappa',
    '(SELECT sum(n) FILTER (y > 0 AND p > 0) / sum(n) FILTER (y > 0) FROM cm) AS detection_rate', '(SELECT sum(n) FILTER (y = 0 AND p > 0) / sum(n) FILTER (y = 0) FROM cm) AS false_alarm_rate')} FROM t, c""", "decisions")  # fmt: skip
def _(v):
    return metrics.report_summary(_cm(v))


@add("class_distribution", "SELECT day, cls, count(*) AS n, grouping_id(day, cls)::INT AS level FROM flows GROUP BY CUBE (day, cls)", "flows")
def _(v):
    return metrics.class_distribution(v("flows"), ["day", "cls"])


@add("merge_rare_classes", "SELECT *, dense_rank() OVER (ORDER BY merged <> '2024-01-01', merged = 'Other', merged)::INT - 1 AS class_idx FROM (SELECT day, CASE WHEN day IN ('2024-01-01') OR n >= 320 THEN day ELSE 'Other' END AS merged, n FROM (SELECT day, count(*) AS n FROM scored GROUP BY day))", "scored")
def _(v):
    return metrics.merge_rare_classes(v("scored"), "day", 320, benign="2024-01-01")[1].select("day", "merged", "n", "class_idx")


@add("class_detection_rate", f"SELECT cls, count(*) AS n, sum(flag)::BIGINT AS alarms, {r('avg(flag) AS rate')} FROM scored GROUP BY cls", "scored")
def _(v):
    return metrics.class_detection_rate(v("scored"), "cls", "flag")


@add("daily_breakdown", f"SELECT day, count(*) AS n, {r('avg(y) AS attack_ratio', 'avg(flag) FILTER (y = 1) AS detection_rate', 'avg(flag) FILTER (y = 0) AS fpr', *[f'{f} FILTER (y = {k}) AS {s}_{m}' for k, s in ((0, 'benign'), (1, 'attack')) for m, f in (('median', 'median(score)'), ('p95', 'quantile_cont(score, 0.95)'), ('mean', 'avg(score)'))])} FROM scored GROUP BY day", "scored")
def _(v):
    return metrics.daily_breakdown(v("scored"), "day", "y", "score", "flag")


@add("daily_drift", f", f AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM scored WHERE y = 0 AND day = '2024-01-01') SELECT day, {r('avg(score) AS benign_mean', '(avg(score) - any_value(m)) / any_value(s) AS z', 'avg(CASE WHEN score >= 50 THEN 1 ELSE 0 END) AS above')} FROM scored, f WHERE y = 0 GROUP BY day", "scored")
def _(v):
    s = v("scored")
    return metrics.daily_drift(s, s.where("y = 0 and day = '2024-01-01'"), "day", "y", "score", 50.0)


@add("daily_recalibration", f", t AS (SELECT day, quantile_cont(score, 0.95) AS threshold, count(*) AS benign FROM scored WHERE y = 0 GROUP BY day HAVING count(*) >= 50) SELECT day, {r('any_value(threshold) AS threshold')}, any_value(benign) AS benign, {r('avg(CASE WHEN score >= threshold THEN 1 ELSE 0 END) FILTER (y = 0) AS fpr', 'avg(CASE WHEN score >= threshold THEN 1 ELSE 0 END) FILTER (y = 1) AS detection_rate')} FROM scored JOIN t USING (day) GROUP BY day", "scored")
def _(v):
    return metrics.daily_recalibration(v("scored"), "day", "y", "score")


@add("class_evidence", f"SELECT cls, {r('avg(flag) AS alarm_rate', 'median(score) AS median', 'quantile_cont(score, 0.95) AS p95', 'median(score) / 50 AS separation')} FROM scored GROUP BY cls", "scored")
def _(v):
    return metrics.class_evidence(v("scored"), "cls", "score", "flag", 50.0)


@add("evidence_spread", f", m AS (SELECT cls, median(score) AS m FROM scored GROUP BY cls) SELECT {r('(max(m) - min(m)) / (abs(median(m)) + 1e-9) AS spread')}, count(*) AS classes FROM m", "scored")
def _(v):
    return metrics.evidence_spread(metrics.class_evidence(v("scored"), "cls", "score", "flag", 50.0))


@add("failure_decomposition", "SELECT agent, " + ", ".join(f"count(*) FILTER (cls > 0 AND flag = {f} AND {'' if ok else 'NOT '}(pred = cls)) AS {n}" for n, f, ok in (("alerted_right", 1, 1), ("alerted_wrong", 1, 0), ("missed_right", 0, 1), ("missed_wrong", 0, 0))) + ", count(*) FILTER (cls > 0) AS n_attack FROM decisions GROUP BY agent", "decisions")
def _(v):
    return metrics.failure_decomposition(v("decisions"), "cls", "pred", "flag", ["agent"])


@add("policy_report", f", k AS (SELECT agent, max(k) AS k FROM (SELECT agent, pred, count(*) AS k FROM decisions GROUP BY agent, pred) GROUP BY agent) SELECT agent, {r('avg((pred = cls)::INT) AS accuracy', 'avg((pred = cls)::INT) FILTER (cls > 0) AS attack_success', 'avg((pred = cls)::INT) FILTER (flag = 1) AS alerted_accuracy', 'avg(flag) AS alarm_rate')}, count(*) AS n, {r('any_value(k) / count(*) AS majority_share')}, any_value(k) / count(*) > 0.8 AS collapsed FROM decisions JOIN k USING (agent) GROUP BY agent", "decisions")
def _(v):
    return metrics.policy_report(v("decisions"), ["agent"], y="cls")


@add("agent_report", f", c AS (SELECT agent, avg((pred = cls)::INT) AS accuracy, count(*) FILTER (pred > 0 AND cls > 0) AS tp, count(*) FILTER (pred > 0 AND cls = 0) AS fp, count(*) FILTER (pred = 0 AND cls > 0) AS fn, avg((pred > 0)::INT) AS flag_rate FROM decisions GROUP BY agent), q AS (SELECT *, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS q FROM c) SELECT agent, {r('accuracy', 'p AS precision', 'q AS recall', '2 * p * q / (p + q + 1e-9) AS f1', 'flag_rate')} FROM q", "decisions")
def _(v):
    return metrics.agent_report(v("decisions"), y="cls")


@add("policy_classes", f", c AS (SELECT agent, cls, pred, count(*) AS n FROM decisions GROUP BY ALL) SELECT agent, cls, pred, n, {r('n / sum(n) OVER (PARTITION BY agent, cls) AS share')} FROM c", "decisions")
def _(v):
    return metrics.policy_classes(v("decisions"), ["agent"], y="cls")


@add("detector_row", f", c AS (SELECT count(*) FILTER (flag = 1 AND cls > 0) AS tp, count(*) FILTER (flag = 1 AND cls = 0) AS fp, count(*) FILTER (flag = 0 AND cls > 0) AS fn, avg((flag = 1)::INT) AS flag_rate, avg(((flag = 1) = (cls > 0))::INT) AS accuracy FROM scored), q AS (SELECT *, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS q FROM c) SELECT 'detector' AS name, {r('accuracy', 'p AS precision', 'q AS recall', '2 * p * q / (p + q + 1e-9) AS f1', 'flag_rate')} FROM q", "scored")
def _(v):
    return metrics.detector_row(v("decisions"), y="cls")


@add("recalibration_summary", f", t AS (SELECT day, quantile_cont(score, 0.95) AS threshold FROM scored WHERE y = 0 GROUP BY day HAVING count(*) >= 50), c AS (SELECT max(threshold) / min(threshold) AS ratio, avg((score >= threshold)::INT) FILTER (y = 0) AS f, avg((score >= threshold)::INT) FILTER (y = 1) AS d, avg((score >= 50)::INT) FILTER (y = 0) AS f0, avg((score >= 50)::INT) FILTER (y = 1) AS d0 FROM scored JOIN t USING (day)) SELECT {r('f AS fpr', 'd AS detection_rate', 'f - f0 AS fpr_change', 'd - d0 AS detection_change', 'ratio AS threshold_ratio')} FROM c", "scored")
def _(v):
    return metrics.recalibration_summary(v("scored"), "day", "y", "score", 50.0)


@add("segment_summary", f", g AS (SELECT {_SEG_SQL} AS seg, flag, CASE WHEN score >= 80 THEN 'DoS+FDIA' WHEN flag = 1 THEN 'DoS' ELSE 'BENIGN' END AS label FROM scored) SELECT {r(*[x.replace('ATT', "(seg <> 'BENIGN')") for x in ('avg((flag = 1)::INT) FILTER (ATT) AS detection_rate', 'avg((flag = 1)::INT) FILTER (NOT ATT) AS false_alarm_rate', 'avg(((flag = 1) = ATT)::INT) AS accuracy', 'avg(contains(label, seg)::INT) FILTER (ATT) AS label_match')])} FROM g", "scored")
def _(v):
    s = joins.tag_scenario(v("scored"), _SEG, "id").withColumn("label", F.when(F.col("score") >= 80, "DoS+FDIA").when(F.col("flag") == 1, "DoS").otherwise("BENIGN"))
    return metrics.segment_summary(s, "segment", alarm="flag")


@add("majority_vote", ", c AS (SELECT id, pred, count(*) AS k FROM decisions GROUP BY id, pred) SELECT id, pred AS winner FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC, pred = 0, pred) = 1", "decisions")
def _(v):
    return metrics.majority_vote(v("decisions"), "id", "pred")


@add("score_histogram", f", b AS (SELECT min(score) AS lo, (max(score) - min(score)) / 60 AS w FROM scored), c AS (SELECT y, least(59, floor((score - lo) / w))::INT AS bin, count(*) AS n, any_value(w) AS w FROM scored, b GROUP BY 1, 2) SELECT y, bin, n, {r('n / sum(n) OVER (PARTITION BY y) / w AS density')} FROM c", "scored")
def _(v):
    return metrics.score_histogram(v("scored"), "score", "y")


_METRIC = "m AS (SELECT 'agent' || agent AS detector, 'accuracy' AS metric, avg((pred = cls)::INT) AS value FROM decisions GROUP BY agent UNION ALL SELECT 'agent' || agent, 'alarms', avg((pred > 0)::INT) FROM decisions GROUP BY agent)"


@add("leaderboard", f", {_METRIC}, k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE metric WHEN 'accuracy' THEN -value ELSE value END, detector) AS k FROM m) SELECT metric, max(detector) FILTER (k = 1) AS winner, max(detector) FILTER (k = 2) AS runner_up FROM k GROUP BY metric", "decisions")
def _(v):
    d = v("decisions").groupBy(F.concat(F.lit("agent"), F.col("agent").cast("string")).alias("detector")).agg(F.avg((F.col("pred") == F.col("cls")).cast("double")).alias("accuracy"), F.avg((F.col("pred") > 0).cast("double")).alias("alarms"))
    return metrics.leaderboard(d.unpivot("detector", ["accuracy", "alarms"], "metric", "value"), {"accuracy": True, "alarms": False})


@add("leaderboard_by_class", f", m AS (SELECT 'agent' || agent AS detector, cls, 'detected' AS metric, avg((pred > 0)::INT) AS value FROM decisions WHERE cls > 0 GROUP BY agent, cls UNION ALL SELECT 'agent' || agent, cls, 'named', avg((pred = cls)::INT) FROM decisions WHERE cls > 0 GROUP BY agent, cls), k AS (SELECT *, row_number() OVER (PARTITION BY metric, cls ORDER BY value DESC, detector) AS k FROM m) SELECT metric, cls, max(detector) FILTER (k = 1) AS winner, max(detector) FILTER (k = 2) AS runner_up FROM k GROUP BY metric, cls", "decisions")
def _(v):
    rate = lambda c: F.avg(c.cast("double"))
    d = v("decisions").where("cls > 0").groupBy(F.concat(F.lit("agent"), F.col("agent").cast("string")).alias("detector"), "cls").agg(rate(F.col("pred") > 0).alias("detected"), rate(F.col("pred") == F.col("cls")).alias("named"))
    return metrics.leaderboard(d.unpivot(["detector", "cls"], ["detected", "named"], "metric", "value"), {"detected": True, "named": True}, by=("cls",))


# -- ranking metrics

_CURVE = "g AS (SELECT score AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n, row_number() OVER (ORDER BY s DESC) - 1 AS place FROM g)"


@add("roc_auc", f", {_CURVE} SELECT {r('sum(neg * (tp - pos / 2)) / any_value(p * n) AS roc_auc')} FROM c", "scored")
def _(v):
    return curves.roc_auc(v("scored"), "y", "score")


@add("pr_auc", f", {_CURVE} SELECT {r('sum(pos * tp / (tp + fp)) / any_value(p) AS pr_auc')} FROM c", "scored")
def _(v):
    return curves.pr_auc(v("scored"), "y", "score")


@add("score_orientation", f", {_CURVE}, a AS (SELECT sum(neg * (tp - pos / 2)) / any_value(p * n) AS a FROM c) SELECT {r('a AS auc')}, a < 0.5 AS flipped, {r('greatest(a, 1 - a) AS oriented_auc')} FROM a", "scored")
def _(v):
    return curves.score_orientation(v("scored"), "y", "score")


@add("roc_pr_curve", f", {_CURVE}, k AS (SELECT DISTINCT (i.range * ((SELECT count(*) FROM c) - 1)) // 299 AS place FROM range(300) i) SELECT place, {r('s', 'tp / p AS tpr', 'fp / n AS fpr', 'tp / (tp + fp) AS precision')} FROM c JOIN k USING (place)", "scored")
def _(v):
    return curves.roc_pr_curve(v("scored"), "y", "score")


@add("best_f1_exhaustive", f", {_CURVE} SELECT {r('s AS threshold', '2 * tp / (tp + fp + p) AS f1')} FROM c ORDER BY 2 * tp / (tp + fp + p) DESC, s DESC LIMIT 1", "scored")
def _(v):
    return curves.best_f1_exhaustive(v("scored"), "y", "score")


@add("prior_threshold_sweep", f", a AS (SELECT unnest([0.01, 0.05, 0.1, 0.2, 0.3, 0.4])::DOUBLE AS alpha), q AS (SELECT alpha, (SELECT quantile_cont(score, [0.99, 0.95, 0.9, 0.8, 0.7, 0.6]) FROM scored)[row_number() OVER (ORDER BY alpha)] AS t FROM a) SELECT {r('alpha', 't AS threshold', '2 * count(*) FILTER (y = 1 AND score >= t) / (count(*) FILTER (score >= t) + count(*) FILTER (y = 1)) AS f1')} FROM q, scored GROUP BY alpha, t", "scored")
def _(v):
    return curves.prior_threshold_sweep(v("scored"), "y", "score")


_CUTS = f"cuts AS (SELECT unnest(range(400)) AS i, unnest((SELECT quantile_cont(score, [{', '.join(repr(0.5 + 0.4995 * i / 399) for i in range(400))}]) FROM scored)) AS t)"


@add("best_f1_threshold", f", {_CURVE}, {_CUTS}, x AS (SELECT i, t, sum(pos) AS tp, sum(neg) AS fp, any_value(p) AS p FROM cuts JOIN c ON s >= t GROUP BY i, t) SELECT {r('t AS threshold', '2 * tp / (tp + fp + p) AS f1')} FROM x ORDER BY 2 * tp / (tp + fp + p) DESC, i LIMIT 1", "scored")
def _(v):
    return curves.best_f1_threshold(v("scored"), "y", "score")


@add("benign_quantile_threshold", f"SELECT day, {r('quantile_cont(score, 0.95) AS threshold')} FROM scored WHERE y = 0 GROUP BY day", "scored")
def _(v):
    return curves.benign_quantile_threshold(v("scored").where("y = 0"), "score", by=["day"])


@add("robust_scale", f"SELECT {r('(quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / 1.349 AS scale')} FROM scored", "scored")
def _(v):
    return curves.robust_scale(v("scored"), "score")


@add("evt_threshold", f""", b AS (SELECT score FROM scored WHERE y = 0), q AS (SELECT quantile_cont(score, 0.9) AS u, quantile_cont(score, 0.95) AS plain, count(*) AS n FROM b),
    e AS (SELECT u, plain, n, count(*) FILTER (score > u) AS k, avg(score - u) FILTER (score > u) AS m1, avg((score - u) * (score - u)) FILTER (score > u) AS m2 FROM b, q GROUP BY u, plain, n),
    g AS (SELECT *, greatest(-0.25, least(0.25, 0.5 * (1 - m2 / (m1 * m1)))) AS xi, 0.05 / (k / n) AS ratio FROM e), h AS (SELECT *, greatest(m1 * (1 - xi), 1e-12) AS beta FROM g),
    f AS (SELECT *, u + CASE WHEN abs(xi) < 1e-6 THEN beta * ln(1 / ratio) ELSE beta / xi * (pow(ratio, -xi) - 1) END AS found FROM h),
    o AS (SELECT *, k < 10 OR NOT isfinite(found) OR found <= 0 OR abs((SELECT avg((score <= found)::INT) FROM b) - 0.95) > 0.03 AS back FROM f)
    SELECT {r('CASE WHEN back THEN plain ELSE found END AS threshold', 'u', 'CASE WHEN back THEN 0 ELSE xi END AS xi', 'CASE WHEN back THEN 1e-12 ELSE beta END AS beta')}, k AS n_exceed, back AS fallback FROM o""", "scored")
def _(v):
    return curves.evt_threshold(v("scored").where("y = 0"), "score")


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, y, day FROM flows" for c in COLS)


@add("ks_drift", f""", l AS ({_LONG}), g AS (SELECT feature, v, count(*) FILTER (y = 0 AND day = 'Monday') AS na, count(*) FILTER (day <> 'Monday') AS nb FROM l GROUP BY 1, 2),
    c AS (SELECT feature, sum(na) OVER w AS ca, sum(nb) OVER w AS cb, sum(na) OVER (PARTITION BY feature) AS ta, sum(nb) OVER (PARTITION BY feature) AS tb FROM g WINDOW w AS (PARTITION BY feature ORDER BY v)),
    d AS (SELECT feature, max(abs(ca / ta - cb / tb)) AS ks, any_value(sqrt(ta * tb / (ta + tb))) AS root FROM c GROUP BY feature), s AS (SELECT feature, ks, root * ks AS lam FROM d),
    p AS (SELECT feature, ks, lam, (SELECT sum(CASE WHEN j.range % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2 * j.range * j.range * lam * lam)) FROM range(1, 101) j) AS series FROM s),
    o AS (SELECT feature, ks, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0, least(1, series)) END AS p_value FROM p) SELECT feature, {r('ks', 'p_value')}, p_value < 0.01 AS drifted FROM o""", "flows")
def _(v):
    return curves.ks_drift(_fit(v), _test(v), COLS)


@add("spearman_topk", f""", l AS (SELECT feature, v, f0 * f3 AS s FROM flows, LATERAL (VALUES {', '.join(f"('{c}', {c})" for c in COLS)}) AS t(feature, v)),
    k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS rv, rank() OVER (PARTITION BY feature ORDER BY s) + (count(*) OVER (PARTITION BY feature, s) - 1) / 2 AS rs FROM l),
    o AS (SELECT feature, corr(rv, rs) AS rho FROM k GROUP BY feature ORDER BY abs(rho) DESC, feature LIMIT 3) SELECT feature, {r('rho')} FROM o""", "flows")
def _(v):
    return curves.spearman_topk(v("flows").withColumn("s", F.col("f0") * F.col("f3")), COLS, "s", 3)


# -- bursts

_TRACE = "t AS (SELECT user_id, epoch(ts) / 3600 AS h FROM scored), sp AS (SELECT user_id, min(h) AS t0, greatest(1, ceil((max(h) - min(h)) / 6))::INT AS nb FROM t GROUP BY user_id), e AS (SELECT user_id, unnest(range(nb))::INT AS bin FROM sp), k AS (SELECT user_id, least(floor((h - t0) / 6)::INT, nb - 1) AS bin, count(*) AS n FROM t JOIN sp USING (user_id) GROUP BY 1, 2), b AS (SELECT user_id, bin, coalesce(n, 0) AS n FROM e LEFT JOIN k USING (user_id, bin))"


def _trace(v):
    return v("scored").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600).alias("h"))


@add("bin_counts", f", {_TRACE} SELECT * FROM b", "scored")
def _(v):
    return bursts.bin_counts(_trace(v), "user_id", "h", 6.0)


@add("run_lengths", f", {_TRACE}, f AS (SELECT user_id, bin, (n > 0)::INT AS f, row_number() OVER (PARTITION BY user_id ORDER BY bin) - row_number() OVER (PARTITION BY user_id, n > 0 ORDER BY bin) AS i FROM b) SELECT user_id, f, min(bin) AS start, count(*) AS length FROM f GROUP BY user_id, f, i", "scored")
def _(v):
    return bursts.run_lengths(bursts.bin_counts(_trace(v), "user_id", "h", 6.0).withColumn("f", (F.col("n") > 0).cast("int")), "user_id", "bin", "f")


_HURST = """u AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS nn FROM b), sc AS (SELECT user_id, bin, n, (1 << k)::INT AS size FROM u, range(2, 31) t(k) WHERE k <= floor(log2(nn)) - 1 AND (bin // (1 << k) + 1) * (1 << k) <= nn),
    dv AS (SELECT *, bin // size AS blk, n - avg(n) OVER (PARTITION BY user_id, size, bin // size) AS d FROM sc), cd AS (SELECT *, sum(d) OVER (PARTITION BY user_id, size, blk ORDER BY bin) AS cs FROM dv),
    rs AS (SELECT user_id, size, (max(cs) - min(cs)) / stddev_samp(n) AS rs FROM cd GROUP BY user_id, size, blk HAVING stddev_samp(n) > 1e-12), mr AS (SELECT user_id, ln(size) AS x, ln(avg(rs)) AS yy FROM rs GROUP BY user_id, size),
    hu AS (SELECT user_id, CASE WHEN count(*) >= 2 THEN regr_slope(yy, x) ELSE 0.5 END AS hurst FROM mr GROUP BY user_id)"""
_RUNS = """f AS (SELECT user_id, bin, (n > 0)::INT AS f, row_number() OVER (PARTITION BY user_id ORDER BY bin) - row_number() OVER (PARTITION BY user_id, n > 0 ORDER BY bin) AS i FROM b), ru AS (SELECT user_id, f, count(*) * {width} AS d FROM f GROUP BY user_id, f, i),
    ra AS (SELECT user_id, coalesce(avg(d) FILTER (f = 1), 0) AS mean_on, coalesce(var_pop(d) FILTER (f = 1), 0) AS var_on, coalesce(avg(d) FILTER (f = 0), 0) AS mean_off, coalesce(var_pop(d) FILTER (f = 0), 0) AS var_off, coalesce(sum(d) FILTER (f = 1), 0) AS t_on, coalesce(sum(d) FILTER (f = 0), 0) AS t_off, count(*) FILTER (f = 1) AS n_bursts FROM ru GROUP BY user_id),
    ca AS (SELECT user_id, sum(n) AS packets, max(n) AS peak, count(*) * {width} AS duration FROM b GROUP BY user_id)"""
_SHARES = ("mean_on", "var_on", "mean_off", "var_off", "t_on / total AS on_ratio", "t_off / total AS idle_ratio", "packets / (t_on + 1e-12) AS burst_rate", "rate AS arrival_rate", "peak / (rate * {width} + 1e-12) AS peak_to_mean", "coalesce(hurst, 0.5) AS hurst", "n_bursts::DOUBLE AS n_bursts")


def trace_sql(width: float) -> tuple[str, str]:
    """The tables behind the burst features of bins b (user_id, bin, n), the last one o; and the features' columns."""
    tables = f"{_HURST}, {_RUNS.format(width=width)}, o AS (SELECT *, t_on + t_off + 1e-12 AS total, packets / (duration + 1e-12) AS rate FROM ra JOIN ca USING (user_id) LEFT JOIN hu USING (user_id))"
    return tables, r(*[c.format(width=width) for c in _SHARES])


@add("burst_features", f", {_TRACE}, {trace_sql(6.0)[0]} SELECT user_id, {trace_sql(6.0)[1]} FROM o", "scored")
def _(v):
    return bursts.burst_features(_trace(v), "user_id", "h", 6.0)


@add("hurst_rs", f", {_TRACE}, {_HURST} SELECT user_id, {r('coalesce(hurst, 0.5) AS hurst')} FROM (SELECT DISTINCT user_id FROM b) LEFT JOIN hu USING (user_id)", "scored")
def _(v):
    return bursts.hurst_rs(bursts.bin_counts(_trace(v), "user_id", "h", 6.0), "user_id", "bin", "n")


# -- detectors

_Z = ", ".join(f"avg({c}) AS m{i}, greatest(stddev_pop({c}), 1e-8) AS s{i}" for i, c in enumerate(COLS))
_ZS = "sqrt((" + " + ".join(f"pow((f{i} - m{i}) / s{i}, 2)" for i in range(4)) + ") / 4)"
_KS = "(" + " + ".join(f"pow(f{i} - m{i}, 2) / (1 + greatest(s{i} * s{i}, 1e-8))" for i in range(4)) + ") / 4"


def _scored_sql(expr: str) -> str:
    return f"{_FIT}, st AS (SELECT {_Z} FROM fit), th AS (SELECT quantile_cont({expr}, 0.95) AS t, avg({expr}) AS mu, stddev_pop({expr}) AS sd FROM fit, st), z AS (SELECT id, y, cls, {expr} AS score, CASE WHEN {expr} >= t THEN 1 ELSE 0 END AS flag, t, mu, sd FROM test, st, th)"


@add("zscore_detector", f", {_scored_sql(_ZS)} SELECT id, {r('score', 'greatest(0, least(1, score / t / 2)) AS trust')}, flag, 4 AS width FROM z", "flows")
def _(v):
    return detectors.zscore_detector(_fit(v), _test(v), COLS).select("id", "score", "flag", "trust", F.size("embedding").alias("width"))


@add("kalman_frozen_nis", f", {_scored_sql(_KS)}, o AS (SELECT *, 1 / (1 + exp(-greatest(-30, least(30, 0.5 * (score - mu) / (sd + 1e-8))))) AS p FROM z) SELECT id, {r('score', 'CASE WHEN flag = 1 THEN p ELSE 1 - p END AS trust')}, flag, 4 AS width FROM o", "flows")
def _(v):
    return detectors.kalman_frozen_nis(_fit(v), _test(v), COLS).select("id", "score", "flag", "trust", F.size("embedding").alias("width"))


@add("wrap_model", f", {_scored_sql('(f0 / 50 + 10 * f3)')}, o AS (SELECT *, 1 / (1 + exp(-greatest(-30, least(30, (score - mu) / (sd + 1e-8))))) AS p FROM z) SELECT id, {r('score', 'CASE WHEN flag = 1 THEN p ELSE 1 - p END AS trust')}, flag, 4 AS width FROM o", "flows")
def _(v):
    linear = lambda x: x[:, 0] / 50 + 10 * x[:, 3]
    return detectors.wrap_model(lambda: linear, _fit(v), _test(v), COLS, load=True).select("id", "score", "flag", "trust", F.size("embedding").alias("width"))


@add("null_detector", f"SELECT id, {r('0 AS score')}, 0 AS flag, {r('0.5 AS trust')} FROM flows", "flows")
def _(v):
    return detectors.null_detector(None, v("flows")).select("id", "score", "flag", "trust")


_NULL = f"{_FIT}, z AS (SELECT id, y, cls, 0.0::DOUBLE AS score, 0 AS flag FROM test)"


def _compared(name: str, scored: str) -> str:
    return f"SELECT '{name}' AS detector, * FROM ({'WITH ' + scored}, c AS (SELECT {_rates('flag = 1')} FROM z), g AS (SELECT score AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM z GROUP BY 1), w AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS up, sum(neg) OVER (ORDER BY s DESC) AS un, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g), au AS (SELECT sum(neg * (up - pos / 2)) / any_value(p * n) AS roc_auc, sum(pos * up / (up + un)) / any_value(p) AS pr_auc FROM w) SELECT tp, fp, fn, tn, {_BINARY}, {r('roc_auc', 'pr_auc')} FROM c, au)"


@add("detector_comparison", f"{_compared('zscore', _scored_sql(_ZS))} UNION ALL {_compared('kalman_frozen', _scored_sql(_KS))} UNION ALL {_compared('null', _NULL)}", "flows")
def _(v):
    return detectors.detector_comparison(_fit(v), _test(v), COLS, names=("zscore", "kalman_frozen", "null"))


@add("detector_comparison_all", None)
def _(v):
    return detectors.detector_comparison(_fit(v), _test(v), COLS)


def _class_rates(name: str, scored: str) -> str:
    return f"SELECT '{name}' AS detector, cls, count(*) AS n, sum(z.flag)::BIGINT AS alarms, {r('avg(z.flag) AS rate')} FROM ({'WITH ' + scored} SELECT * FROM z) z GROUP BY cls"


@add("detector_class_rates", f"{_class_rates('zscore', _scored_sql(_ZS))} UNION ALL {_class_rates('kalman_frozen', _scored_sql(_KS))} UNION ALL {_class_rates('null', _NULL)}", "flows")
def _(v):
    return detectors.class_rates(detectors.scored_by_all(_fit(v), _test(v), COLS, ["cls"], names=("zscore", "kalman_frozen", "null")))


@add("validate_detector_output", "SELECT 0::BIGINT AS bad_score, 0::BIGINT AS bad_flag, 0::BIGINT AS bad_trust, count(*) FILTER ((score >= 60) <> (flag = 1)) AS flag_differs FROM scored", "scored")
def _(v):
    return metrics.validate_detector_output(v("scored").withColumn("trust", F.lit(0.5)), 60.0)


@add("calibrate_residual_threshold", f"SELECT {r('greatest(quantile_cont(score, 0.995), avg(score) + 3 * stddev_pop(score)) AS threshold')} FROM scored", "scored")
def _(v):
    return detectors.calibrate_residual_threshold(v("scored"), "score")


@add("kmeans_assign", f"SELECT id, CASE WHEN pow(f0 - 10, 2) + pow(f2 - 0, 2) <= pow(f0 - 40, 2) + pow(f2 - 0.1, 2) THEN 0 ELSE 1 END AS cluster, {r('least(pow(f0 - 10, 2) + pow(f2 - 0, 2), pow(f0 - 40, 2) + pow(f2 - 0.1, 2)) AS dist')} FROM flows", "flows")
def _(v):
    return detectors.kmeans_assign(v("flows").select("id", F.array("f0", "f2").alias("x")), "x", [[10, 0], [40, 0.1]]).select("id", "cluster", "dist")


@add("kmeans_summary", f"SELECT cluster, count(*) AS n, {r('sum(dist) / 1000 AS inertia')} FROM (SELECT CASE WHEN pow(f0 - 10, 2) + pow(f2 - 0, 2) <= pow(f0 - 40, 2) + pow(f2 - 0.1, 2) THEN 0 ELSE 1 END AS cluster, least(pow(f0 - 10, 2) + pow(f2 - 0, 2), pow(f0 - 40, 2) + pow(f2 - 0.1, 2)) AS dist FROM flows) GROUP BY cluster", "flows")
def _(v):
    a = detectors.kmeans_assign(v("flows").select("id", F.array("f0", "f2").alias("x")), "x", [[10, 0], [40, 0.1]])
    return detectors.kmeans_summary(a).withColumn("inertia", F.col("inertia") / 1000)


@add("isolation_forest", None)
def _(v):
    return detectors.isolation_forest(_fit(v), _test(v), COLS, id_col="id").select("id", "score", "flag", "trust", F.size("embedding").alias("width"))


EMA_SQL = f""", o AS (SELECT id, user_id, score, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS k FROM scored),
    e AS (SELECT * FROM (WITH RECURSIVE w AS (SELECT id, user_id, k, 50.0::DOUBLE AS b, score FROM o WHERE k = 1 UNION ALL SELECT o.id, o.user_id, o.k, 0.99 * w.b + 0.01 * w.score, o.score FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1) SELECT * FROM w))
    SELECT id, {r('abs(score - b) AS score')} FROM e"""


@add("ema_baseline_score", EMA_SQL, "scored")
def _(v):
    return detectors.ema_baseline_score(v("scored"), "user_id", ["ts", "id"], ["score"], {"score": 50.0}).select("id", "score")


TRUST_SQL = f", {r('CASE WHEN flag = 1 THEN h ELSE 1 - h END AS trust')}"


def _kalman_sql(follow: str, growth: float) -> str:
    """The filter's recursion over each user's rows: x and p before row k; follow is what an innovation adds besides the gain."""
    ahead = f"({growth} * w.p + 1e-6)"
    score = f"(w.score - w.x) * (w.score - w.x) / ({ahead} + 400)"
    flag = f"CASE WHEN w.k > 20 AND {score} >= 4 THEN 1 ELSE 0 END"
    return f""", o AS (SELECT id, user_id, score, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS k FROM scored),
    e AS (SELECT * FROM (WITH RECURSIVE w AS (SELECT id, user_id, k, 50.0::DOUBLE AS x, 1.0::DOUBLE AS p, score FROM o WHERE k = 1
        UNION ALL SELECT o.id, o.user_id, o.k, w.x + ({ahead} / ({ahead} + 400) + {follow.format(flag=flag)}) * (w.score - w.x), (1 - {ahead} / ({ahead} + 400)) * {ahead}, o.score FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1) SELECT * FROM w)),
    f AS (SELECT id, {score} AS score, {flag} AS flag FROM e w), g AS (SELECT *, 1 / (1 + exp(-greatest(-30, least(30, 0.5 * (score - 1) / sqrt(2.0))))) AS h FROM f)
    SELECT id, {r('score')}, flag{TRUST_SQL}, 4 AS width FROM g"""


def _kalman(v, **options):
    found = detectors.kalman_by_key(v("scored"), "user_id", ["ts", "id"], ["score"], [50.0], [400.0], 4.0, **options)
    return found.select("id", "score", "flag", "trust", F.size("embedding").alias("width"))


KALMAN_SQL = _kalman_sql("CASE WHEN {flag} = 1 THEN 0.0005 ELSE 0.01 END", 1.0)


@add("kalman_by_key", KALMAN_SQL, "scored")
def _(v):
    return _kalman(v)


@add("kalman_by_key_frozen", _kalman_sql("0", 1.0), "scored")
def _(v):
    return _kalman(v, mode="frozen")


@add("kalman_by_key_forget", _kalman_sql("0", 1.0201), "scored")
def _(v):
    return _kalman(v, mode="forget", forgetting=1.01)


@add("pattern_cache", None)
def _(v):
    s = v("scored").withColumn("x", F.array("score", F.col("cls") * 10.0, F.lit(1.0)))
    return detectors.pattern_cache(s, "user_id", ["ts", "id"], "x").drop("user_id", "ts")
