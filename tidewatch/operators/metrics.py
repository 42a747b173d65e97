"""Threshold metrics, confusion tables, breakdowns and reports: conditional sums by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import _same, prefix_sums, quantiles, stored


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def binary_metrics(df: DataFrame, y: str, score: str, thr: float | Column, by: list[str] | None = None) -> DataFrame:
    """Counts and rates at a threshold (score >= thr alarms); precision at a prior is 1 without alarms."""
    hit, pos = F.col(score) >= thr, F.col(y) == 1
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    c = df.groupBy(*(by or [])).agg(n(hit & pos).alias("tp"), n(hit & ~pos).alias("fp"), n(~hit & pos).alias("fn"), n(~hit & ~pos).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    recall, fpr, precision = _share(tp, tp + fn), _share(fp, fp + tn), _share(tp, tp + fp)
    at = lambda r: F.when(tp + fp == 0, 1.0).otherwise(_share(r * recall, r * recall + (1 - r) * fpr))
    return c.select(
        *(by or []), "tp", "fp", "fn", "tn",
        precision.alias("precision"), recall.alias("recall"), _share(2 * precision * recall, precision + recall).alias("f1"),
        _share(tp + tn, tp + fp + fn + tn).alias("accuracy"), fpr.alias("fpr"), (1 - fpr).alias("specificity"),
        ((recall + 1 - fpr) / 2).alias("balanced_accuracy"), (1000 * fpr).alias("fp_per_1000"),
        at(0.01).alias("precision_at_1pct"), at(0.001).alias("precision_at_01pct"),
    )


def confusion_matrix(df: DataFrame, y: str, p: str, n_classes: int) -> DataFrame:
    """(y, p, n) for every pair of classes, zeros filled."""
    spark = df.sparkSession
    ids = spark.range(n_classes * n_classes).select((F.col("id") / n_classes).cast("int").alias("y"), (F.col("id") % n_classes).cast("int").alias("p"))
    counts = df.groupBy(F.col(y).cast("int").alias("y"), F.col(p).cast("int").alias("p")).agg(F.count("*").alias("n"))
    return ids.join(counts, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def classification_report(cm: DataFrame) -> DataFrame:
    """(cls, precision, recall, f1, support) of each class of a confusion matrix; 0 where undefined."""
    each = cm.groupBy().agg(F.collect_list(F.struct("y", "p", "n")).alias("m")).select(F.explode(F.array_distinct(F.transform("m", lambda x: x["y"]))).alias("cls"), "m")
    total = lambda f: F.aggregate(F.filter("m", f), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    tp = total(lambda x: (x["y"] == F.col("cls")) & (x["p"] == F.col("cls")))
    pred, support = total(lambda x: x["p"] == F.col("cls")), total(lambda x: x["y"] == F.col("cls"))
    out = each.select("cls", tp.alias("tp"), pred.alias("pred"), support.alias("support"))
    precision, recall = _share(F.col("tp"), F.col("pred")), _share(F.col("tp"), F.col("support"))
    return out.select("cls", precision.alias("precision"), recall.alias("recall"), _share(2 * precision * recall, precision + recall).alias("f1"), "support")


def report_summary(cm: DataFrame, include_benign: bool = False) -> DataFrame:
    """accuracy, macro and weighted F1, Cohen's kappa, detection and false-alarm rate of a confusion matrix."""
    r = classification_report(cm)
    macro = r.where(F.lit(include_benign) | (F.col("cls") != 0)).agg(F.avg("f1").alias("macro_f1"))
    weighted = r.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    when = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    t = cm.agg(F.sum("n").alias("all"), when(F.col("y") == F.col("p")).alias("right"), when((F.col("y") > 0) & (F.col("p") > 0)).alias("hit"), when(F.col("y") > 0).alias("attacks"), when((F.col("y") == 0) & (F.col("p") > 0)).alias("false"), when(F.col("y") == 0).alias("benign"))
    margins = cm.groupBy("y").agg(F.sum("n").alias("a")).join(cm.groupBy(F.col("p").alias("y")).agg(F.sum("n").alias("b")), "y").agg(F.sum(F.col("a") * F.col("b")).alias("chance"))
    x = t.crossJoin(margins).crossJoin(macro).crossJoin(weighted)
    po, pe = F.col("right") / F.col("all"), F.col("chance") / (F.col("all") * F.col("all"))
    return x.select(po.alias("accuracy"), "macro_f1", "weighted_f1", F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(0.0).alias("kappa"), _share(F.col("hit"), F.col("attacks")).alias("detection_rate"), _share(F.col("false"), F.col("benign")).alias("false_alarm_rate"))


def class_distribution(df: DataFrame, keys: list[str]) -> DataFrame:
    """Row counts by keys with totals: a null key is a total, level the number of keys summed over (as bits)."""
    return df.cube(*keys).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def merge_rare_classes(df: DataFrame, y: str, min_rows: int = 200, other: str = "Other", benign: str = "BENIGN") -> tuple[DataFrame, DataFrame]:
    """(df with merged and class_idx, mapping): attack classes under min_rows become ``other``; indexes are dense, benign 0.

    Rows without a label are a class of their own, the last one, and rare or not as others; every row stays. Any number of classes: they are
    numbered over range partitions.
    """
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    rare = ~F.col(y).eqNullSafe(F.lit(benign)) & (F.col("n") < min_rows)
    mapping = stored(counts.withColumn("merged", F.when(rare, F.lit(other)).otherwise(F.col(y))))
    rank = F.when(F.col("merged") == benign, 0).when(F.col("merged") == other, 2).when(F.col("merged").isNull(), 3).otherwise(1)
    named = mapping.select("merged").distinct().withColumn("_rank", rank).withColumn("_one", F.lit(1).cast("long"))
    named = prefix_sums(named, ["_rank", "merged"], ["_one"]).select("merged", (F.col("cum__one") - 1).cast("int").alias("class_idx"))
    mapping = mapping.alias("a").join(named.alias("b"), _same(["merged"], "a", "b")).select("a.*", "b.class_idx")
    found = mapping.select(F.col(y).alias("_y"), "merged", "class_idx")
    return df.join(found, F.col(y).eqNullSafe(F.col("_y"))).drop("_y"), mapping


def class_detection_rate(df: DataFrame, y: str, flag: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), y).agg(F.count("*").alias("n"), F.sum(F.col(flag)).cast("long").alias("alarms"), F.avg(flag).alias("rate"))


def daily_breakdown(df: DataFrame, day: str, y: str, score: str, flag: str) -> DataFrame:
    """Per day: rows, share of attacks, rates, and median, 95 % quantile and mean score of benign and attack rows."""
    benign, attack = F.when(F.col(y) == 0, F.col(score)), F.when(F.col(y) == 1, F.col(score))
    stats = [F.avg(c).alias(f"{n}_mean") for n, c in (("benign", benign), ("attack", attack))]
    out = df.groupBy(day).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("attack_ratio"), F.avg(F.when(F.col(y) == 1, F.col(flag))).alias("detection_rate"), F.avg(F.when(F.col(y) == 0, F.col(flag))).alias("fpr"), *stats)
    for name, c in (("benign", benign), ("attack", attack)):
        q = quantiles(df.select(F.col(day).alias("_day"), c.alias("_s")), "_s", [0.5, 0.95], ["_day"]).withColumnsRenamed({"q0": f"{name}_median", "q1": f"{name}_p95"})
        out = out.join(q, F.col(day).eqNullSafe(F.col("_day")), "left").drop("_day")
    return out


def daily_drift(df: DataFrame, fit_df: DataFrame, day: str, y: str, score: str, thr: float) -> DataFrame:
    """Per day: benign mean score, its z against the fit rows, share of benign rows at or above thr."""
    fit = fit_df.agg(F.avg(score).alias("m"), F.stddev_pop(score).alias("s")).first()
    benign = df.where(F.col(y) == 0)
    mean = F.avg(score)
    return benign.groupBy(day).agg(mean.alias("benign_mean"), ((mean - fit.m) / (fit.s or 1.0)).alias("z"), F.avg((F.col(score) >= thr).cast("double")).alias("above"))


def daily_recalibration(df: DataFrame, day: str, y: str, score: str, alpha: float = 0.05, min_benign: int = 50) -> DataFrame:
    """Per day with enough benign rows: its own benign quantile threshold, and rates with it."""
    benign = df.where(F.col(y) == 0)
    enough = benign.groupBy(day).agg(F.count("*").alias("benign")).where(F.col("benign") >= min_benign)
    thresholds = quantiles(benign, score, [1 - alpha], [day]).withColumnRenamed("q0", "threshold").join(enough, day)
    joined = join_daily_threshold(df, thresholds, day)
    return joined.groupBy(day, "threshold", "benign").agg(F.avg(F.when(F.col(y) == 0, (F.col(score) >= F.col("threshold")).cast("double"))).alias("fpr"), F.avg(F.when(F.col(y) == 1, (F.col(score) >= F.col("threshold")).cast("double"))).alias("detection_rate"))


def join_daily_threshold(scored: DataFrame, thresholds: DataFrame, day: str) -> DataFrame:
    return scored.join(thresholds, day)  # Spark broadcasts the days while they are few


def class_evidence(df: DataFrame, y: str, score: str, flag: str, thr: float) -> DataFrame:
    """Per class: alarm rate, median and 95 % quantile of the score, and the median over the threshold."""
    q = quantiles(df.select(F.col(y).alias("_y"), score), score, [0.5, 0.95], ["_y"])
    rates = df.groupBy(y).agg(F.avg(flag).alias("alarm_rate")).join(q, F.col(y).eqNullSafe(F.col("_y")))
    return rates.select(y, "alarm_rate", F.col("q0").alias("median"), F.col("q1").alias("p95"), (F.col("q0") / thr).alias("separation"))


def evidence_spread(evidence: DataFrame, median: str = "median", eps: float = 1e-9) -> DataFrame:
    """(spread, classes): how far apart the classes' median scores lie, over their own median; 0 for one class. One row for each class comes in, as of class_evidence."""
    m = F.col(median)
    spread = (F.max(m) - F.min(m)) / (F.abs(F.percentile(m, 0.5)) + eps)
    return evidence.agg(F.when(F.count(m) > 1, spread).otherwise(0.0).alias("spread"), F.count(m).alias("classes"))


def failure_decomposition(df: DataFrame, y: str, p: str, flag: str, by: list[str] | None = None) -> DataFrame:
    """Attack rows by cause: alerted or missed, class right or wrong; the four sum to n_attack."""
    a, hit, right = F.col(y) > 0, F.col(flag) == 1, F.col(p) == F.col(y)
    n = lambda c: F.sum((a & c).cast("long"))
    return df.groupBy(*(by or [])).agg(n(hit & right).alias("alerted_right"), n(hit & ~right).alias("alerted_wrong"), n(~hit & right).alias("missed_right"), n(~hit & ~right).alias("missed_wrong"), F.sum(a.cast("long")).alias("n_attack"))


def policy_report(decisions: DataFrame, by: list[str], y: str = "y", p: str = "pred", flag: str = "flag", collapsed: float = 0.8) -> DataFrame:
    """Accuracy, success on attacks, accuracy when alerted, alarm rate and the share of the commonest prediction."""
    right = (F.col(p) == F.col(y)).cast("double")
    base = decisions.groupBy(*by).agg(F.avg(right).alias("accuracy"), F.avg(F.when(F.col(y) > 0, right)).alias("attack_success"), F.avg(F.when(F.col(flag) == 1, right)).alias("alerted_accuracy"), F.avg(F.col(flag).cast("double")).alias("alarm_rate"), F.count("*").alias("n"))
    share = decisions.groupBy(*by, p).agg(F.count("*").alias("k")).groupBy(*by).agg(F.max("k").alias("k"))
    out = base.join(share, by).withColumn("majority_share", F.col("k") / F.col("n")).drop("k")
    return out.withColumn("collapsed", F.col("majority_share") > collapsed)


def agent_report(decisions: DataFrame, agent: str = "agent", y: str = "y", p: str = "pred", eps: float = 1e-9) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    c = decisions.groupBy(agent).agg(F.avg((F.col(p) == F.col(y)).cast("double")).alias("accuracy"), n((F.col(p) > 0) & (F.col(y) > 0)).alias("tp"), n((F.col(p) > 0) & (F.col(y) == 0)).alias("fp"), n((F.col(p) == 0) & (F.col(y) > 0)).alias("fn"), F.avg((F.col(p) > 0).cast("double")).alias("flag_rate"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp") + eps), F.col("tp") / (F.col("tp") + F.col("fn") + eps)
    return c.select(agent, "accuracy", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + eps)).alias("f1"), "flag_rate")


def policy_classes(decisions: DataFrame, by: list[str], y: str = "y", p: str = "pred") -> DataFrame:
    """(by, class, prediction, n, share): how each policy's predictions fall for rows of each class."""
    n = decisions.groupBy(*by, y, p).agg(F.count("*").alias("n"))
    totals = decisions.groupBy(*by, y).agg(F.count("*").alias("_total"))
    return n.join(totals, [*by, y]).select(*by, y, p, "n", (F.col("n") / F.col("_total")).alias("share"))


def detector_row(decisions: DataFrame, id_col: str = "id", y: str = "y", flag: str = "flag", eps: float = 1e-9) -> DataFrame:
    """What agent_report gives of an agent, for the detector's own flag (binary accuracy), over the rows that the agents decided, each once."""
    rows = decisions.groupBy(id_col).agg(F.max(y).alias("y"), F.max(flag).alias("f"))
    n = lambda c: F.sum(c.cast("long"))
    hit, attack = F.col("f") == 1, F.col("y") > 0
    c = rows.agg(F.avg((hit == attack).cast("double")).alias("accuracy"), n(hit & attack).alias("tp"), n(hit & ~attack).alias("fp"), n(~hit & attack).alias("fn"), F.avg(hit.cast("double")).alias("flag_rate"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp") + eps), F.col("tp") / (F.col("tp") + F.col("fn") + eps)
    return c.select(F.lit("detector").alias("name"), "accuracy", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + eps)).alias("f1"), "flag_rate")


def recalibration_summary(df: DataFrame, day: str, y: str, score: str, thr: float, alpha: float = 0.05, min_benign: int = 50) -> DataFrame:
    """One row: rates over all days that have an own threshold (as daily_recalibration), with it and with thr, their differences, and the largest over the smallest threshold."""
    own = daily_recalibration(df, day, y, score, alpha, min_benign).select(F.col(day).alias("_day"), "threshold")
    rows = df.join(own, F.col(day) == F.col("_day"))
    rate = lambda at, k: F.avg(F.when(F.col(y) == k, (F.col(score) >= at).cast("double")))
    c = rows.agg(F.max("threshold").alias("high"), F.min("threshold").alias("low"), rate(F.col("threshold"), 0).alias("fpr"), rate(F.col("threshold"), 1).alias("detection_rate"), rate(F.lit(thr), 0).alias("g0"), rate(F.lit(thr), 1).alias("g1"))
    return c.select("fpr", "detection_rate", (F.col("fpr") - F.col("g0")).alias("fpr_change"), (F.col("detection_rate") - F.col("g1")).alias("detection_change"), (F.col("high") / F.col("low")).alias("threshold_ratio"))


def segment_summary(fused: DataFrame, segment: str, label: str = "label", alarm: str = "alarm", benign: str = "BENIGN") -> DataFrame:
    """One row over all segments: detection and false alarm rate, accuracy of the alarm, and the share of attack rows whose label names their segment."""
    attack, hit = F.col(segment) != benign, F.col(alarm) == 1
    rate = lambda c, of: F.avg(F.when(of, c.cast("double")))
    return fused.agg(rate(hit, attack).alias("detection_rate"), rate(hit, ~attack).alias("false_alarm_rate"), F.avg((hit == attack).cast("double")).alias("accuracy"), rate(F.col(label).contains(F.col(segment)), attack).alias("label_match"))


def leaderboard(metrics: DataFrame, higher_is_better: dict[str, bool], by: tuple[str, ...] = ()) -> DataFrame:
    """(metric, by, winner, runner_up) of (detector, metric, value and the columns ``by``, as an attack class); ties by name, a null or NaN value wins nothing."""
    up = F.element_at(F.create_map(*[x for k, v in higher_is_better.items() for x in (F.lit(k), F.lit(v))]), F.col("metric"))
    keys = ["metric", *by]
    known = metrics.where(F.col("value").isNotNull() & ~F.isnan("value"))
    ranked = known.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(up, -F.col("value")).otherwise(F.col("value")), "detector")))
    return ranked.where("r <= 2").groupBy(*keys).agg(F.max(F.when(F.col("r") == 1, F.col("detector"))).alias("winner"), F.max(F.when(F.col("r") == 2, F.col("detector"))).alias("runner_up"))


def majority_vote(df: DataFrame, id_col: str, vote: str) -> DataFrame:
    """(id, winner): the commonest vote; on a tie the smallest class that isn't benign (0)."""
    counts = df.groupBy(id_col, vote).agg(F.count("*").alias("k"))
    best = F.min(F.struct((-F.col("k")).alias("k"), (F.col(vote) == 0).alias("benign"), F.col(vote).alias("winner")))
    return counts.groupBy(id_col).agg(best.alias("b")).select(id_col, "b.winner")


def validate_detector_output(scored: DataFrame, thr: float, embed_dim: int | None = None) -> DataFrame:
    """One row of violation counts of the output contract."""
    bad = lambda c: F.sum(F.coalesce(c, F.lit(True)).cast("long"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    checks = [bad(~finite("score")).alias("bad_score"), bad(~F.col("flag").isin(0, 1)).alias("bad_flag"), bad(~F.col("trust").between(0, 1)).alias("bad_trust"), bad(F.col("flag") != (F.col("score") >= thr).cast("int")).alias("flag_differs")]
    if embed_dim is not None:
        checks.append(bad(F.size("embedding") != embed_dim).alias("bad_embedding"))
    return scored.agg(*checks)


def score_histogram(df: DataFrame, score: str, y: str, bins: int = 60) -> DataFrame:
    """(y, bin, n, density) with equal bins over the range of all scores; the last edge is closed."""
    lo, hi = df.agg(F.min(score), F.max(score)).first()
    width = ((hi - lo) / bins if hi is not None and hi > lo else 1.0) or 1.0
    at = F.least(F.lit(bins - 1), F.floor((F.col(score) - F.lit(lo)) / width)).cast("int")
    counts = df.where(F.col(score).isNotNull()).groupBy(y, at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(y)) / width)


def segment_rates(fused: DataFrame, layers: dict[str, str], segment: str = "segment") -> DataFrame:
    """(layer, segment, rate, n): alarm rate per layer and scenario segment; segment_summary has the rates over all."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), F.col(c).cast("double").alias("alarm")) for k, c in layers.items()]))
    return fused.select(segment, each.alias("x")).groupBy("x.layer", segment).agg(F.avg("x.alarm").alias("rate"), F.count("*").alias("n"))


def reconcile_metrics(reported: DataFrame, actual: DataFrame, tol: float = 5e-5) -> DataFrame:
    """Metrics that differ by more than tol, or stand on one side only."""
    j = reported.select("metric", F.col("value").alias("reported")).join(actual.select("metric", F.col("value").alias("actual")), "metric", "full_outer")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("reported").isNull(), "unreported").when(F.abs(F.col("reported") - F.col("actual")) > tol, "differs")
    return j.withColumn("status", status).where("status is not null")


def compare_runs(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    j = a.select(*on, F.col("value").alias("a")).join(b.select(*on, F.col("value").alias("b")), on)
    return j.withColumn("delta", F.col("b") - F.col("a"))
