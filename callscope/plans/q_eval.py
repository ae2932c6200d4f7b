"""Catalogue: smoothing, pooling, hits and exact evaluation (V3, V4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions import fixed_values as FV
from callscope.operators import hits, labels, metrics, smoothing
from callscope.plans import views
from callscope.plans.oracle import (METRIC_DOUBLES, auroc_ap_ctes, binary_metrics_cte, div0,
                                    sql)
from callscope.plans.registry import finish, query

FLAGSHIP_THRESHOLD = 0.5
HIT_THRESHOLD = 0.85


def smoothed_calls(spark, sf, window=3, method="max"):
    """F2 -> E8 on V3: one pooled score and label per call."""
    v3 = views.segment_scores(spark, sf)
    sm = smoothing.moving_average(v3, window, ["p"])
    agg = F.max("p") if method == "max" else F.avg("p")
    return sm.groupBy("id").agg(agg.alias("p"), F.max("y").alias("y"))


# --- flagship -------------------------------------------------------------------
@query("flagship_call_metrics", sql(
    ["v3"],
    ["sm AS (SELECT id, seq, y, AVG(p) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS p FROM v3)",
     "calls AS (SELECT id, MAX(p) AS p, MAX(y) AS y FROM sm GROUP BY id)",
     binary_metrics_cte("calls", "bm", str(FLAGSHIP_THRESHOLD)),
     *auroc_ap_ctes("calls")],
    "SELECT bm.*, r.auroc, r.ap FROM bm, r_rank r",
    round6=METRIC_DOUBLES + ["auroc", "ap"]))
def flagship_call_metrics(spark, sf):
    """Segment scores -> trailing mean (w=3) -> call max -> threshold -> metrics."""
    calls = smoothed_calls(spark, sf, 3, "max")
    return finish(metrics.evaluate(calls, threshold=FLAGSHIP_THRESHOLD))


# --- F2 / E8 / E9 -----------------------------------------------------------------
@query("moving_average_w3", sql(
    ["v3"], [],
    "SELECT id, seq, p, AVG(p) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS p_ma FROM v3",
    round6=["p", "p_ma"]))
def moving_average_w3(spark, sf):
    v3 = views.segment_scores(spark, sf).select("id", "seq", "p")
    return finish(smoothing.moving_average(v3, 3, ["p"], suffix="_ma"))


@query("moving_average_w0", sql(["v3"], [], "SELECT id, seq, p AS p_ma FROM v3", round6=["p_ma"]))
def moving_average_w0(spark, sf):
    v3 = views.segment_scores(spark, sf).select("id", "seq", "p")
    return finish(smoothing.moving_average(v3, 0, ["p"], suffix="_ma").drop("p"))


@query("call_score_max", sql(["v3"], [], "SELECT id, MAX(p) AS p FROM v3 GROUP BY id", round6=["p"]))
def call_score_max(spark, sf):
    return finish(smoothing.call_score(views.segment_scores(spark, sf), "max"))


@query("call_score_mean", sql(["v3"], [], "SELECT id, AVG(p) AS p FROM v3 GROUP BY id", round6=["p"]))
def call_score_mean(spark, sf):
    return finish(smoothing.call_score(views.segment_scores(spark, sf), "average"))


@query("sample_unit_mean", sql(["v3"], [],
                               "SELECT id, AVG(p) AS p, AVG(label1) AS label1, AVG(y) AS y FROM v3 GROUP BY id",
                               round6=["p", "label1", "y"]))
def sample_unit_mean(spark, sf):
    return finish(smoothing.sample_unit_mean(views.segment_scores(spark, sf), ["p", "label1", "y"]))


# --- D1-D3, B14, B15 ----------------------------------------------------------------
@query("segment_scores_with_label", sql(
    ["v3"],
    ["lab AS (SELECT id, CAST(CASE WHEN MIN(label1) = 1 THEN 1 ELSE 0 END AS INTEGER) AS label FROM v3 GROUP BY id)"],
    f"SELECT v3.id, v3.seq, v3.p, CAST(v3.p >= {FLAGSHIP_THRESHOLD} AS INTEGER) AS seq_predicted_labels, lab.label "
    "FROM v3 JOIN lab ON v3.id = lab.id", round6=["p"]))
def segment_scores_with_label(spark, sf):
    v3 = views.segment_scores(spark, sf)
    seg = v3.select("id", "seq", "p",
                    labels.predict("p", FLAGSHIP_THRESHOLD).alias("seq_predicted_labels"))
    lab = v3.groupBy("id").agg(labels.binarise(F.min("label1")).alias("label"))
    return finish(seg.join(lab, "id", "inner"))


_MODELS = ["Logistic Regression", "XGBoost", "Gradient Boosting", "Random Forest", "Majority"]
_TKEY = ("2way", 120, 3, "max")


def _threshold_values_sql() -> str:
    rows = [f"('{m}', {t!r})" for m, t in FV.OPERATING_THRESHOLDS[_TKEY].items()]
    return "thr(model, threshold) AS (VALUES " + ", ".join(rows) + ")"


@query("threshold_lookup", sql(
    ["v3"],
    ["s AS (SELECT id, seq, p, y, (['" + "', '".join(_MODELS) + "'])[CAST(id % 5 AS INTEGER) + 1] AS model FROM v3)",
     "freq AS (SELECT AVG(CAST(y = 1 AS DOUBLE)) AS lf FROM v3)",
     _threshold_values_sql()],
    "SELECT s.id, s.seq, s.model, COALESCE(thr.threshold, freq.lf) AS threshold, "
    "CAST(s.p >= COALESCE(thr.threshold, freq.lf) AS INTEGER) AS pred "
    "FROM s LEFT JOIN thr ON s.model = thr.model CROSS JOIN freq",
    round6=["threshold"]))
def threshold_lookup(spark, sf):
    v3 = views.segment_scores(spark, sf)
    s = v3.withColumn("model", F.element_at(F.array(*[F.lit(m) for m in _MODELS]),
                                            (F.col("id") % 5 + 1).cast("int")))
    s = (s.withColumn("mode", F.lit(_TKEY[0])).withColumn("time_cut", F.lit(_TKEY[1]))
         .withColumn("window", F.lit(_TKEY[2])).withColumn("method", F.lit(_TKEY[3])))
    lf = metrics.label_frequency(v3, "y")
    s = s.crossJoin(F.broadcast(lf))  # one-row side
    out = labels.apply_thresholds(s, labels.threshold_table(spark),
                                  ["mode", "time_cut", "window", "method", "model"],
                                  fallback="label_frequency")
    return finish(out.select("id", "seq", "model", "threshold", "pred"))


# --- D6, E10, B16 -----------------------------------------------------------------------
@query("time_mapping", sql(
    ["v3", "v3t"], [],
    "SELECT v3.id, v3.seq, v3.p, v3t.start_ms AS starttime, v3t.end_ms AS endtime "
    "FROM v3 LEFT JOIN v3t ON v3.id = v3t.id AND v3.seq = v3t.seq", round6=["p"]))
def time_mapping(spark, sf):
    v3 = views.segment_scores(spark, sf).select("id", "seq", "p")
    return finish(hits.time_mapping(v3, views.segment_times(spark, sf)))


_FH_CTES = [
    f"seg AS (SELECT v3.id, v3.seq, v3.label1, CAST(v3.p >= {HIT_THRESHOLD} AS INTEGER) AS pred, "
    "row_number() OVER (PARTITION BY v3.id ORDER BY v3.seq) AS s_num, "
    "v3t.start_ms AS starttime, v3t.end_ms AS endtime FROM v3 LEFT JOIN v3t ON v3.id = v3t.id AND v3.seq = v3t.seq)",
    "agg AS (SELECT id, CAST(MAX(pred) AS INTEGER) AS predicted_labels, "
    "arg_min(s_num, seq) FILTER (WHERE pred = 1) AS h_num, "
    "arg_min_null(starttime, seq) FILTER (WHERE pred = 1) AS h_s, arg_min_null(endtime, seq) FILTER (WHERE pred = 1) AS h_e, "
    "arg_max_null(starttime, seq) AS l_s, arg_max_null(endtime, seq) AS l_e, arg_min(label1, seq) AS label1 "
    "FROM seg GROUP BY id)"]
_FH_SELECT = (
    "SELECT id, CAST(CASE WHEN predicted_labels = 1 THEN h_num ELSE -1 END AS INTEGER) AS s_num, predicted_labels, "
    "CAST(label1 AS INTEGER) AS label1, "
    "CASE WHEN predicted_labels = 1 AND label1 = 1 THEN 'TP' WHEN predicted_labels = 0 AND label1 = 1 THEN 'FN' "
    "WHEN predicted_labels = 1 AND label1 = 0 THEN 'FP' ELSE 'TN' END AS category, "
    "CASE WHEN predicted_labels = 1 THEN h_s ELSE l_s END AS starttime, "
    "CASE WHEN predicted_labels = 1 THEN h_e ELSE l_e END AS endtime FROM agg")


@query("first_hit_summary", sql(["v3", "v3t"], _FH_CTES, _FH_SELECT))
def first_hit_summary(spark, sf):
    v3 = views.segment_scores(spark, sf)
    seg = hits.time_mapping(v3.withColumn("pred", labels.predict("p", HIT_THRESHOLD)),
                            views.segment_times(spark, sf))
    return hits.first_hits(seg, pred="pred", label="label1", dense_seq=True)  # V3 seq is dense


# --- E13-E22 on V4 ----------------------------------------------------------------------------
@query("confusion_matrix", sql(
    ["v4"], [],
    "SELECT CAST(SUM(CASE WHEN p < 0.5 AND y <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
    "CAST(SUM(CASE WHEN p >= 0.5 AND y <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
    "CAST(SUM(CASE WHEN p < 0.5 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
    "CAST(SUM(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM v4"))
def confusion_matrix(spark, sf):
    v4 = views.call_scores(spark, sf).withColumn("pred", labels.predict("p", 0.5))
    return metrics.confusion(v4, "pred", "y")


@query("binary_metrics", sql(["v4"], [binary_metrics_cte("v4", "bm", "0.5")], "SELECT * FROM bm",
                             round6=METRIC_DOUBLES))
def binary_metrics(spark, sf):
    return finish(metrics.binary_metrics(views.call_scores(spark, sf), threshold=0.5))


@query("auroc_ap_exact", sql(["v4"], auroc_ap_ctes("v4"), "SELECT auroc, ap FROM r_rank",
                             round6=["auroc", "ap"]))
def auroc_ap_exact(spark, sf):
    return finish(metrics.auroc_ap(views.call_scores(spark, sf)))


@query("label_frequency", sql(["v4"], [], "SELECT AVG(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) AS label_frequency FROM v4",
                              round6=["label_frequency"]))
def label_frequency(spark, sf):
    return finish(metrics.label_frequency(views.call_scores(spark, sf)))


_CUM = auroc_ap_ctes("v4")[:3]


@query("roc_points", sql(
    ["v4"], _CUM + [
        "rk AS (SELECT *, LAG(tp) OVER (ORDER BY p DESC) AS tp0, LAG(fp) OVER (ORDER BY p DESC) AS fp0, "
        "LEAD(tp) OVER (ORDER BY p DESC) AS tp2, LEAD(fp) OVER (ORDER BY p DESC) AS fp2 FROM r_cum)"],
    'SELECT CAST(fp AS DOUBLE) / t.n_neg AS fpr, CAST(tp AS DOUBLE) / t.n_pos AS tpr, CAST(p AS DOUBLE) AS threshold '
    "FROM rk, r_tot t WHERE tp0 IS NULL OR tp2 IS NULL OR fp2 - 2 * fp + fp0 <> 0 OR tp2 - 2 * tp + tp0 <> 0 "
    "UNION ALL SELECT 0.0, 0.0, NULL", round6=["fpr", "tpr", "threshold"]))
def roc_points(spark, sf):
    return finish(metrics.roc_points(views.call_scores(spark, sf)))


@query("pr_points", sql(
    ["v4"], _CUM,
    'SELECT CAST(tp AS DOUBLE) / (tp + fp) AS precision, '
    'CASE WHEN t.n_pos = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / t.n_pos END AS recall, '
    "CAST(p AS DOUBLE) AS threshold FROM r_cum, r_tot t UNION ALL SELECT 1.0, 0.0, NULL",
    round6=["precision", "recall", "threshold"]))
def pr_points(spark, sf):
    return finish(metrics.pr_points(views.call_scores(spark, sf)))


def _sweep_sql(src: str, rnd: int, views_: list[str], extra: list[str]) -> str:
    step = repr(1.0 / 511)
    t = f"CAST(CASE WHEN g.j = 511 THEN 1.0 ELSE g.j * CAST({step} AS DOUBLE) END AS DOUBLE)"
    return sql(
        views_,
        extra + auroc_ap_ctes(src) + [
            "g AS (SELECT CAST(range AS INTEGER) AS j FROM range(512))",
            f"tp_fp AS (SELECT g.j, {t} AS thr, "
            f"CAST(SUM(CASE WHEN s.p >= {t} AND s.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
            f"CAST(SUM(CASE WHEN s.p >= {t} AND s.y <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp "
            f"FROM g CROSS JOIN {src} s GROUP BY g.j)",
            f"gl AS (SELECT SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pp, SUM(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS nn, "
            f"AVG(power(p - CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END, 2)) AS brier FROM {src})"],
        f"SELECT round_even(thr, {rnd}) AS \"THRESHOLD\", "
        f"round_even({div0('tp + (nn - fp)', 'pp + nn')}, {rnd}) AS \"TH_ACC\", "
        f"round_even(r.auroc, {rnd}) AS \"AUROC\", round_even(r.ap, {rnd}) AS \"AUPRC\", "
        f"round_even({div0('tp', 'pp')}, {rnd}) AS \"RECALL\", "
        f"round_even({div0('tp', 'tp + fp')}, {rnd}) AS \"PRECISION\", "
        f"round_even({div0('nn - fp', 'nn')}, {rnd}) AS \"SPECIFICITY\", "
        f"round_even({div0('2 * tp', '2 * tp + fp + (pp - tp)')}, {rnd}) AS \"F1\", "
        f"round_even(brier, {rnd}) AS \"BRIER\" FROM tp_fp, gl, r_rank r")


@query("threshold_sweep_512", _sweep_sql("v4", 4, ["v4"], []))
def threshold_sweep_512(spark, sf):
    return metrics.threshold_sweep(views.call_scores(spark, sf), n=FV.SWEEP_POINTS, round_sep=4)


@query("sample_unit_sweep", _sweep_sql(
    "su", 5, ["v3"], ["su AS (SELECT id, AVG(p) AS p, MAX(y) AS y FROM v3 GROUP BY id)"]))
def sample_unit_sweep(spark, sf):
    v3 = views.segment_scores(spark, sf)
    su = v3.groupBy("id").agg(F.avg("p").alias("p"), F.max("y").alias("y"))
    return metrics.threshold_sweep(su, n=FV.SWEEP_POINTS, round_sep=5)


@query("time_to_first_hit", sql(
    ["v3", "v3t"], _FH_CTES + [f"fh AS ({_FH_SELECT})",
                               "st AS (SELECT id, MIN(start_ms) AS call_start FROM v3t GROUP BY id)"],
    "SELECT fh.id, fh.s_num, fh.endtime - st.call_start AS elapsed_ms FROM fh LEFT JOIN st ON fh.id = st.id "
    "WHERE fh.s_num > 0"))
def time_to_first_hit(spark, sf):
    """Ms from the call's first utterance start to the end of the hit."""
    h = first_hit_summary(spark, sf).filter(F.col("s_num") > 0)
    start = views.segment_times(spark, sf).groupBy("id").agg(F.min("start_ms").alias("call_start"))
    return hits.time_to_hit(h.join(start, "id", "left"), F.col("call_start")).select("id", "s_num", "elapsed_ms")
