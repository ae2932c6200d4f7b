"""Catalogue: bootstrap, upsampling and configuration selection (V3, V4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.operators import metrics, ml, resample
from callscope.plans import views
from callscope.plans.oracle import auroc_ap_ctes, binary_metrics_cte, sql, u_sql
from callscope.plans.q_eval import smoothed_calls
from callscope.plans.registry import finish, query
from callscope.session import cut_lineage
from callscope.sources.tables import table

BOOT_METRICS = ["auroc", "auprc", "f1", "accuracy", "brier", "recall", "precision",
                "specificity", "npv", "fdr"]
BOOT_K, BOOT_RATE, SEED, THRESHOLD = 10, 0.75, 42, 0.5


def per_replicate(sample):
    m = metrics.evaluate(sample, threshold=THRESHOLD, group=["k"])
    return m.select("k", *[F.col("ap" if c == "auprc" else c).alias(c) for c in BOOT_METRICS])


def _summary_sql(src_ctes, src: str, threshold: str = str(THRESHOLD), group: tuple[str, ...] = ()) -> str:
    by = [*group, "k"]
    aggs = list(group)
    doubles = []
    for m in BOOT_METRICS:
        aggs += [f"AVG({m}) AS {m}_mean", f"stddev_pop({m}) AS {m}_std",
                 f"printf('%.3f', AVG({m})) || '±' || printf('%.3f', stddev_pop({m})) AS {m}_text"]
        doubles += [f"{m}_mean", f"{m}_std"]
    return sql(
        ["v3"] if "v3" in " ".join(src_ctes) or src == "s_ids" else ["v4"],
        src_ctes + [binary_metrics_cte(src, "bm", threshold, by), *auroc_ap_ctes(src, by),
                    f"per AS (SELECT bm.*, r.auroc, r.ap AS auprc FROM bm JOIN r_rank r USING ({', '.join(by)}))"],
        "SELECT " + ", ".join(aggs) + " FROM per" + (f" GROUP BY {', '.join(group)}" if group else ""), round6=doubles)


@query("bootstrap_rows", _summary_sql(
    [f"r AS (SELECT v4.*, t.k, row_number() OVER (PARTITION BY t.k ORDER BY {u_sql('t.k + 42', 'v4.id')}, v4.id) AS rk, "
     "COUNT(*) OVER (PARTITION BY t.k) AS n FROM v4, range(10) t(k))",
     "s AS (SELECT k, id, p, y FROM r WHERE rk <= round_even(n * 0.75, 0))"], "s"))
def bootstrap_rows(spark, sf):
    """J2 + E25/E26 on call scores: 10 x 75 % without replacement."""
    s = resample.bootstrap_rows(views.call_scores(spark, sf), "id", BOOT_K, BOOT_RATE, SEED)
    return finish(resample.bootstrap_summary(per_replicate(s), BOOT_METRICS))


_CALLS_SQL = [
    "sm AS (SELECT id, seq, y, AVG(p) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS p FROM v3)",
    "calls AS (SELECT id, MAX(p) AS p, MAX(y) AS y FROM sm GROUP BY id)",
    f"ix AS (SELECT id, row_number() OVER (ORDER BY {u_sql('42', 'id')}, id) - 1 AS idx, COUNT(*) OVER () AS n FROM calls)",
    f"dr AS (SELECT t.k, CAST(floor({u_sql('t.k + 42', 'ix.idx')} * ix.n) AS BIGINT) AS idx FROM ix, range(10) t(k) "
    "WHERE ix.idx < floor(ix.n * 0.75))",
]


@query("bootstrap_ids", _summary_sql(
    _CALLS_SQL + ["ids AS (SELECT DISTINCT dr.k, ix.id FROM dr JOIN ix ON dr.idx = ix.idx)",
                  "s_ids AS (SELECT ids.k, calls.id, calls.p, calls.y FROM ids JOIN calls ON ids.id = calls.id)"],
    "s_ids"))
def bootstrap_ids(spark, sf):
    """J3/D8 + E25: id-cluster bootstrap of pooled call scores (drawn with
    replacement, each drawn id scored once)."""
    calls = cut_lineage(smoothed_calls(spark, sf, 3, "max"))  # call-level stage table, read 3 times
    draws = resample.bootstrap_ids(calls, "id", BOOT_K, BOOT_RATE, SEED, distinct=True)
    s = draws.join(calls, "id")
    return finish(resample.bootstrap_summary(per_replicate(s), BOOT_METRICS))


#: stand-in models: a score of the call score, and the model's own operating threshold
_MODELS = [("plain", "p", 0.5), ("square", "p * p", 0.25), ("complement", "1.0 - p", 0.4)]


@query("bootstrap_by_model", _summary_sql(
    _CALLS_SQL + ["ids AS (SELECT DISTINCT dr.k, ix.id FROM dr JOIN ix ON dr.idx = ix.idx)",
                  "scored AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, id, {e} AS p, y, {t} AS t FROM calls" for m, e, t in _MODELS) + ")",
                  "s_m AS (SELECT scored.model, ids.k, scored.id, scored.p, scored.y, scored.t FROM ids JOIN scored ON ids.id = scored.id)"],
    "s_m", "t", ("model",)))
def bootstrap_by_model(spark, sf):
    """J3 + E25/E26 with a model dimension: every model scores the same drawn ids, is
    cut at its own threshold, and has its row of means and deviations."""
    calls = cut_lineage(smoothed_calls(spark, sf, 3, "max"))  # call-level stage table, read 3 times
    draws = resample.bootstrap_ids(calls, "id", BOOT_K, BOOT_RATE, SEED, distinct=True)
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).alias("p"), F.lit(t).alias("t")) for m, e, t in _MODELS])
    scored = calls.select("id", "y", F.inline(models))
    s = cut_lineage(draws.join(scored, "id"))  # read by both kinds of metrics
    by = ["model", "k"]
    per = (metrics.binary_metrics(s, threshold="t", group=by).join(metrics.auroc_ap(s, group=by), by)
           .withColumnRenamed("ap", "auprc"))
    return finish(resample.bootstrap_summary(per, BOOT_METRICS, ["model"]))


@query("inference_extract", sql(
    ["v4"],
    [f"ix AS (SELECT id, row_number() OVER (ORDER BY {u_sql('42', 'id')}, id) - 1 AS idx, COUNT(*) OVER () AS n FROM v4)",
     f"dr AS (SELECT t.k, CAST(floor({u_sql('t.k + 42', 'ix.idx')} * ix.n) AS BIGINT) AS idx FROM ix, range(10) t(k) "
     "WHERE ix.idx < floor(ix.n * 0.75))"],
    "SELECT CAST(dr.k AS INTEGER) AS k, ix.id, d.text AS data, CAST(CASE WHEN v4.y = 1 THEN 1 ELSE 0 END AS INTEGER) AS label "
    "FROM dr JOIN ix ON dr.idx = ix.idx JOIN documents d ON d.doc_id = ix.id JOIN v4 ON v4.id = ix.id"))
def inference_extract(spark, sf):
    """The drawn ids' text and binarised label, duplicates kept."""
    v4 = views.call_scores(spark, sf)
    draws = resample.bootstrap_ids(v4, "id", BOOT_K, BOOT_RATE, SEED, distinct=False)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("data"))
    lab = v4.select("id", F.when(F.col("y") == 1, 1).otherwise(0).cast("int").alias("label"))
    return draws.join(docs, "id").join(lab, "id").select("k", "id", "data", "label")


@query("upsample_by_id", sql(
    ["v3"],
    ["t AS (SELECT DISTINCT id FROM v3 WHERE y = 1)",
     f"r AS (SELECT id, row_number() OVER (ORDER BY {u_sql('42', 'id')}, id) AS rk, COUNT(*) OVER () AS n FROM t)",
     "ch AS (SELECT id FROM r WHERE rk <= floor(n * 0.35))"],
    "SELECT id, seq, y, false AS is_copy FROM v3 UNION ALL "
    "SELECT id, seq, y, true AS is_copy FROM v3 WHERE y = 1 AND id IN (SELECT id FROM ch)"))
def upsample_by_id(spark, sf):
    v3 = cut_lineage(views.segment_scores(spark, sf).select("id", "seq", "y"))  # stage table, read 3 times
    return resample.upsample(v3, "id", "y", rate=0.35, by_id=True, seed=SEED)


@query("upsample_by_row", sql(
    ["v3"],
    ["t AS (SELECT id, seq, y, CAST(id AS VARCHAR) || '_' || CAST(seq AS VARCHAR) AS s_id FROM v3 WHERE y = 1)",
     f"r AS (SELECT *, row_number() OVER (ORDER BY {u_sql('42', 's_id')}, s_id) AS rk, COUNT(*) OVER () AS n FROM t)"],
    "SELECT id, seq, y, false AS is_copy FROM v3 UNION ALL "
    "SELECT id, seq, y, true AS is_copy FROM r WHERE rk <= round_even(n * 0.35, 0)"))
def upsample_by_row(spark, sf):
    v3 = cut_lineage(views.segment_scores(spark, sf).select("id", "seq", "y")
                     .withColumn("s_id", F.concat_ws("_", "id", "seq")))  # stage table, read twice
    return resample.upsample(v3, "id", "y", rate=0.35, by_id=False, row_key="s_id", seed=SEED).drop("s_id")


@query("upsample_prevalence", sql(
    ["v3"],
    ["t AS (SELECT id, seq, y, CAST(id AS VARCHAR) || '_' || CAST(seq AS VARCHAR) AS s_id FROM v3 WHERE y = 1)",
     f"r AS (SELECT *, row_number() OVER (ORDER BY {u_sql('42', 's_id')}, s_id) AS rk, COUNT(*) OVER () AS n FROM t)",
     "a AS (SELECT COUNT(*) AS n, SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos FROM v3)",
     "b AS (SELECT COUNT(*) AS c FROM r WHERE rk <= round_even(n * 0.35, 0))"],
    "SELECT a.n + b.c AS n_rows, b.c AS n_copies, a.pos / a.n AS prevalence_before, (a.pos + b.c) / (a.n + b.c) AS prevalence FROM a, b",
    round6=["prevalence_before", "prevalence"]))
def upsample_prevalence(spark, sf):
    return finish(resample.upsample_prevalence(upsample_by_row(spark, sf), "y"))


# --- E27 K9 P4: configuration selection by per-call AUROC after smoothing ----------------------
_CONFIGS = [(0, "identity"), (1, "square"), (2, "complement")]


def _config_score(p):
    return (F.when(F.col("ordinal") == 0, p).when(F.col("ordinal") == 1, p * p)
            .otherwise(F.lit(1.0) - p))


@query("best_config", sql(
    ["v3"],
    ["c(ordinal, config) AS (VALUES " + ", ".join(f"({o}, '{n}')" for o, n in _CONFIGS) + ")",
     "sc AS (SELECT v3.id, v3.seq, v3.y, c.ordinal, c.config, CASE c.ordinal WHEN 0 THEN v3.p WHEN 1 THEN v3.p * v3.p "
     "ELSE 1.0 - v3.p END AS p FROM v3, c)",
     "sm AS (SELECT id, seq, y, ordinal, config, AVG(p) OVER (PARTITION BY ordinal, id ORDER BY seq "
     "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS p FROM sc)",
     "pooled AS (SELECT 'max' AS method, ordinal, config, id, MAX(p) AS p, MAX(y) AS y FROM sm GROUP BY ordinal, config, id "
     "UNION ALL SELECT 'average', ordinal, config, id, AVG(p), MAX(y) FROM sm GROUP BY ordinal, config, id)",
     *auroc_ap_ctes("pooled", ["method", "ordinal", "config"])],
    "SELECT method, config, CAST(ordinal AS INTEGER) AS ordinal, auroc FROM r_rank "
    "QUALIFY row_number() OVER (PARTITION BY method ORDER BY auroc DESC, ordinal) = 1", round6=["auroc"]))
def best_config(spark, sf):
    """Every configuration scores every segment; ``ml.select_best`` smooths and pools
    per call, evaluates all in one grouped job and keeps the first best."""
    v3 = views.segment_scores(spark, sf)
    cfg = spark.createDataFrame(_CONFIGS, "ordinal INT, config STRING")
    scored = v3.crossJoin(F.broadcast(cfg)).withColumn("p", _config_score(F.col("p"))).select("config", "ordinal", "id", "seq", "p")
    labels = v3.groupBy("id").agg(F.max("y").alias("y"))
    return finish(ml.select_best(scored, labels, window=3)[1])
