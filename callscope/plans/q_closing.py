"""Catalogue: the closing flow of a model run (V6 embeddings; see ``operators.closing``).

Winners are chosen on the valid calls, written down with the scaler, read again, and score
the test calls.  With models that are written down the whole flow is checked in SQL; the
fitted run searches the study's grids and is checked by its tests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from callscope.functions import fixed_values as FV
from callscope.operators import boosting, closing, forest, logistic, metrics, resample, scaling
from callscope.plans import views
from callscope.plans.oracle import METRIC_DOUBLES, auroc_ap_ctes, binary_metrics_cte, sql, u_sql
from callscope.plans.q_ml import (GBT_ITERS, LITERAL, LR_GRID, RF_TREES, SEG_PER_CALL, TREE_DEPTHS, WINDOW, literal_model, literal_path,
                                  literal_path_sql, literal_sql)
from callscope.plans.registry import finish, query
from callscope.session import cut_lineage, ensure_checkpoint_dir

#: The written-down families; the path has a threshold of its own, the trees have the label frequency.
PATH, TREES, PATH_THRESHOLD = "path", "trees", 0.75
ROUNDS, RATE, SEED = 10, 0.75, 42


def literal_families() -> list[closing.Family]:
    return [closing.Family(PATH, literal_path(2)), closing.Family(TREES, literal_model(), tuple(LITERAL["stages"]))]


def segments(spark, sf):
    """(segments with their split, (call, y) labels)."""
    seg = views.feature_vectors(spark, sf).select(
        F.floor(F.col("id") / SEG_PER_CALL).alias("id"), (F.col("id") % SEG_PER_CALL).alias("seq"), "features", "y")
    calls = cut_lineage(seg.groupBy("id").agg(F.max("y").alias("y")))
    split = cut_lineage(resample.stratified_split(calls, "id", "y", SEED).select("id", "split"))
    return seg.drop("y").join(split, "id"), calls


def run(spark, sf, make_families, thresholds, fallback=None):
    """(segment table, call table) of the winners, by way of what a run leaves on disk."""
    seg, calls = segments(spark, sf)
    train = seg.where("split = 'train'")
    scaler = cut_lineage(scaling.fit_scaler(scaling.to_long(train)))
    rows = cut_lineage(scaling.apply_to_vectors(seg, scaler))
    families = make_families(rows.where("split = 'train'").join(calls, "id").withColumn("label", F.col("y").cast("double")))
    winners = closing.select_winners(families, rows.where("split = 'valid'"), calls, WINDOW)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    closing.save_winners(winners, scaler, spark, folder)
    # as another job would: the test rows meet the scaler and the models that were written
    winners, scaler = closing.load_winners(spark, folder)
    test = scaling.apply_to_vectors(seg.where("split = 'test'"), scaler)
    judged = calls.join(seg.where("split = 'test'").select("id").distinct(), "id", "left_semi")
    frequency = metrics.label_frequency(judged).first()[0]  # one number
    table = cut_lineage(closing.segment_table(winners, test, judged, thresholds, 0.0 if frequency is None else frequency))
    return table, closing.call_table(table)


def literal_run(spark, sf):
    return run(spark, sf, lambda train: literal_families(), {(PATH, m): PATH_THRESHOLD for m in closing.METHODS})


def _from_z(statement: str) -> str:
    return statement.replace("FROM embeddings", "FROM z")


_CTES = [
    f"f AS (SELECT vec_id, vec_id // {SEG_PER_CALL} AS id, vec_id % {SEG_PER_CALL} AS seq, CAST(label < 3 AS INTEGER) AS y, embedding FROM embeddings)",
    "calls AS (SELECT id, MAX(y) AS y FROM f GROUP BY id)",
    f"r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {u_sql('42', 'id')}, id) AS rk, COUNT(*) OVER (PARTITION BY y) AS n FROM calls)",
    "sp AS (SELECT id, y, CASE WHEN rk <= ceil(n * 0.2) THEN 'test' WHEN rk <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.2) THEN 'valid' "
    "ELSE 'train' END AS split FROM r)",
    "lg AS (SELECT vec_id, id, unnest(generate_series(1, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM f)",
    "st AS (SELECT dim, AVG(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS std FROM lg JOIN sp USING (id) "
    "WHERE split = 'train' GROUP BY dim)",
    "z AS (SELECT vec_id, list((x - mean) / std ORDER BY dim) AS embedding FROM lg JOIN st USING (dim) GROUP BY vec_id)",
    f"sc AS (SELECT '{PATH}' AS model, * FROM ({_from_z(literal_path_sql(2))}) UNION ALL SELECT '{TREES}', * FROM ({_from_z(literal_sql())}))",
    "sg AS (SELECT model, config, ordinal, f.id, seq, split, sp.y, p FROM sc JOIN f ON sc.id = f.vec_id JOIN sp ON sp.id = f.id)",
    f"sm AS (SELECT model, config, ordinal, id, seq, split, y, AVG(p) OVER (PARTITION BY model, config, id ORDER BY seq "
    f"ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS p FROM sg)",
    "pooled AS (SELECT model, config, ordinal, 'max' AS method, id, round(MAX(p), 9) AS p, MAX(y) AS y FROM sm WHERE split = 'valid' GROUP BY ALL "
    "UNION ALL SELECT model, config, ordinal, 'average', id, round(AVG(p), 9), MAX(y) FROM sm WHERE split = 'valid' GROUP BY ALL)",
    *auroc_ap_ctes("pooled", ["model", "method", "config", "ordinal"], prefix="v"),
    "best AS (SELECT model, method, config FROM v_rank QUALIFY row_number() OVER (PARTITION BY model, method ORDER BY auroc DESC NULLS LAST, ordinal) = 1)",
    "lf AS (SELECT AVG(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) AS t FROM sp WHERE split = 'test')",
    f"seg_t AS (SELECT sm.model, best.method, CAST({WINDOW} AS INTEGER) AS \"window\", sm.config, CASE WHEN sm.model = '{PATH}' THEN {PATH_THRESHOLD} "
    "ELSE lf.t END AS threshold, id, seq, round(p, 9) AS p, y FROM sm JOIN best USING (model, config), lf WHERE split = 'test')",
    "call_t AS (SELECT model, method, \"window\", config, threshold, id, round(CASE WHEN method = 'max' THEN MAX(p) ELSE AVG(p) END, 9) AS p, "
    "MAX(y) AS y FROM seg_t GROUP BY model, method, \"window\", config, threshold, id)",
]
_CUT = "CAST(p >= threshold AS INTEGER) AS pred"

# the literal scorers round to 6 places for their own queries; here they do not
_CTES = [c.replace("round(1 / (1 + exp", "(1 / (1 + exp").replace(", 6) AS p", ") AS p") for c in _CTES]


@query("closing_segments", sql([], _CTES, f"SELECT *, {_CUT} FROM seg_t", round6=["threshold", "p"]))
def closing_segments(spark, sf):
    """The winners' smoothed test segments, each cut at its model's threshold."""
    return finish(literal_run(spark, sf)[0])


@query("closing_calls", sql([], _CTES, f"SELECT *, {_CUT} FROM call_t", round6=["threshold", "p"]))
def closing_calls(spark, sf):
    """The winners' test calls."""
    return finish(literal_run(spark, sf)[1])


_DRAWS = [
    "ids AS (SELECT DISTINCT id FROM call_t)",
    f"ix AS (SELECT id, row_number() OVER (ORDER BY {u_sql('42', 'id')}, id) - 1 AS idx, COUNT(*) OVER () AS n FROM ids)",
    f"dr AS (SELECT DISTINCT t.k, CAST(floor({u_sql('t.k + 42', 'ix.idx')} * ix.n) AS BIGINT) AS idx FROM ix, range({ROUNDS}) t(k) "
    f"WHERE ix.idx < floor(ix.n * {RATE}))",
    "drawn AS (SELECT CAST(dr.k AS INTEGER) AS k, call_t.* FROM dr JOIN ix USING (idx) JOIN call_t ON call_t.id = ix.id)",
    binary_metrics_cte("drawn", "bm", "threshold", ("model", "method", "k")),
    *auroc_ap_ctes("drawn", ["model", "method", "k"], prefix="d"),
]


@query("closing_bootstrap", sql(
    [], _CTES + _DRAWS, "SELECT bm.*, d.auroc, d.ap FROM bm JOIN d_rank d USING (model, method, k)", round6=METRIC_DOUBLES + ["auroc", "ap"]))
def closing_bootstrap(spark, sf):
    """Metrics of every model, method and draw of test calls."""
    return finish(closing.bootstrap(cut_lineage(literal_run(spark, sf)[1]), ROUNDS, RATE, SEED)[0])


def fitted_families(train) -> list[closing.Family]:
    """The four families of the study over their whole grids; both boosted ones grow together."""
    grids = [[make(d, max(GBT_ITERS)) for d in TREE_DEPTHS] for make in (boosting.newton_config, boosting.residual_config)]
    both = boosting.fit(train, [c for grid in grids for c in grid])
    newton, residual = both.only(range(len(grids[0]))), both.only(range(len(grids[0]), len(both.configs)))
    return [closing.Family("Logistic Regression", logistic.fit(train, LR_GRID)),
            closing.Family("XGBoost", newton, tuple(GBT_ITERS)),
            closing.Family("Gradient Boosting", residual, tuple(GBT_ITERS)),
            closing.Family("Random Forest", forest.fit(train, max(RF_TREES), max(TREE_DEPTHS)), tuple(RF_TREES), tuple(TREE_DEPTHS))]


@query("closing_fitted")
def closing_fitted(spark, sf):
    """The whole flow with fitted models: means and deviations of the bootstrap, a row for each
    family and pooling method, at the study's thresholds (two classes, 60 s, window 3)."""
    thresholds = {(model, m): t for m in closing.METHODS for model, t in FV.OPERATING_THRESHOLDS[("2way", 60, WINDOW, m)].items()}
    calls = run(spark, sf, fitted_families, thresholds)[1]
    return finish(closing.bootstrap(cut_lineage(calls), ROUNDS, RATE, SEED)[1])
