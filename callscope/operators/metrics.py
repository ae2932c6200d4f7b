"""Exact binary-classifier evaluation.

All metrics are computed as grouped aggregates so that model, configuration,
window, time cut or bootstrap replicate are just *group columns*: one job
evaluates all of them.  Ranking metrics use the tie-aware score table

    (group, p) -> pos, neg            (partial aggregation, map-side)

plus descending cumulative counts computed with the blocked running sum of
``plans.blocked`` (score blocks of 1/65536 of the unit interval), so one huge
model never sorts in a single task.  The score table is the only step that
reads the scored rows; it is checkpointed (``materialize=True``) so that its
several consumers never recompute the upstream pipeline.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.scalar import linspace_point
from callscope.plans import blocked
from callscope.session import cut_lineage

SCORE_BLOCKS = 1 << 16


def _div0(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0 (the sklearn zero_division=0 convention)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def _desc_block(p: str) -> Column:
    k = F.least(F.greatest(F.floor(F.col(p) * F.lit(SCORE_BLOCKS)), F.lit(0)),
                F.lit(SCORE_BLOCKS - 1))
    return (F.lit(SCORE_BLOCKS - 1) - k).cast("long")


def score_counts(df: DataFrame, p: str = "p", y: str = "y", group: Sequence[str] = (),
                 materialize: bool = False) -> DataFrame:
    """The score table ``(group, p) -> pos, neg`` (``y == 1`` is positive).

    It is the only step that reads the scored rows; every metric below is
    derived from it.  With ``materialize`` the (compact) table is checkpointed
    into the shared checkpoint folder, so the several small branches that read
    it never recompute the upstream pipeline."""
    pos = (F.col(y) == 1).cast("long")
    c = df.groupBy(*group, F.col(p).cast("double").alias("p")).agg(
        F.sum(pos).alias("pos"), F.sum(F.lit(1) - pos).alias("neg"))
    return cut_lineage(c) if materialize else c


def _totals(c: DataFrame, group: Sequence[str]) -> DataFrame:
    return c.groupBy(*group).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                                 (F.sum(F.col("pos") * F.pow(F.col("p") - 1.0, 2) + F.col("neg") * F.pow("p", 2))
                                  / F.sum(F.col("pos") + F.col("neg"))).alias("brier"))


def _join_group(a: DataFrame, b: DataFrame, group: Sequence[str]) -> DataFrame:
    if group:  # null-safe: a NULL group value is a group, as in groupBy
        return blocked.join_null_safe(a, b, list(group))
    return a.crossJoin(F.broadcast(b))  # one-row side


def _cumulative(c: DataFrame, group: Sequence[str], rank: bool = False) -> DataFrame:
    cols = {"tp": "pos", "fp": "neg"}
    if rank:  # 1-based position among the distinct scores, same blocked pass
        cols["__r"] = F.lit(1).cast("long")
    cum = blocked.running_sum(c, list(group), [F.col("p").desc()], _desc_block("p"), cols)
    return _join_group(cum, _totals(c, group), group)


def cumulative_counts(df: DataFrame, p: str = "p", y: str = "y", group: Sequence[str] = (),
                      materialize: bool = True) -> DataFrame:
    """Per distinct score ``p``: pos, neg, tp = #positives with score >= p, fp
    likewise, and the group totals n_pos, n_neg."""
    return _cumulative(score_counts(df, p, y, group, materialize), group)


def _rank(c: DataFrame, group: Sequence[str]) -> DataFrame:
    cum = _cumulative(c, group)
    auc_term = F.col("pos") * ((F.col("n_neg") - F.col("fp")) + F.col("neg") / F.lit(2.0))
    ap_term = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    # undefined (NULL) when a group has only one class
    return cum.groupBy(*group).agg(
        F.try_divide(F.sum(auc_term), F.first("n_pos") * F.first("n_neg")).alias("auroc"),
        F.try_divide(F.sum(ap_term), F.first("n_pos")).alias("ap"))


def auroc_ap(df: DataFrame, p: str = "p", y: str = "y", group: Sequence[str] = (),
             materialize: bool = True) -> DataFrame:
    """Exact AUROC (ties count one half) and average precision
    (step sum over distinct thresholds, as sklearn's average_precision_score)."""
    return _rank(score_counts(df, p, y, group, materialize), group)


def roc_points(df: DataFrame, p: str = "p", y: str = "y", group: Sequence[str] = (),
               materialize: bool = True, drop_intermediate: bool = True) -> DataFrame:
    """(fpr, tpr, threshold) at the distinct scores plus the origin
    (threshold NULL), like sklearn's ``roc_curve``: with ``drop_intermediate``
    a point is kept only where the curve turns (non-zero second difference of
    fp or tp), the first and last points always.  Neighbours are found by a
    join on ``(group, rank)`` of a blocked rank, not by a window over a group."""
    c = score_counts(df, p, y, group, materialize)
    cum = _cumulative(c, group, rank=drop_intermediate)
    if drop_intermediate:
        r = cut_lineage(cum) if materialize else cum  # compact; read three times below
        prev = r.select(*group, (F.col("__r") + 1).alias("__r"), F.col("tp").alias("__tp0"),
                        F.col("fp").alias("__fp0"))
        nxt = r.select(*group, (F.col("__r") - 1).alias("__r"), F.col("tp").alias("__tp2"),
                       F.col("fp").alias("__fp2"))
        at = [*group, "__r"]
        j = blocked.join_null_safe(blocked.join_null_safe(r, prev, at, "left"), nxt, at, "left")
        corner = ((F.col("__fp2") - 2 * F.col("fp") + F.col("__fp0")) != 0) | \
                 ((F.col("__tp2") - 2 * F.col("tp") + F.col("__tp0")) != 0)
        cum = j.filter(F.col("__tp0").isNull() | F.col("__tp2").isNull() | corner)
    pts = cum.select(*group, F.try_divide(F.col("fp"), F.col("n_neg")).alias("fpr"),
                     F.try_divide(F.col("tp"), F.col("n_pos")).alias("tpr"), F.col("p").alias("threshold"))
    origin = c.select(*group).distinct().select(*group, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                                                 F.lit(None).cast("double").alias("threshold"))
    return pts.unionByName(origin)


def pr_points(df: DataFrame, p: str = "p", y: str = "y", group: Sequence[str] = (),
              materialize: bool = True) -> DataFrame:
    """(precision, recall, threshold) at every distinct score plus the
    terminal point precision 1, recall 0 (threshold NULL)."""
    c = score_counts(df, p, y, group, materialize)
    cum = _cumulative(c, group)
    pts = cum.select(*group, (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                     _div0(F.col("tp"), F.col("n_pos")).alias("recall"), F.col("p").alias("threshold"))
    end = c.select(*group).distinct().select(*group, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                                              F.lit(None).cast("double").alias("threshold"))
    return pts.unionByName(end)


def confusion(df: DataFrame, pred: str = "pred", y: str = "y", group: Sequence[str] = ()) -> DataFrame:
    """Tn, fp, fn, tp as conditional sums."""
    pr, yy = F.col(pred) == 1, F.col(y) == 1
    s = lambda c: F.sum(c.cast("long"))
    return df.groupBy(*group).agg(s(~pr & ~yy).alias("tn"), s(pr & ~yy).alias("fp"),
                                  s(~pr & yy).alias("fn"), s(pr & yy).alias("tp"))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    n = tp + fp + fn + tn
    return [
        _div0(tp + tn, n).alias("accuracy"),
        _div0(tp, tp + fp).alias("precision"),
        _div0(tp, tp + fn).alias("recall"),
        _div0(tn, tn + fp).alias("specificity"),
        _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _div0(tn, tn + fn).alias("npv"),
        _div0(fp, fp + tp).alias("fdr"),
    ]


def _binary_from_counts(c: DataFrame, threshold: float, group: Sequence[str]) -> DataFrame:
    hit = F.col("p") >= F.lit(threshold)
    g = c.groupBy(*group).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
        (F.sum(F.col("pos") * F.pow(F.col("p") - 1.0, 2) + F.col("neg") * F.pow("p", 2))
         / F.sum(F.col("pos") + F.col("neg"))).alias("brier"))
    return g.select(*group, *[F.col(k).cast("long").alias(k) for k in ("tn", "fp", "fn", "tp")],
                    *_rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")), "brier")


def binary_metrics(df: DataFrame, p: str = "p", y: str = "y", threshold: float | str = 0.5,
                   group: Sequence[str] = (), materialize: bool = False) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, specificity, F1,
    NPV, FDR at a threshold (``p >= t``), and the Brier score.  ``threshold``
    may be a column name (per-row thresholds, e.g. from ``labels.apply_thresholds``)."""
    if not isinstance(threshold, str):
        return _binary_from_counts(score_counts(df, p, y, group, materialize), threshold, group)
    t = F.col(threshold)
    pr, yy = F.col(p) >= t, F.col(y) == 1
    s = lambda c: F.sum(c.cast("long"))
    g = df.groupBy(*group).agg(
        s(pr & yy).alias("tp"), s(pr & ~yy).alias("fp"), s(~pr & yy).alias("fn"),
        s(~pr & ~yy).alias("tn"),
        F.avg(F.pow(F.col(p) - yy.cast("double"), 2)).alias("brier"))
    return g.select(*group, "tn", "fp", "fn", "tp",
                    *_rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")), "brier")


def evaluate(df: DataFrame, p: str = "p", y: str = "y", threshold: float = 0.5,
             group: Sequence[str] = (), materialize: bool = True) -> DataFrame:
    """E13-E22 in one table: threshold metrics and AUROC / AP, all derived from
    one (materialised) score table."""
    c = score_counts(df, p, y, group, materialize)
    return _join_group(_binary_from_counts(c, threshold, group), _rank(c, group), group)


def _bucket(p: Column, n: int) -> Column:
    """Largest j with linspace_point(j) <= p, exact under binary rounding;
    -1 when p is below 0."""
    j0 = F.least(F.greatest(F.floor(p * F.lit(n - 1)), F.lit(-1)), F.lit(n - 1)).cast("int")
    up = F.when((j0 + 1 <= n - 1) & (linspace_point(j0 + 1, n) <= p), j0 + 1).otherwise(j0)
    return F.when((up >= 0) & (linspace_point(up, n) > p), up - 1).otherwise(up)


def threshold_sweep(df: DataFrame, p: str = "p", y: str = "y", n: int = 512,
                    round_sep: int | None = 4, group: Sequence[str] = (),
                    materialize: bool = True) -> DataFrame:
    """metrics at ``n`` thresholds ``linspace(0, 1, n)``.

    One pass over the score table: distinct scores fall into the bucket of the
    largest threshold they reach, bucket counts are suffix-summed over the
    ``n`` thresholds (a fixed-size table), and threshold-free metrics (AUROC,
    AUPRC, Brier) are computed once and joined, instead of being recomputed at
    every threshold."""
    spark = df.sparkSession
    c = score_counts(df, p, y, group, materialize)
    b = (c.withColumn("__j", _bucket(F.col("p"), n)).groupBy(*group, "__j")
         .agg(F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg")))
    glob = _join_group(_totals(c, group), _rank(c, group), group)
    grid = F.broadcast(spark.range(n).select(F.col("id").cast("int").alias("__j")))
    frame = c.select(*group).distinct().crossJoin(grid) if group else grid
    w = (Window.partitionBy(*group).orderBy(F.col("__j").desc())
         .rowsBetween(Window.unboundedPreceding, 0))
    s = (blocked.join_null_safe(frame, b, [*group, "__j"], "left")
         .select(*group, "__j",
                 F.sum(F.coalesce("__pos", F.lit(0))).over(w).alias("tp"),
                 F.sum(F.coalesce("__neg", F.lit(0))).over(w).alias("fp")))
    s = _join_group(s, glob, group)
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("n_pos") - tp, F.col("n_neg") - fp
    cols = {
        "THRESHOLD": linspace_point("__j", n),
        "TH_ACC": _div0(tp + tn, F.col("n_pos") + F.col("n_neg")),
        "AUROC": F.col("auroc"), "AUPRC": F.col("ap"),
        "RECALL": _div0(tp, F.col("n_pos")),
        "PRECISION": _div0(tp, tp + fp),
        "SPECIFICITY": _div0(tn, F.col("n_neg")),
        "F1": _div0(2 * tp, 2 * tp + fp + fn),
        "BRIER": F.col("brier"),
    }
    r = (lambda x: F.bround(x, round_sep)) if round_sep is not None else (lambda x: x)
    return s.select(*group, *[r(x).alias(k) for k, x in cols.items()])


def label_frequency(df: DataFrame, y: str = "y", group: Sequence[str] = ()) -> DataFrame:
    """Prevalence of the positive class."""
    return df.groupBy(*group).agg(F.avg((F.col(y) == 1).cast("double")).alias("label_frequency"))


__all__ = ["score_counts", "cumulative_counts", "auroc_ap", "roc_points", "pr_points",
           "confusion", "binary_metrics", "evaluate", "threshold_sweep", "label_frequency"]
