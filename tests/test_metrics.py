"""Metric plans against brute force and properties."""

import random

import pytest
from pyspark.sql import functions as F

from callscope.operators import metrics


@pytest.fixture(scope="module")
def scores(spark):
    rnd = random.Random(3)
    rows = [(round(rnd.random(), 2), rnd.randint(0, 1)) for _ in range(300)] + [(0.0, 1), (1.0, 0), (1.0, 1)]
    return spark.createDataFrame(rows, "p double, y int")


def brute_auroc(rows):
    pos = [p for p, y in rows if y == 1]
    neg = [p for p, y in rows if y != 1]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def brute_ap(rows):
    P = sum(1 for _, y in rows if y == 1)
    ap, prev_r = 0.0, 0.0
    for t in sorted({p for p, _ in rows}, reverse=True):
        tp = sum(1 for p, y in rows if p >= t and y == 1)
        fp = sum(1 for p, y in rows if p >= t and y != 1)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_auroc_ap_brute(spark, scores):
    rows = [(r.p, r.y) for r in scores.collect()]
    got = metrics.auroc_ap(scores).first()
    assert got.auroc == pytest.approx(brute_auroc(rows))
    assert got.ap == pytest.approx(brute_ap(rows))


def test_auroc_symmetry(spark, scores):
    a = metrics.auroc_ap(scores).first().auroc
    b = metrics.auroc_ap(scores.withColumn("p", -F.col("p"))).first().auroc
    assert a == pytest.approx(1 - b)


def test_sweep_equals_cross_join(spark, scores):
    sw = {round(r.THRESHOLD, 6): r for r in metrics.threshold_sweep(scores, n=512, round_sep=None).collect()}
    assert len(sw) == 512
    rows = [(r.p, r.y) for r in scores.collect()]
    P = sum(y for _, y in rows)
    step = 1.0 / 511
    for j in range(512):
        t = 1.0 if j == 511 else j * step
        tp = sum(1 for p, y in rows if p >= t and y == 1)
        assert sw[round(t, 6)].RECALL == pytest.approx(tp / P)
    recalls = [sw[k].RECALL for k in sorted(sw)]
    assert all(a >= b for a, b in zip(recalls, recalls[1:]))


def test_grouped_equals_single(spark, scores):
    two = scores.withColumn("g", F.lit("a")).unionByName(
        scores.withColumn("g", F.lit("b")).withColumn("p", F.col("p") / 2))
    g = {r.g: r.auroc for r in metrics.auroc_ap(two, group=["g"]).collect()}
    assert g["a"] == pytest.approx(metrics.auroc_ap(scores).first().auroc)
    assert g["b"] == pytest.approx(g["a"])


def test_binary_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.6, 0), (0.4, 1), (0.1, 0)], "p double, y int")
    r = metrics.binary_metrics(df, threshold=0.5).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (1, 1, 1, 1)
    assert r.accuracy == 0.5 and r.npv == 0.5 and r.fdr == 0.5
    assert r.brier == pytest.approx((0.01 + 0.36 + 0.36 + 0.01) / 4)


def test_sweep_exact_at_threshold_values(spark):
    """Scores equal to the linspace points themselves land on the right side."""
    step = 1.0 / 511
    pts = [0.0, 1.0] + [j * step for j in (1, 2, 100, 255, 256, 510)] + [j / 511 for j in (3, 77, 509)]
    rows = [(p, i % 2) for i, p in enumerate(pts)] + [(0.5, 1), (0.999, 0)]
    df = spark.createDataFrame(rows, "p double, y int")
    sw = metrics.threshold_sweep(df, n=512, round_sep=None, materialize=False).collect()
    got = {round(r.THRESHOLD, 12): r for r in sw}
    P = sum(y for _, y in rows)
    N = len(rows) - P
    for j in range(512):
        t = 1.0 if j == 511 else j * step
        tp = sum(1 for p, y in rows if p >= t and y == 1)
        fp = sum(1 for p, y in rows if p >= t and y != 1)
        r = got[round(t, 12)]
        assert r.RECALL == pytest.approx(tp / P), j
        assert r.SPECIFICITY == pytest.approx((N - fp) / N), j


def test_roc_drop_intermediate_like_sklearn(spark):
    # collinear middle points are dropped; corners, first and last are kept
    rows = [(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 0), (0.4, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    full = sorted((r.fpr, r.tpr) for r in metrics.roc_points(df, drop_intermediate=False, materialize=False).collect())
    kept = sorted((r.threshold, r.fpr, r.tpr) for r in metrics.roc_points(df, materialize=False).collect()
                  if r.threshold is not None)
    assert len(full) == 7
    # thresholds 0.9 (first), 0.7 (corner), 0.5 (corner), 0.4 (last); 0.8 and 0.6 lie on straight runs
    assert [t for t, _, _ in kept] == [0.4, 0.5, 0.7, 0.9]
