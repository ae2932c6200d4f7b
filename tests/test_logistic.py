"""The path of penalties: optimal for every C, exact on cases with a known solution."""

import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.operators import logistic, ml


def frame(spark, n=150, classes=2, seed=3, parts=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(4)]
        y = int(x[0] - x[1] + rng.gauss(0, 1) > 0) + (int(x[2] > 0.5) if classes > 2 else 0)
        rows.append((i, x, y))
    return spark.createDataFrame(rows, "id long, features array<double>, label int").repartition(parts)


@pytest.mark.parametrize("classes", [2, 3])
def test_the_penalised_gradient_vanishes_for_every_c(spark, classes):
    df = frame(spark, classes=classes)
    cs = ml.logspace(-4, 4, 12)
    path = logistic.fit(df, cs, classes=classes, tol=1e-7, partition_rows=40)
    assert path.gradients.max() <= 1e-7
    rows = df.collect()
    x, y, n = logistic.matrix([r.features for r in rows], 4), np.array([r.label for r in rows]), len(rows)
    for c, w in zip(cs, path.weights):
        for k in range(len(w)):  # row by row, from the definition
            g = np.zeros(5)
            for xi, yi in zip(x, y):
                m = w @ xi
                p = 1 / (1 + math.exp(-m[0])) if classes == 2 else math.exp(m[k] - max(m)) / sum(math.exp(v - max(m)) for v in m)
                g += (p - (yi if classes == 2 else yi == k)) * xi
            assert np.abs(g / n + np.append(w[k, :-1], 0) / (c * n)).max() <= 2e-7


def test_passes_do_not_depend_on_the_number_of_cs(spark):
    df = frame(spark)
    many, few = logistic.fit(df, ml.logspace(-2, 2, 40)), logistic.fit(df, ml.logspace(-2, 2, 2))
    assert many.passes <= 1.5 * few.passes + 5
    assert logistic.fit(df, many.cs, start=many).passes == 1


def test_equals_the_single_fits(spark):
    df = frame(spark)
    cs = [0.01, 1.0, 100.0]
    path = logistic.fit(df, cs, tol=1e-8)
    train = ml.with_vector(df.withColumn("label", F.col("label").cast("double")))
    for w, (_, est) in zip(path.weights, ml.lr_configs(cs, 150)):
        m = est.setTol(1e-10).setMaxIter(500).fit(train)
        assert np.append(m.coefficients.toArray(), m.intercept) == pytest.approx(w[0], abs=1e-4)


def test_known_solutions(spark):
    # one feature that is always 0: the intercept is the log odds, the weight 0
    df = spark.createDataFrame([(0, [0.0], int(i < 3)) for i in range(4)], "id int, features array<double>, label int")
    path = logistic.fit(df, [0.5, 5.0], tol=1e-9)
    assert path.weights[:, 0, 0] == pytest.approx([0, 0]) and path.weights[:, 0, 1] == pytest.approx([math.log(3)] * 2, abs=1e-6)
    p = logistic.score(path, df, ["id"], ordinal=7).select("config", "ordinal", F.round("p", 6).alias("p")).distinct().collect()
    assert sorted(map(tuple, p)) == [("lr_C=0.5", 7, 0.75), ("lr_C=5", 8, 0.75)]
    # two mirrored rows: w solves C * 2 * (1 - s(w)) = w
    df = spark.createDataFrame([(0, [1.0], 1), (1, [-1.0], 0)], "id int, features array<double>, label int")
    w = logistic.fit(df, [1.0], tol=1e-10).weights[0, 0]
    assert 2 * (1 - 1 / (1 + math.exp(-w[0]))) == pytest.approx(w[0], abs=1e-7) and w[1] == pytest.approx(0, abs=1e-9)


def test_odd_rows_classes_and_a_saved_path(spark):
    df = frame(spark, classes=3)
    odd = spark.createDataFrame([(900, None, 1), (901, [], 0), (902, [1.0], 2), (903, [1.0, None, float("nan"), 0.0], 1), (904, [1.0] * 4, None)], df.schema)
    path = logistic.fit(df.unionByName(odd), [0.1, 1.0], classes=3)
    whole = {(r.config, r.id): r.p for r in logistic.score(path, df, ["id"], klass=2).collect()}
    parts = [{(r.config, r.id): r.p for r in logistic.score(path, df, ["id"], klass=k).collect()} for k in (0, 1)]
    assert all(parts[0][k] + parts[1][k] + p == pytest.approx(1) for k, p in whole.items())
    folder = tempfile.mkdtemp(prefix="callscope-lr-")
    logistic.save(path, spark, folder)
    assert {(r.config, r.id): r.p for r in logistic.score(logistic.load(spark, folder), df, ["id"], klass=2).collect()} == whole
    for bad in (df.where("false"), df.withColumn("label", F.lit(3))):
        with pytest.raises(ValueError):
            logistic.fit(bad, [1.0], classes=3)


def test_correlated_features_cost_few_passes(spark):
    rng = np.random.default_rng(5)
    common = rng.normal(size=(3000, 1))
    x = (common + 0.05 * rng.normal(size=(3000, 12))) * np.logspace(-1, 1, 12)
    y = (x[:, 3] - x[:, 2] + 0.2 * rng.normal(size=3000) > 0).astype(int)
    df = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, y)], "features array<double>, label int")
    path = logistic.fit(df, ml.logspace(-4, 4, 20), tol=1e-6, partition_rows=1000)
    assert path.gradients.max() <= 1e-6
    assert path.passes <= 60


def test_many_features_are_fitted_without_their_products(spark, monkeypatch):
    df = frame(spark)
    whole = logistic.fit(df, [0.1, 10.0], tol=1e-8)
    monkeypatch.setattr(logistic, "GRAM_FEATURES", 3)
    assert np.allclose(whole.weights, logistic.fit(df, [0.1, 10.0], tol=1e-8).weights, atol=1e-5)
