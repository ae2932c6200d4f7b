"""pyspark.ml training path: vectors, linear scoring parity, persistence, selection."""

import tempfile

import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from callscope.operators import ml
from callscope.sources import sinks


@pytest.fixture(scope="module")
def data(spark):
    rows = []
    for i in range(80):
        x = [((i * 7 + k * 3) % 11) / 10.0 for k in range(4)]
        y = (i // 4) % 2 if i % 4 == 0 else int(x[0] + x[1] > 1.0)
        rows.append((i, i // 4, i % 4, x, float(y), y))
    df = spark.createDataFrame(rows, "id long, call long, seq long, features array<double>, label double, y int")
    return ml.with_vector(df)


def test_long_to_dense(spark):
    long = spark.createDataFrame([(1, 0, 0.5), (1, 2, 2.0), (2, 1, 1.0)], "id int, dim int, z double")
    got = {r.id: r.features for r in ml.long_to_dense(long, 3).collect()}
    assert got == {1: [0.5, 0.0, 2.0], 2: [0.0, 1.0, 0.0]}


def test_linear_scoring_matches_transform_and_persists(spark, data):
    models = ml.fit_all(ml.lr_configs([0.1, 10.0], 80), data, parallelism=2)
    lin = {(r.config, r.id): r.p for r in ml.score_linear(models, data, ["id"]).collect()}
    tr = {(r.config, r.id): r.p for r in ml.score_all(models, data, ["id"]).collect()}
    assert lin == pytest.approx(tr, abs=1e-9)
    path = tempfile.mkdtemp(prefix="callscope-model-")
    sinks.save_model(models[0][1], path)
    back = LogisticRegressionModel.load(path)
    assert list(back.coefficients) == pytest.approx(list(models[0][1].coefficients))
    # weaker regularisation (larger C) gives larger weights
    assert sum(abs(x) for x in models[1][1].coefficients) > sum(abs(x) for x in models[0][1].coefficients)


def test_select_best_first_wins_ties(spark, data):
    models = ml.fit_all(ml.lr_configs([1.0, 1.0], 80), data, parallelism=2)
    scored = ml.score_linear(models, data, ["call", "seq"]).withColumnRenamed("call", "id")
    labels = data.groupBy(F.col("call").alias("id")).agg(F.max("y").alias("y"))
    _, best = ml.select_best(scored, labels, window=3)
    assert {r.method: r.ordinal for r in best.collect()} == {"max": 0, "average": 0}


def test_saved_models_score_like_fitted(spark, data):
    from pyspark.ml.classification import RandomForestClassificationModel
    models = ml.fit_all(ml.rf_configs([2], [5, 10]), data, parallelism=2)
    saved = ml.save_models(models, tempfile.mkdtemp(prefix="callscope-grid-"))
    back = ml.load_models(saved)
    assert all(isinstance(m, RandomForestClassificationModel) for _, m in back)
    a = {(r.config, r.id): r.p for r in ml.score_all(models, data, ["id"]).collect()}
    b = {(r.config, r.id): r.p for r in ml.score_all(back, data, ["id"]).collect()}
    assert a == pytest.approx(b)


def test_pluggable_pandas_tokenizer(spark):
    """A pandas UDF tokenizer plugs into term_frequency."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    from callscope.operators import text

    @pandas_udf("array<string>")
    def upper_words(s: pd.Series) -> pd.Series:
        return s.str.upper().str.split()

    docs = spark.createDataFrame([("a b a",), ("b c",)], "text string")
    got = {r.term: r.frequency for r in text.term_frequency(docs, tokenizer=upper_words).collect()}
    assert got == {"A": 2, "B": 2, "C": 1}


def test_first_trees_equal_a_shorter_fit(spark, data):
    """One boosted fit serves the smaller numbers of iterations of its depth."""
    alone = [(n, e.fit(data)) for n, e in ml.gbt_configs([1, 2], [3, 7])]
    shared = ml.fit_all(ml.gbt_configs([1, 2], [3, 7]), data, parallelism=2)
    assert [(n, m.getNumTrees) for n, m in shared] == [(n, m.getNumTrees) for n, m in alone]
    score = lambda models: {(r.config, r.ordinal, r.id): r.p for r in ml.score_grid(models, data, ["id"]).collect()}
    assert score(shared) == pytest.approx(score(alone), abs=1e-9)
    saved = ml.load_models(ml.save_models(shared, tempfile.mkdtemp(prefix="callscope-boosted-")))
    assert score(saved) == pytest.approx(score(alone), abs=1e-9)
    three = data.withColumn("label", (F.col("id") % 3).cast("double"))
    alone = [(n, e.fit(three)) for n, e in ml.gbt_configs([2], [2, 5], multiclass=True)]
    shared = ml.fit_all(ml.gbt_configs([2], [2, 5], multiclass=True), three, parallelism=2)
    assert score(shared) == pytest.approx(score(alone), abs=1e-9)


def test_grid_of_all_families_keeps_its_order(spark, data):
    models = ml.fit_all(ml.rf_configs([1], [2]) + ml.lr_configs([0.1, 1.0], 80) + ml.gbt_configs([1], [2]), data)
    got = {(r.config, r.ordinal) for r in ml.score_grid(models, data, ["id"]).collect()}
    assert got == {(n, i) for i, (n, _) in enumerate(models)}


def test_queries_fit_the_whole_grids(spark, sf_small, monkeypatch):
    """Each family in full: 100 C; depths 1-5 x 100-500 trees."""
    from callscope.operators import boosting, forest, logistic
    from callscope.plans import q_ml

    class Seen(Exception):
        pass

    seen = []

    def path(train, cs, **k):
        seen.extend(f"lr_C={c:.6g}" for c in cs)
        return q_ml.literal_path(k["classes"])

    def grow(train, trees, depth, **k):
        seen.extend(f"rf_d={d}_n={n}" for d in q_ml.TREE_DEPTHS if d <= depth for n in q_ml.RF_TREES if n <= trees)
        return boosting.Trees.empty(2, 1 if k["classes"] == 2 else k["classes"], 3)

    def fit(train, configs, **k):
        seen.extend(f"{c.name}_n={n}" for c in configs for n in q_ml.GBT_ITERS if n <= c.rounds)
        raise Seen

    monkeypatch.setattr(logistic, "fit", path)
    monkeypatch.setattr(forest, "fit", grow)
    monkeypatch.setattr(forest, "load", lambda spark, path: boosting.Trees.empty(2, 1, 3))
    monkeypatch.setattr(boosting, "fit", fit)
    trees = [f"d={d}_n={n}" for d in range(1, 6) for n in range(100, 501, 100)]
    for fn, families in ((q_ml.train_gbt, ("gbt",)), (q_ml.train_xgb, ("xgb",)), (q_ml.score_and_select, ("rf", "xgb", "gbt")),
                         (q_ml.three_way_model, ("rf", "xgb", "gbt"))):
        seen.clear()
        with pytest.raises(Seen):
            fn(spark, sf_small)
        assert [n for n in seen if n[:2] != "lr"] == [f"{f}_{t}" for f in families for t in trees]
        assert len({n for n in seen if n[:2] == "lr"}) == (0 if len(families) == 1 else 100)
