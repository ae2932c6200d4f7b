import numpy as np

from callscope.llm import quality as Q
from callscope.llm import queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op9_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels if rows[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.95
    assert np.mean([a for a, b in held if b == 1]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_held_out_labels_do_not_matter(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F
    other = labels.withColumn("quality", F.when(queries.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (Q.fit(docs, x, may_learn=~queries.held_out()) for x in (labels, other))
    assert a.prior == b.prior and all(np.array_equal(x, y) for x, y in zip(a.weights, b.weights))


def test_prior_is_estimated():
    random = np.random.default_rng(1)
    good = lambda n: random.normal(0, 1, (n, 3))
    bad = lambda n: random.normal(4, 1, (n, 3))
    p, u = good(3000), np.concatenate([good(2100), bad(900)])
    model = Q.fit_matrix(p, u[random.permutation(len(u))])
    assert abs(model.prior - 0.7) < 0.06
    assert model.score(good(500)).mean() > 0.9 and model.score(bad(500)).mean() < 0.1


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "word " * 200_000, None), (None, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    model = Q.fit(df, labels)
    got = Q.score(df, model).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    assert Q.score(df.limit(0), model).count() == 0
    assert np.isfinite([Q.features(r[1]) for r in rows]).all()
