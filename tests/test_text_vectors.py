"""Vectors of TF-IDF: places, empty rows, and models on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.operators import logistic, text


def weights(spark):
    return spark.createDataFrame([("a", "x", 0.5), ("a", "z", 0.25), ("b", "y", 1.0), ("b", "unknown", 3.0), (None, "x", 2.0)],
                                 "doc_id string, term string, tfidf double")


def index(spark):
    return text.term_index(spark.createDataFrame([("z", 1), ("x", 2), ("y", 3)], "term string, rank long"))


def test_places_by_rank_empty_rows_and_null_keys(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("none",), (None,)], "doc_id string")
    sparse = text.sparse_vectors(weights(spark), index(spark), rows)
    got = {r.doc_id: (r.indices, r["values"]) for r in sparse.collect()}
    assert got == {"a": ([0, 1], [0.25, 0.5]), "b": ([2], [1.0]), "none": ([], []), None: ([1], [2.0])}
    dense = {r.doc_id: r.features for r in text.dense_vectors(sparse, 3).collect()}
    assert dense == {"a": [0.25, 0.5, 0.0], "b": [0.0, 0.0, 1.0], "none": [0.0, 0.0, 0.0], None: [0.0, 2.0, 0.0]}


def test_dense_keeps_other_columns_and_every_batch_size(spark, monkeypatch):
    df = spark.range(50).select("id", F.col("id").alias("extra"), F.array((F.col("id") % 7).cast("int")).alias("indices"),
                                F.array(F.col("id").cast("double")).alias("values")).coalesce(1)
    for numbers in (1, 20, 1 << 20):
        monkeypatch.setattr(text, "DENSE_BATCH", numbers)
        got = text.dense_vectors(df, 7).orderBy("id").collect()
        assert [r.extra for r in got] == list(range(50))
        assert all(r.features == [float(r.id) if i == r.id % 7 else 0.0 for i in range(7)] for r in got)
    assert text.dense_vectors(df.limit(0), 7).count() == 0
    with pytest.raises(Exception):
        text.dense_vectors(df, 3).collect()


def test_a_model_on_text(spark):
    docs = spark.createDataFrame([(i, "chest pain now" if i % 2 else "broken finger now") for i in range(40)], "doc_id long, text string")
    v = text.vocabulary(text.term_frequency(docs), top_k=5)
    tfidf, _ = text.fit_tfidf(docs, v)
    data = text.dense_vectors(text.sparse_vectors(tfidf, text.term_index(v), docs), 5).withColumn("label", (F.col("doc_id") % 2).cast("double"))
    assert np.allclose([np.linalg.norm(r.features) for r in data.collect()], 1.0)
    scored = logistic.score(logistic.fit(data, [10.0]), data, ["doc_id"]).collect()
    assert all((r.p > 0.5) == (r.doc_id % 2 == 1) for r in scored)
