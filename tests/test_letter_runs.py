"""Counts by letter runs: one way for vocabularies that travel with the tasks, one by joins."""

import random

from pyspark.sql import functions as F

from callscope.operators import text

TERMS = ["a", "aa", "aba", "été", "bab", "naïve", "𝒳a", "x" * 70]


def texts(spark):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choice("aab é-b 1") for _ in range(draw.randrange(60)))) for i in range(60)]
    rows += [(7, "aab"), (7, None), (97, "ababab"), (None, "aaaa été"), (None, "aa"), (90, "x" * 300 + "ab" * 60), (91, "𝒳a𝒳a naïveté"), (92, None), (93, "")]
    return spark.createDataFrame(rows, "doc_id int, text string").repartition(3)


def counted(df):
    return sorted(map(tuple, df.select("doc_id", "term", "tf").collect()), key=repr)


def test_both_ways_count_what_a_scan_counts(spark, monkeypatch):
    docs, vocab = texts(spark), spark.createDataFrame([(t,) for t in [*TERMS, "aa", None]], "term string")
    by_scan = (text.bag_of_words(docs, vocab.where("term is not null"), method="scan").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")))
    expected = counted(by_scan)
    assert (90, "x" * 70, 4) in expected and (97, "aba", 1) in expected
    assert counted(text.bag_of_words(docs, vocab, method="runs")) == expected
    monkeypatch.setattr(text, "DENSE_BATCH", 16)  # two rows at once
    monkeypatch.setattr(text, "RUN_CHUNK", 3)
    monkeypatch.setattr(text, "SHORT_RUN", 2)
    assert counted(text.bag_of_words(docs, vocab, method="runs")) == expected
    monkeypatch.setattr(text, "TASK_TERMS", 3)
    assert counted(text.bag_of_words(docs, vocab, method="runs")) == expected


def test_no_terms_and_no_texts(spark):
    docs, vocab = texts(spark), spark.createDataFrame([("aa",)], "term string")
    assert text.bag_of_words(docs, vocab.limit(0), method="runs").count() == 0
    assert text.bag_of_words(docs.limit(0), vocab, method="runs").count() == 0


def test_only_the_counts_are_shuffled(spark):
    """The runs of a text are not shuffled, nor is the bag of words to meet its weights."""
    docs, vocab = spark.createDataFrame([(1, "aa b")], "doc_id int, text string"), spark.createDataFrame([("aa",)], "term string")
    plan = text.bag_of_words(docs, vocab)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc_id" in plan
    weights, _ = text.fit_tfidf(docs, vocab)
    assert "SortMergeJoin" not in weights._jdf.queryExecution().executedPlan().toString()
