"""Letter runs cut from Arrow batches, counts that stay arrays, prefixes without a grid."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callscope.operators import text

ODD = ["", None, "aé b", "été", "𝒳𝒴 a𝒳", "a1b_c-d", "é", "½ ² Ⅷ ª ǅ", "漢字かな 한글", "áb", "😀a😀", "İI ẞ", " \t", "x" * 50, "ʰกั", "a"]


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def few_rows(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_letters_are_those_of_the_patterns(spark):
    table = text.letter_table(text.letter_ranges(spark))
    chars = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(c,) for c in random.Random(3).sample(chars, 3000)], "c string")
    for r in df.select("c", F.col("c").rlike(r"^\p{L}$").alias("is")).collect():
        assert table[ord(r.c)] == r["is"], hex(ord(r.c))


@pytest.mark.parametrize("size", [1, 7, 16 << 20])
def test_runs_are_those_of_the_pattern(spark, monkeypatch, size):
    monkeypatch.setattr(text, "RUN_BYTES", size)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 3)], "doc_id int, text string").coalesce(1)
    expected = {r.term: r["count"] for r in docs.select(F.explode(text.default_tokens("text")).alias("term")).groupBy("term").count().collect()}
    freq = text.term_frequency(docs)
    assert {r.term: r.frequency for r in freq.collect()} == expected
    assert "regexp_extract_all" not in executed(freq)
    table = text.letter_table(text.letter_ranges(spark))
    some = pa.array([t or "" for t in ODD]).slice(2, 9)
    runs, row = text.letter_runs(some, table)
    assert [[w for w, r in zip(runs.to_pylist(), row, strict=True) if r == i] for i in range(9)] == [
        "".join(c if table[ord(c)] else " " for c in t).split(" ") if not t else [w for w in "".join(c if table[ord(c)] else " " for c in t).split(" ") if w]
        for t in some.to_pylist()]


def test_equal_keys_in_many_batches_are_added_up(spark, few_rows):
    rows = [(k, "a b a") for k in (1, None, 2, 1, 1, None, 3, 1, 1) for _ in range(3)] + [(4, "nothing"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    vocab = spark.createDataFrame([("a",), ("b",)], "term string")
    got = {(r.doc_id, r.term): r.tf for r in text.bag_of_words(docs, vocab).collect()}
    n = {1: 15, None: 6, 2: 3, 3: 3}
    assert got == {**{(k, "a"): 2 * v for k, v in n.items()}, **{(k, "b"): v for k, v in n.items()}}


def test_a_row_for_each_document_is_shuffled_and_weighed(spark):
    """Terms are not shuffled one by one, nor brought together again for norms and vectors."""
    docs = spark.createDataFrame([(i, f"aa b {'aa' * (i % 3)} cc") for i in range(9)] + [(9, None), (9, "b")], "doc_id int, text string")
    vocab = spark.createDataFrame([("aa", 1), ("b", 2), ("zz", 3)], "term string, rank long")
    bag = executed(text.bag_of_words(docs, vocab))
    assert "HashAggregate" not in bag and "regexp_extract_all" not in bag
    weights, idf = text.fit_tfidf(docs, vocab)
    assert "Exchange" not in executed(weights)
    arrays, _ = text.fit_tfidf(docs, vocab, packed=True)
    long = {(r.doc_id, r.term): r.tfidf for r in weights.collect()}
    by_rows = {(r.doc_id, r.term): r.tfidf for r in text.tfidf(text.bag_of_words(docs, vocab), idf).collect()}
    assert long.keys() == by_rows.keys() and all(abs(long[k] - by_rows[k]) < 1e-12 for k in long)
    rows = docs.select("doc_id").distinct()
    index = text.term_index(vocab.where("term <> 'b'"))  # a term without a place
    a, b = ({r.doc_id: (r.indices, [round(v, 9) for v in r["values"]]) for r in text.sparse_vectors(w, index, rows).collect()} for w in (arrays, weights))
    assert a == b and a[9] == ([], [])


def test_vocabularies_that_are_not_plain(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aa b-c"), (2, "b-c aa aa")], "doc_id int, text string")
    for terms in (["aa", "b-c"], ["aa", "aa"], ["aa", None]):
        vocab = spark.createDataFrame([(t,) for t in terms], "term string")
        a, b = ({(r.doc_id, r.term): r.tf for r in df.collect()} for df in (
            text.bag_of_words(docs, vocab), text.unpack(text.bag_of_words(docs, vocab, packed=True), "doc_id", "tf")))
        assert a == b and a[(2, "aa")] == 2
    monkeypatch.setattr(text, "TASK_TERMS", 1)
    vocab = spark.createDataFrame([("aa",), ("b",)], "term string")
    weights, _ = text.fit_tfidf(docs, vocab, packed=True)
    assert {r.doc_id: sorted(r.terms) for r in weights.collect()} == {1: ["aa", "b"], 2: ["aa", "b"]}


def test_prefix_counts_shuffle_no_grid(spark):
    """what is shuffled are counts that change."""
    rows = [(1, s, "aa" if s in (2, 5) else "b" if s == 0 else "") for s in range(8)] + [(1, 2, "aa"), (None, 0, "aa"), (2, 0, "x"), (2, 1, None)]
    utt = spark.createDataFrame(rows, "id int, seq int, tagged string")
    vocab = spark.createDataFrame([("aa",), ("b",)], "term string")
    out = text.prefix_term_frequency(utt, vocab)
    got = sorted(map(tuple, out.select("id", "seq", "term", "tf").collect()))
    assert got == sorted([*((1, s, "aa", 2 if s < 5 else 3) for s in range(2, 8)), *((1, s, "b", 1) for s in range(8))])
    plan = executed(out)
    assert plan.index("Generate") < plan.index("Exchange")  # every prefix is written out behind the last shuffle
