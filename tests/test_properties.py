"""Property tests: partitioning invariance, split sizes, prefixes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from callscope.operators import hits, metrics, resample, sequence, smoothing


@pytest.fixture(scope="module")
def segs(spark):
    rnd = random.Random(11)
    rows = []
    for cid in range(40):
        n = rnd.choice([1, 2, 5, 9, 30])
        t = 0
        for s in range(n):
            t += rnd.randint(500, 30000)
            rows.append((cid, s, round(rnd.random(), 3), cid % 3, t - 400, t))
    return spark.createDataFrame(rows, "id long, seq long, p double, label1 int, starttime long, endtime long")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("op", ["cut", "ma", "hits", "auroc", "split"])
def test_invariant_under_repartition(spark, segs, op):
    def run(d):
        if op == "cut":
            return sequence.time_cut(d.withColumnRenamed("endtime", "end_ms"), 60000)
        if op == "ma":
            return smoothing.moving_average(d, 3)
        if op == "hits":
            return hits.first_hits(d.withColumn("pred", (F.col("p") > 0.7).cast("int")))
        if op == "auroc":
            return metrics.auroc_ap(d.withColumn("y", (F.col("label1") == 1).cast("int")), materialize=False)
        return resample.stratified_split(d.select("id", "label1").distinct(), "id", "label1")
    a, b = _rows(run(segs.repartition(1))), _rows(run(segs.repartition(17)))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y)


@pytest.mark.parametrize("in_place", [False, True])
def test_split_sizes(spark, in_place):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("label1"))
    s = resample.stratified_split(df, "id", "label1", tag_in_place=in_place)
    other = resample.stratified_split(df, "id", "label1", tag_in_place=not in_place)
    assert {r.id: (r.label1, r.split) for r in s.collect()} == {r.id: (r.label1, r.split) for r in other.collect()}
    got = {(r.label1, r.split): r.n for r in s.groupBy("label1", "split").agg(F.count("*").alias("n")).collect()}
    for k in range(3):
        n = sum(v for (lab, _), v in got.items() if lab == k)
        n_test = math.ceil(0.2 * n)
        assert got[(k, "test")] == n_test
        assert got[(k, "valid")] == math.ceil(0.2 * (n - n_test))


def test_prefix_extends_previous(spark, segs):
    utt = segs.select("id", "seq", F.lit(0).alias("speaker"), F.concat(F.lit("w"), F.col("seq").cast("string")).alias("text"),
                      F.col("starttime").alias("start_ms"), F.col("endtime").alias("end_ms"))
    st = {(r.id, r.seq): r.text for r in sequence.stack_prefixes(sequence.tag_speaker(utt)).collect()}
    for (cid, s), t in st.items():
        if s > 0:
            assert t.startswith(st[(cid, s - 1)] + " ")


def test_window_one_is_identity(spark, segs):
    a = {(r.id, r.seq): r.p for r in segs.collect()}
    b = {(r.id, r.seq): r.p for r in smoothing.moving_average(segs, 1).collect()}
    assert a == b


def test_bootstrap_sizes(spark, segs):
    calls = segs.select("id").distinct()
    n = calls.count()
    rows = resample.bootstrap_rows(calls, "id", k=4, rate=0.75)
    sizes = {r.k: r.n for r in rows.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert sizes == {k: round(0.75 * n) for k in range(4)}
    draws = resample.bootstrap_ids(calls, "id", k=4, rate=0.75, distinct=False)
    assert {r.k: r.n for r in draws.groupBy("k").agg(F.count("*").alias("n")).collect()} == \
        {k: int(0.75 * n) for k in range(4)}


def test_k_of_group_matches_rule(spark):
    """B3 against the rule stated in words: any element is a flat entry, or at
    least two elements (duplicates counted) fall into one group."""
    from hypothesis import given, settings, strategies as st

    from callscope.functions.scalar import k_of_group

    flat, groups = ["a"], [["b", "c"], ["c", "d"]]

    def rule(xs):
        return any(x in flat for x in xs) or any(sum(1 for x in xs if x in g) >= 2 for g in groups)

    cases = []

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.sampled_from(["a", "b", "c", "d", "e"]), max_size=6))
    def collect(xs):
        cases.append(xs)

    collect()
    df = spark.createDataFrame([(i, xs) for i, xs in enumerate(cases)], "i int, s array<string>")
    got = {r.i: r.h for r in df.select("i", k_of_group("s", flat, groups).alias("h")).collect()}
    assert all(got[i] == rule(xs) for i, xs in enumerate(cases))


def test_bag_of_words_runs_equals_scan(spark):
    from callscope.operators import text
    docs = spark.createDataFrame(
        [(1, "aaaa ab aab, Xaa! été-été"), (2, "bababa ab\nÉté"), (3, ""), (4, "naïve naïveté aaa")],
        "doc_id int, text string")
    vocab = spark.createDataFrame([(w,) for w in ["aa", "ab", "ba", "x", "Xa", "été", "na", "ïve", "aaa"]], "term string")
    assert text.letters_only(vocab)
    a = sorted(tuple(r) for r in text.bag_of_words(docs, vocab, method="scan").collect())
    b = sorted(tuple(r) for r in text.bag_of_words(docs, vocab, method="runs").select("doc_id", "term", "tf").collect())
    assert a == b


def test_bag_of_words_mixed_terms_and_letter_case(spark):
    """Letters-only terms go by runs, others by scans; texts count in lower case."""
    from callscope.operators import text
    docs = spark.createDataFrame([(1, "Chest pain, CHEST-pain"), (2, "a1 A1 chest")], "doc_id int, text string")
    vocab = spark.createDataFrame([("chest",), ("chest pain",), ("a1",), ("t-p",)], "term string")
    got = sorted(tuple(r) for r in text.bag_of_words(docs, vocab).collect())
    assert got == [(1, "chest", 2), (1, "chest pain", 1), (1, "t-p", 1), (2, "a1", 2), (2, "chest", 1)]
    raw = sorted(tuple(r) for r in text.bag_of_words(docs, vocab, lower=False).collect())
    assert raw == [(1, "t-p", 0)][:0] + [(2, "a1", 1), (2, "chest", 1)]


def test_prefix_counts_of_terms_with_spaces(spark):
    from callscope.operators import text
    utt = spark.createDataFrame([(1, 0, "my chest"), (1, 1, "pain and"), (1, 2, "chest pain")], "id int, seq int, tagged string")
    vocab = spark.createDataFrame([("chest",), ("chest pain",)], "term string")
    got = sorted(tuple(r) for r in text.prefix_term_frequency(utt, vocab).collect())
    assert got == [(1, 0, "chest", 1), (1, 1, "chest", 1), (1, 1, "chest pain", 1), (1, 2, "chest", 2), (1, 2, "chest pain", 2)]


def test_split_keeps_null_strata(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(40)], "id int, label1 int")
    for in_place in (False, True):
        s = resample.stratified_split(df, "id", "label1", tag_in_place=in_place)
        assert s.count() == 40
        assert s.filter(F.col("label1").isNull() & (F.col("split") == "test")).count() == 2  # ceil(0.2 * 10)
