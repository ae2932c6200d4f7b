"""One check per SURVEY §7.5 hazard not covered elsewhere."""

import pytest
from pyspark.sql import functions as F

from callscope.functions import fixed_values as FV
from callscope.functions.scalar import occurrences, round_half_even
from callscope.operators import labels, sequence, text


def test_h1_respiratory_arrest_is_label_two(spark):
    df = spark.createDataFrame([(["호흡정지"],), ([FV.ARREST_SYMPTOM, "호흡정지"],), (["두통", "어지러움"],), (["두통"],)],
                               "symptom array<string>")
    got = [(r.label, r.label1, r.label2) for r in labels.label_columns(df).collect()]
    assert got == [(False, 2, False), (True, 1, False), (False, 2, False), (False, 0, False)]


def test_h4_terms_missing_from_idf_are_dropped(spark):
    tf = spark.createDataFrame([(1, "x", 2), (1, "y", 1)], "doc_id int, term string, tf long")
    idf = spark.createDataFrame([("x", 1.5)], "term string, idf double")
    got = text.tfidf(tf, idf, normalize=False).collect()
    assert [(r.term, r.tfidf) for r in got] == [("x", 3.0)]


def test_h6_literal_by_default_regex_on_request(spark):
    df = spark.createDataFrame([("a.c abc a.c",)], "t string")
    r = df.select(occurrences("t", "a.c").alias("lit"), occurrences("t", "a.c", regex=True).alias("rx")).first()
    assert (r.lit, r.rx) == (2, 3)


def test_h8_wide_export_flags_truncation(spark):
    utt = spark.createDataFrame([(1, i, 0, f"t{i}", i * 10, i * 10 + 5) for i in range(5)],
                                "id int, seq long, speaker int, text string, start_ms long, end_ms long")
    w = sequence.wide_slots(utt, 3).first()
    assert w.truncated is True and w.S2 == "t2" and "S3" not in w.asDict()


def test_h12_half_even_rounding(spark):
    r = spark.range(1).select(round_half_even(F.lit(0.03125), 4).alias("a"),
                              round_half_even(F.lit(0.03135), 4).alias("b")).first()
    assert r.a == pytest.approx(0.0312)  # Python's round(0.03125, 4)
    assert r.b == pytest.approx(round(0.03135, 4), abs=1e-4)


def test_h22_last_sequence_cut_drops_empty_calls(spark):
    u = spark.createDataFrame([(1, 0, 70000), (2, 0, 1000), (2, 1, 90000)], "id int, seq int, end_ms long")
    got = {r.id: r.seq for r in sequence.last_sequence(u, cut_ms=60000).collect()}
    assert got == {2: 0}
