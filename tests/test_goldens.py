"""Hand-computed goldens (FIXTURES.md part 4)."""

import math

import pytest
from pyspark.sql import functions as F

from callscope.functions.scalar import k_of_group
from callscope.operators import hits, metrics, scaling, sequence, smoothing, text, tokens
from callscope.plans import blocked


def test_marker_segments(spark):
    # 4.1: two rows of 12 tokens, pad 0, markers 900 and 901
    a = [7, 900, 11, 12, 901, 13, 14, 15, 0, 0, 0, 8]
    b = [7, 901, 21, 22, 900, 23, 24, 25, 901, 26, 27, 8]
    rows = [(rid, pos, t) for rid, arr in (("A", a), ("B", b)) for pos, t in enumerate(arr)]
    tok = spark.createDataFrame(rows, "id string, pos int, token int")
    tok = tok.withColumn("is_marker", F.col("token").isin(900, 901))
    vl = tokens.valid_last_long(tok, pad=0)
    assert {r.id: r.valid_last for r in vl.collect()} == {"A": 7, "B": 11}
    seg = tokens.segment_tokens(tok.join(vl, "id"), valid_last="valid_last")
    got = {}
    for r in seg.collect():
        got.setdefault(r.id, {}).setdefault(r.seg, []).append(r.pos)
    assert {k: sorted(map(sorted, v.values())) for k, v in got.items()} == {
        "A": [[0], [1, 2, 3], [4, 5, 6, 7]],
        "B": [[0], [1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]],
    }


def test_marker_edge_cases(spark):
    # marker at 0 gives no head segment; a marker on the last valid token is dropped
    rows = [("x", p, p in (0, 3, 5)) for p in range(6)] + [("n", p, False) for p in range(3)]
    tok = spark.createDataFrame(rows, "id string, pos int, is_marker boolean")
    seg = tokens.segment_tokens(tok)
    got = {(r.id, r.pos): r.seg for r in seg.collect()}
    assert got == {("x", 0): 0, ("x", 1): 0, ("x", 2): 0, ("x", 3): 1, ("x", 4): 1,
                   ("n", 0): 0, ("n", 1): 0, ("n", 2): 0}


def test_time_cut_prefix_break(spark):
    # 4.2: stop at the first overrun; equal is kept
    u = spark.createDataFrame([(1, i, e) for i, e in enumerate([1000, 61000, 59000, 2000])] + [(2, 0, 60000)],
                              "id int, seq int, end_ms long")
    got = sorted((r.id, r.seq) for r in sequence.time_cut(u, 60000).collect())
    assert got == [(1, 0), (2, 0)]


@pytest.mark.parametrize("arr,expected", [
    (["a"], True), (["b"], False), (["b", "c"], True), (["b", "d"], False),
    (["b", "b"], True), ([], False), (["c", "d"], True)])
def test_k_of_group(spark, arr, expected):
    # 4.3
    df = spark.createDataFrame([(arr,)], "s array<string>")
    assert df.select(k_of_group("s", ["a"], [["b", "c"], ["c", "d"]]).alias("h")).first().h is expected


def test_moving_average(spark):
    # 4.4
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.1, 0.2, 0.6, 0.9])], "id int, seq int, p double")
    w3 = [r.p for r in smoothing.moving_average(df, 3).orderBy("seq").collect()]
    assert w3 == pytest.approx([0.1, 0.15, 0.3, 0.5666667], abs=1e-7)
    w0 = [r.p for r in smoothing.moving_average(df, 0).orderBy("seq").collect()]
    assert w0 == pytest.approx([0.1, 0.2, 0.6, 0.9])
    # tiny blocks force the halo path
    halo = blocked.trailing_mean(df, ["id"], "seq", 3, {"m": "p"}, width=2)
    assert [r.m for r in halo.orderBy("seq").collect()] == pytest.approx(w3)


def test_auroc_ap_ties(spark):
    # 4.5
    df = spark.createDataFrame([(.9, 1), (.8, 0), (.8, 1), (.3, 0), (.2, 1), (.1, 0)], "p double, y int")
    r = metrics.auroc_ap(df).first()
    assert r.auroc == pytest.approx(0.7222222, abs=1e-7)
    assert r.ap == pytest.approx(0.7555556, abs=1e-7)


def test_idf(spark):
    # 4.6: D=3; df=3 -> 1.0, df=1 -> ln(4/2)+1
    docs = spark.createDataFrame([(1, "x y"), (2, "x"), (3, "x")], "doc_id int, text string")
    vocab = spark.createDataFrame([("x",), ("y",)], "term string")
    tf = text.bag_of_words(docs, vocab)
    idf = {r.term: r.idf for r in text.inverse_document_frequency(tf, docs, vocab).collect()}
    assert idf["x"] == pytest.approx(1.0)
    assert idf["y"] == pytest.approx(1.6931472, abs=1e-7)


def test_first_hit(spark):
    # 4.7
    rows = [(1, 0, 0, 1, 0, 10), (1, 1, 1, 1, 10, 20), (1, 2, 1, 1, 20, 30),
            (2, 0, 0, 0, 0, 5), (2, 1, 0, 0, 5, 9),
            (3, 0, 1, 2, 0, 7)]
    df = spark.createDataFrame(rows, "id int, seq int, pred int, label1 int, starttime long, endtime long")
    got = {r.id: r for r in hits.first_hits(df).collect()}
    assert (got[1].s_num, got[1].starttime, got[1].endtime, got[1].category) == (2, 10, 20, "TP")
    assert (got[2].s_num, got[2].starttime, got[2].endtime, got[2].category) == (-1, 5, 9, "TN")
    assert got[3].category == "TN"


def test_speaker_fill(spark):
    # 4.8
    toks = ["<cls>", "[SPK1]", "x", "y", "[SPK0]", "z", "<pad>"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(toks)], "id int, pos int, token string")
    got = [r.spk for r in tokens.speaker_fill(df).orderBy("pos").collect()]
    assert got == [0, 1, 1, 1, 0, 0, 0]


def test_scaler(spark):
    # 4.9: population std; a constant column gets std 1
    long = spark.createDataFrame([(i, 0, float(x)) for i, x in enumerate([1, 2, 3])] +
                                 [(i, 1, 5.0) for i in range(3)], "id int, dim int, x double")
    sc = {r.dim: r for r in scaling.fit_scaler(long).collect()}
    assert sc[0].mean == pytest.approx(2.0) and sc[0].std == pytest.approx(0.8164966, abs=1e-7)
    assert sc[1].std == 1.0
    z = {(r.id, r.dim): r.z for r in scaling.apply_scaler(long, scaling.fit_scaler(long)).collect()}
    assert z[(0, 1)] == 0.0 and z[(2, 0)] == pytest.approx(1 / 0.8164966, abs=1e-6)


def test_softmax_argmax(spark):
    from callscope.functions.scalar import argmax, softmax
    df = spark.createDataFrame([([1.0, 3.0, 2.0],)], "a array<double>")
    r = df.select(softmax("a").alias("s"), argmax("a").alias("k")).first()
    e = [math.exp(x - 3.0) for x in (1.0, 3.0, 2.0)]
    assert r.s == pytest.approx([x / sum(e) for x in e])
    assert r.k == 1


def test_moving_average_with_gaps(spark):
    df = spark.createDataFrame([(1, s, p) for s, p in zip([3, 10, 11, 40], [0.1, 0.2, 0.6, 0.9])],
                               "id int, seq int, p double")
    got = [r.p for r in smoothing.moving_average(df, 3, dense=False).orderBy("seq").collect()]
    assert got == pytest.approx([0.1, 0.15, 0.3, 0.5666667], abs=1e-7)
