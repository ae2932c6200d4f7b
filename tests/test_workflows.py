"""The stage compositions run end to end on a small call-record folder."""

import os
import tempfile

from pyspark.sql import functions as F

from callscope import workflows
from test_sources import _write_calls


def test_stage_one_and_two(spark):
    folder = tempfile.mkdtemp(prefix="callscope-wf-")
    _write_calls(folder)
    idx = workflows.labelled_index(spark, os.path.join(folder, "json"), os.path.join(folder, "wav", "original"))
    got = {r.id: (r.label1, r.split) for r in idx.collect()}
    assert set(got) == {"c1", "c4"}
    rows = workflows.call_rows(idx, cuts={"train": None, "valid": 60000, "test": 60000})
    texts = {r.id: r.text for r in rows.collect()}
    # c4 has no utterances and disappears; c1 is cut at 60 s unless it is in train
    assert set(texts) == {"c1"}
    expect = "[SPK0] 여보세요 [SPK1] 네" if got["c1"][1] == "train" else "[SPK0] 여보세요"
    assert texts["c1"] == expect
    stacked = workflows.call_rows(idx, cuts={"train": None, "valid": None, "test": None}, stacked=True)
    assert stacked.count() == 2


def test_evaluation_and_hits(spark):
    seg = spark.createDataFrame([(i // 4, i % 4, ((i * 37) % 100) / 100.0) for i in range(80)], "id long, seq long, p double")
    lab = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, y int")
    out = workflows.evaluate_segments(seg, lab, window=2, n_boot=3)
    assert out["metrics"].count() == 1 and out["sweep"].count() == 512 and out["bootstrap"].count() == 1
    times = seg.select("id", "seq", (F.col("seq") * 1000).alias("start_ms"), (F.col("seq") * 1000 + 900).alias("end_ms"))
    rep = workflows.first_hit_report(seg.withColumn("label1", (F.col("id") % 2).cast("int")), times, 0.9)
    rows = rep.collect()
    assert len(rows) == 20
    assert all((r.s_num == -1) == (r.predicted_labels == 0) for r in rows)
    assert all(r.elapsed_ms == r.endtime for r in rows)


def test_tfidf_features_train_fitted(spark):
    rows = spark.createDataFrame([("a", "train", "x y x"), ("b", "train", "y z"), ("c", "test", "x q")],
                                 "id string, split string, text string")
    feats, idf, vocab = workflows.tfidf_features(rows, top_k=3)
    assert {r.term for r in vocab.collect()} == {"x", "y", "z"}
    got = {(r.id, r.term) for r in feats.collect()}
    assert ("c", "x") in got and not any(t == "q" for _, t in got)
