"""Scans and sinks: call JSON with type guard, media listing, CSV round trip."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from callscope.operators import labels, sequence
from callscope.sources import calls as call_src
from callscope.sources import sinks


def _write_calls(folder):
    recs = {
        "c1": {"_id": "c1", "symptom": ["심정지"], "utterances": [
            {"startAt": 0, "endAt": 1000, "speaker": 0, "text": "여보세요"},
            {"startAt": 1000, "endAt": 61000, "speaker": 1, "text": "네"}]},
        "c2": {"_id": "c2", "symptom": "흉통", "utterances": [
            {"startAt": 0, "endAt": 10, "speaker": 0, "text": "x"}]},
        "c3": {"_id": "c3", "utterances": [{"startAt": 0, "endAt": 10, "speaker": 0, "text": "y"}]},
        "c4": {"_id": "c4", "symptom": ["흉통", "실신"], "utterances": []},
    }
    os.makedirs(os.path.join(folder, "json"))
    os.makedirs(os.path.join(folder, "wav", "original"))
    for k, v in recs.items():
        with open(os.path.join(folder, "json", f"{k}.json"), "w", encoding="utf-8") as f:
            json.dump(v, f, ensure_ascii=False, indent=2)
    for k in ("c1", "c2", "c4"):
        with open(os.path.join(folder, "wav", "original", f"{k}.wav"), "wb") as f:
            f.write(b"RIFF")  # Spark file listings skip zero-byte files


def test_call_scan_guard_media_labels(spark):
    folder = tempfile.mkdtemp(prefix="callscope-calls-")
    _write_calls(folder)
    calls = call_src.read_calls(spark, os.path.join(folder, "json"))
    assert calls.count() == 4
    guarded = labels.symptom_guard(calls)
    assert sorted(r._id for r in guarded.collect()) == ["c1", "c4"]
    media = call_src.media_listing(spark, os.path.join(folder, "wav", "original"))
    kept = call_src.with_media(guarded, media)
    lab = {r._id: (r.label, r.label1, r.label2) for r in labels.label_columns(kept).collect()}
    assert lab == {"c1": (True, 1, False), "c4": (False, 2, True)}
    utt = sequence.explode_utterances(kept)
    assembled = sequence.assemble_calls(sequence.tag_speaker(sequence.time_cut(utt, 60000))).collect()
    assert [(r.id, r.text, r.end_ms) for r in assembled] == [("c1", "[SPK0] 여보세요", 1000)]


def test_csv_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="callscope-csv-")
    df = spark.createDataFrame([(1, 0.5, 1, 60), (2, 0.25, 0, 120)], "id long, p double, y int, time_cut int")
    sinks.write_csv(df, folder, ["time_cut"])
    back = call_src.read_csv(spark, folder, "id LONG, p DOUBLE, y INT, time_cut INT")
    assert sorted(tuple(r) for r in back.select("id", "p", "y", "time_cut").collect()) == [(1, 0.5, 1, 60), (2, 0.25, 0, 120)]
    pq = tempfile.mkdtemp(prefix="callscope-pq-")
    sinks.write_results(df, pq)
    assert spark.read.parquet(pq).filter(F.col("time_cut") == 60).count() == 1
