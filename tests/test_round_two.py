"""Cases that earlier fixtures did not reach: long calls, NULL groups, quoted CSV
texts, cut calls in a stream, and plans without broadcasts."""

import datetime as dt
import re
import uuid

import pytest
from pyspark.sql import functions as F

from callscope.operators import metrics, resample, sequence
from callscope.plans import blocked
from callscope.sources import calls as call_src
from callscope.sources import sinks
from callscope.streaming import calls as st

N, SLOTS = 120, 117


@pytest.fixture(scope="module")
def long_calls(spark):
    rows = [(1, i, i % 3, f"u{i}", 10 * i, 10 * i + 5) for i in range(N)] + [(2, i, 0, f"v{i}", i, i + 1) for i in range(3)]
    return spark.createDataFrame(rows, "id long, seq long, speaker int, text string, start_ms long, end_ms long")


def test_long_calls_survive_the_slots(long_calls):
    wide = sequence.wide_slots(long_calls, SLOTS)
    assert {r.id: r.truncated for r in wide.collect()} == {1: True, 2: False}
    rest = sequence.beyond_slots(long_calls, SLOTS)
    back = sequence.wide_to_long(wide, SLOTS, rest=rest)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long_calls.collect()))
    text = {r.id: r.text for r in sequence.rebuild_text(wide, SLOTS, rest=rest).collect()}
    assert text[1] == " ".join(f"[SPK{i % 3}] u{i}" for i in range(N)) and text[2] == "[SPK0] v0 [SPK0] v1 [SPK0] v2"


def test_rebuilt_text_stops_at_an_empty_slot_beyond_them(long_calls):
    gap = long_calls.withColumn("text", F.when(F.col("seq") != 118, F.col("text")))
    text = {r.id: r.text for r in sequence.rebuild_text(sequence.wide_slots(gap, SLOTS), SLOTS, rest=sequence.beyond_slots(gap, SLOTS)).collect()}
    assert text[1].endswith("u117")


def test_sweep_and_roc_keep_a_null_group(spark):
    rows = [(g, p / 10, int(p > 5)) for g in ("a", None) for p in range(1, 10)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    by = {}
    for r in metrics.threshold_sweep(df, group=["g"]).drop("THRESHOLD").collect():
        by.setdefault(r.g, []).append(tuple(r)[1:])
    assert sorted(by["a"]) == sorted(by[None]) and len(by[None]) == 512 and any(x[3] == 1.0 for x in by[None])
    roc = {}
    for r in metrics.roc_points(df, group=["g"]).collect():
        roc.setdefault(r.g, []).append((r.fpr, r.tpr))
    assert sorted(roc["a"]) == sorted(roc[None])


def test_csv_keeps_quotes_commas_and_newlines(spark, tmp_path):
    texts = ['say "hi", ok', 'a\nb "c"', "back\\slash", '"', "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sinks.write_csv(df, str(tmp_path / "c"))
    back = call_src.read_csv(spark, str(tmp_path / "c"), "id INT, text STRING")
    assert sorted(map(tuple, back.collect())) == list(enumerate(texts))


def test_prevalence_after_upsampling(spark):
    df = spark.createDataFrame([(i, int(i < 10)) for i in range(100)], "id int, label int")
    (r,) = resample.upsample_prevalence(resample.upsample(df, rate=0.5)).collect()
    assert (r.n_rows, r.n_copies, r.prevalence_before) == (105, 5, 0.1) and abs(r.prevalence - 15 / 105) < 1e-12


def _stream(spark, folder, batches):
    for i, rows in enumerate(batches):
        data = [(e, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), u, "x", v, None) for e, u, h, v in rows]
        (spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
         .coalesce(1).write.parquet(f"{folder}/{i}"))
    for i in range(len(batches)):
        (part,) = (folder / str(i)).glob("part-*.parquet")
        part.rename(folder / f"events-{i:02d}.parquet")
    return st.score_stream(spark, str(folder), "events-*.parquet", max_files=1)


BATCHES = [[(1, 1, 0, 1.0), (2, 2, 0, 1.0), (3, 3, 0, 1.0)], [(4, 1, 1, 1.0), (5, 3, 5, 1.0)], [(6, 1, 30, 900.0), (7, 9, 30, 1.0)],
           [(8, 9, 60, 1.0)], [(9, 9, 90, 1.0)], [(10, 9, 120, 1.0)]]


@pytest.mark.parametrize("cut", [None, 2 * 3_600_000])
def test_cut_calls_without_a_hit_are_reported(spark, tmp_path, cut):
    stream = st.first_hit_stream(_stream(spark, tmp_path, BATCHES), threshold=0.8, window=1, cut_ms=cut, watermark="1 hour", silence_ms=3_600_000)
    got = {r.id: (r.s_num, r.event_id) for r in st.run_available_now(stream, "test").collect()}
    assert got[2] == (-1, 2) and got[3] == (-1, 3 if cut else 5)
    assert got[1] == ((-1, 4) if cut else (3, 6))


def test_state_is_empty_after_silence(spark, tmp_path):
    stream = st.moving_average_stream(_stream(spark, tmp_path, BATCHES), window=2, cut_ms=2 * 3_600_000, watermark="1 hour", silence_ms=3_600_000)
    from callscope.session import ensure_checkpoint_dir
    base = f"{ensure_checkpoint_dir(spark)}/state-{uuid.uuid4()}"
    q = (stream.writeStream.format("noop").outputMode("append").option("checkpointLocation", base).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) >= 3 and rows[-1] <= 4  # what one open call keeps: its value, its list, its timer twice


def test_blocked_helpers_shuffle_the_rows_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", F.lit("wide").alias("detail"))
        for out in (blocked.row_number(df, ["g"], ["id"], blocked.seq_block("id", 64)),
                    blocked.running_sum(df, ["g"], ["id"], blocked.seq_block("id", 64), {"s": "id"}),
                    blocked.forward_fill(df, ["g"], ["id"], blocked.seq_block("id", 64), "id", "f")):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert out.count() == 1000
            # the join reads the window's rows as they are: no exchange in between
            assert re.search(r"SortMergeJoin .*\n(?:[ :+-]*(?:Project|Sort) .*\n)*[ :+-]*Window", plan), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_blocked_null_groups(spark):
    df = spark.createDataFrame([(g, h, i) for i, (g, h) in enumerate([(None, 1), (None, None), ("a", None), (None, 1), ("a", None), (None, None)])],
                               "g string, h int, i int")
    got = blocked.row_number(df, ["g", "h"], ["i"], blocked.seq_block("i", 2)).orderBy("i").collect()
    assert [r.rn for r in got] == [1, 1, 1, 2, 2, 2]
