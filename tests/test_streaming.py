"""Streaming operators equal their batch forms, across micro-batches."""

import tempfile

import pytest
from pyspark.sql import functions as F

from callscope.operators import smoothing
from callscope.plans import blocked
from callscope.streaming import calls as st


def test_stream_moving_average_matches_batch(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    folder = tempfile.mkdtemp(prefix="callscope-stream-")
    # three files in event-time order -> three micro-batches with maxFilesPerTrigger=1
    t1, t2 = ev.select(F.col("ts").cast("timestamp").cast("double").alias("t")).approxQuantile("t", [0.33, 0.66], 0.0)
    t = F.col("ts").cast("timestamp").cast("double")
    for i, cond in enumerate([t < t1, (t >= t1) & (t < t2), t >= t2]):
        ev.filter(cond).coalesce(1).write.parquet(f"{folder}/part{i}")
    import glob
    import os
    import shutil
    flat = tempfile.mkdtemp(prefix="callscope-stream-flat-")
    for i, f in enumerate(sorted(glob.glob(f"{folder}/part*/*.parquet"))):
        dst = os.path.join(flat, f"events-{i}.parquet")
        shutil.copy(f, dst)
        os.utime(dst, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))  # file order = event order
    stream = st.score_stream(spark, flat, file_glob="events-*.parquet", max_files=1)
    year = 365 * 86_400_000  # no call goes silent within the data: state spans all batches
    out = st.run_available_now(st.moving_average_stream(stream, window=3, watermark="400 days",
                                                        silence_ms=year), "test")
    got = {(r.id, r.event_id): r.p_ma for r in out.collect()}

    b = ev.select(F.col("user_id").alias("id"), "event_id", "ts", (F.col("value") / (F.col("value") + 50.0)).alias("p"))
    b = blocked.row_number(b, ["id"], ["ts", "event_id"], F.lit(0), out="rn").withColumn("seq", F.col("rn") - 1)
    ref = {(r.id, r.event_id): r.p for r in smoothing.moving_average(b, 3).collect()}
    assert len(got) == len(ref)
    assert got == pytest.approx(ref)


def test_stream_first_hit_once_per_call(spark, sf_small):
    stream = st.score_stream(spark, sf_small)
    out = st.run_available_now(st.first_hit_stream(stream, 0.8, window=1), "hit-test").collect()
    ids = [r.id for r in out if r.s_num != -1]
    assert len(ids) == len(set(ids))
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    expect = {r.user_id for r in ev.filter(F.col("value") / (F.col("value") + 50.0) >= 0.8).select("user_id").distinct().collect()}
    assert set(ids) == expect


def test_stream_cut_is_a_prefix_break(spark, sf_small):
    """L3: with a cut, each call keeps only the segments before its first
    segment ending more than cut_ms after the call's first segment."""
    cut = 6 * 3600 * 1000
    out = st.run_available_now(st.moving_average_stream(st.score_stream(spark, sf_small), window=1,
                                                        cut_ms=cut), "cut-test")
    got = {(r.id, r.event_id) for r in out.collect()}
    ev = spark.read.parquet(f"{sf_small}/events.parquet").orderBy("user_id", "ts", "event_id").collect()
    expect, start, stopped = set(), {}, set()
    for r in ev:
        ms = int(r.ts.replace(tzinfo=__import__("datetime").timezone.utc).timestamp() * 1000)
        start.setdefault(r.user_id, ms)
        if r.user_id in stopped or ms - start[r.user_id] > cut:
            stopped.add(r.user_id)
            continue
        expect.add((r.user_id, r.event_id))
    assert got == expect


def test_late_segments_are_dropped(spark):
    """L3: a segment older than the watermark arriving in a later micro-batch is ignored."""
    import datetime as dt
    import os
    import shutil
    folder = tempfile.mkdtemp(prefix="callscope-late-")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    on_time = [(i, dt.datetime(2024, 1, 10 + i), 1, "click", 10.0 * (i + 1), "{}") for i in range(5)]
    late = [(99, dt.datetime(2024, 1, 2), 1, "click", 50.0, "{}"), (100, dt.datetime(2024, 1, 16), 1, "click", 5.0, "{}")]
    for i, rows in enumerate([on_time, late]):
        d = f"{folder}/part{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(d)
        f = [x for x in os.listdir(d) if x.endswith(".parquet")][0]
        shutil.copy(os.path.join(d, f), os.path.join(folder, f"events-{i}.parquet"))
        os.utime(os.path.join(folder, f"events-{i}.parquet"), (1_700_000_000 + 100 * i,) * 2)
    stream = st.score_stream(spark, folder, file_glob="events-*.parquet", max_files=1)
    out = st.run_available_now(st.moving_average_stream(stream, window=1), "late-test")
    got = sorted((r.event_id, r.seq) for r in out.collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (100, 5)]


def _batches(spark, batches):
    """One file for each micro-batch, in order, of (event_id, hours, call, score) rows."""
    import datetime as dt
    import os
    import shutil
    folder = tempfile.mkdtemp(prefix="callscope-batches-")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for i, rows in enumerate(batches):
        rows = [(e, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), c, "x", 50.0 * p / (1 - p), "{}") for e, h, c, p in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{i}")
        f = [x for x in os.listdir(f"{folder}/part{i}") if x.endswith(".parquet")][0]
        shutil.copy(f"{folder}/part{i}/{f}", f"{folder}/events-{i}.parquet")
        os.utime(f"{folder}/events-{i}.parquet", (1_700_000_000 + 100 * i,) * 2)
    return st.score_stream(spark, folder, file_glob="events-*.parquet", max_files=1)


HOUR = 3_600_000


@pytest.mark.parametrize("cut,expected", [
    (None, {(1, 7, 106), (2, 1, 200), (3, -1, 300), (4, -1, 401)}),
    (2, {(1, -1, 101), (2, 1, 200), (3, -1, 300), (4, -1, 401)})])
def test_one_alert_per_call_over_many_batches(spark, cut, expected):
    """Call 1 speaks every 90 minutes and hits late (behind the cut); call 2 hits at once and
    often; 3 falls silent early, 4 too, after two segments.  Silence: two hours."""
    batches = []
    for i in range(12):
        rows = [(100 + i, 1.5 * i, 1, 0.9 if i >= 6 else 0.1), (200 + i, 1.5 * i + 0.1, 2, 0.9)]
        if i == 0:
            rows.append((300, 0.2, 3, 0.2))
        if i in (0, 1):
            rows.append((400 + i, 1.5 * i + 0.3, 4, 0.3))
        batches.append(rows)
    batches += [[(900 + i, 40.0 + 10 * i, 9, 0.1)] for i in range(2)]  # moves the watermark; call 9 stays open
    stream = st.first_hit_stream(_batches(spark, batches), 0.8, window=1, cut_ms=None if cut is None else cut * HOUR, watermark="0 seconds", silence_ms=2 * HOUR)
    out = [(r.id, r.s_num, r.event_id) for r in st.run_available_now(stream, "alerts").collect()]
    assert len(out) == len(set(out))
    assert {r for r in out if r[0] != 9} == expected


def test_closed_calls_leave_no_state(spark):
    batches = [[(i * 10 + c, float(i), c, 0.1) for c in range(5)] for i in range(3)] + [[(900, 50.0, 9, 0.1)], [(901, 100.0, 10, 0.1)], [(902, 100.5, 10, 0.1)]]
    stream = st.moving_average_stream(_batches(spark, batches), window=3, watermark="0 seconds", silence_ms=2 * HOUR)
    folder = tempfile.mkdtemp(prefix="callscope-state-")
    q = (stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start(f"{folder}/o"))
    q.awaitTermination()
    left = spark.read.format("statestore").option("stateVarName", "call").load(f"{folder}/c").count()
    assert left == 1  # call 10
    assert spark.read.parquet(f"{folder}/o").count() == 18
