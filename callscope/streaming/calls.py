"""L1-L3: incremental per-call smoothing, first-hit alerts and the time cut.

Segment scores arrive as a stream; each call keeps a small state — the last
``window - 1`` scores, the segment count and what has been reported — as value and
list states of a stateful processor (``transformWithState``).  Within a micro-batch
the rows of a call are ordered by event time; across batches the state carries the
history.  A watermark on event time bounds the state: a timer closes calls that stay
silent past it (a call without a hit then reports ``s_num = -1``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callscope.session import ensure_checkpoint_dir

SCORE_SCHEMA = "id LONG, event_id LONG, ts TIMESTAMP, end_ms LONG, p DOUBLE"
MA_OUT = "id LONG, event_id LONG, ts TIMESTAMP, seq LONG, p DOUBLE, p_ma DOUBLE"
HIT_OUT = "id LONG, s_num LONG, event_id LONG, ts TIMESTAMP, p_ma DOUBLE"
#: files of a micro-batch, unless the caller says otherwise
MAX_FILES = 64


def score_stream(spark: SparkSession, folder: str, file_glob: str = "events.parquet",
                 max_files: int | None = MAX_FILES) -> DataFrame:
    """Event rows of ``folder`` (files matching ``file_glob``) as segment scores
    ``(id, event_id, ts, end_ms, p)``, the streaming twin of view V3."""
    schema = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    ev = r.parquet(folder)
    # the table's wall-clock TIMESTAMP_NTZ read as UTC, whatever the session zone;
    # the watermark needs an instant (TIMESTAMP)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return ev.select(F.col("user_id").alias("id"), "event_id", F.timestamp_micros(micros).alias("ts"),
                     F.floor(micros / 1000).cast("long").alias("end_ms"),
                     (F.col("value") / (F.col("value") + F.lit(50.0))).alias("p"))


class _Calls(StatefulProcessor):
    """What both operators know of a call: the last ``window - 1`` scores, the number of
    segments, whether it is cut, and the time at which silence ends it.

    The timer is set by the last segment *seen*, so a call that is cut stays known, and its
    segments ignored, as long as they keep arriving.  Segments behind the watermark are late
    and ignored.  The rows of a call in a micro-batch are ordered by event time."""

    SCHEMA = "n LONG, done BOOLEAN, cut BOOLEAN, start LONG, last_event LONG, last_ms LONG, timer LONG"

    def __init__(self, window: int, cut_ms: int | None, silence_ms: int):
        self.window, self.cut_ms, self.silence_ms = window, cut_ms, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", self.SCHEMA)
        self.last = handle.getListState("last", "p DOUBLE")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        frame = pd.concat(list(rows))
        watermark = timerValues.getCurrentWatermarkInMs()
        if watermark > 0:
            frame = frame[frame["end_ms"] >= watermark]
        frame = frame.sort_values(["ts", "event_id"], kind="stable")
        if len(frame) == 0:
            return
        if self.call.exists():
            n, done, cut, start, last_event, last_ms, timer = self.call.get()
            before = [x[0] for x in self.last.get()]
        else:
            n, done, cut, start, last_event, last_ms, timer = 0, False, False, int(frame["end_ms"].iloc[0]), None, None, None
            before = []
        seen = int(frame["end_ms"].iloc[-1])
        if cut:
            frame = frame.iloc[:0]
        elif self.cut_ms is not None:
            over = np.flatnonzero(frame["end_ms"].to_numpy() - start > self.cut_ms)
            if len(over):
                frame, cut = frame.iloc[:over[0]], True
        if len(frame):
            mean = _trailing(before, frame["p"].to_numpy(), self.window)
            if self.window > 1:
                self.last.put([(float(p),) for p in (before + frame["p"].tolist())[1 - self.window:]])
            last_event, last_ms = int(frame["event_id"].iloc[-1]), int(frame["end_ms"].iloc[-1])
        else:
            mean = np.empty(0)
        out, done = self.answer(key, frame, mean, n, done, cut, last_event, last_ms)
        expires = max(seen + self.silence_ms, timer or 0, watermark + 1)
        if expires != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(expires)
        self.call.update((int(n + len(frame)), bool(done), bool(cut), int(start), last_event, last_ms, int(expires)))
        if out is not None:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.call.exists():
            _, done, _, _, last_event, last_ms, _ = self.call.get()
            if not done:
                out = self.silent(key, last_event, last_ms)
                if out is not None:
                    yield out
            self.call.clear()
            self.last.clear()

    def answer(self, key, frame, mean, n, done, cut, last_event, last_ms):
        """(rows to emit or None, whether the call has been answered)."""
        raise NotImplementedError

    def silent(self, key, last_event, last_ms):
        """What a call that ends unanswered emits."""
        return None

    def close(self) -> None:
        pass


class _Means(_Calls):
    def answer(self, key, frame, mean, n, done, cut, last_event, last_ms):
        if not len(frame):
            return None, done
        return pd.DataFrame({"id": frame["id"].to_numpy(), "event_id": frame["event_id"].to_numpy(), "ts": frame["ts"].to_numpy(),
                             "seq": np.arange(n, n + len(frame)), "p": frame["p"].to_numpy(), "p_ma": mean}), done


class _FirstHit(_Calls):
    def __init__(self, threshold: float, *args):
        super().__init__(*args)
        self.threshold = threshold

    def answer(self, key, frame, mean, n, done, cut, last_event, last_ms):
        if done:
            return None, True
        hits = np.flatnonzero(mean >= self.threshold)
        if len(hits):
            i = hits[0]
            return self._row(key, n + i + 1, frame["event_id"].iloc[i], int(frame["end_ms"].iloc[i]), mean[i]), True
        return (self.silent(key, last_event, last_ms), True) if cut else (None, False)

    def silent(self, key, last_event, last_ms):
        return self._row(key, -1, last_event, last_ms, np.nan)

    def _row(self, key, s_num, event, ms, mean):
        return pd.DataFrame({"id": [key[0]], "s_num": [s_num], "event_id": [event], "ts": pd.to_datetime([ms], unit="ms"), "p_ma": [mean]})


def _trailing(before: list[float], new: np.ndarray, window: int) -> np.ndarray:
    values = np.concatenate([np.asarray(before, dtype=float), new.astype(float)])
    if window <= 1:
        return new.astype(float)
    c = np.concatenate([[0.0], np.cumsum(values)])
    at = np.arange(len(before), len(values))
    low = np.maximum(at - window + 1, 0)
    return (c[at + 1] - c[low]) / (at + 1 - low)


#: The state store that timers and list states need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _by_call(scores: DataFrame, processor: StatefulProcessor, schema: str, watermark: str) -> DataFrame:
    """A session that still has Spark's default state store gets the one that is needed."""
    conf = scores.sparkSession.conf
    if not conf.get(_PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        conf.set(_PROVIDER, ROCKS)
    return (scores.withWatermark("ts", watermark).groupBy("id")
            .transformWithStateInPandas(processor, schema, "append", "eventTime"))


def moving_average_stream(scores: DataFrame, window: int = 3, cut_ms: int | None = None,
                          watermark: str = "1 day", silence_ms: int = 86_400_000) -> DataFrame:
    """L1 (+L3): trailing mean of the last ``window`` scores of each call, emitted for every
    arriving segment (append mode).  A call silent for ``silence_ms`` of event time past the
    watermark is closed (state dropped).  With ``cut_ms``, the first segment that ends more
    than that after the call's first one, and all that follow, are ignored."""
    return _by_call(scores, _Means(window, cut_ms, silence_ms), MA_OUT, watermark)


def first_hit_stream(scores: DataFrame, threshold: float, window: int = 3,
                     cut_ms: int | None = None, watermark: str = "1 day",
                     silence_ms: int = 86_400_000) -> DataFrame:
    """L2 (+L1, L3): one alert per call — the first segment whose trailing mean reaches
    ``threshold`` (``s_num`` 1-based).  A call without a hit reports ``s_num = -1`` with its
    last segment (within the cut) once, when it is cut or has been silent for ``silence_ms``
    past the watermark.  Silence alone ends a call and drops its state."""
    return _by_call(scores, _FirstHit(threshold, window, cut_ms, silence_ms), HIT_OUT, watermark)


def run_available_now(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available into a Parquet sink under the shared
    checkpoint folder (exactly-once file sink + checkpointed state) and return
    the sink as a batch DataFrame."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True)
         .start(f"{base}/out"))
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")
