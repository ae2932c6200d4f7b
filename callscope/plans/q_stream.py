"""Catalogue: streaming smoothing, first-hit alerts and time cut over the events table.

The streamed segment scores are V3's (``p = value / (value + 50)`` per user in
``(ts, event_id)`` order), so the smoothing and cut results have batch SQL
oracles; the first-hit stream depends on watermark progress (timeouts) and is
checked rows-only here and against the batch operator in the tests.
"""

from __future__ import annotations

from callscope.plans.registry import finish, query
from callscope.streaming import calls as st

HIT_THRESHOLD = 0.85
CUT_MS = 6 * 3600 * 1000
_OUT = ["id", "event_id", "seq", "p", "p_ma"]
_MA = "AVG(p) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query("stream_moving_average", f"""SELECT id, event_id, seq, round(p, 6) AS p, round({_MA}, 6) AS p_ma FROM (
  SELECT user_id AS id, event_id, value / (value + 50.0) AS p,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq
  FROM events) AS s""")
def stream_moving_average(spark, sf):
    """L1: incremental trailing mean per call, one output row per segment."""
    out = st.run_available_now(st.moving_average_stream(st.score_stream(spark, sf), window=3), "ma")
    return finish(out.select(*_OUT))


DAY_MS = 86_400_000


@query("stream_first_hit", f"""WITH s AS (
  SELECT user_id AS id, event_id, epoch_ms(ts) AS e, value / (value + 50.0) AS p,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
m AS (SELECT *, AVG(p) OVER (PARTITION BY id ORDER BY rn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS p_ma FROM s),
h AS (SELECT id, MIN(rn) FILTER (WHERE p_ma >= {HIT_THRESHOLD}) AS hit_rn, MAX(e) AS last_e,
      arg_max(event_id, rn) AS last_event FROM m GROUP BY id),
mx AS (SELECT MAX(epoch_ms(ts)) AS max_e FROM events)
SELECT m.id, CAST(m.rn AS BIGINT) AS s_num, m.event_id, round(m.p_ma, 6) AS p_ma
FROM m JOIN h ON m.id = h.id AND m.rn = h.hit_rn
UNION ALL
SELECT h.id, CAST(-1 AS BIGINT), h.last_event, CAST(NULL AS DOUBLE) FROM h, mx
WHERE h.hit_rn IS NULL AND h.last_e + {DAY_MS} < mx.max_e - {DAY_MS}""")
def stream_first_hit(spark, sf):
    """L2: one alert per call at the first smoothed score >= threshold; calls
    silent for a day of event time past the (1 day) watermark without a hit
    report ``s_num = -1`` with their last segment when the watermark passes."""
    out = st.run_available_now(st.first_hit_stream(st.score_stream(spark, sf), HIT_THRESHOLD, window=3,
                                                   watermark="1 day", silence_ms=DAY_MS), "hit")
    return finish(out.select("id", "s_num", "event_id", "p_ma"))


@query("stream_time_cut", f"""WITH s AS (
  SELECT user_id AS id, event_id, ts, value / (value + 50.0) AS p, epoch_ms(ts) AS e FROM events),
f AS (SELECT *, FIRST_VALUE(e) OVER (PARTITION BY id ORDER BY ts, event_id) AS st FROM s),
g AS (SELECT *, MAX(CASE WHEN e - st > {CUT_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped FROM f),
k AS (SELECT id, event_id, p, CAST(row_number() OVER (PARTITION BY id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq
      FROM g WHERE stopped = 0)
SELECT id, event_id, seq, round(p, 6) AS p, round({_MA}, 6) AS p_ma FROM k""")
def stream_time_cut(spark, sf):
    """L3 with L1: per call, the segment ending more than 6 h after the call's
    first segment and everything after it are ignored; trailing mean of the rest."""
    stream = st.moving_average_stream(st.score_stream(spark, sf), window=3, cut_ms=CUT_MS)
    return finish(st.run_available_now(stream, "cut").select(*_OUT))


CUT_DAYS_MS = 3 * DAY_MS


@query("stream_first_hit_cut", f"""WITH e AS (
  SELECT user_id AS id, event_id, epoch_ms(ts) AS e, value / (value + 50.0) AS p, ts,
         FIRST_VALUE(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS st FROM events),
s AS (SELECT id, event_id, e, p, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS rn FROM e
      WHERE e - st <= {CUT_DAYS_MS}),
m AS (SELECT *, AVG(p) OVER (PARTITION BY id ORDER BY rn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS p_ma FROM s),
h AS (SELECT id, MIN(rn) FILTER (WHERE p_ma >= {HIT_THRESHOLD}) AS hit_rn, arg_max(event_id, rn) AS last_event FROM m GROUP BY id),
seen AS (SELECT id, MAX(e) AS last_e, MAX(e - st) > {CUT_DAYS_MS} AS cut FROM e GROUP BY id),
mx AS (SELECT MAX(epoch_ms(ts)) AS max_e FROM events)
SELECT m.id, CAST(m.rn AS BIGINT) AS s_num, m.event_id, round(m.p_ma, 6) AS p_ma
FROM m JOIN h ON m.id = h.id AND m.rn = h.hit_rn
UNION ALL
SELECT h.id, CAST(-1 AS BIGINT), h.last_event, CAST(NULL AS DOUBLE) FROM h JOIN seen ON seen.id = h.id, mx
WHERE h.hit_rn IS NULL AND (seen.cut OR seen.last_e + {DAY_MS} < mx.max_e - {DAY_MS})""")
def stream_first_hit_cut(spark, sf):
    """L2 with L3: calls are cut three days after their first segment; a call without a
    hit reports ``s_num = -1`` when it is cut, or like a silent one."""
    stream = st.first_hit_stream(st.score_stream(spark, sf), HIT_THRESHOLD, window=3, cut_ms=CUT_DAYS_MS,
                                 watermark="1 day", silence_ms=DAY_MS)
    return finish(st.run_available_now(stream, "hit-cut").select("id", "s_num", "event_id", "p_ma"))
