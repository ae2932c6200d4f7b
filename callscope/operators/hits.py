"""Time mapping and first-hit analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.operators.labels import outcome_category
from callscope.operators.sequence import segment_ordinal


def time_mapping(scores: DataFrame, times: DataFrame, id_col: str = "id", seq: str = "seq",
                 start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Attach start/end of the i-th utterance to the i-th segment of the
    same id; a missing slot gives NULL times.  Joined on the composite key, so a
    long call is spread over the hash partitions of ``(id, seq)``."""
    t = times.select(id_col, seq, F.col(start).alias("starttime"), F.col(end).alias("endtime"))
    return scores.join(t, [id_col, seq], "left")


def first_hits(seg: DataFrame, id_col: str = "id", seq: str = "seq", pred: str = "pred",
               label: str = "label1", start: str = "starttime", end: str = "endtime",
               dense_seq: bool = False) -> DataFrame:
    """Per id, whether any segment is predicted 1; the first such segment's
    ordinal (1-based) and times, else ``s_num = -1`` with the last segment's
    times; the call label and the outcome category.  Aggregates only (min_by /
    max_by combine map-side).  ``dense_seq=True`` declares ``seq`` to be the
    0-based position already, so the ordinal is ``seq + 1`` (no ranking pass)."""
    d = (seg.withColumn("s_num", (F.col(seq) + 1).cast("long")) if dense_seq
         else segment_ordinal(seg, id_col, seq, out="s_num"))
    hit = F.when(F.col(pred) == 1, F.col(seq))
    g = d.groupBy(id_col).agg(
        F.max(F.col(pred)).cast("int").alias("predicted_labels"),
        F.min_by(F.struct(F.col("s_num"), F.col(start).alias("s"), F.col(end).alias("e")), hit).alias("__h"),
        F.max_by(F.struct(F.col(start).alias("s"), F.col(end).alias("e")), F.col(seq)).alias("__l"),
        F.min_by(F.col(label), F.col(seq)).alias(label),
    )
    has_hit = F.col("predicted_labels") == 1
    return g.select(
        id_col,
        F.when(has_hit, F.col("__h.s_num")).otherwise(F.lit(-1)).cast("int").alias("s_num"),
        "predicted_labels",
        F.col(label).cast("int").alias(label),
        outcome_category("predicted_labels", label).alias("category"),
        F.when(has_hit, F.col("__h.s")).otherwise(F.col("__l.s")).alias("starttime"),
        F.when(has_hit, F.col("__h.e")).otherwise(F.col("__l.e")).alias("endtime"),
    )


def time_to_hit(hits: DataFrame, call_start: int | Column = 0) -> DataFrame:
    """Elapsed ms from call start (a constant or a column) to the end of
    the hit segment."""
    start = F.lit(call_start) if isinstance(call_start, int) else call_start
    return hits.withColumn("elapsed_ms", F.col("endtime") - start)
