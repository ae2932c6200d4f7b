"""Sequence assembly over utterances keyed by ``(id, seq)``.

Every operator takes explicit id / order columns: Spark has no row order, so the
position inside a call is always data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.scalar import speaker_tag
from callscope.plans import blocked



def explode_utterances(calls: DataFrame, id_col: str = "_id",
                       arr: str = "utterances", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per utterance, array position kept as ``seq``."""
    return (calls.select(F.col(id_col).alias("id"), *keep, F.posexplode(arr).alias("seq", "u"))
            .select("id", *keep, F.col("seq").cast("long").alias("seq"),
                    F.col("u.speaker").cast("int").alias("speaker"),
                    F.col("u.text").alias("text"),
                    F.col("u.startAt").cast("long").alias("start_ms"),
                    F.col("u.endAt").cast("long").alias("end_ms")))


def tag_speaker(utt: DataFrame, out: str = "tagged") -> DataFrame:
    """``[SPK{speaker}] {text}``."""
    return utt.withColumn(out, speaker_tag("speaker", "text"))


def time_cut(utt: DataFrame, cut_ms: int | None, id_col: str = "id", seq: str = "seq",
             end_col: str = "end_ms") -> DataFrame:
    """Keep utterances before the first one whose end exceeds the cut
    (equal is kept; later, shorter ones are dropped too).  ``None`` = no cut.

    Written as an aggregate + join instead of a running-max window: the aggregate
    combines map-side, so a very long call never lands whole in one task, and
    AQE splits a skewed join partition.
    """
    if cut_ms is None:
        return utt
    first_over = (utt.filter(F.col(end_col) > F.lit(cut_ms))
                  .groupBy(id_col).agg(F.min(seq).alias("__first_over")))
    return (blocked.join_null_safe(utt, first_over, [id_col], "left")
            .filter(F.col("__first_over").isNull() | (F.col(seq) < F.col("__first_over")))
            .drop("__first_over"))


def assemble_calls(utt: DataFrame, id_col: str = "id", seq: str = "seq",
                   text_col: str = "tagged", end_col: str = "end_ms",
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per call, texts joined with one space in ``seq`` order;
    ``end_ms`` is the last kept utterance's end.  Calls without utterances do not
    appear (B13)."""
    aggs = [
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text_col))),
                                 lambda x: x[text_col]), " ").alias("text"),
        F.max_by(end_col, seq).alias(end_col),
        F.count(F.lit(1)).alias("n_utterances"),
    ] + [F.first(c).alias(c) for c in carry]
    return utt.groupBy(id_col).agg(*aggs)


def stack_prefixes(utt: DataFrame, id_col: str = "id", seq: str = "seq",
                   text_col: str = "tagged", end_col: str = "end_ms",
                   start_sentence: int = 0, window_size: int = 0) -> DataFrame:
    """One row per prefix 0..i with the joined text of the prefix,
    ``end_ms`` of utterance i and ``s_id = id_i``.

    ``start_sentence`` / ``window_size`` keep rows with ``seq >= start`` and at
    least ``window_size`` texts, where texts before ``start`` count as one.
    The text column is quadratic in the call length by definition; prefer
    ``text.prefix_term_frequency`` when only term counts are needed.
    """
    w = Window.partitionBy(id_col).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    out = (utt.withColumn("text", F.array_join(F.collect_list(text_col).over(w), " "))
           .withColumn("s_id", F.concat_ws("_", F.col(id_col).cast("string"),
                                           F.col(seq).cast("string"))))
    if start_sentence or window_size:
        n_texts = (F.col(seq) - F.lit(start_sentence) + F.lit(2) if start_sentence > 0
                   else F.col(seq) + F.lit(1))
        out = out.filter((F.col(seq) >= F.lit(start_sentence)) & (n_texts >= F.lit(window_size)))
    return out.select(id_col, seq, "s_id", "text", end_col)


def wide_slots(utt: DataFrame, max_sentence: int, id_col: str = "id", seq: str = "seq",
               end_col: str = "end_ms") -> DataFrame:
    """Long -> wide ``S{n}_Speaker, S{n}, S{n}_startAt, S{n}_endAt`` for
    n < max_sentence, null padded; ``truncated`` flags calls with more slots.

    Only positions below ``max_sentence`` (``seq`` is the 0-based position, as
    from ``explode_utterances``) are collected — ``collect_list`` skips the
    NULLs of the others — so every per-call array is bounded by the slot count
    however long the call is, and the aggregate combines map-side."""
    keep = F.col(seq) < F.lit(max_sentence)
    slot = F.struct(F.col(seq).alias("seq"), F.col("speaker").cast("int").alias("speaker"),
                    F.col("text").alias("text"), F.col("start_ms").cast("long").alias("start_ms"),
                    F.col(end_col).cast("long").alias("end_ms"))
    g = utt.groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(keep, slot))).alias("__s"),
                                (F.max(seq) >= F.lit(max_sentence)).alias("truncated"))
    cols = [F.col(id_col)]
    for n in range(max_sentence):
        one = F.get(F.col("__s"), n)  # the n-th utterance in seq order
        cols += [one["speaker"].alias(f"S{n}_Speaker"), one["text"].alias(f"S{n}"),
                 one["start_ms"].alias(f"S{n}_startAt"), one["end_ms"].alias(f"S{n}_endAt")]
    cols.append("truncated")
    return g.select(*cols)


def beyond_slots(utt: DataFrame, max_sentence: int, id_col: str = "id", seq: str = "seq",
                 end_col: str = "end_ms") -> DataFrame:
    """The utterances that ``wide_slots`` has no slot for, in long form: what calls
    flagged ``truncated`` lack.  Hand it to ``wide_to_long`` and ``rebuild_text``."""
    return (utt.filter(F.col(seq) >= F.lit(max_sentence))
            .select(id_col, F.col(seq).cast("long").alias("seq"), F.col("speaker").cast("int").alias("speaker"), "text",
                    F.col("start_ms").cast("long").alias("start_ms"), F.col(end_col).cast("long").alias("end_ms")))


def wide_to_long(wide: DataFrame, max_sentence: int, id_col: str = "id", rest: DataFrame | None = None) -> DataFrame:
    """Wide slots back to ``(id, seq, speaker, text, start_ms, end_ms)``; empty
    slots are dropped.  ``rest``: the utterances beyond the slots (``beyond_slots``)."""
    arr = F.array(*[F.struct(F.col(f"S{n}_Speaker").alias("speaker"), F.col(f"S{n}").alias("text"),
                             F.col(f"S{n}_startAt").alias("start_ms"),
                             F.col(f"S{n}_endAt").alias("end_ms"))
                    for n in range(max_sentence)])
    long = (wide.select(id_col, F.posexplode(arr).alias("seq", "s"))
            .filter(F.col("s.text").isNotNull())
            .select(id_col, F.col("seq").cast("long").alias("seq"), "s.speaker", "s.text",
                    "s.start_ms", "s.end_ms"))
    return long if rest is None else long.unionByName(rest.filter(F.col("text").isNotNull()))


def rebuild_text(wide: DataFrame, max_sentence: int, id_col: str = "id", rest: DataFrame | None = None) -> DataFrame:
    """Tagged text rebuilt from slots, stopping at the first empty slot.  ``rest``:
    the utterances beyond the slots, which follow where no slot is empty."""
    arr = F.array(*[F.struct(F.col(f"S{n}_Speaker").alias("speaker"), F.col(f"S{n}").alias("text"))
                    for n in range(max_sentence)])
    first_null = F.array_position(F.transform("__a", lambda x: x["text"].isNull()), F.lit(True))
    kept = F.when(first_null == 0, F.col("__a")).otherwise(
        F.slice("__a", 1, F.greatest(first_null - 1, F.lit(0))))
    out = (wide.select(id_col, arr.alias("__a"))
           .select(id_col, F.array_join(F.transform(kept, lambda x: speaker_tag(x["speaker"], x["text"])), " ").alias("text"),
                   (first_null == 0).alias("__full")))
    if rest is None:
        return out.drop("__full")
    empty = rest.filter(F.col("text").isNull()).groupBy(id_col).agg(F.min("seq").alias("__stop"))
    more = blocked.join_null_safe(rest, empty, [id_col], "left").filter(F.col("__stop").isNull() | (F.col("seq") < F.col("__stop")))
    more = assemble_calls(tag_speaker(more), id_col).select(id_col, F.col("text").alias("__more"))
    joined = blocked.join_null_safe(out, more, [id_col], "left")
    text = F.when(F.col("__full") & F.col("__more").isNotNull(), F.concat_ws(" ", "text", "__more")).otherwise(F.col("text"))
    return joined.select(id_col, text.alias("text"))


def last_sequence(df: DataFrame, id_col: str = "id", seq: str = "seq",
                  end_col: str = "end_ms", cut_ms: int | None = None) -> DataFrame:
    """The last row of each id, optionally among rows with ``end <= cut``.
    An aggregate (``max_by``) rather than a window: combines map-side."""
    d = df if cut_ms is None else df.filter(F.col(end_col) <= F.lit(cut_ms))
    others = [c for c in d.columns if c != id_col]
    return (d.groupBy(id_col).agg(F.max_by(F.struct(*others), F.col(seq)).alias("__r"))
            .select(id_col, "__r.*"))


def segment_ordinal(df: DataFrame, id_col: str = "id", seq: str = "seq",
                    out: str = "s_num") -> DataFrame:
    """Ordinal 1..n per id in ``seq`` order (blocked, skew-safe)."""
    return blocked.row_number(df, [id_col], [seq], blocked.seq_block(seq), out=out)
