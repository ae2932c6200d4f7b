"""Catalogue: scans, sequence assembly, prefixes, slots (V1, V3, events)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from callscope.functions.fixed_values import MAX_SENTENCE
from callscope import workflows
from callscope.operators import labels, resample, sequence
from callscope.plans import views
from callscope.plans.oracle import sql, u_sql
from callscope.plans.registry import finish, query
from callscope.session import ensure_checkpoint_dir
from callscope.sources import calls as call_src
from callscope.sources import sinks
from callscope.sources.tables import table

TAG_SQL = "'[SPK' || CAST(speaker AS VARCHAR) || '] ' || text"
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _scratch(spark, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


# --- C1 C2 I10 ------------------------------------------------------------------------
@query("utterance_explode", sql(
    ["v1"], [], f"SELECT id, seq, speaker, text, start_ms, end_ms, {TAG_SQL} AS tagged FROM v1"))
def utterance_explode(spark, sf):
    calls = views.calls_nested(spark, sf)
    utt = sequence.explode_utterances(calls, "_id")
    return sequence.tag_speaker(utt)


# --- B12 F4 C2 C3 B13 ---------------------------------------------------------------------
def _assembly_sql(cut_ms: int) -> str:
    return sql(
        ["v1"],
        [f"k AS (SELECT *, MAX(end_ms) OVER (PARTITION BY id ORDER BY seq {RUN}) AS run_max FROM v1)"],
        f"SELECT id, string_agg({TAG_SQL}, ' ' ORDER BY seq) AS text, arg_max(end_ms, seq) AS end_ms, "
        f"COUNT(*) AS n_utterances FROM k WHERE run_max <= {cut_ms} GROUP BY id")


def _assembly(cut_ms):
    def run(spark, sf):
        utt = sequence.time_cut(views.utterances(spark, sf), cut_ms)
        return sequence.assemble_calls(sequence.tag_speaker(utt))
    return run


for _cut in (60, 90, 120):
    query(f"call_assembly_cut{_cut}", _assembly_sql(_cut * 1000))(_assembly(_cut * 1000))


# --- C4 C5 F3 P5 / C6 ----------------------------------------------------------------------
def _stack_sql(where: str = "") -> str:
    return sql(
        ["v1"],
        [f"s AS (SELECT id, seq, CAST(id AS VARCHAR) || '_' || CAST(seq AS VARCHAR) AS s_id, "
         f"string_agg({TAG_SQL}, ' ') OVER (PARTITION BY id ORDER BY seq {RUN}) AS text, end_ms FROM v1)"],
        "SELECT * FROM s" + (f" WHERE {where}" if where else ""))


@query("prefix_stack", _stack_sql())
def prefix_stack(spark, sf):
    return sequence.stack_prefixes(sequence.tag_speaker(views.utterances(spark, sf)))


@query("prefix_stack_cut90", sql(
    ["v1"],
    [f"k AS (SELECT *, MAX(end_ms) OVER (PARTITION BY id ORDER BY seq {RUN}) AS run_max FROM v1)",
     f"s AS (SELECT id, seq, CAST(id AS VARCHAR) || '_' || CAST(seq AS VARCHAR) AS s_id, "
     f"string_agg({TAG_SQL}, ' ') OVER (PARTITION BY id ORDER BY seq {RUN}) AS text, end_ms FROM k "
     "WHERE run_max <= 90000)"],
    "SELECT * FROM s"))
def prefix_stack_cut90(spark, sf):
    """B12 + C4: the stacked test-mode rows — prefixes of the call as heard
    until the first utterance ending after 90 s."""
    utt = sequence.time_cut(views.utterances(spark, sf), 90000)
    return sequence.stack_prefixes(sequence.tag_speaker(utt))


@query("prefix_stack_min", _stack_sql("seq >= 1 AND seq - 1 + 2 >= 3"))
def prefix_stack_min(spark, sf):
    return sequence.stack_prefixes(sequence.tag_speaker(views.utterances(spark, sf)),
                                   start_sentence=1, window_size=3)


# --- C7 C8 C9 -----------------------------------------------------------------------------------
def _wide_sql() -> str:
    cols = []
    for n in range(MAX_SENTENCE):
        cols += [f'MAX(CASE WHEN seq = {n} THEN speaker END) AS "S{n}_Speaker"',
                 f'MAX(CASE WHEN seq = {n} THEN text END) AS "S{n}"',
                 f'MAX(CASE WHEN seq = {n} THEN start_ms END) AS "S{n}_startAt"',
                 f'MAX(CASE WHEN seq = {n} THEN end_ms END) AS "S{n}_endAt"']
    return sql(["v1"], [], "SELECT id, " + ", ".join(cols) +
               f", COUNT(*) > {MAX_SENTENCE} AS truncated FROM v1 GROUP BY id")


@query("wide_slots", _wide_sql())
def wide_slots(spark, sf):
    return sequence.wide_slots(views.utterances(spark, sf), MAX_SENTENCE)


@query("wide_to_long", sql(["v1"], [], "SELECT id, seq, speaker, text, start_ms, end_ms FROM v1"))
def wide_to_long(spark, sf):
    utt = views.utterances(spark, sf)
    return sequence.wide_to_long(sequence.wide_slots(utt, MAX_SENTENCE), MAX_SENTENCE, rest=sequence.beyond_slots(utt, MAX_SENTENCE))


@query("rebuild_text_from_slots", sql(
    ["v1"], [], f"SELECT id, string_agg({TAG_SQL}, ' ' ORDER BY seq) AS text FROM v1 GROUP BY id"))
def rebuild_text_from_slots(spark, sf):
    utt = views.utterances(spark, sf)
    return sequence.rebuild_text(sequence.wide_slots(utt, MAX_SENTENCE), MAX_SENTENCE, rest=sequence.beyond_slots(utt, MAX_SENTENCE))


# --- C10 F6 ----------------------------------------------------------------------------------------
@query("last_sequence", sql(
    ["v1"], [], "SELECT * FROM v1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"))
def last_sequence(spark, sf):
    return sequence.last_sequence(views.utterances(spark, sf))


@query("last_sequence_cut", sql(
    ["v1"], [], "SELECT * FROM v1 WHERE end_ms <= 60000 "
    "QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"))
def last_sequence_cut(spark, sf):
    return sequence.last_sequence(views.utterances(spark, sf), cut_ms=60000)


# --- C11 F5 -------------------------------------------------------------------------------------------
@query("segment_ordinal", sql(
    ["v3"], [], "SELECT id, seq, CAST(row_number() OVER (PARTITION BY id ORDER BY seq) AS BIGINT) AS s_num FROM v3"))
def segment_ordinal(spark, sf):
    v3 = views.segment_scores(spark, sf).select("id", "seq")
    return sequence.segment_ordinal(v3)


# --- E29 -------------------------------------------------------------------------------------------------
@query("descriptive_stats", sql(
    ["v1"], ["e AS (SELECT id, arg_max(end_ms, seq) AS end_ms FROM v1 GROUP BY id)"],
    "SELECT AVG(end_ms) AS mean_end_ms, stddev_pop(end_ms) AS std_end_ms, MAX(end_ms) AS max_end_ms, "
    "MIN(end_ms) AS min_end_ms FROM e", round6=["mean_end_ms", "std_end_ms"]))
def descriptive_stats(spark, sf):
    last = sequence.last_sequence(views.utterances(spark, sf))
    return finish(last.agg(F.avg("end_ms").alias("mean_end_ms"),
                           F.stddev_pop("end_ms").alias("std_end_ms"),
                           F.max("end_ms").alias("max_end_ms"), F.min("end_ms").alias("min_end_ms")))


# --- E28 U2 ----------------------------------------------------------------------------------------------------
@query("distinct_ids", "SELECT DISTINCT user_id AS id FROM events")
def distinct_ids(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()


@query("dedup_rows", "SELECT DISTINCT user_id, event_type FROM events")
def dedup_rows(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type").dropDuplicates()


# --- A1 A2 A4 A5 A7 A8: scans and sinks over data Spark derives from the tables ------------------------
@query("json_scan", sql(
    ["v1"], [], "SELECT CAST(id AS VARCHAR) AS id, COUNT(*) AS n_utterances, "
    "arg_max(end_ms, seq) AS end_ms FROM v1 WHERE id % 4 <> 0 GROUP BY id"))
def json_scan(spark, sf):
    """Call records written as JSON (every 4th with a non-list symptom), scanned
    back with the declared schema, type-guarded and exploded."""
    calls = views.calls_nested(spark, sf)
    sym = F.when(F.col("_id") % 4 == 0, F.lit('"unknown"')).otherwise(F.lit('["click"]'))
    text = F.concat(F.lit('{"_id": "'), F.col("_id").cast("string"), F.lit('", "symptom": '), sym,
                    F.lit(', "utterances": '), F.to_json("utterances"), F.lit("}"))
    path = _scratch(spark, "calls-json")
    calls.select(text.alias("value")).write.mode("overwrite").text(path)
    scanned = labels.symptom_guard(call_src.read_calls(spark, path, multi_line=False))
    utt = sequence.explode_utterances(scanned, "_id")
    return utt.groupBy("id").agg(F.count(F.lit(1)).alias("n_utterances"),
                                 F.max_by("end_ms", "seq").alias("end_ms"))


@query("csv_round_trip", sql(["v4"], [], "SELECT id, p, y, 'say \"' || CAST(id AS VARCHAR) || '\", \\ ok' || chr(10) || 'next; line' AS note, "
                                         "CAST(id % 3 AS INTEGER) AS time_cut FROM v4",
                             round6=["p"]))
def csv_round_trip(spark, sf):
    """Scores written as CSV partitioned by a run parameter and read back with
    a declared schema (partition column recovered from the folder names)."""
    note = F.concat(F.lit('say "'), F.col("id").cast("string"), F.lit('", \\ ok\nnext; line'))
    v4 = views.call_scores(spark, sf).select("id", "p", "y", note.alias("note"), (F.col("id") % 3).cast("int").alias("time_cut"))
    path = _scratch(spark, "scores-csv")
    sinks.write_csv(v4, path, ["time_cut"])
    back = call_src.read_csv(spark, path, "id BIGINT, p DOUBLE, y INT, note STRING, time_cut INT")
    return finish(back)


@query("results_by_time_cut", _assembly_sql(90000))
def results_by_time_cut(spark, sf):
    """Assemblies for every cut in one table partitioned by
    ``time_cut``, read back with a partition filter (only the 90 s folder is
    scanned)."""
    parts = [_assembly(c * 1000)(spark, sf).withColumn("time_cut", F.lit(c)) for c in (60, 90, 120)]
    allc = parts[0].unionByName(parts[1]).unionByName(parts[2])
    path = _scratch(spark, "assembly-results")
    sinks.write_results(allc, path)
    return (spark.read.parquet(path).filter(F.col("time_cut") == 90)
            .select("id", "text", "end_ms", "n_utterances"))


@query("split_call_rows", sql(
    ["v1"],
    ["idx AS (SELECT DISTINCT conv_id AS id, CAST(conv_id % 3 AS INTEGER) AS label1, conv_id % 3 = 1 AS label, "
     "conv_id % 2 = 0 AS label2 FROM conversations)",
     f"r AS (SELECT *, row_number() OVER (PARTITION BY label1 ORDER BY {u_sql('42', 'id')}, id) AS rk, "
     "COUNT(*) OVER (PARTITION BY label1) AS n FROM idx)",
     "sp AS (SELECT id, label, label1, label2, CASE WHEN rk <= ceil(n * 0.2) THEN 'test' "
     "WHEN rk <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.2) THEN 'valid' ELSE 'train' END AS split FROM r)",
     f"k AS (SELECT v1.*, sp.split, sp.label, sp.label1, sp.label2, "
     f"MAX(v1.end_ms) OVER (PARTITION BY v1.id ORDER BY v1.seq {RUN}) AS run_max FROM v1 JOIN sp ON v1.id = sp.id)"],
    f"SELECT id, string_agg({TAG_SQL}, ' ' ORDER BY seq) AS text, arg_max(end_ms, seq) AS end_ms, "
    "COUNT(*) AS n_utterances, split, label, label1, label2 FROM k WHERE split = 'train' OR run_max <= 60000 "
    "GROUP BY id, split, label, label1, label2"))
def split_call_rows(spark, sf):
    """H24 with J1: call records labelled, split 64/16/20 in place (the
    transcripts are not shuffled for the split), then assembled per call with
    the 60 s cut on valid and test only."""
    calls = views.calls_nested(spark, sf)
    rec = calls.select(F.col("_id").alias("id"), "utterances",
                       (F.col("_id") % 3 == 1).alias("label"), (F.col("_id") % 3).cast("int").alias("label1"),
                       (F.col("_id") % 2 == 0).alias("label2"))
    index = resample.stratified_split(rec, "id", "label1", 42, tag_in_place=True)
    return workflows.call_rows(index, cuts={"train": None, "valid": 60000, "test": 60000})
