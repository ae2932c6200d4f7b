"""Stand-in views V1-V6 over the driver tables (see FIXTURES.md part 3).

They map the benchmark tables onto the call-triage data model:

* V1 ``utterances``      conversations -> (id, seq, speaker, text, start_ms, end_ms)
* V2 ``symptom_lists``   events per (user, day) -> ordered event types as symptoms
* V3 ``segment_scores``  events -> per-user ordered scores p with labels
* V4 ``call_scores``     documents joined with labels -> (id, p, y)
* V5 ``token_logits``    embeddings x 16 positions -> (id, pos, is_marker, logits)
* V6 ``feature_vectors`` embeddings -> 64-d vectors with binary / 3-way labels

Everything is derived lazily from the parquet scans, so the work grows with the
tables.  Ordered derivations use the blocked helpers (skew-safe).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.plans import blocked
from callscope.sources.tables import table

# --- fixed values: symptom vocabulary of the event stand-in (V2) -------------
V2_ARREST = "error"
V2_EMERGENCY = ["purchase"]
V2_GROUPS = [["click", "view"], ["signup", "view"]]
V2_CARDIAC = ["purchase", "signup"]


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one row per utterance; times are 50 ms per character, cumulative."""
    c = table(spark, sf_dir, "conversations")
    u = c.select(
        F.col("conv_id").alias("id"), F.col("turn").alias("seq"),
        F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1)
        .otherwise(2).cast("int").alias("speaker"),
        "text", (F.lit(50) * F.length("text")).cast("long").alias("__dur"))
    u = blocked.running_sum(u, ["id"], ["seq"], blocked.seq_block("seq"), {"end_ms": "__dur"})
    return u.select("id", "seq", "speaker", "text",
                    (F.col("end_ms") - F.col("__dur")).cast("long").alias("start_ms"),
                    F.col("end_ms").cast("long").alias("end_ms"))


def calls_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 folded back into call records: ``(_id, utterances ARRAY<STRUCT>)`` in
    the shape of the JSON source (array order = seq)."""
    u = utterances(spark, sf_dir)
    arr = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "start_ms", "end_ms", "speaker", "text"))),
        lambda x: F.struct(x["start_ms"].alias("startAt"), x["end_ms"].alias("endAt"),
                           x["speaker"].alias("speaker"), x["text"].alias("text")))
    return u.groupBy(F.col("id").alias("_id")).agg(arr.alias("utterances"))


def symptom_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: one record per (user, day); symptoms = event types in (ts, event_id) order."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    rid = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string"))
    return (e.groupBy(rid.alias("id"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))),
                             lambda x: x["event_type"]).alias("symptom")))


def _user_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    return blocked.row_number(e, ["user_id"], ["ts", "event_id"], day, out="__rn")


def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: (id, seq, p, label1, y) — per-user ordered scores.  ``p`` is not
    rounded to 8 digits: engines round decimal ties differently, which would
    make the stand-in itself engine-dependent."""
    e = _user_seq(spark, sf_dir)
    return e.select(
        F.col("user_id").alias("id"), (F.col("__rn") - 1).cast("long").alias("seq"),
        (F.col("value") / (F.col("value") + F.lit(50.0))).alias("p"),
        (F.col("user_id") % 3).cast("int").alias("label1"),
        ((F.col("user_id") % 3) == 1).cast("int").alias("y"))


def segment_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 times: utterance slots for non-'view' events only (so some are missing)."""
    e = _user_seq(spark, sf_dir).filter(F.col("event_type") != "view")
    seq = (F.col("__rn") - 1).cast("long")
    return e.select(F.col("user_id").alias("id"), seq.alias("seq"),
                    (seq * 1000).alias("start_ms"), (seq * 1000 + 900).alias("end_ms"))


def call_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: (id, p, y) — one score per document with a quality label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lb = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lb, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.round((F.col("n_chars") % 1000) / F.lit(1000.0), 3).alias("p"),
        F.col("quality").cast("int").alias("y"))


def token_logits(spark: SparkSession, sf_dir: str, positions: int = 16) -> DataFrame:
    """V5: 16 token positions per vector with 3 class logits and a marker flag."""
    emb = table(spark, sf_dir, "embeddings")
    x = emb.select("vec_id", "embedding", "label",
                   F.explode(F.sequence(F.lit(0), F.lit(positions - 1))).alias("pos"))
    lg = [F.get(F.col("embedding"), 4 * F.col("pos") + k).cast("double") for k in (1, 2, 3)]
    return x.select(F.col("vec_id").alias("id"), F.col("pos").cast("int").alias("pos"),
                    (((F.col("vec_id") + F.col("pos")) % 5) == 0).alias("is_marker"),
                    lg[0].alias("l0"), lg[1].alias("l1"), lg[2].alias("l2"),
                    (F.col("label") % 3).cast("int").alias("label"))


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: (id, features ARRAY<DOUBLE>, y, label3)."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("id"),
                      F.col("embedding").cast("array<double>").alias("features"),
                      (F.col("label") < 3).cast("int").alias("y"),
                      (F.col("label") % 3).cast("int").alias("label3"))
