"""End-to-end compositions of the operators, mirroring the three stages of the
studied pipeline (SURVEY §3): call JSON -> labelled, split, assembled datasets;
text features; segment scores -> smoothed call scores, evaluation and hits.

Each function returns lazy DataFrames; persist them with ``sources.sinks`` as
stage tables (Parquet, partitioned by split / time cut) instead of CSV files.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import fixed_values as FV
from callscope.operators import hits, labels, metrics, resample, sequence, smoothing, text
from callscope.session import cut_lineage
from callscope.sources import calls as call_src

#: The time cut applies to validation and test, never to training
DEFAULT_CUTS = {"train": None, "valid": 60000, "test": 60000}


def labelled_index(spark: SparkSession, json_dir: str, media_dir: str | None = None,
                   seed: int = FV.SPLIT_SEED) -> DataFrame:
    """Stage 1a (A1, A3, B2-B5, J1, B20): one row per usable call with labels
    and a stratified 64/16/20 split on ``label1``."""
    calls = labels.symptom_guard(call_src.read_calls(spark, json_dir))
    if media_dir is not None:
        calls = call_src.with_media(calls, call_src.media_listing(spark, media_dir))
    lab = labels.label_columns(calls).withColumnRenamed("_id", "id")
    # call records carry whole transcripts: tag them in place instead of shuffling them
    return resample.stratified_split(lab, "id", "label1", seed, tag_in_place=True)


def call_rows(index: DataFrame, cuts: Mapping[str, int | None] = DEFAULT_CUTS,
              stacked: bool = False) -> DataFrame:
    """Stage 1b (C1-C5, B12, B13): assembled text per call (or per prefix with
    ``stacked``), each split cut at its own time limit; labels carried."""
    utt = sequence.tag_speaker(sequence.explode_utterances(
        index, "id", keep=("split", "label", "label1", "label2")))
    parts = []
    for split, cut in cuts.items():
        u = sequence.time_cut(utt.filter(F.col("split") == split), cut)
        if stacked:
            rows = sequence.stack_prefixes(u).join(
                u.select("id", "split", "label", "label1", "label2").distinct(), "id")
        else:
            rows = sequence.assemble_calls(u, carry=("split", "label", "label1", "label2"))
        parts.append(rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tfidf_features(rows: DataFrame, key: str = "id", top_k: int = FV.VOCAB_TOP_K,
                   tokenizer=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stage 2a (E1-E5, F1, G2, D4, H26): vocabulary and IDF fitted on the
    train split only, applied to every row.  Returns ``(tfidf, idf, vocab)``."""
    train = rows.filter(F.col("split") == "train")
    vocab = cut_lineage(text.vocabulary(text.term_frequency(train, tokenizer=tokenizer), top_k=top_k))
    _, idf = text.fit_tfidf(train, vocab, key)
    feats = text.tfidf(text.bag_of_words(rows, vocab, key), idf, key)
    return feats, idf, vocab


def evaluate_segments(segments: DataFrame, call_labels: DataFrame, window: int = 3,
                      method: str = "max", threshold: float = 0.5, n_boot: int = FV.BOOTSTRAP_ROUNDS,
                      rate: float = FV.BOOTSTRAP_RATE, seed: int = FV.SPLIT_SEED) -> dict[str, DataFrame]:
    """Stage 2b/3 evaluation (F2, E8, E13-E22, F11, J3, E25): segment scores
    ``(id, seq, p)`` -> smoothed, pooled call scores joined with ``(id, y)``
    -> metrics, 512-point sweep and the id-bootstrap summary."""
    sm = smoothing.moving_average(segments, window, ["p"])
    # the pooled call table (one row per call) feeds four results: materialise it once
    calls = cut_lineage(smoothing.call_score(sm, method).join(call_labels.select("id", "y"), "id"))
    draws = resample.bootstrap_ids(calls, "id", n_boot, rate, seed)
    per = metrics.evaluate(draws.join(calls, "id"), threshold=threshold, group=["k"])
    names = ["auroc", "ap", "f1", "accuracy", "brier", "recall", "precision", "specificity", "npv", "fdr"]
    return {
        "calls": calls,
        "metrics": metrics.evaluate(calls, threshold=threshold),
        "sweep": metrics.threshold_sweep(calls),
        "bootstrap": resample.bootstrap_summary(per, names),
    }


def first_hit_report(segments: DataFrame, times: DataFrame, threshold: float,
                     label: str = "label1") -> DataFrame:
    """Stage 3 hits (B14, D6, E10, B16, I11): first segment at or over the
    threshold per call, with its times, category and time from call start."""
    seg = hits.time_mapping(segments.withColumn("pred", labels.predict("p", threshold)), times)
    h = hits.first_hits(seg, pred="pred", label=label)
    start = times.groupBy("id").agg(F.min("start_ms").alias("__start"))
    return hits.time_to_hit(h.join(start, "id", "left"), F.col("__start")).drop("__start")
