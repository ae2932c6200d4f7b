"""Catalogue: token sequences, speaker fill, segment pooling, softmax metrics,
scaling (documents, V1, V5, embeddings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.operators import resample, scaling, sequence, smoothing, tokens
from callscope.plans import blocked, views
from callscope.plans.oracle import sql, u_sql
from callscope.plans.registry import finish, query
from callscope.session import cut_lineage
from callscope.sources.tables import table

MAX_LEN = 256
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
SPLIT_SQL = "list_filter(regexp_split_to_array({t}, '[ \\t\\n\\r]+'), lambda x: x <> '')"


@query("token_pad_mask", sql(
    [], [f"t AS (SELECT doc_id, {SPLIT_SQL.format(t='text')}[1:{MAX_LEN}] AS toks FROM documents)"],
    f"SELECT doc_id, array_to_string(list_resize(toks, {MAX_LEN}, '<pad>'), ' ') AS padded, "
    f"CAST(len(toks) AS INTEGER) AS n_real, CAST(CASE WHEN len(toks) = {MAX_LEN} THEN {MAX_LEN - 1} "
    f"ELSE ((len(toks) - 1) % {MAX_LEN} + {MAX_LEN}) % {MAX_LEN} END AS INTEGER) AS valid_last FROM t"))
def token_pad_mask(spark, sf):
    d = tokens.pad_sequence(table(spark, sf, "documents").select("doc_id", "text"), "text", MAX_LEN)
    return d.select("doc_id", F.array_join("tokens", " ").alias("padded"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
                    tokens.valid_last_index("tokens", MAX_LEN).alias("valid_last"))


def call_tokens(spark, sf):
    """Tokens of each call's tagged text with a leading <cls>, positions from a
    blocked running sum of per-utterance token counts (no per-call string)."""
    utt = sequence.tag_speaker(views.utterances(spark, sf))
    utt = utt.select("id", "seq", tokens.split_tokens("tagged").alias("__tk"))
    utt = utt.withColumn("__n", F.size("__tk").cast("long"))
    off = blocked.running_sum(utt, ["id"], ["seq"], blocked.seq_block("seq"), {"__end": "__n"})
    tk = off.select("id", (F.col("__end") - F.col("__n") + 1).alias("__off"),
                    F.posexplode("__tk").alias("i", "token"))
    tk = tk.select("id", (F.col("__off") + F.col("i")).cast("long").alias("pos"), "token")
    cls = utt.select("id").distinct().select("id", F.lit(0).cast("long").alias("pos"),
                                               F.lit(tokens.CLS).alias("token"))
    return tk.unionByName(cls)


@query("speaker_forward_fill", sql(
    ["v1"],
    ["a AS (SELECT id, '<cls> ' || string_agg('[SPK' || CAST(speaker AS VARCHAR) || '] ' || text, ' ' ORDER BY seq) AS t "
     "FROM v1 GROUP BY id)",
     f"k AS (SELECT id, {SPLIT_SQL.format(t='t')} AS toks FROM a)",
     "u AS (SELECT id, unnest(toks) AS token, unnest(generate_series(0, len(toks) - 1)) AS pos FROM k)",
     "m AS (SELECT *, CASE WHEN regexp_full_match(token, '\\[SPK([0-9]+)\\]') "
     "THEN CAST(regexp_extract(token, '\\[SPK([0-9]+)\\]', 1) AS INTEGER) END AS mk FROM u)"],
    "SELECT id, CAST(pos AS BIGINT) AS pos, token, CAST(CASE WHEN token IN ('<pad>', '<unk>', '<cls>', '<sep>') THEN 0 "
    f"ELSE coalesce(last_value(mk IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos {RUN}), 0) END AS INTEGER) AS spk FROM m"))
def speaker_forward_fill(spark, sf):
    # the token table is a stage boundary (token tensors): materialise it once
    return tokens.speaker_fill(cut_lineage(call_tokens(spark, sf)))


_SEG_CTES = [
    f"s AS (SELECT *, SUM(CASE WHEN is_marker AND pos > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos {RUN}) AS seg, "
    "MAX(CASE WHEN is_marker THEN pos END) OVER (PARTITION BY id) AS mlast, COUNT(*) OVER (PARTITION BY id) - 1 AS vl FROM v5)",
    "k AS (SELECT * FROM s WHERE CASE WHEN mlast IS NULL THEN pos <= vl ELSE pos < mlast OR (mlast < vl AND pos <= vl) END)",
    "sg AS (SELECT id, CAST(seg AS INTEGER) AS seg, AVG(l0) AS l0, AVG(l1) AS l1, AVG(l2) AS l2, MIN(label) AS label "
    "FROM k GROUP BY id, seg)"]


def pooled_segments(spark, sf):
    v5 = views.token_logits(spark, sf)
    seg = tokens.segment_tokens(v5, "id", "pos", "is_marker")
    return tokens.segment_mean(seg, ["l0", "l1", "l2"], carry=["label"])


@query("segment_mean_pool", sql(["v5"], _SEG_CTES, "SELECT * FROM sg", round6=["l0", "l1", "l2"]))
def segment_mean_pool(spark, sf):
    return finish(pooled_segments(spark, sf))


@query("segment_max_pool", sql(
    ["v5"], _SEG_CTES + [
        "ma AS (SELECT id, label, " + ", ".join(
            f"AVG({c}) OVER (PARTITION BY id ORDER BY seg ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS {c}"
            for c in ("l0", "l1", "l2")) + " FROM sg)",
        "mx AS (SELECT id, MAX(l0) AS l0, MAX(l1) AS l1, MAX(l2) AS l2, MIN(label) AS label FROM ma GROUP BY id)"],
    "SELECT *, exp(l1 - greatest(l0, l1, l2)) / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) "
    "+ exp(l2 - greatest(l0, l1, l2))) AS p1 FROM mx", round6=["l0", "l1", "l2", "p1"]))
def segment_max_pool(spark, sf):
    """Segment logits -> trailing mean over 3 segments -> per-class max -> softmax."""
    sg = smoothing.moving_average(pooled_segments(spark, sf), 3, ["l0", "l1", "l2"], seq="seg")
    mx = tokens.class_max(sg, ["l0", "l1", "l2"], carry=["label"])
    return finish(mx.withColumn("p1", tokens.softmax_class(["l0", "l1", "l2"], 1)))


_SOFT_CTES = [
    "x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(generate_series(0, len(embedding) - 1)) AS k FROM embeddings)",
    "m AS (SELECT vec_id, MAX(v) AS mx FROM x GROUP BY vec_id)",
    "s AS (SELECT x.vec_id, x.label, MIN(CASE WHEN x.v = m.mx THEN x.k END) AS am, SUM(exp(x.v - m.mx)) AS z, "
    "MAX(CASE WHEN x.k = x.label THEN x.v - m.mx END) AS lv FROM x JOIN m USING (vec_id) GROUP BY x.vec_id, x.label)"]


def _logits(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("logits"), "label")


@query("softmax_argmax_accuracy", sql(
    [], _SOFT_CTES, "SELECT COUNT(*) AS n, AVG(CASE WHEN am = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM s",
    round6=["accuracy"]))
def softmax_argmax_accuracy(spark, sf):
    return finish(tokens.accuracy_and_loss(_logits(spark, sf), "logits", "label").select("n", "accuracy"))


@query("cross_entropy", sql([], _SOFT_CTES, "SELECT COUNT(*) AS n, AVG(ln(z) - lv) AS cross_entropy FROM s",
                            round6=["cross_entropy"]))
def cross_entropy(spark, sf):
    return finish(tokens.accuracy_and_loss(_logits(spark, sf), "logits", "label").select("n", "cross_entropy"))


@query("standardise_features", sql(
    [],
    ["f AS (SELECT vec_id AS id, CAST(label < 3 AS INTEGER) AS y, embedding FROM embeddings)",
     f"r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {u_sql('42', 'id')}, id) AS rk, "
     "COUNT(*) OVER (PARTITION BY y) AS n FROM f)",
     "tr AS (SELECT id FROM r WHERE rk > ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.2))",
     "lg AS (SELECT id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS dim, "
     "CAST(unnest(embedding) AS DOUBLE) AS x FROM f)",
     "st AS (SELECT dim, AVG(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS std "
     "FROM lg WHERE id IN (SELECT id FROM tr) GROUP BY dim)"],
    "SELECT lg.id, lg.dim, (lg.x - st.mean) / st.std AS z FROM lg JOIN st USING (dim)", round6=["z"]))
def standardise_features(spark, sf):
    fv = views.feature_vectors(spark, sf)
    train = resample.stratified_split(fv.select("id", "y"), "id", "y", 42).filter("split = 'train'")
    sc = scaling.fit_scaler(scaling.to_long(fv.join(train.select("id"), "id", "left_semi")))
    return finish(scaling.to_long(scaling.apply_to_vectors(fv, sc)).withColumnRenamed("x", "z").select("id", "dim", "z"))
