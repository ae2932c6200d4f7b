"""Catalogue: label rules, predicates, splits, row filters (V2, V3, documents, pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions import scalar
from callscope.operators import labels, resample
from callscope.plans import views
from callscope.plans.oracle import sql, u_sql
from callscope.plans.registry import finish, query
from callscope.sources import calls as call_src
from callscope.sources.tables import table


def labelled_v2(spark, sf):
    v2 = views.symptom_lists(spark, sf)
    return labels.label_columns(v2, "symptom", arrest=views.V2_ARREST, emergency=views.V2_EMERGENCY,
                                emergency_groups=views.V2_GROUPS, cardiac=views.V2_CARDIAC)


# --- B3 B4 B5 B6 B7 P2 ----------------------------------------------------------------
@query("symptom_k_of_group", sql(
    ["v2"], [],
    "SELECT id, coalesce(list_has_any(symptom, ['purchase']), false) "
    "OR len(list_filter(symptom, lambda x: list_contains(['click', 'view'], x))) >= 2 "
    "OR len(list_filter(symptom, lambda x: list_contains(['signup', 'view'], x))) >= 2 AS hit FROM v2"))
def symptom_k_of_group(spark, sf):
    v2 = views.symptom_lists(spark, sf)
    return v2.select("id", scalar.k_of_group("symptom", views.V2_EMERGENCY, views.V2_GROUPS).alias("hit"))


@query("label_three_way", sql(["v2l"], [], "SELECT id, label1 FROM v2l"))
def label_three_way(spark, sf):
    return labelled_v2(spark, sf).select("id", "label1")


@query("label_flags", sql(["v2l"], [], "SELECT id, label, label2 FROM v2l"))
def label_flags(spark, sf):
    return labelled_v2(spark, sf).select("id", "label", "label2")


@query("label_binarise", sql(["v2l"], [], "SELECT id, CAST(CASE WHEN label1 = 1 THEN 1 ELSE 0 END AS INTEGER) AS y FROM v2l"))
def label_binarise(spark, sf):
    d = labelled_v2(spark, sf).withColumn("label1", labels.binarise("label1"))
    return labels.select_label(d, "label1")


# --- B2 ---------------------------------------------------------------------------------------
@query("list_guard", sql(
    ["v2"],
    ["j AS (SELECT id, CASE WHEN len(symptom) = 1 THEN '{\"symptom\": \"' || symptom[1] || '\"}' "
     "ELSE '{\"symptom\": ' || to_json(symptom) || '}' END AS js FROM v2)"],
    "SELECT id, CAST(json_array_length(js, '$.symptom') AS INTEGER) AS n_symptoms FROM j "
    "WHERE json_type(js, '$.symptom') = 'ARRAY'"))
def list_guard(spark, sf):
    """Records whose symptom is sometimes a bare string, parsed with a declared
    ARRAY type (non-lists become NULL) and type-guarded."""
    v2 = views.symptom_lists(spark, sf)
    js = F.when(F.size("symptom") == 1,
                F.concat(F.lit('{"symptom": "'), F.get("symptom", 0), F.lit('"}'))) \
        .otherwise(F.to_json(F.struct("symptom")))
    parsed = v2.select("id", F.from_json(js, "symptom ARRAY<STRING>").alias("r")).select("id", "r.symptom")
    return labels.symptom_guard(parsed).select("id", F.size("symptom").cast("int").alias("n_symptoms"))


# --- B1 -------------------------------------------------------------------------------------------
@query("path_parts", sql(
    [], ["n AS (SELECT page_id, string_split(url, '/')[-1] AS name FROM pages)"],
    "SELECT page_id, name, CASE WHEN contains(name, '.') THEN regexp_extract(name, '^(.*)\\.[^.]*$', 1) "
    "ELSE name END AS stem, CASE WHEN contains(name, '.') THEN string_split(name, '.')[-1] ELSE '' END AS ext FROM n"))
def path_parts(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", scalar.file_name("url").alias("name"), scalar.file_stem("url").alias("stem"),
                    scalar.file_ext("url").alias("ext"))


# --- A3 D7 ------------------------------------------------------------------------------------------
@query("media_semi_join", sql(
    [], [],
    "SELECT d.doc_id, 'calls/' || CAST(d.doc_id AS VARCHAR) || '.json' AS json_path, "
    "'wav/original/' || CAST(d.doc_id AS VARCHAR) || '.wav' AS media_path "
    "FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)"))
def media_semi_join(spark, sf):
    """Documents stand in for call files, labels for the media listing."""
    calls = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("calls/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("json_path"))
    media = table(spark, sf, "labels").select(
        F.concat(F.lit("wav/original/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("media_path"))
    media = media.withColumn("stem", scalar.file_stem("media_path"))
    return call_src.with_media(calls, media, "json_path")


# --- B9 B10 B21 ------------------------------------------------------------------------------------
@query("id_set_filter", sql(
    ["v4"], [], "SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT id FROM v4 WHERE y = 1)"))
def id_set_filter(spark, sf):
    ids = views.call_scores(spark, sf).filter("y = 1").select(F.col("id").alias("user_id"))
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return ev.join(ids, "user_id", "left_semi")


# --- B8 B22 --------------------------------------------------------------------------------------------
@query("drop_columns", sql(["v3"], [], "SELECT seq, p, label1, y FROM v3", round6=["p"]))
def drop_columns(spark, sf):
    v3 = views.segment_scores(spark, sf)
    v3 = (v3.withColumn("Unnamed: 0", F.monotonically_increasing_id())
          .withColumn("s_id", F.concat_ws("_", "id", "seq")))
    return finish(labels.feature_columns(v3))


# --- B11 -----------------------------------------------------------------------------------------------------
@query("drop_null_rows", sql(
    [], [], "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id "
    "WHERE d.lang IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL"))
def drop_null_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    lb = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return d.join(lb, "doc_id", "left").na.drop()


# --- B17 G3 -------------------------------------------------------------------------------------------------------
@query("toy_head", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def toy_head(spark, sf):
    return resample.head(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", 100)


@query("shuffle_seeded", sql(
    [], [], f"SELECT doc_id, CAST(row_number() OVER (ORDER BY {u_sql('42', 'doc_id')}, doc_id) AS BIGINT) AS position "
    "FROM documents"))
def shuffle_seeded(spark, sf):
    return resample.seeded_shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id", 42)


# --- J1 J5 F12 B20 E6 -------------------------------------------------------------------------------------------------
_SPLIT_CTES = [
    f"r AS (SELECT *, row_number() OVER (PARTITION BY label1 ORDER BY {u_sql('42', 'id')}, id) AS rk, "
    "COUNT(*) OVER (PARTITION BY label1) AS n FROM v2l)",
    "s AS (SELECT *, CASE WHEN rk <= ceil(n * 0.2) THEN 'test' "
    "WHEN rk <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.2) THEN 'valid' ELSE 'train' END AS split FROM r)"]


@query("stratified_split", sql(["v2l"], _SPLIT_CTES, "SELECT id, label1, split FROM s"))
def stratified_split(spark, sf):
    return resample.stratified_split(labelled_v2(spark, sf).select("id", "label1"), "id", "label1", 42)


@query("stratified_kfold", sql(
    ["v2l"], [], f"SELECT id, label1, CAST((row_number() OVER (PARTITION BY label1 ORDER BY {u_sql('42', 'id')}, id) - 1) % 5 AS INTEGER) AS fold FROM v2l"))
def stratified_kfold(spark, sf):
    return resample.stratified_kfold(labelled_v2(spark, sf).select("id", "label1"), 5, "id", "label1", 42)


@query("class_distribution", sql(
    ["v2l"], _SPLIT_CTES,
    "SELECT split, COUNT(*) AS n, AVG(CAST(label AS DOUBLE)) AS label_rate, "
    "AVG(CASE WHEN label1 = 0 THEN 1.0 ELSE 0.0 END) AS label1_0, AVG(CASE WHEN label1 = 1 THEN 1.0 ELSE 0.0 END) AS label1_1, "
    "AVG(CASE WHEN label1 = 2 THEN 1.0 ELSE 0.0 END) AS label1_2, AVG(CAST(label2 AS DOUBLE)) AS label2_rate FROM s GROUP BY split",
    round6=["label_rate", "label1_0", "label1_1", "label1_2", "label2_rate"]))
def class_distribution(spark, sf):
    s = resample.stratified_split(labelled_v2(spark, sf), "id", "label1", 42)
    r = lambda c: F.avg(c.cast("double"))
    return finish(s.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), r(F.col("label")).alias("label_rate"),
        r(F.col("label1") == 0).alias("label1_0"), r(F.col("label1") == 1).alias("label1_1"),
        r(F.col("label1") == 2).alias("label1_2"), r(F.col("label2")).alias("label2_rate")))


# --- B18 D11 I7 ----------------------------------------------------------------------------------------------------------
def _triage_levels():
    return [
    F.when(F.array_contains("symptom", "view"), F.size("symptom") % 5 + 1).alias("lv1"),
    F.when(F.array_contains("symptom", "click"), (F.size("symptom") + 1) % 5 + 1).alias("lv2"),
    F.when(F.array_contains("symptom", "signup"), (F.size("symptom") + 2) % 5 + 1).alias("lv3"),
    ]


@query("coalesce_triage", sql(
    ["v2"],
    ["t AS (SELECT id, CASE WHEN list_contains(symptom, 'view') THEN len(symptom) % 5 + 1 END AS lv1, "
     "CASE WHEN list_contains(symptom, 'click') THEN (len(symptom) + 1) % 5 + 1 END AS lv2, "
     "CASE WHEN list_contains(symptom, 'signup') THEN (len(symptom) + 2) % 5 + 1 END AS lv3 FROM v2)"],
    "SELECT id, CAST(coalesce(lv1, lv2, lv3) AS INTEGER) AS triage_level, "
    "CAST(CASE WHEN coalesce(lv1, lv2, lv3) <= 3 THEN 1 ELSE 0 END AS INTEGER) AS triage_label "
    "FROM t WHERE coalesce(lv1, lv2, lv3) IS NOT NULL"))
def coalesce_triage(spark, sf):
    t = views.symptom_lists(spark, sf).select("id", *_triage_levels())
    return labels.coalesce_triage(t, "lv1", "lv2", "lv3").select("id", "triage_level", "triage_label")


@query("text_tabular_join", sql(
    [], [], "SELECT d.doc_id, d.n_chars, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"))
def text_tabular_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return d.join(table(spark, sf, "labels"), "doc_id", "inner")


_BOOL_WORDS = ["yes", "No", "TRUE", "f", "Y", "n", "1", "0", "t", "false"]


@query("parse_bool", sql(
    [], [], "SELECT event_id, s, lower(trim(s)) IN ('yes', 'true', 't', 'y', '1') AS b FROM "
    "(SELECT event_id, (['" + "', '".join(_BOOL_WORDS) + "'])[CAST(event_id % 10 AS INTEGER) + 1] AS s FROM events)"))
def parse_bool(spark, sf):
    ev = table(spark, sf, "events").select("event_id")
    s = F.element_at(F.array(*[F.lit(w) for w in _BOOL_WORDS]), (F.col("event_id") % 10 + 1).cast("int"))
    return ev.select("event_id", s.alias("s")).withColumn("b", scalar.parse_bool("s"))
