"""Catalogue: token frequency, vocabulary, bag of words, IDF and TF-IDF
(documents, V1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions.fixed_values import VOCAB_TOP_K
from callscope.operators import resample, sequence, text
from callscope.plans import views
from callscope.plans.oracle import sql, u_sql
from callscope.plans.registry import finish, query
from callscope.session import cut_lineage
from callscope.sources.tables import table

BOW_K = VOCAB_TOP_K
CUM_PERCENT = 85.0
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
FREQ_SQL = ("f AS (SELECT term, COUNT(*) AS frequency FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) "
            "AS term FROM {src}) WHERE length(term) > 0 GROUP BY term)")
TOP_SQL = "v AS (SELECT term FROM f ORDER BY frequency DESC, term LIMIT {k})"
COUNT_SQL = "CAST((length(lower({t})) - length(replace(lower({t}), v.term, ''))) / length(v.term) AS BIGINT)"


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def doc_vocab(spark, sf, k=BOW_K):
    """Top-k vocabulary, materialised once."""
    return cut_lineage(text.vocabulary(text.term_frequency(docs(spark, sf)), top_k=k))


@query("corpus_token_freq", sql([], [FREQ_SQL.format(src="documents")], "SELECT term, frequency FROM f"))
def corpus_token_freq(spark, sf):
    return text.term_frequency(docs(spark, sf))


_VOCAB_SELECT = ("SELECT term, frequency, 100.0 * SUM(frequency) OVER (ORDER BY frequency DESC, term {run}) / t.total "
                 "AS cum_percent, row_number() OVER (ORDER BY frequency DESC, term) AS rank FROM f, t")


@query("vocab_cumulative_topk", sql(
    [], [FREQ_SQL.format(src="documents"), "t AS (SELECT SUM(frequency) AS total FROM f)"],
    _VOCAB_SELECT.format(run=RUN) + f" QUALIFY rank <= {VOCAB_TOP_K}", round6=["cum_percent"]))
def vocab_cumulative_topk(spark, sf):
    return finish(text.vocabulary(text.term_frequency(docs(spark, sf)), top_k=VOCAB_TOP_K))


@query("vocab_cumulative_pct", sql(
    [], [FREQ_SQL.format(src="documents"), "t AS (SELECT SUM(frequency) AS total FROM f)"],
    _VOCAB_SELECT.format(run=RUN) + f" QUALIFY cum_percent <= {CUM_PERCENT}", round6=["cum_percent"]))
def vocab_cumulative_pct(spark, sf):
    return finish(text.vocabulary(text.term_frequency(docs(spark, sf)), max_percent=CUM_PERCENT))


_BOW_CTES = [FREQ_SQL.format(src="documents"), TOP_SQL.format(k=BOW_K),
             f"tf AS (SELECT d.doc_id, v.term, {COUNT_SQL.format(t='d.text')} AS tf FROM documents d, v)",
             "tfs AS (SELECT * FROM tf WHERE tf > 0)"]
_IDF_CTES = _BOW_CTES + [
    "nd AS (SELECT COUNT(DISTINCT doc_id) AS n_docs FROM documents)",
    "dfr AS (SELECT v.term, CAST(COUNT(tfs.doc_id) AS BIGINT) AS df FROM v LEFT JOIN tfs ON v.term = tfs.term GROUP BY v.term)",
    "idf AS (SELECT dfr.term, dfr.df, nd.n_docs, ln((nd.n_docs + 1.0) / (dfr.df + 1.0)) + 1.0 AS idf FROM dfr, nd)"]


@query("bow_counts", sql([], _BOW_CTES, "SELECT doc_id, term, tf FROM tfs"))
def bow_counts(spark, sf):
    return text.bag_of_words(docs(spark, sf), doc_vocab(spark, sf), "doc_id")


@query("bow_counts_vocab776", sql(
    [], [FREQ_SQL.format(src="documents"), TOP_SQL.format(k=VOCAB_TOP_K),
         f"tf AS (SELECT d.doc_id, v.term, {COUNT_SQL.format(t='d.text')} AS tf FROM documents d, v)"],
    "SELECT doc_id, term, tf FROM tf WHERE tf > 0"))
def bow_counts_vocab776(spark, sf):
    """I1/D5 with the study's vocabulary size (776 terms), counted by letter runs:
    the cost does not grow with the number of terms (``method="runs"``)."""
    v = doc_vocab(spark, sf, VOCAB_TOP_K)
    return text.bag_of_words(docs(spark, sf), v, "doc_id", method="runs").select("doc_id", "term", "tf")


@query("doc_frequency_idf", sql([], _IDF_CTES, "SELECT term, df, n_docs, idf FROM idf", round6=["idf"]))
def doc_frequency_idf(spark, sf):
    return finish(text.fit_tfidf(docs(spark, sf), doc_vocab(spark, sf), "doc_id")[1]
                  .select("term", "df", "n_docs", "idf"))


_TFIDF_SELECT = ("w AS (SELECT tfs.doc_id, tfs.term, tfs.tf * idf.idf AS x FROM tfs JOIN idf ON tfs.term = idf.term)",
                 "SELECT doc_id, term, x / CASE WHEN sqrt(SUM(x * x) OVER (PARTITION BY doc_id)) = 0 THEN 1e-10 "
                 "ELSE sqrt(SUM(x * x) OVER (PARTITION BY doc_id)) END AS tfidf FROM w")


@query("tfidf_l2", sql([], _IDF_CTES + [_TFIDF_SELECT[0]], _TFIDF_SELECT[1], round6=["tfidf"]))
def tfidf_l2(spark, sf):
    return finish(text.fit_tfidf(docs(spark, sf), doc_vocab(spark, sf), "doc_id")[0])


_SPLIT_DOCS = [
    f"r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY {u_sql('42', 'doc_id')}, doc_id) AS rk, "
    "COUNT(*) OVER (PARTITION BY lang) AS n FROM documents)",
    "sd AS (SELECT doc_id, text, CASE WHEN rk <= ceil(n * 0.2) THEN 'test' "
    "WHEN rk <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.2) THEN 'valid' ELSE 'train' END AS split FROM r)",
    "train AS (SELECT doc_id, text FROM sd WHERE split = 'train')",
    "test AS (SELECT doc_id, text FROM sd WHERE split <> 'train')",
    FREQ_SQL.format(src="train"), TOP_SQL.format(k=BOW_K),
    f"tfs AS (SELECT * FROM (SELECT d.doc_id, v.term, {COUNT_SQL.format(t='d.text')} AS tf FROM train d, v) WHERE tf > 0)",
    "nd AS (SELECT COUNT(*) AS n_docs FROM train)",
    "dfr AS (SELECT v.term, COUNT(tfs.doc_id) AS df FROM v LEFT JOIN tfs ON v.term = tfs.term GROUP BY v.term)",
    "idf AS (SELECT dfr.term, ln((nd.n_docs + 1.0) / (dfr.df + 1.0)) + 1.0 AS idf FROM dfr, nd)",
    f"tt AS (SELECT * FROM (SELECT d.doc_id, v.term, {COUNT_SQL.format(t='d.text')} AS tf FROM test d, v) WHERE tf > 0)",
    "w AS (SELECT tt.doc_id, tt.term, tt.tf * idf.idf AS x FROM tt JOIN idf ON tt.term = idf.term)"]


@query("tfidf_apply_train_idf", sql([], _SPLIT_DOCS, _TFIDF_SELECT[1], round6=["tfidf"]))
def tfidf_apply_train_idf(spark, sf):
    """Vocabulary and IDF fitted on the train split only, applied to valid and test."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    # rank ids only; the per-language cut keys (one row per language) tag the texts in place
    cuts = cut_lineage(resample.split_cuts(d, "doc_id", "lang", 42))
    s = resample.apply_split(d, cuts, "doc_id", "lang", 42)
    train, test = s.filter("split = 'train'"), s.filter("split <> 'train'")
    v = cut_lineage(text.vocabulary(text.term_frequency(train), top_k=BOW_K))  # bounded, used twice
    _, idf = text.fit_tfidf(train, v, "doc_id", materialize=True)
    return finish(text.unpack(text.tfidf(text.bag_of_words(test, v, "doc_id", packed=True), idf), "doc_id", "tfidf"))


_TAG = "'[SPK' || CAST(speaker AS VARCHAR) || '] ' || text"


@query("prefix_tf_running", sql(
    ["v1"],
    [FREQ_SQL.format(src="v1"), TOP_SQL.format(k=BOW_K),
     f"s AS (SELECT id, seq, string_agg({_TAG}, ' ') OVER (PARTITION BY id ORDER BY seq {RUN}) AS ptext FROM v1)"],
    f"SELECT * FROM (SELECT s.id, s.seq, CAST(s.id AS VARCHAR) || '_' || CAST(s.seq AS VARCHAR) AS s_id, v.term, "
    f"{COUNT_SQL.format(t='s.ptext')} AS tf FROM s, v) WHERE tf > 0"))
def prefix_tf_running(spark, sf):
    """Term counts of every stacked prefix, keyed by both the call id and the
    segment id ``s_id`` (H20)."""
    utt = sequence.tag_speaker(views.utterances(spark, sf))
    v = cut_lineage(text.vocabulary(text.term_frequency(utt), top_k=BOW_K))
    out = text.prefix_term_frequency(utt, v)
    return out.withColumn("s_id", F.concat_ws("_", F.col("id").cast("string"), F.col("seq").cast("string")))


# --- K2: vectors of TF-IDF; prefixes of valid and test calls weighted by the train IDF ------------------

@query("tfidf_vectors", sql(
    [], [*_IDF_CTES, "px AS (SELECT term, row_number() OVER (ORDER BY frequency DESC, term) - 1 AS pos FROM f)",
         _TFIDF_SELECT[0], f"t AS ({_TFIDF_SELECT[1]})"],
    "SELECT t.doc_id, CAST(px.pos AS INTEGER) AS \"index\", t.tfidf AS value FROM t JOIN px USING (term) WHERE round(t.tfidf, 6) <> 0", round6=["value"]))
def tfidf_vectors(spark, sf):
    """The non-zero places of every document's dense vector of 776 numbers."""
    v = doc_vocab(spark, sf)
    weights, _ = text.fit_tfidf(docs(spark, sf), v, "doc_id", packed=True)
    size = v.count()  # at most the study's 776
    sparse = text.sparse_vectors(weights, text.term_index(v), docs(spark, sf).select("doc_id"))
    long = text.dense_vectors(sparse, size).select("doc_id", F.posexplode("features").alias("index", "value"))
    return finish(long.where(F.round("value", 6) != 0))


_PREFIX_CTES = [
    f"r AS (SELECT id, row_number() OVER (PARTITION BY id % 3 ORDER BY {u_sql('42', 'id')}, id) AS rk, COUNT(*) OVER (PARTITION BY id % 3) AS n "
    "FROM (SELECT DISTINCT id FROM v1))",
    "sp AS (SELECT id, CASE WHEN rk <= ceil(n * 0.2) THEN 'test' WHEN rk <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.2) THEN 'valid' "
    "ELSE 'train' END AS split FROM r)",
    f"tx AS (SELECT id, seq, split, {_TAG} AS text FROM v1 JOIN sp USING (id))",
    "train AS (SELECT id, string_agg(text, ' ' ORDER BY seq) AS text FROM tx WHERE split = 'train' GROUP BY id)",
    FREQ_SQL.format(src="train"), TOP_SQL.format(k=BOW_K),
    "nd AS (SELECT COUNT(*) AS n_docs FROM train)",
    f"dfr AS (SELECT v.term, COUNT(*) FILTER (WHERE {COUNT_SQL.format(t='train.text')} > 0) AS df FROM train, v GROUP BY v.term)",
    "idf AS (SELECT dfr.term, ln((nd.n_docs + 1.0) / (dfr.df + 1.0)) + 1.0 AS idf FROM dfr, nd)",
    f"ps AS (SELECT id, seq, split, string_agg(text, ' ') OVER (PARTITION BY id ORDER BY seq {RUN}) AS ptext FROM tx WHERE split <> 'train')",
    f"pt AS (SELECT * FROM (SELECT id, seq, split, v.term, {COUNT_SQL.format(t='ps.ptext')} AS tf FROM ps, v) WHERE tf > 0)",
    "w AS (SELECT id, seq, split, pt.term, tf * idf AS x FROM pt JOIN idf USING (term))"]


@query("prefix_tfidf_valid_test", sql(
    ["v1"], _PREFIX_CTES,
    "SELECT id, seq, split, term, x / CASE WHEN sqrt(SUM(x * x) OVER (PARTITION BY id, seq)) = 0 THEN 1e-10 "
    "ELSE sqrt(SUM(x * x) OVER (PARTITION BY id, seq)) END AS tfidf FROM w", round6=["tfidf"]))
def prefix_tfidf_valid_test(spark, sf):
    """Vocabulary and IDF of the train calls' whole texts; every prefix of the valid and test
    calls is weighted by that IDF and normalised on its own."""
    utt = sequence.tag_speaker(views.utterances(spark, sf))
    calls = utt.select("id").distinct().withColumn("__stratum", F.col("id") % 3)
    split = cut_lineage(resample.stratified_split(calls, "id", "__stratum", 42).select("id", "split"))
    utt = cut_lineage(utt.join(split, "id"))  # read by the vocabulary, the IDF and the prefixes
    train = sequence.assemble_calls(utt.where("split = 'train'"))
    v = cut_lineage(text.vocabulary(text.term_frequency(train), top_k=BOW_K))
    _, idf = text.fit_tfidf(train, v, "id")
    counts = text.prefix_term_frequency(utt.where("split <> 'train'"), v)
    return finish(text.tfidf(counts, idf, ["id", "seq"]).join(split, "id"))
