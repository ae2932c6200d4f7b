"""Catalogue: model training, scoring and selection (V6 embeddings).

Segments are embedding rows; a call is ``vec_id div 4`` with ``seq = vec_id mod 4``.
Train / valid calls come from the stratified split on the call label.
Model fits are checked rows-only; scoring is checked in SQL on models that are written down.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators import boosting, forest, logistic, metrics, ml, resample, scaling, text
from callscope.plans import q_text, views
from callscope.plans.registry import finish, query
from callscope.session import cut_lineage, ensure_checkpoint_dir

SEG_PER_CALL = 4
LR_GRID = ml.logspace(-4, 4, 100)
TREE_DEPTHS = [1, 2, 3, 4, 5]
RF_TREES = [100, 200, 300, 400, 500]
GBT_ITERS = [100, 200, 300, 400, 500]
WINDOW = 3


def prepared(spark, sf, label: str = "y"):
    """Standardised segment vectors with call keys, split by call."""
    fv = views.feature_vectors(spark, sf)
    seg = fv.select("id", (F.col("id") / SEG_PER_CALL).cast("long").alias("call"),
                    (F.col("id") % SEG_PER_CALL).alias("seq"), "features", "y", "label3")
    calls = seg.groupBy("call").agg(F.max("y").alias("y"))
    split = resample.stratified_split(calls, "call", "y", 42)
    seg = seg.join(split.select("call", "split"), "call")
    sc = scaling.fit_scaler(scaling.to_long(seg.filter("split = 'train'")))
    out = scaling.apply_to_vectors(seg, sc).withColumn("label", F.col(label).cast("double"))
    return ml.with_vector(out), calls


def boosted(*families):
    """The boosted families at every depth, with the largest number of rounds; the smaller
    numbers are read off on the way."""
    return [make(d, max(GBT_ITERS)) for make in families for d in TREE_DEPTHS]


def _scored(data, keys, cs=(), forests=False, boosted_configs=(), classes=2, persist=False):
    """Class-1 probabilities of the valid rows under every configuration of the grid, in the
    order: penalties, forests, boosted trees.  ``persist``: every model is saved and loaded
    before it scores, as by a separate scoring job (A6, K10)."""
    train, valid = data.filter("split = 'train'"), data.filter("split = 'valid'")
    spark = data.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    parts, at = [], 0
    if cs:
        path = logistic.fit(train, cs, classes=classes)
        if persist:
            logistic.save(path, spark, f"{base}/path")
            path = logistic.load(spark, f"{base}/path")
        parts.append(logistic.score(path, valid, keys))
        at = len(cs)
    if forests:
        trees = forest.fit(train, max(RF_TREES), max(TREE_DEPTHS), classes=classes)
        if persist:
            forest.save(trees, spark, f"{base}/forest")
            trees = forest.load(spark, f"{base}/forest")
        parts.append(forest.score(trees, valid, keys, TREE_DEPTHS, RF_TREES, ordinal=at))
        at += len(TREE_DEPTHS) * len(RF_TREES)
    if boosted_configs:
        model = boosting.fit(train, boosted_configs, classes=classes)
        if persist:
            boosting.save(model, spark, f"{base}/boosted")
            model = boosting.load(spark, f"{base}/boosted")
        parts.append(boosting.score(model, valid, keys, GBT_ITERS, ordinal=at))
    return reduce(DataFrame.unionByName, parts)


def _grid(spark, sf, **families):
    data, calls = prepared(spark, sf)
    scored = _scored(cut_lineage(data), ["call", "seq"], **families)
    labels = calls.select(F.col("call").alias("id"), "y")
    return ml.select_best(scored.withColumnRenamed("call", "id"), labels, window=WINDOW)


@query("train_lr_grid")
def train_lr_grid(spark, sf):
    """K3 + K9: 100 values of C, validation AUROC per pooling method."""
    res, _ = _grid(spark, sf, cs=LR_GRID)
    return finish(res.select("method", "config", "auroc"))


@query("train_rf")
def train_rf(spark, sf):
    """K4: random forest depth x tree-count grid."""
    res, _ = _grid(spark, sf, forests=True)
    return finish(res.select("method", "config", "auroc"))


@query("train_gbt")
def train_gbt(spark, sf):
    """K5: gradient boosting of residuals, depth x rounds."""
    res, _ = _grid(spark, sf, boosted_configs=boosted(boosting.residual_config))
    return finish(res.select("method", "config", "auroc"))


@query("train_xgb")
def train_xgb(spark, sf):
    """K6: second-order boosting, depth x rounds."""
    res, _ = _grid(spark, sf, boosted_configs=boosted(boosting.newton_config))
    return finish(res.select("method", "config", "auroc"))


@query("train_lr_tfidf")
def train_lr_tfidf(spark, sf):
    """K2 + K3: 100 values of C on the documents' TF-IDF vectors (776 terms); vocabulary and IDF
    are those of the train documents, AUROC that of the valid ones."""
    labelled = views.call_scores(spark, sf).select(F.col("id").alias("doc_id"), "y")
    docs = resample.stratified_split(q_text.docs(spark, sf).join(labelled, "doc_id"), "doc_id", "y", 42, tag_in_place=True)
    train = docs.where("split = 'train'")
    v = cut_lineage(text.vocabulary(text.term_frequency(train), top_k=q_text.BOW_K))
    _, idf = text.fit_tfidf(train, v, "doc_id")
    weights = text.tfidf(text.bag_of_words(docs, v, "doc_id", packed=True), idf)
    vectors = text.dense_vectors(text.sparse_vectors(weights, text.term_index(v), docs), v.count())
    data = cut_lineage(vectors.join(docs.select("doc_id", "split", "y"), "doc_id").withColumn("label", F.col("y").cast("double")))
    path = logistic.fit(data.where("split = 'train'"), LR_GRID)
    scored = logistic.score(path, data.where("split = 'valid'"), ["doc_id", "y"])
    return finish(metrics.auroc_ap(scored, "p", "y", ["config"]))


@query("score_and_select")
def score_and_select(spark, sf):
    """Every family scored into one table, best per pooling method."""
    _, best = _grid(spark, sf, cs=LR_GRID, forests=True,
                    boosted_configs=boosted(boosting.newton_config, boosting.residual_config), persist=True)
    return finish(best)


@query("three_way_model")
def three_way_model(spark, sf):
    """K7: 3-way targets (softmax path, forests, jointly boosted classes of both families);
    class-1 probability evaluated against the binarised label."""
    data, _ = prepared(spark, sf, label="label3")
    scored = _scored(cut_lineage(data), ["id", "label3"], cs=LR_GRID, forests=True,
                     boosted_configs=boosted(boosting.newton_config, boosting.residual_config), classes=3)
    ev = scored.withColumn("y", (F.col("label3") == 1).cast("int"))
    return finish(metrics.auroc_ap(ev, "p", "y", ["config"]))


#: A small forest that is written down, not fitted, so that SQL can walk it too.
LITERAL = {"features": 64, "depths": [2, 3], "rounds": 6, "stages": [2, 6]}


def literal_model(classes: int = 2) -> boosting.Model:
    """Trees whose splits and leaves follow from their numbers."""
    configs = [boosting.Config(f"literal_d={d}", "newton", d, LITERAL["rounds"], 1.0) for d in LITERAL["depths"]]
    outputs = 1 if classes == 2 else classes
    trees = []
    for config in configs:
        t = boosting.Trees.empty(config.rounds, outputs, config.nodes)
        for r in range(config.rounds):
            for k in range(outputs):
                for node in range(config.nodes):
                    key = config.depth * 1009 + r * 97 + k * 31 + node
                    if node < config.nodes // 2 and not (node and key % 5 == 0):  # some inner nodes are leaves
                        t.feature[r, k, node], t.threshold[r, k, node] = key * 7 % LITERAL["features"], (key % 9 - 4) / 16
                        t.missing_left[r, k, node] = key % 2 == 0
                    t.value[r, k, node] = (key % 11 - 5) / 8
        trees.append(t)
    return boosting.Model(configs, classes, trees, np.zeros((len(configs), outputs)), LITERAL["features"])


def literal_sql(classes: int = 2, klass: int = 1) -> str:
    """The same walk as nested CASE expressions over ``embeddings``."""
    model = literal_model(classes)

    def walk(t, r, k, node):
        f = int(t.feature[r, k, node])
        if f < 0:
            return str(float(t.value[r, k, node]))
        x = f"CAST(embedding[{f + 1}] AS DOUBLE)"
        left, right = walk(t, r, k, 2 * node + 1), walk(t, r, k, 2 * node + 2)
        missing = left if t.missing_left[r, k, node] else right
        return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN {missing} WHEN {x} <= {float(t.threshold[r, k, node])} THEN {left} ELSE {right} END"

    parts = []
    for c, (config, t) in enumerate(zip(model.configs, model.trees, strict=True)):
        for s, n in enumerate(LITERAL["stages"]):
            m = [" + ".join(walk(t, r, k, 0) for r in range(n)) for k in range(t.feature.shape[1])]
            p = f"1 / (1 + exp(-({m[0]})))" if classes == 2 else f"exp({m[klass]}) / ({' + '.join(f'exp({x})' for x in m)})"
            parts.append(f"SELECT '{config.name}_n={n}' AS config, {c * len(LITERAL['stages']) + s} AS ordinal, vec_id AS id, round({p}, 6) AS p FROM embeddings")
    return " UNION ALL ".join(parts)


@query("score_trees_staged", literal_sql())
def score_trees_staged(spark, sf):
    """A grid of written-down trees over all vectors, read off after 2 and 6 rounds."""
    return finish(boosting.score(literal_model(), views.feature_vectors(spark, sf), ["id"], LITERAL["stages"]))


@query("score_trees_three_way", literal_sql(3))
def score_trees_three_way(spark, sf):
    """K7/K8: joint probabilities of three classes."""
    return finish(boosting.score(literal_model(3), views.feature_vectors(spark, sf), ["id"], LITERAL["stages"]))


def literal_path(classes: int = 3) -> logistic.Path:
    """Coefficients that follow from their numbers."""
    cs = [0.01, 1.0, 100.0]
    weights = np.array([[[((c * 13 + k * 29 + f * 7) % 17 - 8) / 32 for f in range(65)] for k in range(1 if classes == 2 else classes)] for c in range(len(cs))])
    return logistic.Path(cs, classes, weights, np.zeros(len(cs)), 0)


def literal_path_sql(classes: int = 3, klass: int = 1) -> str:
    path = literal_path(classes)
    parts = []
    for i, (name, w) in enumerate(zip(path.names, path.weights, strict=True)):
        m = [f"(list_dot_product(CAST(embedding AS DOUBLE[]), {row[:-1].tolist()}::DOUBLE[]) + {row[-1]})" for row in w]
        p = f"1 / (1 + exp(-{m[0]}))" if classes == 2 else f"exp({m[klass]}) / ({' + '.join(f'exp({x})' for x in m)})"
        parts.append(f"SELECT '{name}' AS config, {i} AS ordinal, vec_id AS id, round({p}, 6) AS p FROM embeddings")
    return " UNION ALL ".join(parts)


@query("score_path", literal_path_sql(2))
def score_path(spark, sf):
    """K3/K8: a path of written-down coefficients over all vectors."""
    return finish(logistic.score(literal_path(2), views.feature_vectors(spark, sf), ["id"]))


@query("score_path_three_way", literal_path_sql(3))
def score_path_three_way(spark, sf):
    """K3/K7: joint probabilities of three classes."""
    return finish(logistic.score(literal_path(3), views.feature_vectors(spark, sf), ["id"]))
