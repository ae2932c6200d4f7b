"""Model training, scoring and selection with ``pyspark.ml``.

Configurations are *data*: every fitted model scores the evaluation rows into
one long table keyed by ``config``, and the selection objective — AUROC after
per-call smoothing and pooling — is computed for all configurations in one
grouped job (``metrics.auroc_ap`` with ``config`` as a group column).  Fits run
concurrently from a small driver thread pool, the way ``CrossValidator`` does
with ``parallelism``; each fit is itself a distributed Spark job.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       LogisticRegressionModel, OneVsRest, OneVsRestModel,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators import metrics, smoothing

#: Rows of a task of a boosted fit, and models that are chained in one plan.
BOOST_ROWS, CHAIN = 16_384, 25


def logspace(lo: float, hi: float, n: int) -> list[float]:
    """``n`` points 10**lo .. 10**hi (numpy.logspace)."""
    if n == 1:
        return [10.0 ** lo]
    return [10.0 ** (lo + (hi - lo) * i / (n - 1)) for i in range(n)]


def with_vector(df: DataFrame, features: str = "features", out: str = "fv") -> DataFrame:
    """K2: ``ARRAY<DOUBLE>`` -> ml ``Vector``."""
    return df.withColumn(out, array_to_vector(F.col(features)))


def long_to_dense(long: DataFrame, size: int, id_col: str = "id", index: str = "dim",
                  value: str = "z", out: str = "features") -> DataFrame:
    """K2: sparse long ``(id, index, value)`` -> dense array of ``size``
    (missing entries 0); the map per id is bounded by ``size``."""
    m = long.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct(index, value))).alias("__m"))
    return m.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                                        lambda i: F.coalesce(F.element_at("__m", i), F.lit(0.0))
                                        .cast("double")).alias(out))


def lr_configs(cs: Sequence[float], n_train: int, multinomial: bool = False) -> list[tuple[str, Estimator]]:
    """K3: sklearn's ``C`` maps to ``regParam = 1 / (C * n)`` with no elastic net,
    no internal standardisation, and sklearn's default tolerance (1e-4) and
    iteration cap (100)."""
    fam = "multinomial" if multinomial else "binomial"
    return [(f"lr_C={c:.6g}", LogisticRegression(featuresCol="fv", labelCol="label", regParam=1.0 / (c * n_train),
                                                 elasticNetParam=0.0, standardization=False,
                                                 maxIter=100, tol=1e-4, family=fam))
            for c in cs]


def rf_configs(depths: Sequence[int], trees: Sequence[int], seed: int = 42) -> list[tuple[str, Estimator]]:
    """K4: random forest grid (every depth x tree count)."""
    return [(f"rf_d={d}_n={n}", RandomForestClassifier(featuresCol="fv", labelCol="label", maxDepth=d,
                                                       numTrees=n, seed=seed))
            for d in depths for n in trees]


def gbt_configs(depths: Sequence[int], iters: Sequence[int], seed: int = 42,
                multiclass: bool = False) -> list[tuple[str, Estimator]]:
    """K5/K6: gradient-boosted trees (binary; ``OneVsRest`` for more classes).
    The XGBoost family of the source is served by the same estimator."""
    out = []
    for d in depths:
        for n in iters:
            g = GBTClassifier(featuresCol="fv", labelCol="label", maxDepth=d, maxIter=n, seed=seed)
            if multiclass:
                g = OneVsRest(classifier=g, featuresCol="fv", labelCol="label")
            out.append((f"gbt_d={d}_n={n}", g))
    return out


def _booster(estimator: Estimator) -> GBTClassifier | None:
    inner = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    return inner if isinstance(inner, GBTClassifier) else None


def _shared(name: str, estimator: Estimator) -> tuple:
    """Equal for boosted configurations that differ in the number of iterations alone."""
    booster = _booster(estimator)
    if booster is None or booster.isDefined("validationIndicatorCol"):
        return (name, id(estimator))
    return (type(estimator).__name__, repr(sorted((p.name, v) for p, v in booster.extractParamMap().items()
                                                  if p.name != "maxIter")))


def first_trees(model: Model, n: int) -> Model:
    """The boosted model of the first ``n`` iterations: each tree is fitted to what the
    earlier ones leave, so it equals a fit with ``maxIter = n``."""
    if isinstance(model, OneVsRestModel):
        out = model.copy()
        out.models = [first_trees(m, n) for m in model.models]
        return out
    if n >= model.getNumTrees:
        return model
    jvm, whole = SparkSession.active()._jvm, model._java_obj
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        f"{model.uid}_{n}", whole.trees()[:n], whole.treeWeights()[:n],
        model.numFeatures, model.numClasses)
    out = GBTClassificationModel(cut)
    model._copyValues(out)
    return out._set(maxIter=n)


def fit_all(configs: Sequence[tuple[str, Estimator]], train: DataFrame,
            parallelism: int = 4) -> list[tuple[str, Model]]:
    """Fit every configuration; ``parallelism`` concurrent Spark jobs.  Boosted
    configurations that differ in the number of iterations alone are one fit of the
    largest number, of which the others are the first trees."""
    largest: dict[tuple, Estimator] = {}
    for name, e in configs:
        key, booster = _shared(name, e), _booster(e)
        if key not in largest or booster is not None and booster.getMaxIter() > _booster(largest[key]).getMaxIter():
            largest[key] = e
    few = train
    if any(_booster(e) is not None for e in largest.values()):
        # a boosting iteration is a job for each level: no more tasks than the rows need
        few = train.coalesce(max(1, n_rows(train) // BOOST_ROWS))
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        fits = list(pool.map(lambda e: e.fit(train if _booster(e) is None else few), largest.values()))
    fitted = dict(zip(largest, fits, strict=True))
    out = []
    for name, e in configs:
        model, booster = fitted[_shared(name, e)], _booster(e)
        out.append((name, model if booster is None else first_trees(model, booster.getMaxIter())))
    return out


def score_all(models: Sequence[tuple[str, Model]], df: DataFrame, keys: Sequence[str],
              klass: int = 1) -> DataFrame:
    """Class-``klass`` probability of every row under every model, one
    long table ``(config, ordinal, keys..., p)``.  The models are chained on the
    same rows (each writes its own output columns), so all of them are applied
    in one narrow pass, then the per-model columns are unpivoted."""
    d = df
    outs = []
    for i, (name, m) in enumerate(models):
        m = m.copy()
        setters = () if isinstance(m, OneVsRestModel) else (
            ("setPredictionCol", f"__pred{i}"), ("setRawPredictionCol", f"__raw{i}"),
            ("setProbabilityCol", f"__prob{i}"))
        for setter, col in setters:
            if hasattr(m, setter):
                getattr(m, setter)(col)
        before = set(d.columns)
        d = m.transform(d)
        for new in set(d.columns) - before:  # models that ignore the column setters
            if not new.startswith("__"):
                d = d.withColumnRenamed(new, f"__{new}{i}")
        src = next(c for c in (f"__prob{i}", f"__probability{i}", f"__raw{i}", f"__rawPrediction{i}")
                   if c in d.columns)
        outs.append(F.struct(F.lit(name).alias("config"), F.lit(i).alias("ordinal"),
                             F.get(vector_to_array(F.col(src)), klass).alias("p")))
    return (d.select(*keys, F.explode(F.array(*outs)).alias("__s"))
            .select("__s.config", "__s.ordinal", *keys, "__s.p"))


def score_linear(models: Sequence[tuple[str, Model]], df: DataFrame, keys: Sequence[str],
                 features: str = "features") -> DataFrame:
    """K8 for binary logistic models in one plan: the fitted coefficients form a
    small table (configs x features, bounded by the grid) that is broadcast and
    applied with JVM-side array arithmetic, instead of one ``transform`` per
    model."""
    spark = df.sparkSession
    rows = [(name, i, [float(x) for x in m.coefficients.toArray()], float(m.intercept))
            for i, (name, m) in enumerate(models)]
    coef = spark.createDataFrame(rows, "config STRING, ordinal INT, w ARRAY<DOUBLE>, b DOUBLE")
    margin = F.col("b") + F.aggregate(F.zip_with("w", features, lambda a, x: a * x), F.lit(0.0),
                                      lambda acc, v: acc + v)
    return (df.select(*keys, features).crossJoin(F.broadcast(coef))
            .select("config", "ordinal", *keys, (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias("p")))


def score_grid(models: Sequence[tuple[str, Model]], df: DataFrame, keys: Sequence[str],
               klass: int = 1) -> DataFrame:
    """K8/K10 for a grid of several families: binary logistic models by their
    coefficients, the others chained ``CHAIN`` at a time; ordinals are places in
    ``models``."""
    linear = [i for i, (_, m) in enumerate(models) if isinstance(m, LogisticRegressionModel) and m.numClasses == 2
              and klass == 1]
    others = [i for i in range(len(models)) if i not in set(linear)]
    parts = [(linear, score_linear)] if linear else []
    parts += [(others[at:at + CHAIN], lambda *a: score_all(*a, klass=klass)) for at in range(0, len(others), CHAIN)]
    out = None
    for places, score in parts:
        own = score([models[i] for i in places], df, keys).withColumn(
            "ordinal", F.element_at(F.lit(places), F.col("ordinal") + 1))
        out = own if out is None else out.unionByName(own)
    return out


def select_best(scored: DataFrame, labels: DataFrame, window: int = 0,
                methods: Sequence[str] = ("max", "average"), id_col: str = "id",
                seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Per config, smooth segment scores per call (F2), pool per call
    (E8), join the call labels and compute AUROC; the best configuration per
    pooling method wins by AUROC, ties to the first config (strict ``>``).
    Returns ``(all_results, winners)``."""
    sm = smoothing.moving_average(scored, window, ["p"], id_col=["config", "ordinal", id_col], seq=seq)
    pooled = sm.groupBy("config", "ordinal", id_col).agg(F.max("p").alias("max"), F.avg("p").alias("average"))
    long = pooled.select("config", "ordinal", id_col, F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(m).alias("p")) for m in methods])).alias("__m"))
    long = long.select("config", "ordinal", id_col, "__m.method", "__m.p").join(labels, id_col)
    res = metrics.auroc_ap(long, "p", "y", ["method", "config", "ordinal"])
    best = (res.groupBy("method")
            .agg(F.max_by(F.struct("config", "ordinal", "auroc"), F.struct(F.col("auroc"), -F.col("ordinal")))
                 .alias("b")).select("method", "b.config", "b.ordinal", "b.auroc"))
    return res, best


def save_models(models: Sequence[tuple[str, Model]], base: str) -> list[tuple[str, str, type]]:
    """Persist every fitted configuration under ``base/<ordinal>``;
    returns ``(config, path, model class)`` entries."""
    out = []
    for i, (name, m) in enumerate(models):
        path = f"{base.rstrip('/')}/{i}"
        m.write().overwrite().save(path)
        out.append((name, path, type(m)))
    return out


def load_models(saved: Sequence[tuple[str, str, type]]) -> list[tuple[str, Model]]:
    """Load saved configurations back for grid-wide scoring."""
    return [(name, cls.load(path)) for name, path, cls in saved]


def n_rows(df: DataFrame) -> int:
    """Row count for parameters that scale with the training size (one scalar)."""
    return int(df.count())


__all__ = ["logspace", "with_vector", "long_to_dense", "lr_configs", "rf_configs", "gbt_configs",
           "fit_all", "first_trees", "score_all", "score_linear", "score_grid", "select_best", "n_rows", "save_models", "load_models"]
