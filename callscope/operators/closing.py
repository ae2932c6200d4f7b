"""The closing flow of a model run (A6, K9, K10, E27, B14, B15, J3, E25): winners are chosen on
the validation rows, persisted with their scaler, and score the test rows at their own
thresholds; calls are then drawn again and again for the deviations of every metric.

All configurations of all families score a row at once into one array, and that array stays
one value of the row while it is smoothed: the window moves rows, not rows x configurations.
It is unpivoted behind the window, where pooling adds it up before the next shuffle.

Pooled scores are rounded to ``DIGITS`` places, so that means which are equal stay equal in
whatever order their parts were added.

Defined results: a call without a label takes no part in the choice and keeps a null label
in the tables; equal AUROCs: the earlier configuration; where a method has no AUROC at all (a
single class) its first configuration; empty tables give empty tables, the choice then being
the first configurations.  Repeated (id, seq) rows count each.  Winners of several windows
cannot be scored together (ValueError).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators import boosting, forest, labels, logistic, metrics, resample, smoothing

METHODS = ("max", "average")
DIGITS = 9


@dataclass(frozen=True)
class Family:
    """A fitted grid under the name of its model.  ``model``: a path of penalties, boosted
    trees with the numbers of rounds in ``sizes``, or a forest with depths and sizes."""

    name: str
    model: logistic.Path | boosting.Model | boosting.Trees
    sizes: tuple[int, ...] = ()
    depths: tuple[int, ...] = ()

    @property
    def kind(self) -> str:
        return {"Path": "path", "Model": "boosted", "Trees": "forest"}[type(self.model).__name__]

    @property
    def configs(self) -> list[str]:
        if self.kind == "path":
            return self.model.names
        if self.kind == "boosted":
            return [f"{c.name}_n={n}" for c in self.model.configs for n in self.sizes]
        return [f"rf_d={d}_n={n}" for d in self.depths for n in self.sizes]

    def only(self, place: int) -> Family:
        """The family of one configuration, without what the others alone need."""
        if self.kind == "path":
            p = self.model
            return replace(self, model=logistic.Path([p.cs[place]], p.classes, p.weights[place:place + 1], p.gradients[place:place + 1], p.passes))
        first, size = divmod(place, len(self.sizes))
        n = self.sizes[size]
        if self.kind == "boosted":
            m = self.model
            kept = min(n, m.configs[first].rounds)
            trees = boosting.Trees(*[a[:kept] for a in m.trees[first].plain()])
            own = boosting.Model([replace(m.configs[first], rounds=kept)], m.classes, [trees], m.base[first:first + 1], m.n_features)
            return replace(self, model=own, sizes=(n,))
        return replace(self, model=boosting.Trees(*[a[:n] for a in self.model.plain()]), sizes=(n,), depths=(self.depths[first],))

    def probabilities(self, rows) -> np.ndarray:
        """(configuration, row): probabilities of class 1."""
        if self.kind == "path":
            p = logistic.probabilities(logistic.matrix(rows, self.model.weights.shape[2] - 1), self.model.weights)
            return p[:, 1 if p.shape[1] > 1 else 0]
        if self.kind == "boosted":
            x = boosting._matrix(rows, self.model.n_features)
            p = boosting.staged_probabilities(self.model, range(len(self.model.configs)), self.sizes, x)
        else:
            x = boosting._matrix(rows, max(int(self.model.feature.max()) + 1, 1))
            p = forest.grid_probabilities(self.model, self.depths, self.sizes, x, 1)
        return p.reshape(-1, len(rows))

    def save(self, spark: SparkSession, folder: str) -> None:
        {"path": logistic, "boosted": boosting, "forest": forest}[self.kind].save(self.model, spark, folder)


@dataclass(frozen=True)
class Winner:
    """The best configuration of a model under a pooling method, as a family of its own."""

    method: str
    window: int
    config: str
    ordinal: int
    auroc: float | None
    family: Family


def score(families: Sequence[Family], df: DataFrame, keys: Sequence[str], features: str = "features") -> DataFrame:
    """(keys.., p): the array of every configuration's probability, family after
    family, in one pass over the rows."""
    families = list(families)
    passed = df.select(*keys).schema

    def run(frames):
        for frame in frames:
            if len(frame):
                p = np.concatenate([f.probabilities(frame["__x"]) for f in families])
                yield pd.DataFrame({**{k: frame[k] for k in keys}, "p": list(p.T)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in passed.fields), "p array<double>"])
    return df.select(*keys, F.col(features).cast("array<double>").alias("__x")).mapInPandas(run, schema)


def unpivot(df: DataFrame, heads: Sequence[Mapping], keys: Sequence[str]) -> DataFrame:
    """One row for each element of ``p``, with the element's head (a value for each name)."""
    named = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in h.items()]) for h in heads])
    out = df.select(*keys, F.explode(F.arrays_zip(named.alias("h"), F.col("p").alias("p"))).alias("__s"))
    return out.select(*[F.col(f"__s.h.{k}") for k in heads[0]], *keys, "__s.p")


def select_winners(families: Sequence[Family], valid: DataFrame, call_labels: DataFrame, window: int = 3,
                   methods: Sequence[str] = METHODS, id_col: str = "id", seq: str = "seq", features: str = "features") -> list[Winner]:
    """For every model and pooling method, the configuration of the largest AUROC of
    the calls' scores.  What reaches the driver is a row for each model and method."""
    families = list(families)
    heads = [{"model": f.name, "place": i, "config": c} for f in families for i, c in enumerate(f.configs)]
    smooth = smoothing.moving_average_arrays(score(families, valid, [id_col, seq], features), window, "p", id_col, seq)
    pooled = (unpivot(smooth, heads, [id_col]).groupBy("model", "place", "config", id_col)
              .agg(F.max("p").alias("max"), F.avg("p").alias("average")))
    long = pooled.select("model", "place", "config", id_col, F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.round(m, DIGITS).alias("p")) for m in methods])).alias("__m"))
    long = long.select("model", "place", "config", "__m.method", "__m.p", id_col).join(call_labels.select(id_col, "y"), id_col)
    res = metrics.auroc_ap(long.where("y is not null"), "p", "y", ["model", "method", "place"])
    best = res.groupBy("model", "method").agg(F.max_by(F.struct("place", "auroc"), F.struct("auroc", -F.col("place"))).alias("b"))
    found = {(r.model, r.method): r.b for r in best.collect()}  # models x methods
    out = []
    for f in families:
        for m in methods:
            b = found.get((f.name, m))
            place = b.place if b else 0
            out.append(Winner(m, window, f.configs[place], place, b.auroc if b else None, f.only(place)))
    return out


def save_winners(winners: Sequence[Winner], scaler: DataFrame, spark: SparkSession, folder: str) -> None:
    """The table of winners, each one's model, and the scaler they expect."""
    base = folder.rstrip("/")
    rows = [(i, w.family.name, w.method, w.window, w.config, w.ordinal, w.auroc, w.family.kind, list(w.family.sizes), list(w.family.depths))
            for i, w in enumerate(winners)]
    for i, w in enumerate(winners):
        w.family.save(spark, f"{base}/models/{i}")
    scaler.write.mode("overwrite").parquet(f"{base}/scaler")
    # written last: a run without this table is not complete
    spark.createDataFrame(rows, "place int, model string, method string, window int, config string, ordinal int, auroc double, kind string, "
                          "sizes array<int>, depths array<int>").coalesce(1).write.mode("overwrite").parquet(f"{base}/winners")


def load_winners(spark: SparkSession, folder: str) -> tuple[list[Winner], DataFrame]:
    """What ``save_winners`` wrote: the winners, and the scaler."""
    base = folder.rstrip("/")
    load = {"path": logistic.load, "boosted": boosting.load, "forest": forest.load}
    rows = sorted(spark.read.parquet(f"{base}/winners").collect(), key=lambda r: r.place)  # models x methods
    winners = [Winner(r.method, r.window, r.config, r.ordinal, r.auroc,
                      Family(r.model, load[r.kind](spark, f"{base}/models/{r.place}"), tuple(r.sizes), tuple(r.depths))) for r in rows]
    return winners, spark.read.parquet(f"{base}/scaler")


def segment_table(winners: Sequence[Winner], test: DataFrame, call_labels: DataFrame, thresholds: Mapping[tuple[str, str], float], fallback: float,
                  id_col: str = "id", seq: str = "seq", features: str = "features") -> DataFrame:
    """(model, method, window, config, threshold, id, seq, p, pred, y): the smoothed score
    of every test segment under every winner, cut at the threshold of (model, method), or at
    ``fallback`` (the label frequency) where there is none.  All winners share one pass over the rows."""
    windows = {w.window for w in winners}
    if len(windows) != 1:
        raise ValueError(f"winners of one window are scored together, found {sorted(windows)}")
    heads = [{"model": w.family.name, "method": w.method, "window": w.window, "config": w.config,
              "threshold": float(thresholds.get((w.family.name, w.method), fallback))} for w in winners]
    smooth = smoothing.moving_average_arrays(score([w.family for w in winners], test, [id_col, seq], features), windows.pop(), "p", id_col, seq)
    long = unpivot(smooth, heads, [id_col, seq]).withColumn("p", F.round("p", DIGITS))
    return (long.join(call_labels.select(id_col, "y"), id_col, "left")
            .select("model", "method", "window", "config", "threshold", id_col, seq, "p", labels.predict("p", F.col("threshold")).alias("pred"), "y"))


def call_table(segments: DataFrame, id_col: str = "id") -> DataFrame:
    """The calls' scores from their segments, pooled as each winner was chosen."""
    head = ["model", "method", "window", "config", "threshold"]
    pooled = segments.groupBy(*head, id_col).agg(F.max("p").alias("__max"), F.avg("p").alias("__avg"), F.first("y").alias("y"))
    p = F.round(F.when(F.col("method") == "max", F.col("__max")).otherwise(F.col("__avg")), DIGITS)
    return pooled.select(*head, id_col, p.alias("p"), labels.predict(p, F.col("threshold")).alias("pred"), "y")


def bootstrap(calls: DataFrame, rounds: int = 10, rate: float = 0.75, seed: int = 42, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(metrics of every model, method and draw; their means and deviations).  All
    models are judged on the same drawn calls, each at its own threshold."""
    known = calls.where("y is not null")
    drawn = resample.bootstrap_ids(known.select(id_col).distinct(), id_col, rounds, rate, seed).join(known, id_col)
    by = ["model", "method", "k"]
    each = metrics.binary_metrics(drawn, threshold="threshold", group=by).join(metrics.auroc_ap(drawn, group=by), by)
    names = ["auroc", "ap", "f1", "accuracy", "brier", "recall", "precision", "specificity", "npv", "fdr"]
    return each, resample.bootstrap_summary(each, names, ["model", "method"])
