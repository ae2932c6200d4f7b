"""K3: logistic regression for a whole path of penalties at once.

The coefficients of all values of C form one matrix.  A pass over the rows multiplies every
block of rows with it and adds up the gradients and losses of all of them, so the number of
passes does not depend on how many values of C there are.  The driver holds the matrix and a
short history (configurations x classes x features numbers, whatever the rows) and takes a
limited-memory quasi-Newton step for each C that has not converged; a step is halved until
its loss has fallen enough.  Start values are 0, or those of a fitted path.

The steps begin from a curvature that all configurations share: one pass adds up the products
of the features, and the Hessian of each C is taken for a multiple of these (which follows the
last step) plus its penalty.  So correlated features cost few passes.  What the driver holds of
it is the square of the features, whatever the rows; above ``GRAM_FEATURES`` it is left out.

The objective is the mean loss plus ``|w|^2 / (2 C n)``, the intercepts being free: the one
of ``C * sum(loss) + |w|^2 / 2``.  A C has converged when no component of its gradient exceeds
``tol``.  Two classes have one logistic margin, more have one each (softmax).

Defined results: rows without a label or without features take no part; null and NaN features,
and those that a short array lacks, count as 0; without rows, or with labels other than
0 .. classes-1, there is no model (ValueError); equal rows count each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.session import cut_lineage

#: Rows of a partition and of a block, kept pairs of steps, halvings of a step.
PARTITION_ROWS, BLOCK, HISTORY, HALVINGS = 16_384, 1024, 10, 30
#: Features up to which their products are added up.
GRAM_FEATURES = 2048


@dataclass
class Path:
    """``weights``: (C, class, feature), the last feature being the intercept.
    ``gradients``: the largest component of each C's gradient; ``passes``: over the rows."""

    cs: list[float]
    classes: int
    weights: np.ndarray
    gradients: np.ndarray
    passes: int

    @property
    def names(self) -> list[str]:
        return [f"lr_C={c:.6g}" for c in self.cs]


def matrix(lists, width: int) -> np.ndarray:
    """Feature rows and a column of ones."""
    out = np.zeros((len(lists), width + 1))
    out[:, width] = 1.0
    for i, row in enumerate(lists):
        row = np.asarray([] if row is None else row, dtype=float)[:width]
        out[i, :len(row)] = np.nan_to_num(row, nan=0.0, posinf=np.inf, neginf=-np.inf)
    return out


def probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(C, class, row); with one margin, that of class 1 alone."""
    m = np.einsum("ckf,nf->ckn", weights, x, optimize=True)
    if weights.shape[1] == 1:
        return np.where(m >= 0, 1.0 / (1.0 + np.exp(-np.abs(m))), np.exp(-np.abs(m)) / (1.0 + np.exp(-np.abs(m))))
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients (C, class, feature) and losses (C) of some rows, added up."""
    m = np.einsum("ckf,nf->ckn", weights, x, optimize=True)
    if weights.shape[1] == 1:
        m = m[:, 0]
        e = np.exp(-np.abs(m))
        loss = np.log1p(e) + np.maximum(m, 0.0) - m * y
        rest = (np.where(m >= 0, 1.0, e) / (1.0 + e) - y)[:, None]
    else:
        top = m.max(1, keepdims=True)
        total = np.log(np.exp(m - top).sum(1)) + top[:, 0]
        rows = np.arange(len(y))
        loss = total - m[:, y, rows]
        rest = np.exp(m - total[:, None])
        rest[:, y, rows] -= 1.0
    return np.einsum("ckn,nf->ckf", rest, x, optimize=True), loss.sum(1)


class _Curvature:
    """Solves with ``scale`` times the mean products of the features plus a penalty on all but
    the last feature, the intercept (by its Schur complement)."""

    def __init__(self, products: np.ndarray):
        self.products = products
        values, self.vectors = np.linalg.eigh(products[:-1, :-1])
        self.values, self.cross = np.maximum(values, 0.0), self.vectors.T @ products[:-1, -1]

    def solve(self, q: np.ndarray, scale: float, penalty: float) -> np.ndarray:
        down = 1.0 / (scale * self.values + penalty)
        u, v = (q[:, :-1] @ self.vectors) * down, scale * self.cross * down
        rest = max(scale * (self.products[-1, -1] - v @ self.cross), 1e-9 * scale)
        t = (q[:, -1] - scale * (u @ self.cross)) / rest
        return np.column_stack([(u - np.outer(t, v)) @ self.vectors.T, t])

    def scale(self, s: np.ndarray, y: np.ndarray, penalty: float) -> float:
        """The multiple that a step ``s`` and its change of gradients ``y`` show."""
        own = np.einsum("kf,fg,kg->", s, self.products, s, optimize=True)
        seen = np.einsum("kf,kf->", s, y) - penalty * np.einsum("kf,kf->", s[:, :-1], s[:, :-1])
        return float(np.clip(seen / own, 1e-4, 0.5)) if own > 0 else 0.25


class _Steps:
    """The quasi-Newton state of one C."""

    def __init__(self, weights: np.ndarray, penalty: float, curvature: _Curvature | None = None):
        self.w, self.penalty, self.pairs = weights.ravel().copy(), penalty, []
        self.curvature, self.shape = curvature, weights.shape
        self.f = self.g = self.d = None
        self.step, self.halvings, self.done = 1.0, 0, False

    def trial(self) -> np.ndarray:
        return self.w if self.d is None else self.w + self.step * self.d

    def regularised(self, g: np.ndarray, f: float, width: int) -> tuple[np.ndarray, float]:
        w = self.trial().reshape(-1, width).copy()
        w[:, -1] = 0.0
        return g + self.penalty * w.ravel(), f + 0.5 * self.penalty * float((w * w).sum())

    def take(self, g: np.ndarray, f: float, width: int, tol: float) -> None:
        """Judges the trial point, given its mean gradient and loss."""
        g, f = self.regularised(g, f, width)
        if self.d is not None:
            if not f <= self.f + 1e-4 * self.step * float(self.g @ self.d) + 1e-15 * abs(self.f):
                self.step, self.halvings = self.step / 2, self.halvings + 1
                self.done = self.halvings > HALVINGS
                return
            s, yv = self.step * self.d, g - self.g
            if float(s @ yv) > 1e-12 * float(yv @ yv):
                self.pairs = [*self.pairs, (s, yv)][-HISTORY:]
            self.w = self.w + s
        first = self.d is None
        self.f, self.g = f, g
        if np.abs(g).max() <= tol:
            self.done = True
            return
        self.d = self.direction()
        if float(self.d @ g) >= 0:
            self.pairs, self.d = [], -g
        self.step, self.halvings = min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12)) if first and self.curvature is None else 1.0, 0

    def direction(self) -> np.ndarray:
        q, kept = self.g.copy(), []
        for s, y in reversed(self.pairs):
            a = float(s @ q) / float(s @ y)
            q -= a * y
            kept.append(a)
        if self.curvature is not None:
            scale = self.curvature.scale(*(v.reshape(self.shape) for v in self.pairs[-1]), self.penalty) if self.pairs else 0.25
            q = self.curvature.solve(q.reshape(self.shape), scale, self.penalty).ravel()
        elif self.pairs:
            s, y = self.pairs[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(self.pairs, reversed(kept), strict=True):
            q += s * (a - float(y @ q) / float(s @ y))
        return -q


def fit(df: DataFrame, cs: Sequence[float], features: str = "features", label: str = "label", classes: int = 2, tol: float = 1e-5,
        max_passes: int = 1000, start: Path | None = None, partition_rows: int = PARTITION_ROWS) -> Path:
    """Fits every C; see the module for the objective and the defined results."""
    cs = [float(c) for c in cs]
    rows = cut_lineage(df.where(F.col(label).isNotNull() & F.col(features).isNotNull())
                       .select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y")))
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.min("y").alias("least"), F.max("y").alias("most")).first()
    if not found.n or found.least < 0 or found.most >= classes:
        raise ValueError(f"labels must be 0 .. {classes - 1}, found {found.least} .. {found.most}")
    n, width = found.n, found.width
    outputs = 1 if classes == 2 else classes

    def blocks(items):
        held = []
        for row in items:
            held.append(row)
            if len(held) == BLOCK:
                yield matrix([r[0] for r in held], width), np.array([r[1] for r in held])
                held = []
        if held:
            yield matrix([r[0] for r in held], width), np.array([r[1] for r in held])

    data = rows.repartition(max(1, -(-n // partition_rows))).rdd.mapPartitions(blocks).persist(StorageLevel.MEMORY_AND_DISK)
    weights = np.zeros((len(cs), outputs, width + 1)) if start is None else start.weights

    def products(items):
        out = np.zeros((width + 1, width + 1))
        for x, _ in items:
            out += x.T @ x
        yield out

    curvature = None
    if width <= GRAM_FEATURES:
        found = data.mapPartitions(products).treeReduce(np.add) / n
        curvature = _Curvature(found) if np.isfinite(found).all() else None
    steps = [_Steps(w, 1.0 / (c * n), curvature) for w, c in zip(weights, cs, strict=True)]
    passes = 0
    while passes < max_passes:
        busy = [s for s in steps if not s.done]
        if not busy:
            break
        points = np.stack([s.trial().reshape(outputs, width + 1) for s in busy])
        shared = rows.sparkSession.sparkContext.broadcast(points)  # configurations x classes x features

        def one(items, shared=shared):
            g, f = np.zeros_like(shared.value), np.zeros(len(shared.value))
            for x, y in items:
                own = sums(x, y, shared.value)
                g += own[0]
                f += own[1]
            yield g, f

        g, f = data.mapPartitions(one).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
        shared.unpersist()
        for s, own, loss in zip(busy, g, f, strict=True):
            s.take(own.ravel() / n, float(loss) / n, width + 1, tol)
        passes += 1
    data.unpersist()
    gradients = np.array([np.abs(s.g).max() for s in steps])
    return Path(cs, classes, np.stack([s.w.reshape(outputs, width + 1) for s in steps]), gradients, passes)


def score(path: Path, df: DataFrame, keys: Sequence[str], features: str = "features", klass: int = 1, ordinal: int = 0) -> DataFrame:
    """K8: (config, ordinal, keys.., p) for every C, in one pass over the rows; the
    coefficients (configurations x classes x features) go along with the tasks."""
    weights = path.weights
    width = weights.shape[2] - 1
    passed = df.select(*keys).schema

    def run(frames):
        for frame in frames:
            p = probabilities(matrix(frame["__x"], width), weights)
            p = p[:, klass] if weights.shape[1] > 1 else p[:, 0] if klass == 1 else 1.0 - p[:, 0]
            yield pd.DataFrame({**{k: frame[k] for k in keys}, "__p": list(p.T)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in passed.fields), "__p array<double>"])
    rows = df.select(*keys, F.col(features).cast("array<double>").alias("__x")).mapInPandas(run, schema)
    named = F.array(*[F.struct(F.lit(name).alias("config"), F.lit(ordinal + i).alias("ordinal")) for i, name in enumerate(path.names)])
    return (rows.select(*keys, F.explode(F.arrays_zip(named.alias("c"), F.col("__p").alias("p"))).alias("__s"))
            .select("__s.c.config", "__s.c.ordinal", *keys, "__s.p"))


def save(path: Path, spark: SparkSession, folder: str) -> None:
    """A row for every C and class."""
    rows = [(i, c, path.classes, k, path.weights[i, k].tolist(), float(path.gradients[i]), path.passes)
            for i, c in enumerate(path.cs) for k in range(path.weights.shape[1])]
    spark.createDataFrame(rows, "place int, c double, classes int, klass int, weights array<double>, gradient double, passes int").write.mode("overwrite").parquet(folder)


def load(spark: SparkSession, folder: str) -> Path:
    rows = sorted(spark.read.parquet(folder).collect(), key=lambda r: (r.place, r.klass))  # a model, of the size that was saved
    heads = [r for r in rows if r.klass == 0]
    weights = np.array([r.weights for r in rows]).reshape(len(heads), -1, len(rows[0].weights))
    return Path([r.c for r in heads], heads[0].classes, weights, np.array([r.gradient for r in heads]), heads[0].passes)
