"""K4: random forests for a whole grid of depths and sizes from one set of trees.

Trees are grown together, level by level, over binned features: a pass adds up class weights
by (tree, node, drawn feature, bin), and the sums decide the splits.  What is random is drawn
from hashes: a row's weight in a tree (Poisson with mean 1) from the tree and the row's place,
a node's features (the square root of their number) from the tree and the node.  So a forest of
fewer trees is the first trees of a larger one, a shallower tree is the top of a deeper one, and a
grid of depths and sizes costs as many passes as its deepest trees have levels (times the
groups of ``GROUP`` trees that bound what a task adds up).

Splits are by Gini impurity; a missing value goes the way that gained most; ties go to the
feature drawn first, the smaller threshold, missing values to the left.  A probability is the
mean of the leaves' class shares.  Counts are whole numbers, so splits do not depend on how
the rows are partitioned.  Rows without a label take no part; without rows, or with labels
other than 0 .. classes-1, there is no forest (ValueError).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators.boosting import BINS, PARTITION_ROWS, Trees, _blocks, _matrix, bin_cuts, binned, walk_values
from callscope.session import cut_lineage

#: Trees that are grown in one pass.
GROUP = 100
#: Poisson(1): chances of at most 0, 1, .. 9.
_AT_MOST = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])


def _hash(x: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits of 64 bits."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def row_weights(tree: int, places: np.ndarray, seed: int) -> np.ndarray:
    """How often each row counts in a tree."""
    start = _hash(np.array([seed * 1_000_003 + tree], np.uint64))
    u = (_hash(places.astype(np.uint64) ^ start) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_AT_MOST, u, side="right")


def node_features(tree: int, nodes: np.ndarray, n_features: int, seed: int) -> np.ndarray:
    """(node, drawn features): the least hashes among the features."""
    m = max(1, int(np.sqrt(n_features)))
    start = _hash(np.array([(seed * 1_000_003 + tree) ^ 0x5EED], np.uint64))
    keys = _hash(_hash(nodes.astype(np.uint64) ^ start)[:, None] ^ np.arange(n_features, dtype=np.uint64)[None, :])
    return np.argsort(keys, axis=1, kind="stable")[:, :m]


def _walk(feature, cut, left, x, steps: int, missing: int) -> np.ndarray:
    at, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
    for _ in range(steps):
        f = feature[at]
        value = x[np.maximum(f, 0), rows]
        go_left = np.where(value == missing, left[at], value <= cut[at])
        at = np.where(f < 0, at, 2 * at + 2 - go_left)
    return at


def level_counts(plain: tuple, tree: int, arrays: tuple, level: int, classes: int, bins: int, seed: int) -> np.ndarray:
    """Weights by node of the level, drawn feature, bin and class."""
    x, y, places = plain
    width, first = 2 ** level, 2 ** level - 1
    drawn = node_features(tree, np.arange(first, first + width), len(x), seed)
    at = _walk(*arrays, x, level, bins - 1) - first
    w = row_weights(tree, places, seed)
    live = np.flatnonzero((at >= 0) & (w > 0))
    at, w, m = at[live], w[live], drawn.shape[1]
    values = x[drawn[at].T, live[None, :]].astype(np.int64)
    cell = ((at[None, :] * m + np.arange(m)[:, None]) * bins + values) * classes + y[live][None, :]
    return np.bincount(cell.ravel(), np.broadcast_to(w, cell.shape).ravel(), width * m * bins * classes).astype(np.int64).reshape(width, m, bins, classes)


def best_splits(tree: int, level: int, counts: np.ndarray, n_features: int, seed: int) -> list[tuple]:
    """(feature, bin, missing values left, class weights, of the left child, of the right one)."""
    width, m, bins, _ = counts.shape
    drawn = node_features(tree, np.arange(2 ** level - 1, 2 ** (level + 1) - 1), n_features, seed)
    out = []
    for i in range(width):
        c = counts[i].astype(float)
        total = c[0].sum(0)
        n = total.sum()
        if n == 0:
            out.append((-1, 0, False, total, total, total))
            continue
        inner, gains, lefts = np.cumsum(c[:, :bins - 1], 1), [], []
        for to_left in (1.0, 0.0):
            left = inner + to_left * c[:, bins - 1:]
            right = total - left
            nl, nr = left.sum(2), right.sum(2)
            score = (left ** 2).sum(2) / np.maximum(nl, 1) + (right ** 2).sum(2) / np.maximum(nr, 1) - (total ** 2).sum() / n
            gains.append(np.where((nl > 0) & (nr > 0), score, -np.inf))
            lefts.append(left)
        both = np.stack(gains, -1)
        j, b, way = np.unravel_index(int(np.argmax(both)), both.shape)
        if both[j, b, way] > 1e-9:
            left = lefts[way][j, b]
            out.append((int(drawn[i, j]), int(b), way == 0, total, left, total - left))
        else:
            out.append((-1, 0, False, total, total, total))
    return out


def fit(df: DataFrame, trees: int, depth: int, features: str = "features", label: str = "label", classes: int = 2, bins: int = BINS,
        seed: int = 42, partition_rows: int = PARTITION_ROWS) -> Trees:
    """Arrays by (tree, class, node); two classes have the shares of class 1 alone."""
    rows = cut_lineage(df.where(F.col(label).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y")))
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}  # as many as classes
    if not counts or min(counts) < 0 or max(counts) >= classes:
        raise ValueError(f"labels must be 0 .. {classes - 1}, found {sorted(counts)}")
    cuts = bin_cuts(rows, "x", bins)
    width = max(map(len, cuts), default=0) + 2  # with the bin of missing values
    outputs = [1] if classes == 2 else list(range(classes))

    def to_part(items):
        x, y, places = [binned(np.empty((0, len(cuts))), cuts, width)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for some in _blocks(items, 1024):
            x.append(binned(_matrix([r[0] for r in some], len(cuts)), cuts, width))
            y.append(np.array([r[1] for r in some], np.int64))
            places.append(np.array([r[2] for r in some], np.int64))
        yield np.concatenate(x, 1), np.concatenate(y), np.concatenate(places)

    n_parts = max(1, -(-sum(counts.values()) // partition_rows))
    numbered = rows.withColumn("place", F.monotonically_increasing_id())  # of the checkpointed rows
    state = numbered.repartition(n_parts).rdd.mapPartitions(to_part).persist(StorageLevel.MEMORY_AND_DISK)
    n_features = len(cuts)
    out = Trees.empty(trees, len(outputs), 2 ** (depth + 1) - 1)
    for start in range(0, trees, GROUP):
        group = range(start, min(start + GROUP, trees))
        for level in range(depth):
            so_far = [(t, (out.feature[t, 0], out.bin[t, 0], out.missing_left[t, 0])) for t in group]
            found = state.flatMap(lambda p, s=so_far, v=level: ((t, level_counts(p, t, a, v, classes, width, seed)) for t, a in s))
            if n_parts > 1:
                found = found.reduceByKey(lambda a, b: a + b)
            splits = found.map(lambda kv, v=level: (kv[0], best_splits(kv[0], v, kv[1], n_features, seed))).collect()  # a row for each tree
            for t, nodes in splits:
                _set_level(out, t, level, nodes, outputs)
    state.unpersist()
    for f, c in enumerate(cuts):  # bins back to values
        of = out.feature == f
        out.threshold[of] = np.append(c, np.inf)[np.minimum(out.bin[of], len(c))]
    return out


def _set_level(out: Trees, t: int, level: int, nodes: list[tuple], outputs: list[int]) -> None:
    shares = lambda c: c[outputs] / max(c.sum(), 1)
    for i, (f, b, missing_left, total, left, right) in enumerate(nodes):
        node = 2 ** level - 1 + i
        if level == 0:
            out.value[t, :, 0] = shares(total)
        if f >= 0:
            out.feature[t, :, node], out.bin[t, :, node], out.missing_left[t, :, node] = f, b, missing_left
            out.value[t, :, 2 * node + 1], out.value[t, :, 2 * node + 2] = shares(left), shares(right)


def grid_probabilities(trees: Trees, depths: Sequence[int], sizes: Sequence[int], x: np.ndarray, klass: int) -> np.ndarray:
    """(depth, size, row): means of the shares over the first trees, walked to each depth."""
    outputs = trees.feature.shape[1]
    out = np.empty((len(depths), len(sizes), len(x)))
    for i, depth in enumerate(depths):
        sums, done = np.zeros(len(x)), 0
        for s in sorted(range(len(sizes)), key=lambda s: sizes[s]):
            for t in range(done, sizes[s]):
                sums += walk_values(trees, t, 0 if outputs == 1 else klass, depth, x)
            done = max(done, sizes[s])
            p = sums / sizes[s]
            out[i, s] = 1.0 - p if outputs == 1 and klass == 0 else p
    return out


def score(trees: Trees, df: DataFrame, keys: Sequence[str], depths: Sequence[int], sizes: Sequence[int], features: str = "features",
          klass: int = 1, ordinal: int = 0, n_features: int | None = None) -> DataFrame:
    """(config, ordinal, keys.., p) for every depth and size, in one pass over the
    rows; the trees (trees x nodes numbers) are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(trees.plain())
    width = n_features or int(trees.feature.max()) + 1
    passed = df.select(*keys).schema

    def run(frames):
        own = Trees(*shared.value)
        for frame in frames:
            x = _matrix(frame["__x"], max(width, 1))
            p = grid_probabilities(own, depths, sizes, x, klass)
            yield pd.DataFrame({**{k: frame[k] for k in keys}, "__p": list(np.moveaxis(p.reshape(-1, len(x)), 1, 0))})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in passed.fields), "__p array<double>"])
    rows = df.select(*keys, F.col(features).cast("array<double>").alias("__x")).mapInPandas(run, schema)
    names = [(f"rf_d={d}_n={n}", ordinal + i * len(sizes) + s) for i, d in enumerate(depths) for s, n in enumerate(sizes)]
    named = F.array(*[F.struct(F.lit(n).alias("config"), F.lit(o).alias("ordinal")) for n, o in names])
    return (rows.select(*keys, F.explode(F.arrays_zip(named.alias("c"), F.col("__p").alias("p"))).alias("__s"))
            .select("__s.c.config", "__s.c.ordinal", *keys, "__s.p"))


def save(trees: Trees, spark, path: str) -> None:
    """A row for every tree and class."""
    rows = [(t, k, *(a[t, k].tolist() for a in trees.plain())) for t in range(len(trees.feature)) for k in range(trees.feature.shape[1])]
    spark.createDataFrame(rows, "tree int, klass int, feature array<int>, bin array<int>, threshold array<double>, missing_left array<boolean>, "
                          "value array<double>").write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Trees:
    rows = spark.read.parquet(path).collect()  # a model, of the size that was saved
    out = Trees.empty(1 + max(r.tree for r in rows), 1 + max(r.klass for r in rows), len(rows[0].feature))
    for r in rows:
        for f in Trees.__dataclass_fields__:
            getattr(out, f)[r.tree, r.klass] = r[f]
    return out
