"""Boosted trees on binned features (K5-K8, K10): second-order and residual boosting.

All configurations of a grid grow together.  Features are binned once; a pass over the
rows adds up, for every (configuration, class, node, feature, bin), the gradients, their
curvatures and the number of rows, and the sums decide all splits of a level.  So the
passes over the data are (rounds x deepest tree), however many configurations, families
and classes there are, and a shorter configuration is the first rounds of a longer one.

Two families:

* ``newton`` — second-order boosting: gain ``(GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2)) / 2``,
  leaf ``-G/(H+l2)``, both sides with a curvature of ``min_child`` or more, margins from 0;
* ``residual`` — gradient boosting of residuals: gain ``nL nR/(nL+nR) (mean_L - mean_R)^2``, Newton
  leaves, margins from the classes' log odds.

Two classes have one tree a round (logistic), more have one tree a class a round (softmax),
so probabilities always come from joint margins.  A missing value (null or NaN) goes the way
that gained most.  Equal gains: the smaller feature, then the smaller threshold, then missing
values to the left.

Gradients are rounded to multiples of 2^-30 and added as whole numbers, so splits do not depend
on how the rows are partitioned.  Rows are cut into parts of at most about ``GROW_BYTES``, and a
task has one part for one configuration: what is shuffled grows with the number of parts,
and the configurations share the cores.  Where one part holds all rows there is nothing to
reduce, and a task grows several rounds of its configuration on its own by the same functions;
there only the smaller one of two siblings is counted, the other being the rest of their parent.
Margins are kept with the binned rows; every few rounds they are renewed and, less often,
checkpointed, so a lost executor replays a few trees only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.session import cut_lineage, ensure_checkpoint_dir

#: Rows of a forest's partition, bytes of a part here, bins of a feature, rounds between two
#: renewals (where every pass replays them: ``REPLAY``) and two checkpoints.  Several parts cost
#: two stages for every level of every round, so a part is as large as a task can well hold.
PARTITION_ROWS, GROW_BYTES, BINS, RENEW, REPLAY, CHECKPOINT = 16_384, 96 << 20, 64, 20, 4, 100
#: Bytes of a part's row besides its bins, and for each class.
ROW_BYTES, CLASS_BYTES = 40, 24
#: What a gradient of 1 counts, and bytes of trees that may be broadcast at once.
UNIT, BROADCAST_BYTES = float(1 << 30), 64 << 20
#: Values that are counted at once in a pass.
CHUNK = 1 << 17


@dataclass(frozen=True)
class Config:
    """A family at a depth, with its largest number of rounds."""

    name: str
    family: str
    depth: int
    rounds: int
    rate: float
    l2: float = 1.0
    min_child: float = 1.0

    @property
    def nodes(self) -> int:
        return 2 ** (self.depth + 1) - 1

    @property
    def counts_rows(self) -> bool:
        """Whether the gain of a split depends on the number of rows on its sides."""
        return self.family == "residual" or not self.min_child > 0


def newton_config(depth: int, rounds: int, name: str | None = None, rate: float = 0.3, **kw) -> Config:
    """K6, with the usual defaults of second-order boosting."""
    return Config(name or f"xgb_d={depth}", "newton", depth, rounds, rate, **kw)


def residual_config(depth: int, rounds: int, name: str | None = None, rate: float = 0.1) -> Config:
    """K5."""
    return Config(name or f"gbt_d={depth}", "residual", depth, rounds, rate)


@dataclass
class Trees:
    """A configuration's trees: arrays by (round, class, node), a node's children being
    2i+1 and 2i+2; feature -1 is a leaf (or no node), its value is what it adds."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, rounds: int, classes: int, nodes: int) -> Trees:
        shape = (rounds, classes, nodes)
        return cls(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape), np.zeros(shape, bool), np.zeros(shape))

    def plain(self) -> tuple:
        return tuple(getattr(self, f) for f in self.__dataclass_fields__)

    def put(self, start: int, other: Trees) -> None:
        for f in self.__dataclass_fields__:
            getattr(self, f)[start:start + len(other.feature)] = getattr(other, f)

    @property
    def bytes(self) -> int:
        return sum(a.nbytes for a in self.plain())


@dataclass
class Model:
    """``base``: margins of each configuration and class before the first round."""

    configs: list[Config]
    classes: int
    trees: list[Trees]
    base: np.ndarray
    n_features: int
    cuts: list[np.ndarray] = field(default_factory=list)

    def only(self, which: Sequence[int]) -> Model:
        """The model of some of the configurations."""
        which = list(which)
        return Model([self.configs[c] for c in which], self.classes, [self.trees[c] for c in which], self.base[which], self.n_features, self.cuts)


# binning ---------------------------------------------------------------------------

def bin_cuts(df: DataFrame, features: str = "features", bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of every feature's bins, by approximate quantiles: one aggregate of
    mergeable sketches, and (features x bins) numbers for the driver."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    x = F.when(~F.isnan("x"), F.col("x"))
    long = df.select(F.posexplode(features).alias("dim", "x")).select("dim", x.alias("x"))
    rows = long.groupBy("dim").agg(F.percentile_approx("x", F.lit(shares), 10_000).alias("q"), F.max("x").alias("top")).collect()
    out = {r.dim: np.unique(np.array([q for q in r.q or [] if q < r.top])) for r in rows}
    return [out.get(d, np.empty(0)) for d in range(max(out, default=-1) + 1)]


def binned(values: np.ndarray, cuts: list[np.ndarray], bins: int) -> np.ndarray:
    """(features, rows): the number of cuts below a value, so that bin <= t is value <= cuts[t];
    the last bin is for missing values."""
    out = np.empty((len(cuts), len(values)), np.uint8 if bins <= 256 else np.uint16)
    for f, c in enumerate(cuts):
        x = values[:, f]
        out[f] = np.where(np.isnan(x), bins - 1, np.searchsorted(c, x, side="left"))
    return out


def _matrix(lists, width: int) -> np.ndarray:
    """Rows of feature arrays; nulls, and what a short array lacks, are NaN."""
    out = np.full((len(lists), width), np.nan)
    for i, row in enumerate(lists):
        if row is not None:
            row = np.asarray(row, dtype=float)[:width]
            out[i, :len(row)] = row
    return out


# one partition -----------------------------------------------------------------------

class Part:
    """The binned rows of a partition with their margins by (configuration, class, row)."""

    def __init__(self, bins: int, x: np.ndarray, y: np.ndarray, margins: np.ndarray):
        self.bins, self.x, self.y, self.margins = bins, x, y, margins

    def plain(self) -> tuple:
        return self.bins, self.x, self.y, self.margins

    def add(self, configs: list[Config], trees: list[Trees]) -> Part:
        """With what the trees add to the margins."""
        margins = self.margins.copy()
        for c, own in enumerate(trees):
            for r in range(len(own.feature)):
                for k in range(own.feature.shape[1]):
                    margins[c, k] += own.value[r, k][self.walk(own, r, k, configs[c].depth)]
        return Part(self.bins, self.x, self.y, margins)

    def walk(self, trees: Trees, r: int, k: int, steps: int) -> np.ndarray:
        """The node of every row after at most ``steps`` splits."""
        feature, cut, left = trees.feature[r, k], trees.bin[r, k], trees.missing_left[r, k]
        at, rows = np.zeros(len(self.y), np.int64), np.arange(len(self.y))
        for _ in range(steps):
            f = feature[at]
            value = self.x[np.maximum(f, 0), rows]
            go_left = np.where(value == self.bins - 1, left[at], value <= cut[at])
            at = np.where(f < 0, at, 2 * at + 2 - go_left)
        return at

    def gradients(self, config: Config, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every class and row, in multiples of 2^-30."""
        m = self.margins[c]
        if len(m) == 1:
            p = 1.0 / (1.0 + np.exp(-m))
            g = p - self.y
        else:
            p = np.exp(m - m.max(0))
            p /= p.sum(0)
            g = p - (self.y == np.arange(len(m))[:, None])
        if config.family == "residual":
            h = np.abs(g) * (1.0 - np.abs(g))
        else:
            h = np.maximum((1.0 if len(m) == 1 else 2.0) * p * (1.0 - p), 1e-16)
        return np.rint(g * UNIT), np.rint(h * UNIT)

    def sums(self, configs: list[Config], trees: list[Trees], level: int):
        """((configuration, class), sums): whole numbers by (gradient, curvature, rows), node
        of the level, feature and bin, for every tree that may still split.  Rows that no gain
        asks for are counted on the first feature only."""
        n = len(self.y)
        first, width = 2 ** level - 1, 2 ** level
        for c, config in enumerate(configs):
            if level >= config.depth or not len(trees[c].feature):
                continue
            g, h = self.gradients(config, c)
            for k in range(len(g)):
                at = self.walk(trees[c], 0, k, level) - first
                live = np.flatnonzero(at >= 0)
                x = self.x if len(live) == n else self.x.take(live, axis=1)
                yield (c, k), self.histogram(x, at[live], width, (g[k, live], h[k, live], None), (True, True, config.counts_rows))

    def histogram(self, x: np.ndarray, at: np.ndarray, width: int, weights: tuple, whole: tuple) -> np.ndarray:
        """Sums of the weights (None: 1) by weight, node, feature and bin; of the first feature alone
        for those that are not ``whole``."""
        (n_features, n), bins = x.shape, self.bins
        out = np.zeros((3, width, n_features, bins), np.int64)
        step = min(max(1, CHUNK // max(n, 1)), max(n_features, 1))
        tiled = [np.tile(w, step) if w is not None and all_of else w for w, all_of in zip(weights, whole, strict=True)]
        first = at * bins
        for f in range(0, n_features, step):
            some = min(step, n_features - f)
            if some == 1:
                cell = first + x[f]
            else:
                cell = x[f:f + some].astype(np.int64)
                cell += first * some
                cell += (np.arange(some) * bins)[:, None]
                cell = cell.ravel()
            for i, w in enumerate(tiled):
                if whole[i]:
                    got = np.bincount(cell, None if w is None else w[:cell.size], width * some * bins)
                    out[i, :, f:f + step] = np.rint(got).astype(np.int64).reshape(width, some, bins)
        for i, w in enumerate(weights):
            if not whole[i] and n_features:
                out[i, :, 0] = np.rint(np.bincount(at * bins + x[0], w, width * bins)).astype(np.int64).reshape(width, bins)
        return out

    def grow_tree(self, config: Config, classes: int, trees: Trees, k: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree where this part holds all rows, and the node where each row ends.  Of two
        siblings the one of fewer rows is counted, and the other is what that leaves of their
        parent."""
        residual = config.family == "residual"
        whole = (True, not residual, config.counts_rows)  # residuals: curvatures of the chosen splits only
        live, at, node = np.arange(len(self.y)), np.zeros(len(self.y), np.int64), np.zeros(len(self.y), np.int64)
        sums = self.histogram(self.x, at, 1, (g, h, None), whole)
        for level in range(config.depth):
            def curvature(node: int, f: int, live=live, at=at) -> np.ndarray:
                rows = live[at == node]
                return np.bincount(self.x[f, rows], h[rows], self.bins)

            found = best_splits(config, classes, sums, curvature if residual else None)
            set_level(trees, k, level, found)
            feature, cut, left = (np.array([s[i] for s in found]) for i in (1, 2, 3))
            split = feature >= 0
            live, at = live[split[at]], at[split[at]]
            if not len(live):
                break
            value = self.x[feature[at], live]
            at = 2 * at + 1 - np.where(value == self.bins - 1, left[at], value <= cut[at])
            node[live] = 2 ** (level + 1) - 1 + at
            if level + 1 == config.depth:
                break
            parents = np.arange(len(found))
            small = np.bincount(at, minlength=2 * len(found)).reshape(-1, 2).argmin(1)
            own = (at & 1) == small[at >> 1]
            rows = live[own]
            counted = self.histogram(self.x.take(rows, axis=1), at[own] >> 1, len(found), (g[rows], h[rows], None), whole)
            rest = sums - counted
            rest[:, ~split] = 0
            sums = np.empty((3, 2 * len(found), *sums.shape[2:]), np.int64)
            sums[:, 2 * parents + small], sums[:, 2 * parents + 1 - small] = counted, rest
        return node


def best_splits(config: Config, classes: int, sums: np.ndarray, curvature=None) -> list[tuple]:
    """(gain, feature, bin, missing values left, value, value left, value right) of every node
    of a level; feature -1: no split gains.  ``curvature``: (node, feature) -> the curvatures by
    bin, where the sums have those of the first feature alone."""
    last = sums.shape[3] - 1
    out = []
    for node, (g, h, n) in enumerate(np.moveaxis(sums, 1, 0).astype(float)):
        g, h = g / UNIT, h / UNIT
        total = g[0].sum(), h[0].sum(), n[0].sum()
        best = (0.0, -1, 0, False, 0.0, 0.0)
        if total[2]:
            inner = [np.cumsum(s[:, :last], 1) for s in (g, h, n)]
            gains = []
            missing = any(s[:, last:].any() for s in (g, h, n))
            for to_left in (1.0, 0.0) if missing else (1.0,):  # without missing values both ways are one
                left = [i + to_left * s[:, last:] for i, s in zip(inner, (g, h, n), strict=True)]
                right = [t - x for t, x in zip(total, left, strict=True)]
                gains.append(_gain(config, left, right, total))
            both = np.stack(gains, -1)  # feature, bin, missing left first
            if both.size:
                at = int(np.argmax(both))
                f, b, way = np.unravel_index(at, both.shape)
                if both[f, b, way] > 1e-6:
                    own = [g[f], h[f] if curvature is None else curvature(node, f) / UNIT]
                    left = [float(np.cumsum(s[:last])[b] + (way == 0) * s[last]) for s in own]
                    best = (float(both[f, b, way]), int(f), int(b), way == 0, _leaf(config, classes, *left),
                            _leaf(config, classes, total[0] - left[0], total[1] - left[1]))
        out.append((*best[:4], _leaf(config, classes, *total[:2]) if total[2] else 0.0, *best[4:]))
    return out


def _gain(config: Config, left, right, total) -> np.ndarray:
    (gl, hl, nl), (gr, hr, nr), (g, h, _) = left, right, total
    if config.family == "residual":
        both = (nl > 0) & (nr > 0)
        nl, nr = np.maximum(nl, 1), np.maximum(nr, 1)
        return np.where(both, nl * nr / (nl + nr) * (gl / nl - gr / nr) ** 2, -np.inf)
    enough = (hl >= config.min_child) & (hr >= config.min_child)
    if config.counts_rows:  # else a side with enough curvature has rows
        enough &= (nl > 0) & (nr > 0)
    own = g * g / (h + config.l2) if h + config.l2 > 0 else 0.0
    hl, hr = np.maximum(hl + config.l2, 1e-300), np.maximum(hr + config.l2, 1e-300)
    return np.where(enough, 0.5 * (gl * gl / hl + gr * gr / hr - own), -np.inf)


def _leaf(config: Config, classes: int, g: float, h: float) -> float:
    if config.family == "residual":
        scale = 1.0 if classes == 2 else (classes - 1) / classes
        return config.rate * scale * -g / h if abs(h) > 1e-150 else 0.0
    return config.rate * -g / (h + config.l2) if h + config.l2 > 0 else 0.0


def set_level(trees: Trees, k: int, level: int, splits: list[tuple]) -> None:
    """Writes a level's splits and the values of their children into a one-round tree."""
    for i, (_, f, b, left, value, value_left, value_right) in enumerate(splits):
        node = 2 ** level - 1 + i
        if level == 0:
            trees.value[0, k, 0] = value
        if f >= 0:
            trees.feature[0, k, node], trees.bin[0, k, node], trees.missing_left[0, k, node] = f, b, left
            trees.value[0, k, 2 * node + 1], trees.value[0, k, 2 * node + 2] = value_left, value_right


# training ----------------------------------------------------------------------------

def fit(df: DataFrame, configs: Sequence[Config], features: str = "features", label: str = "label", classes: int = 2,
        bins: int = BINS, partition_rows: int | None = None) -> Model:
    """Fits all configurations together.  Rows without a label take no part; labels are
    0 .. classes-1; without rows there is no model (ValueError).  ``partition_rows``: rows of a
    part, else as many as ``GROW_BYTES`` hold."""
    configs = list(configs)
    rows = df.where(F.col(label).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))
    rows = cut_lineage(rows)
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}  # as many as classes
    if not counts or min(counts) < 0 or max(counts) >= classes:
        raise ValueError(f"labels must be 0 .. {classes - 1}, found {sorted(counts)}")
    cuts = bin_cuts(rows, "x", bins)
    width = max(map(len, cuts), default=0) + 2  # with the bin of missing values
    n = sum(counts.values())
    outputs = 1 if classes == 2 else classes
    base = np.zeros((len(configs), outputs))
    for c, config in enumerate(configs):
        if config.family == "residual":
            share = np.clip([counts.get(k, 0) / n for k in range(classes)], 1e-7, 1 - 1e-7)
            base[c] = np.log(share[1] / share[0]) if classes == 2 else np.log(share)

    def to_part(items):
        x, y = [binned(np.empty((0, len(cuts))), cuts, width)], [np.empty(0, np.int64)]
        for some in _blocks(items, 1024):
            x.append(binned(_matrix([r[0] for r in some], len(cuts)), cuts, width))
            y.append(np.array([r[1] for r in some], np.int64))
        y = np.concatenate(y)
        x = np.concatenate(x, 1)
        for c in range(len(configs)):
            yield c, (width, x, y, np.repeat(base[c:c + 1, :, None], len(y), 2))

    ensure_checkpoint_dir(df.sparkSession)
    partition_rows = partition_rows or max(1, GROW_BYTES // (len(cuts) * (1 if width <= 256 else 2) + ROW_BYTES + CLASS_BYTES * outputs))
    n_parts = max(1, -(-n // partition_rows))
    turn = {c: i for i, c in enumerate(sorted(range(len(configs)), key=lambda c: -configs[c].depth))}  # the longest tasks start first
    parts = rows.repartition(n_parts).rdd.mapPartitionsWithIndex(
        lambda i, items: ((turn[c] * n_parts + i, (c, [], part)) for c, part in to_part(items)))
    state = parts.partitionBy(n_parts * len(configs), lambda place: place).values()
    trees = _grow(state, configs, outputs, classes, n_parts == 1)
    for t in trees:  # bins back to values; beyond the last cut lie missing values alone
        for f, c in enumerate(cuts):
            of = t.feature == f
            t.threshold[of] = np.append(c, np.inf)[np.minimum(t.bin[of], len(c))]
    return Model(configs, classes, trees, base, len(cuts), cuts)


def _blocks(items, size: int):
    out = []
    for x in items:
        out.append(x)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def _grow(state, configs: list[Config], outputs: int, classes: int, alone: bool) -> list[Trees]:
    """``state``: (configuration, trees of its last rounds, the plain Part) of every part.  What
    lies in it and what tasks return are plain arrays, so that workers need no copy of this
    package.  ``alone``: one part holds all rows."""
    rounds, deepest = max(c.rounds for c in configs), max(c.depth for c in configs)
    trees = [Trees.empty(c.rounds, outputs, c.nodes) for c in configs]
    step = min(RENEW, rounds if alone else REPLAY)
    keys = min(len(configs) * outputs, state.ctx.defaultParallelism)

    def empty(c: int, r: int) -> Trees:
        return Trees.empty(int(r < configs[c].rounds), outputs, configs[c].nodes)

    def grow_alone(item: tuple, start: int, stop: int):
        """Several rounds where one part holds all rows."""
        c, part, found = item[0], Part(*item[2]), []
        own = [configs[c]]
        for r in range(start, stop):
            tree = empty(c, r)
            if len(tree.feature):
                margins = part.margins.copy()
                for k, (g, h) in enumerate(zip(*part.gradients(own[0], 0), strict=True)):
                    node = part.grow_tree(own[0], classes, tree, k, g, h)
                    margins[0, k] += tree.value[0, k][node]
                part = Part(part.bins, part.x, part.y, margins)
            found.append(tree.plain())
        return c, found, part.plain()

    def add_all(item: tuple, found: list) -> Part:
        """``found``: of every round, the plain trees of all configurations."""
        c, part = item[0], Part(*item[2])
        for own in found:
            part = part.add([configs[c]], [Trees(*own[c])])
        return part

    def level_sums(item: tuple, found: list, own: list[Trees], level: int):
        c = item[0]
        if level < configs[c].depth and len(own[c].feature):
            for (_, k), s in add_all(item, found).sums([configs[c]], [own[c]], level):
                yield (c, k), s

    def grow_together(state, start: int, stop: int):
        found = []
        for r in range(start, stop):
            own = [empty(c, r) for c in range(len(configs))]
            for level in range(deepest):
                sums = state.flatMap(lambda item, v=level: level_sums(item, found, own, v))  # noqa: B023  runs at once
                best = (sums.reduceByKey(lambda a, b: a + b, keys)
                        .map(lambda kv: (kv[0], best_splits(configs[kv[0][0]], classes, kv[1]))).collect())  # a row for each tree
                for (c, k), splits in best:
                    set_level(own[c], k, level, splits)
            found.append([t.plain() for t in own])
        return state.map(lambda item: (item[0], [own[item[0]] for own in found], add_all(item, found).plain()))

    state = state.persist(StorageLevel.MEMORY_AND_DISK)
    for start in range(0, rounds, step):
        stop = min(start + step, rounds)
        renewed = state.map(lambda item, a=start, b=stop: grow_alone(item, a, b)) if alone else grow_together(state, start, stop)
        renewed = renewed.persist(StorageLevel.MEMORY_AND_DISK)
        if stop % CHECKPOINT == 0:
            renewed.checkpoint()
        # every part of a configuration has the same trees
        grown = dict(renewed.map(lambda item: (item[0], item[1])).reduceByKey(lambda a, b: a, keys).collect())
        for c, found in grown.items():
            for r, o in enumerate(found, start):
                if len(o[0]):
                    trees[c].put(r, Trees(*o))
        state.unpersist()
        state = renewed
    state.unpersist()
    return trees


# scoring -------------------------------------------------------------------------------

def walk_values(trees: Trees, r: int, k: int, steps: int, x: np.ndarray) -> np.ndarray:
    """What a tree adds to every row of feature values (missing: NaN)."""
    feature, threshold, left = trees.feature[r, k], trees.threshold[r, k], trees.missing_left[r, k]
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(steps):
        f = feature[at]
        value = x[rows, np.maximum(f, 0)]
        go_left = np.where(np.isnan(value), left[at], value <= threshold[at])
        at = np.where(f < 0, at, 2 * at + 2 - go_left)
    return trees.value[r, k][at]


def staged_probabilities(model: Model, which: Sequence[int], stages: Sequence[int], x: np.ndarray, klass: int = 1) -> np.ndarray:
    """(configuration, stage, row): probabilities of a class, the margins being read off after
    each number of rounds; every tree is walked once."""
    out = np.empty((len(which), len(stages), len(x)))
    for i, c in enumerate(which):
        trees, config = model.trees[c], model.configs[c]
        margins = np.repeat(model.base[c][:, None], len(x), 1)
        done = 0
        for s in sorted(range(len(stages)), key=lambda s: stages[s]):
            for r in range(done, min(stages[s], config.rounds)):
                for k in range(len(margins)):
                    margins[k] += walk_values(trees, r, k, config.depth, x)
            done = max(done, stages[s])
            if len(margins) == 1:
                p = 1.0 / (1.0 + np.exp(-margins[0]))
                out[i, s] = p if klass == 1 else 1.0 - p
            else:
                e = np.exp(margins - margins.max(0))
                out[i, s] = e[klass] / e.sum(0)
    return out


def score(model: Model, df: DataFrame, keys: Sequence[str], stages: Sequence[int], features: str = "features", klass: int = 1,
          ordinal: int = 0, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(config, ordinal, keys.., p) for every configuration at every stage (its name
    ends in ``_n=<rounds>``), in one pass over the rows.  The trees are broadcast; where they
    are larger than ``limit`` bytes, the configurations are scored in several passes."""
    groups, size = [[]], 0
    for c, t in enumerate(model.trees):
        if groups[-1] and size + t.bytes > limit:
            groups.append([])
            size = 0
        groups[-1].append(c)
        size += t.bytes
    out = None
    for which in groups:
        part = _score(model, which, df, keys, list(stages), features, klass, ordinal)
        out = part if out is None else out.unionByName(part)
    return out


def _score(model: Model, which: list[int], df: DataFrame, keys: Sequence[str], stages: list[int], features: str, klass: int,
           ordinal: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast([model.trees[c].plain() for c in which])
    configs, classes, base, width = [model.configs[c] for c in which], model.classes, model.base[which], model.n_features
    passed = df.select(*keys).schema

    def run(frames):
        own = Model(configs, classes, [Trees(*t) for t in shared.value], base, width)
        for frame in frames:
            x = _matrix(frame["__x"], own.n_features)
            p = staged_probabilities(own, range(len(own.configs)), stages, x, klass)
            yield pd.DataFrame({**{k: frame[k] for k in keys}, "__p": list(np.moveaxis(p.reshape(-1, len(x)), 1, 0))})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in passed.fields), "__p array<double>"])
    rows = df.select(*keys, F.col(features).cast("array<double>").alias("__x")).mapInPandas(run, schema)
    names = [(f"{model.configs[c].name}_n={n}", ordinal + c * len(stages) + s) for c in which for s, n in enumerate(stages)]
    named = F.array(*[F.struct(F.lit(n).alias("config"), F.lit(o).alias("ordinal")) for n, o in names])
    both = F.explode(F.arrays_zip(named.alias("c"), F.col("__p").alias("p"))).alias("__s")
    return rows.select(*keys, both).select("__s.c.config", "__s.c.ordinal", *keys, "__s.p")


# persistence -----------------------------------------------------------------------------

def save(model: Model, spark: SparkSession, path: str) -> None:
    """A row for every tree."""
    rows = [(c, cfg.name, cfg.family, cfg.depth, cfg.rounds, cfg.rate, cfg.l2, cfg.min_child, model.classes, model.n_features, r, k, float(model.base[c, k]),
             t.feature[r, k].tolist(), t.bin[r, k].tolist(), t.threshold[r, k].tolist(), t.missing_left[r, k].tolist(), t.value[r, k].tolist())
            for c, (cfg, t) in enumerate(zip(model.configs, model.trees, strict=True)) for r in range(cfg.rounds) for k in range(t.feature.shape[1])]
    spark.createDataFrame(rows, "place int, name string, family string, depth int, rounds int, rate double, l2 double, min_child double, classes int, "
                          "n_features int, round int, klass int, base double, feature array<int>, bin array<int>, threshold array<double>, "
                          "missing_left array<boolean>, value array<double>").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(path).collect()  # a model, of the size that was saved
    heads = {r.place: r for r in rows}
    first = rows[0]
    outputs = 1 if first.classes == 2 else first.classes
    configs = [Config(h.name, h.family, h.depth, h.rounds, h.rate, h.l2, h.min_child) for _, h in sorted(heads.items())]
    model = Model(configs, first.classes, [Trees.empty(c.rounds, outputs, c.nodes) for c in configs], np.zeros((len(configs), outputs)), first.n_features)
    for r in rows:
        t = model.trees[r.place]
        model.base[r.place, r.klass] = r.base
        for f in Trees.__dataclass_fields__:
            getattr(t, f)[r.round, r.klass] = r[f]
    return model
