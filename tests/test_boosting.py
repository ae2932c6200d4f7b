"""Boosting equals a slow direct fit, whatever the partitions; scores are read off in stages."""

import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.operators import boosting as B


def rows(n, classes, seed, missing=0.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [round(rng.gauss(0, 1), 1), float(rng.randrange(3)), round(rng.random(), 1), 7.0]
        y = int(x[0] + x[1] > 1) + (int(x[2] > 0.6) if classes > 2 else 0)
        x = [None if rng.random() < missing else (float("nan") if rng.random() < missing / 2 else v) for v in x]
        out.append((i, x, y if rng.random() < 0.9 else rng.randrange(classes)))
    return out


def frame(spark, data, parts=1):
    return spark.createDataFrame(data, "id long, features array<double>, label int").repartition(parts)


class Direct:
    """Boosting row by row: every threshold between two values, both ways for missing ones."""

    def __init__(self, config, classes, data):
        self.c, self.k, self.x = config, classes, [[float("nan") if v is None else v for v in r[1]] for r in data]
        self.y = [r[2] for r in data]
        outputs = 1 if classes == 2 else classes
        share = [self.y.count(k) / len(self.y) for k in range(classes)]
        start = [math.log(share[1] / share[0])] if classes == 2 else [math.log(s) for s in share]
        self.base = start if config.family == "residual" else [0.0] * outputs
        self.m = [list(self.base) for _ in data]
        self.rounds = []
        for _ in range(config.rounds):
            trees = []
            for k in range(outputs):
                g, h = zip(*(self.gradient(m, y, k) for m, y in zip(self.m, self.y)))
                trees.append(self.node(list(range(len(data))), [round(v * 2**30) / 2**30 for v in g], [round(v * 2**30) / 2**30 for v in h], 0))
            for i, x in enumerate(self.x):
                for k, t in enumerate(trees):
                    self.m[i][k] += self.value(t, x)
            self.rounds.append(trees)

    def probability(self, m):
        if len(m) == 1:
            return [1 - 1 / (1 + math.exp(-m[0])), 1 / (1 + math.exp(-m[0]))]
        e = [math.exp(v - max(m)) for v in m]
        return [v / sum(e) for v in e]

    def gradient(self, m, y, k):
        p = self.probability(m)[1 if len(m) == 1 else k]
        g = p - (y if len(m) == 1 else (y == k))
        if self.c.family == "residual":
            return g, abs(g) * (1 - abs(g))
        return g, max((1 if len(m) == 1 else 2) * p * (1 - p), 1e-16)

    def leaf(self, G, H):
        if self.c.family == "residual":
            return self.c.rate * (1 if self.k == 2 else (self.k - 1) / self.k) * -G / H if abs(H) > 1e-150 else 0.0
        return self.c.rate * -G / (H + self.c.l2)

    def node(self, at, g, h, depth):
        total = lambda s: (math.fsum(g[i] for i in s), math.fsum(h[i] for i in s), len(s))
        G, H, _ = total(at)
        best = None
        if depth < self.c.depth:
            for f in range(len(self.x[0])):
                values = sorted({x[f] for x in self.x if not math.isnan(x[f])})
                for t in [*values[:-1], math.inf]:
                    for missing_left in (True, False):
                        left = [i for i in at if (missing_left if math.isnan(self.x[i][f]) else self.x[i][f] <= t)]
                        right = [i for i in at if i not in set(left)]
                        if not left or not right:
                            continue
                        (gl, hl, nl), (gr, hr, nr) = total(left), total(right)
                        if self.c.family == "residual":
                            gain = nl * nr / (nl + nr) * (gl / nl - gr / nr) ** 2
                        elif min(hl, hr) < self.c.min_child:
                            continue
                        else:
                            gain = 0.5 * (gl * gl / (hl + self.c.l2) + gr * gr / (hr + self.c.l2) - G * G / (H + self.c.l2))
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, f, t, missing_left, left, right)
        if best is None:
            return self.leaf(G, H)
        _, f, t, missing_left, left, right = best
        return f, t, missing_left, self.node(left, g, h, depth + 1), self.node(right, g, h, depth + 1)

    def value(self, tree, x):
        while isinstance(tree, tuple):
            f, t, missing_left, left, right = tree
            tree = left if (missing_left if math.isnan(x[f]) else x[f] <= t) else right
        return tree


def splits(model, c, r, k, node=0):
    t = model.trees[c]
    f = int(t.feature[r, k, node])
    if f < 0:
        return float(t.value[r, k, node])
    return (f, float(t.threshold[r, k, node]), bool(t.missing_left[r, k, node]), splits(model, c, r, k, 2 * node + 1), splits(model, c, r, k, 2 * node + 2))


def same(a, b):
    """Equal features and ways of every row; a way for missing values matters only where there are some."""
    if not isinstance(a, tuple) or not isinstance(b, tuple):
        return not isinstance(a, tuple) and not isinstance(b, tuple) and a == pytest.approx(b, abs=1e-7)
    return a[0] == b[0] and a[1] == b[1] and same(a[3], b[3]) and same(a[4], b[4])


@pytest.mark.parametrize("classes,missing", [(2, 0.0), (2, 0.2), (3, 0.15)])
def test_equals_a_direct_fit(spark, classes, missing):
    data = rows(70, classes, 4, missing)
    configs = [B.newton_config(3, 3), B.residual_config(2, 3), B.newton_config(1, 2, min_child=3.0, l2=0.5)]
    model = B.fit(frame(spark, data), configs, classes=classes, bins=200)
    for c, config in enumerate(configs):
        direct = Direct(config, classes, data)
        for r, trees in enumerate(direct.rounds):
            for k, tree in enumerate(trees):
                assert same(splits(model, c, r, k), tree), (config.name, r, k)
        got = {(x.config, x.id): x.p for x in B.score(model, frame(spark, data), ["id"], [config.rounds]).collect()}
        for row, m in zip(data, direct.m):
            assert got[f"{config.name}_n={config.rounds}", row[0]] == pytest.approx(direct.probability(m)[1], abs=1e-6)


def test_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(B, "RENEW", 2)
    monkeypatch.setattr(B, "CHECKPOINT", 4)
    monkeypatch.setattr(B, "CHUNK", 50)
    data = rows(90, 3, 8, 0.1)
    configs = [B.newton_config(2, 5), B.residual_config(3, 3)]
    one = B.fit(frame(spark, data), configs, classes=3)
    many = B.fit(frame(spark, data, 3), configs, classes=3, partition_rows=25)
    for a, b in zip(one.trees, many.trees):
        assert (a.feature == b.feature).all() and (a.threshold == b.threshold).all() and (a.missing_left == b.missing_left).all()
        assert np.allclose(a.value, b.value, atol=1e-9)


def test_stages_passes_and_a_saved_model(spark):
    data = rows(80, 2, 2, 0.1)
    df = frame(spark, data, 3)
    configs = [B.newton_config(2, 6), B.residual_config(1, 6)]
    model = B.fit(df, configs)
    scores = lambda m, stages, **kw: {(r.config, r.ordinal, r.id): r.p for r in B.score(m, df, ["id"], stages, **kw).collect()}
    whole = scores(model, [6, 2])
    assert scores(model, [6, 2], limit=1) == whole
    short = B.fit(df, [B.newton_config(2, 2), B.residual_config(1, 2)])
    for (config, ordinal, i), p in scores(short, [2]).items():
        assert whole[config, 2 * ordinal + 1, i] == pytest.approx(p, abs=1e-9)
    path = tempfile.mkdtemp(prefix="callscope-boost-")
    B.save(model, spark, path)
    assert scores(B.load(spark, path), [6, 2]) == whole
    both = scores(model, [6], klass=0)
    assert all(both[c, o, i] + whole[c, o * 2, i] == pytest.approx(1) for c, o, i in both)


def test_odd_rows(spark):
    data = rows(40, 2, 3) + [(100, None, 1), (101, [], 0), (102, [1.0], 1), (103, [9.0, 9.0, 9.0, 9.0, 9.0], None)]
    df = frame(spark, data, 2)
    model = B.fit(df, [B.newton_config(2, 3)])
    assert B.score(model, df, ["id"], [3]).where(F.col("p").between(0, 1)).count() == len(data)
    with pytest.raises(ValueError):
        B.fit(df.where("false"), [B.newton_config(1, 1)])
    with pytest.raises(ValueError):
        B.fit(df.withColumn("label", F.lit(5)), [B.newton_config(1, 1)])
    flat = B.fit(df.withColumn("label", F.lit(1)), [B.newton_config(1, 2), B.residual_config(1, 2)])
    assert (flat.trees[0].feature == -1).all()


def test_configurations_have_tasks_of_their_own(spark, monkeypatch):
    """What is shuffled grows with the parts of the rows, and a part is not small."""
    grow, tasks = B._grow, []
    monkeypatch.setattr(B, "_grow", lambda state, *rest: tasks.append(state.getNumPartitions()) or grow(state, *rest))
    configs = [B.newton_config(1, 1), B.newton_config(2, 1), B.residual_config(1, 1)]
    many = spark.range(20_000).select(F.array((F.col("id") % 10).cast("double")).alias("features"), (F.col("id") % 2).cast("double").alias("label"))
    B.fit(many, configs)
    B.fit(frame(spark, rows(90, 2, 1)), configs, partition_rows=25)
    assert tasks == [3, 12]


@pytest.mark.parametrize("family,classes", [("newton", 2), ("newton", 3), ("residual", 2), ("residual", 3)])
def test_one_part_counts_the_smaller_siblings_only(monkeypatch, family, classes):
    """the same trees as from whole sums of every level, from fewer counted rows."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 12, (5, 400)).astype(np.uint8)  # bin 11: missing
    y = np.minimum((x[1] > 7) + (x[3] > 8) * rng.integers(0, 2, 400), classes - 1)
    config = B.Config("c", family, 4, 3, 0.3)
    part = B.Part(12, x, y, np.zeros((1, 1 if classes == 2 else classes, 400)))
    counted, whole = [], B.Part.histogram
    monkeypatch.setattr(B.Part, "histogram", lambda self, x, *rest: counted.append(x.shape[1]) or whole(self, x, *rest))
    for _ in range(3):
        one, by_level = (B.Trees.empty(1, part.margins.shape[1], config.nodes) for _ in range(2))
        counted.clear()
        for k, (g, h) in enumerate(zip(*part.gradients(config, 0), strict=True)):
            part.grow_tree(config, classes, one, k, g, h)
        few = sum(counted)
        counted.clear()
        for level in range(config.depth):
            for (_, k), s in part.sums([config], [by_level], level):
                B.set_level(by_level, k, level, B.best_splits(config, classes, s))
        assert few < 0.7 * sum(counted)
        assert all(np.array_equal(a, b) for a, b in zip(one.plain(), by_level.plain(), strict=True))
        part = part.add([config], [one])


def test_a_part_is_as_large_as_a_task_holds(spark, monkeypatch):
    """several parts cost stages for every level of every round."""
    grow, seen = B._grow, []
    monkeypatch.setattr(B, "_grow", lambda state, configs, outputs, classes, alone: seen.append((state.getNumPartitions(), alone)) or grow(state, configs, outputs, classes, alone))
    many = spark.range(200_000).select(F.array((F.col("id") % 10).cast("double")).alias("features"), (F.col("id") % 2).cast("double").alias("label"))
    configs = [B.newton_config(1, 1), B.residual_config(2, 1)]
    model = B.fit(many, configs)
    assert seen == [(2, True)]
    monkeypatch.setattr(B, "GROW_BYTES", 65 * 70_000)  # a byte of bins, 64 besides
    again = B.fit(many, configs)
    assert seen[1] == (6, False)
    assert all(np.array_equal(x, y) for a, b in zip(model.trees, again.trees, strict=True) for x, y in zip(a.plain(), b.plain(), strict=True))


def test_rows_end_where_their_tree_sends_them():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (4, 300)).astype(np.uint8)  # bin 8: missing
    y = ((x[0] > 3) ^ (x[2] > 6)).astype(np.int64)
    for family, depth in (("newton", 1), ("newton", 4), ("residual", 5)):
        config = B.Config("c", family, depth, 1, 0.3)
        part, tree = B.Part(9, x, y, np.zeros((1, 1, 300))), B.Trees.empty(1, 1, config.nodes)
        g, h = part.gradients(config, 0)
        node = part.grow_tree(config, 2, tree, 0, g[0], h[0])
        assert np.array_equal(node, part.walk(tree, 0, 0, depth))


def test_parts_of_a_model():
    configs = [B.newton_config(1, 2), B.newton_config(2, 2), B.residual_config(1, 2)]
    model = B.Model(configs, 2, [B.Trees.empty(2, 1, c.nodes) for c in configs], np.arange(3.0)[:, None], 5)
    some = model.only(range(1, 3))
    assert [c.name for c in some.configs] == ["xgb_d=2", "gbt_d=1"] and some.base.tolist() == [[1.0], [2.0]]
    assert some.trees[0] is model.trees[1] and (some.classes, some.n_features) == (2, 5)
