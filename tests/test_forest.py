"""Forests equal a slow direct growth; smaller and shallower ones are parts of the largest."""

import math
import random
import tempfile

import numpy as np
import pytest

from callscope.operators import forest


def rows(n, classes, seed, missing=0.1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [round(rng.gauss(0, 1), 1) for _ in range(6)]
        y = int(x[0] + x[1] > 0) + (int(x[2] > 0.5) if classes > 2 else 0)
        out.append((i, [None if rng.random() < missing else v for v in x], y))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id long, features array<double>, label int").coalesce(1)


def gini_gain(left, right, classes):
    score = lambda c: sum(v * v for v in c) / sum(c)
    total = [a + b for a, b in zip(left, right)]
    return score(left) + score(right) - score(total)


@pytest.mark.parametrize("classes", [2, 3])
def test_splits_and_shares_of_a_direct_growth(spark, classes):
    data = rows(60, classes, 5)
    trees = forest.fit(frame(spark, data), 4, 3, classes=classes, bins=200, seed=9)
    order = [tuple(r) for r in frame(spark, data).select("id").collect()]
    by_place = [data[i] for (i,) in order]
    for t in range(4):
        weights = forest.row_weights(t, np.arange(len(data)), 9)
        at = {0: [(r, int(w)) for r, w in zip(by_place, weights) if w]}
        for node in range(7):
            members = at.get(node, [])
            f = int(trees.feature[t, 0, node])
            if not members:
                assert f == -1
                continue
            count = lambda s: [sum(w for r, w in s if r[2] == k) for k in range(classes)]
            shares = np.array(count(members)) / sum(w for _, w in members)
            assert trees.value[t, :, node] == pytest.approx(shares[1:] if classes == 2 else shares)
            best = 1e-9
            drawn = forest.node_features(t, np.array([node]), 6, 9)[0].tolist()
            for g in drawn:
                for cut in [*sorted({r[1][g] for r in data if r[1][g] is not None})[:-1], math.inf]:
                    for missing_left in (True, False):
                        left = [m for m in members if (missing_left if m[0][1][g] is None else m[0][1][g] <= cut)]
                        right = [m for m in members if m not in left]
                        if left and right:
                            best = max(best, gini_gain(count(left), count(right), classes))
            if f == -1:
                assert best == pytest.approx(1e-9)
                continue
            assert f in drawn
            left = [m for m in members if (trees.missing_left[t, 0, node] if m[0][1][f] is None else m[0][1][f] <= trees.threshold[t, 0, node])]
            right = [m for m in members if m not in left]
            assert gini_gain(count(left), count(right), classes) == pytest.approx(best)
            at[2 * node + 1], at[2 * node + 2] = left, right


def test_parts_of_the_largest_forest_and_partitions(spark, monkeypatch):
    data = rows(90, 3, 2)
    df = frame(spark, data)
    whole = forest.fit(df, 7, 3, classes=3)
    monkeypatch.setattr(forest, "GROUP", 3)
    small = forest.fit(df, 4, 2, classes=3, partition_rows=25)
    nodes = 7
    assert (whole.feature[:4, :, :3] == small.feature[:, :, :3]).all() and (whole.threshold[:4, :, :3] == small.threshold[:, :, :3]).all()
    assert np.allclose(whole.value[:4, :, :nodes], small.value)
    scores = lambda t, d, n, **kw: {(r.config, r.id): r.p for r in forest.score(t, df, ["id"], d, n, **kw).collect()}
    grid = scores(whole, [1, 2, 3], [7, 4])
    for k, p in scores(small, [1, 2], [4]).items():
        assert grid[k] == pytest.approx(p)
    path = tempfile.mkdtemp(prefix="callscope-forest-")
    forest.save(whole, spark, path)
    assert scores(forest.load(spark, path), [1, 2, 3], [7, 4]) == grid
    each = [scores(whole, [3], [7], klass=k) for k in range(3)]
    assert all(sum(e[k] for e in each) == pytest.approx(1) for k in each[0])


def test_draws():
    w = np.concatenate([forest.row_weights(t, np.arange(20_000), 1) for t in range(5)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    drawn = np.concatenate([forest.node_features(t, np.arange(15), 64, 1).ravel() for t in range(200)])
    counts = np.bincount(drawn, minlength=64)
    assert counts.min() > 0.75 * counts.mean() and counts.max() < 1.25 * counts.mean()


def test_odd_rows(spark):
    data = rows(40, 2, 3) + [(100, None, 1), (101, [], 0), (102, [9.0] * 9, None)]
    df = frame(spark, data)
    trees = forest.fit(df, 5, 2)
    assert forest.score(trees, df, ["id"], [1, 2], [5]).where("p between 0 and 1").count() == 2 * len(data)
    zero = {(r.config, r.id): r.p for r in forest.score(trees, df, ["id"], [2], [5], klass=0).collect()}
    one = {(r.config, r.id): r.p for r in forest.score(trees, df, ["id"], [2], [5]).collect()}
    assert all(zero[k] + p == pytest.approx(1) for k, p in one.items())
    with pytest.raises(ValueError):
        forest.fit(df.where("false"), 1, 1)
