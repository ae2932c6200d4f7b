"""The closing flow against slow direct versions: choice, persistence, tables, bootstrap."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.operators import boosting, closing, forest, logistic, ml, scaling, smoothing
from callscope.plans import q_closing


def frame(spark, calls=40, seed=5, parts=3):
    rng = random.Random(seed)
    rows = []
    for c in range(calls):
        y = rng.random() < 0.4
        for s in range(rng.randint(1, 9)):
            rows.append((c, s, [rng.gauss(0.8 * y, 1) for _ in range(4)], int(y)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, seq long, features array<double>, y int").repartition(parts)


def fitted(df):
    train = df.withColumn("label", F.col("y").cast("double"))
    return [closing.Family("lr", logistic.fit(train, ml.logspace(-2, 2, 3))),
            closing.Family("boosted", boosting.fit(train, [boosting.newton_config(d, 4) for d in (1, 2)]), (2, 4)),
            closing.Family("forest", forest.fit(train, 5, 2), (3, 5), (1, 2))]


def means(values, window):
    return [sum(values[max(0, i - window + 1):i + 1]) / len(values[max(0, i - window + 1):i + 1]) for i in range(len(values))]


def auroc(pairs):
    pos, neg = [p for p, y in pairs if y == 1], [p for p, y in pairs if y != 1]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def direct(families, rows, window):
    """{(model, place, method): {call: score}}, row by row."""
    by_call = {}
    for r in sorted(rows, key=lambda r: r.seq):
        by_call.setdefault(r.id, []).append(list(r.features))
    out = {}
    for f in families:
        for call, xs in by_call.items():
            for place, p in enumerate(f.probabilities(xs)):
                smooth = means(p.tolist(), window)
                out.setdefault((f.name, place, "max"), {})[call] = round(max(smooth), 9)
                out.setdefault((f.name, place, "average"), {})[call] = round(sum(smooth) / len(smooth), 9)
    return out


@pytest.fixture(scope="module")
def case(spark):
    df = frame(spark).cache()
    return df, fitted(df), df.groupBy("id").agg(F.max("y").alias("y"))


def test_one_pass_scores_equal_each_familys_own(spark, case):
    df, families, _ = case
    got = {(r.id, r.seq): r.p for r in closing.score(families, df, ["id", "seq"]).collect()}
    path, trees, woods = (f.model for f in families)
    parts = [logistic.score(path, df, ["id", "seq"]), boosting.score(trees, df, ["id", "seq"], [2, 4], ordinal=3),
             forest.score(woods, df, ["id", "seq"], [1, 2], [3, 5], ordinal=7)]
    names = [c for f in families for c in f.configs]
    for part in parts:
        for r in part.collect():
            assert got[r.id, r.seq][r.ordinal] == pytest.approx(r.p, abs=1e-12) and names[r.ordinal] == r.config


def test_winners_equal_a_direct_search(spark, case):
    df, families, labels = case
    y = {r.id: r.y for r in labels.collect()}
    scores = direct(families, df.collect(), 3)
    winners = closing.select_winners(families, df, labels, 3)
    assert [(w.family.name, w.method) for w in winners] == [(f.name, m) for f in families for m in closing.METHODS]
    for w in winners:
        tried = [auroc([(p, y[c]) for c, p in scores[w.family.name, i, w.method].items()])
                 for i in range(len(next(f for f in families if f.name == w.family.name).configs))]
        assert w.ordinal == int(np.argmax(tried)) and w.auroc == pytest.approx(max(tried))  # the first of the best


def test_a_winner_scores_as_in_its_grid(case):
    _, families, _ = case
    rows = [[0.1, -2.0, 0.5, 1.0], [1.0, 1.0, float("nan"), 0.0], [0.0, 0.0, 0.0, 0.0]]
    for f in families:
        whole = f.probabilities(rows)
        for i, name in enumerate(f.configs):
            own = f.only(i)
            assert own.configs == [name] and np.allclose(own.probabilities(rows)[0], whole[i])


def test_saved_winners_score_alike(spark, case):
    df, families, labels = case
    winners = closing.select_winners(families, df, labels, 2)
    scaler = scaling.fit_scaler(scaling.to_long(df))
    folder = tempfile.mkdtemp(prefix="callscope-closing-")
    closing.save_winners(winners, scaler, spark, folder)
    again, read = closing.load_winners(spark, folder)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, scaler.collect()))
    x = np.random.default_rng(1).normal(size=(20, 4)).tolist()
    for a, b in zip(winners, again, strict=True):
        assert (a.method, a.window, a.config, a.ordinal, a.auroc, a.family.name) == (b.method, b.window, b.config, b.ordinal, b.auroc, b.family.name)
        assert np.allclose(a.family.probabilities(x), b.family.probabilities(x))


def test_tables_thresholds_and_missing_labels(spark, case):
    df, families, labels = case
    winners = closing.select_winners(families, df, labels, 3)
    part = labels.where("id <> 7")  # a call nobody has labelled
    seg = closing.segment_table(winners, df, part, {("lr", "max"): 0.9}, 0.25)
    calls = closing.call_table(seg)
    scores = direct([w.family for w in winners[::2]], df.collect(), 3)
    rows = calls.collect()
    assert len(rows) == len(winners) * 40 and seg.count() == len(winners) * df.count()
    for r in rows:
        assert r.threshold == (0.9 if (r.model, r.method) == ("lr", "max") else 0.25)
        assert r.pred == (r.p >= r.threshold) and (r.y is None) == (r.id == 7)
        if r.method == "max":
            assert r.p == pytest.approx(scores[r.model, 0, "max"][r.id], abs=2e-9)
    each, summary = closing.bootstrap(calls, rounds=4, rate=0.8)
    per = each.collect()
    assert len(per) == len(winners) * 4 and summary.count() == len(winners)
    by_draw = {}
    for r in per:  # every model is judged on the same calls
        by_draw.setdefault(r.k, set()).add((r.tp + r.fn, r.fp + r.tn))
    assert all(len(v) == 1 for v in by_draw.values())
    assert all(sum(next(iter(v))) <= 39 for v in by_draw.values())


def test_empty_rows_single_class_and_mixed_windows(spark, case):
    df, families, labels = case
    none = closing.select_winners(families, df.limit(0), labels, 3)
    assert [(w.ordinal, w.auroc) for w in none] == [(0, None)] * len(none)
    same = closing.select_winners(families, df, labels.withColumn("y", F.lit(1)), 3)
    assert [(w.ordinal, w.auroc) for w in same] == [(0, None)] * len(same)
    assert closing.call_table(closing.segment_table(none, df.limit(0), labels, {}, 0.5)).count() == 0
    with pytest.raises(ValueError):
        closing.segment_table([none[0], closing.Winner("max", 5, "x", 0, None, families[0].only(0))], df, labels, {}, 0.5)


@pytest.mark.parametrize("window", [0, 1, 3, 7])
def test_array_means_equal_single_ones(spark, window):
    rng = random.Random(2)
    df = spark.createDataFrame([(c, s, [rng.random(), rng.random()]) for c in range(3) for s in range(25)], "id long, seq long, p array<double>")
    got = {(r.id, r.seq): r.p for r in smoothing.moving_average_arrays(df, window).collect()}
    for i in range(2):
        one = smoothing.moving_average(df.select("id", "seq", F.col("p")[i].alias("p")), window)
        assert all(got[r.id, r.seq][i] == pytest.approx(r.p, abs=1e-12) for r in one.collect())


def test_the_window_does_not_shuffle_configurations(spark, case):
    """The rows meet the window before they are unpivoted."""
    df, families, _ = case
    smooth = smoothing.moving_average_arrays(closing.score(families, df, ["id", "seq"]), 3)
    long = closing.unpivot(smooth, [{"config": c} for f in families for c in f.configs], ["id"])
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(arrays_zip") < plan.index("Window") < plan.rindex("Exchange")


def test_the_registered_flow_leaves_a_run_behind(spark, sf_small):
    seg, calls = q_closing.literal_run(spark, sf_small)
    assert {r.model for r in calls.select("model").distinct().collect()} == {q_closing.PATH, q_closing.TREES}
    assert seg.select("id").distinct().count() == calls.select("id").distinct().count()


def test_both_boosted_families_grow_together(spark, monkeypatch):
    """one fit, so that their configurations share the cores and the passes."""
    monkeypatch.setattr(q_closing, "GBT_ITERS", [1, 2])
    monkeypatch.setattr(q_closing, "TREE_DEPTHS", [1, 2])
    monkeypatch.setattr(q_closing, "RF_TREES", [2])
    monkeypatch.setattr(q_closing, "LR_GRID", [1.0])
    fits, fit = [], boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda df, configs, **kw: fits.append(len(configs)) or fit(df, configs, **kw))
    train = frame(spark, calls=20).withColumn("label", F.col("y").cast("double"))
    families = {f.name: f for f in q_closing.fitted_families(train)}
    assert fits == [4]
    for name, make in (("XGBoost", boosting.newton_config), ("Gradient Boosting", boosting.residual_config)):
        alone = fit(train, [make(d, 2) for d in (1, 2)])
        got = families[name].model
        assert families[name].configs == [f"{c.name}_n={n}" for c in alone.configs for n in (1, 2)] and np.array_equal(got.base, alone.base)
        assert all(np.array_equal(x, y) for a, b in zip(got.trees, alone.trees, strict=True) for x, y in zip(a.plain(), b.plain(), strict=True))
