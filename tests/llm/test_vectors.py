import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.llm import ann, queries, rabitq
from callscope.llm.vectors import unit, usable


def load(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


def nearest(ids, x, queries, k):
    u = unit(x)
    out = {}
    for q in queries:
        s = u @ u[np.flatnonzero(ids == q)[0]]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-round(s[i], 12), ids[i]))
        out[q] = [(int(ids[i]), s[i]) for i in order[:k]]
    return out


def nearest_ids(x, queries, k):
    u = unit(x)
    s = {q: u @ u[q] for q in queries}
    return {q: {int(i) for i in np.argsort(-own)[:k + 1] if i != q} for q, own in s.items()}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_and_scores(spark, sf):
    ids, x = load(spark, sf)
    want = nearest(ids, x, [int(i) for i in ids if i % 50 == 0], 5)
    got = {}
    for r in queries.op8_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    u = dict(zip(ids.tolist(), unit(x)))
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 6))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        assert all(abs(s - u[q] @ u[v]) < 1e-12 and v != q for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for v, _ in want[q]})
    assert hits / (5 * len(want)) >= 0.9


def test_ann_on_clusters_visits_few_parts(spark):
    random = np.random.default_rng(5)
    centres = random.normal(size=(40, 16)) * 3
    x = np.repeat(centres, 50, axis=0) + random.normal(size=(2000, 16)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = ann.fit(usable(df, "vec_id", "embedding"))
    assert index.probes <= 2 < index.parts


@pytest.mark.parametrize("spread, most", [(0.5, 8), (None, 48)])
def test_ann_recall_with_many_parts(spark, monkeypatch, spread, most):
    """64 parts, 16 sample rows a part as with the most parts, few of the rows sampled:
    clusters, and vectors without any (``spread`` None)."""
    monkeypatch.setattr(ann, "PART_ROWS", 250)
    random = np.random.default_rng(5)
    x = random.normal(size=(16_000, 16))
    if spread:
        x = np.repeat(random.normal(size=(200, 16)) * 3, 80, axis=0) + x * spread
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    index = ann.fit(usable(df, "vec_id", "embedding"), n_sample=1024)
    got = {}
    for r in ann.search(df, F.col("id") % 50 == 0, k=5, index=index).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = nearest_ids(x, got, 5)
    recall = sum(len(own & want[q]) for q, own in got.items()) / (5 * len(want))
    print(f"spread {spread}: {index.parts} parts, {index.probes} probes, recall {recall:.4f}")
    assert len(got) == 320 and index.parts == 64 and index.probes <= most
    assert recall >= 0.9


EDGE = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (50, [1.0, 0.0]), (100, [2.0, 0.0]),
        (7, [1.0, 0.1]), (6, [1.0, 0.1]), (6, [1.0, 0.1]), (8, [-1.0, 0.0]), (9, [1e-30, 1e-30]), (10, [3e37, 3e37])]


def test_ann_edge_cases(spark):
    df = spark.createDataFrame([(*r, 1) for r in EDGE], "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in ann.search(df, F.col("id") % 50 == 0, k=4).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [(50, 1, 100), (50, 2, 6), (50, 3, 6), (50, 4, 7), (100, 1, 50), (100, 2, 6), (100, 3, 6), (100, 4, 7)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert len(ann.search(df, F.col("id") == 8, k=99).collect()) == 7


def brute_links(ids, x, threshold):
    s = unit(x) @ unit(x).T >= threshold
    np.fill_diagonal(s, False)
    root = np.arange(len(ids))
    while True:
        new = np.array([min([root[i], *root[s[i]]]) for i in range(len(ids))])
        if (new == root).all():
            break
        root = new
    least = {r: min(ids[root == r]) for r in set(root.tolist())}
    return sorted((int(i), int(n), int(least[r]), bool(i == least[r])) for i, n, r in zip(ids, s.sum(1), root.tolist()))


def test_near_duplicates_small(spark):
    for sf in ("/root/testdata/sf0.01",):
        ids, x = load(spark, sf)
        assert sorted(map(tuple, queries.op10_near_vectors(spark, sf).collect())) == brute_links(ids, x, 0.9)


def test_near_duplicates_with_links(spark, monkeypatch):
    random = np.random.default_rng(6)
    base = random.normal(size=(30, 24))
    x = base[random.integers(0, 30, 900)] + random.normal(size=(900, 24)) * random.uniform(0.02, 0.4, (900, 1))
    x = np.concatenate([x, x[:40], x[:40]]).astype(np.float32).astype(float)
    ids = random.permutation(len(x)) + 5
    monkeypatch.setattr(rabitq, "BLOCK", 100)
    monkeypatch.setattr(rabitq, "CELL_ROWS", 150)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, n_links int").repartition(5)
    for threshold in (0.9, 0.6):
        assert sorted(map(tuple, rabitq.near_duplicates(df, threshold=threshold).collect())) == brute_links(ids, x, threshold)


def test_estimates_are_unbiased_and_bounded():
    random = np.random.default_rng(7)
    x, y = (unit(random.normal(size=(400, 64))) for _ in range(2))
    error = []
    for seed in range(20):
        turn = rabitq.rotation(64, seed)
        error.append(rabitq.Codes(x, turn, 0.9).estimate(y @ turn) - x @ y.T)
    assert abs(np.mean(error)) < 1e-3 and np.abs(np.mean(error, 0)).mean() < 0.03
    near = unit(x + random.normal(size=x.shape) * 0.05)
    codes = rabitq.Codes(x, turn, 0.9)
    s = np.einsum("ij,ij->i", codes.signs(), near @ turn)
    assert (s >= codes.least)[np.einsum("ij,ij->i", x, near) >= 0.9].all()
    assert (codes.signs() @ (y @ turn).T >= codes.least[:, None]).mean() < 0.01


def test_near_duplicates_edge_cases(spark):
    df = spark.createDataFrame(EDGE + [(None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, rabitq.near_duplicates(df).collect()), key=str)
    assert got == sorted([*((i, 0, i, True) for i in (0, 1, 2, 3, 4, 5, 8)), (9, 1, 9, True), (10, 1, 9, False),
                          (6, 5, 6, True), (6, 5, 6, True), (7, 5, 6, False), (50, 5, 6, False), (100, 5, 6, False), (None, 5, 6, False)], key=str)
    assert rabitq.near_duplicates(df.limit(0)).count() == 0
    assert {r.n_links for r in rabitq.near_duplicates(df.limit(2)).collect()} == {0}
