import random
import re

import numpy as np
import pytest

from callscope.llm import jaccard, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holds = {}
    for i, s in enumerate(sets):
        for x in s:
            holds.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holds[x] if j < i}:
            common = len(s & sets[j])
            if den * common >= num * (len(s) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(sets[i]), least.get(find(i))) for i, (key, _) in enumerate(rows)), key=str)


def test_query_small(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op4_jaccard(spark, sf_small).collect()), key=str) == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("k, num, den, crowded, block", [(4, 85, 100, 64, 512), (3, 4, 5, 3, 8)])
def test_against_brute_force(spark, monkeypatch, k, num, den, crowded, block):
    monkeypatch.setattr(jaccard, "CROWDED", crowded)
    monkeypatch.setattr(jaccard, "TIMES_MEAN", 0)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PAIRS", 40 * block)
    rng = random.Random(4)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz") for _ in range(rng.choice((5, 40, 90, 400)))] for _ in range(12)]
    line = "this common line is in many of the documents here".split()
    rows = [(5, None), (6, ""), (7, " \n"), (8, "a b"), (9, "A  B"), (10, "a b c"), (None, "a b"), (None, "x y z q r")]
    for i in range(400):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 5, 12))):
            w[rng.randrange(len(w))] = rng.choice("pqrs") * 3 + str(rng.randrange(5))
        if rng.random() < 0.4:
            w = line + w
        if rng.random() < 0.2:
            w = w[:rng.randrange(len(w))]
        rows.append((rng.randrange(10_000) + 11, rng.choice([" ", "\t", "  "]).join(w)))
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, component_id int").repartition(6)
    got = sorted(map(tuple, jaccard.similarity_components(df, k=k, num=num, den=den).collect()), key=str)
    assert got == brute(rows, k, num, den)
    assert jaccard.similarity_components(df.limit(0)).count() == 0


def test_sketches_never_lose_a_pair():
    random_ = np.random.default_rng(3)
    measure = jaccard.Measure(85, 100)
    for n in (20, 150, 900, 5000):
        a = np.unique(random_.integers(0, 2**63, n, dtype=np.uint64))
        for part in (0, 0.02, 0.05, 0.07):
            b = np.unique(np.concatenate([a[int(part * n):], random_.integers(0, 2**63, int(part * n / 2), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            sketches = jaccard._Sketches([jaccard._sketch(a), jaccard._sketch(b)])
            got = jaccard._near(np.array([len(a), len(b)]), sketches, np.array([0]), np.array([1]), measure)
            assert len(got) >= measure.linked(common, len(a), len(b))


def test_near_copies_cost_few_pairs(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(3):  # two of them share 0.88 of their n-grams, about
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    verified, links = [], jaccard._links

    def counted(pairs, *how):
        verified.append(pairs.count())
        return links(pairs, *how)

    monkeypatch.setattr(jaccard, "_links", counted)
    got = sorted(map(tuple, jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows, 4, 85, 100)
    assert sum(verified) < 10 * len(rows), verified


def test_groups_that_can_link_with_none_leave_their_lists(spark):
    measure = jaccard.Measure(85, 100)
    rows = [(1, 10, 100, 0), (1, 11, 100, 2), (1, 11, 100, 2), (1, 12, 50, 0),  # 12: of another size
            (2, 10, 100, 5), (2, 11, 100, 12),  # 11: too few are left behind its place
            (3, 13, 100, 0), (4, 14, 1, 0), (4, 15, 1, 0)]
    found = jaccard._lists(spark.createDataFrame(rows, "token long, g long, n long, pos int"), measure)
    assert sorted(map(tuple, found.collect())) == [(1, 10, 1), (1, 11, 1), (4, 14, 1), (4, 15, 1)]


def test_near_copies_in_long_lists_stay_in_their_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    found, whole = [], jaccard._candidates

    def candidates(*args):
        out = whole(*args)
        found.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_candidates", candidates)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words[:-1], f"own{i}"])) for i in range(200)] + [(900, " ".join(words[:150] + ["else"] * 100))]
    got = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 0) for i in range(200)} | {(900, 900)}
    assert sum(found) <= 6 * 200 and found[-1] == 0


def test_lists_of_the_same_groups_go_on_once(spark):
    measure = jaccard.Measure(85, 100)
    rows = [(token, g, 100, token % 10) for token in range(1, 9) for g in (10, 11)] + [(token, 12, 100, token % 10) for token in (3, 8)]
    found = sorted(map(tuple, jaccard._lists(spark.createDataFrame(rows, "token long, g long, n long, pos int"), measure).collect()))
    assert found == [(1, 10, 1), (1, 11, 1), (3, 10, 1), (3, 11, 1), (3, 12, 1)]


def test_pairs_of_long_lists_come_in_large_chunks(monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS", 300)
    home = np.ones(60, bool)
    home[5:15] = False
    chunks = list(jaccard._pairs(np.array([0, 20]), np.array([20, 40]), home))
    got = [p for _, a, b in chunks for p in zip(a.tolist(), b.tolist(), strict=True)]
    want = [(a, b) for lo, hi in ((0, 20), (20, 60)) for a in range(lo, hi) for b in range(a + 1, hi) if hi == 20 or home[a] or home[b]]
    assert sorted(got) == sorted(want) and len(chunks) <= 4


def test_sketches_tell_sets_with_little_in_common_apart():
    random_ = np.random.default_rng(5)
    measure, passed = jaccard.Measure(4, 5), 0
    for n in (140, 200, 270, 500, 530, 1000, 2100):
        common = np.unique(random_.integers(0, 2**63, n // 5, dtype=np.uint64))
        sets = [np.unique(np.concatenate([common, random_.integers(0, 2**63, n - n // 5, dtype=np.uint64)])) for _ in range(60)]
        a, b = np.triu_indices(len(sets), 1)
        passed += len(jaccard._near(np.array([len(s) for s in sets]), jaccard._Sketches([jaccard._sketch(s) for s in sets]), a, b, measure))
    assert passed == 0  # similar by 1 / 9


def test_a_common_passage_makes_no_long_lists(spark, monkeypatch):
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(120)] + passage)) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 600, 100)]
    longest, whole = [], jaccard._candidates

    def candidates(lists, *how):
        longest.append(lists.groupBy("token").count().agg({"count": "max"}).first()[0])
        return whole(lists, *how)

    monkeypatch.setattr(jaccard, "_candidates", candidates)
    got = sorted(map(tuple, jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), k=5, num=4, den=5).collect()), key=str)
    assert got == brute(rows, 5, 4, 5)
    assert longest[0] <= 6, longest  # the end of the six copies
