import hashlib
import random
import re

import numpy as np

from callscope.llm import common, queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    """docs: (id, text) rows; the result of every row."""
    first, words = {}, [WORD.findall(t or "") for _, t in docs]
    for (key, _), w in zip(docs, words):
        for i in range(len(w) - window + 1):
            own = tuple(w[i:i + window])
            if key is not None:
                first[own] = min(first.get(own, key), key)
    out = []
    for (key, _), w in zip(docs, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if key is not None and first[tuple(w[i:i + window])] < key:
                gone[i:i + window] = [True] * window
        out.append((key, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def test_query_small(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    want = [(k, n, g, hashlib.sha256(t.encode()).hexdigest()) for k, n, g, t in brute(docs, 50)]
    got = sorted(map(tuple, queries.op7_substrings(spark, sf_small).collect()), key=str)
    assert got == want
    assert sum(g for _, _, g, _ in want) > 0


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(60)] for _ in range(4)]
    docs = [(1, None), (1, ""), (None, " ".join(base[0])), (None, " ".join(base[0])), (7, "x " * 40), (5, "x " * 30), (9, "x\ty\n" * 25),
            (2, " ".join(base[0])), (2, " ".join(base[0])), (3, "  ".join(base[0])), (4, "é " * 9)]
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            s = rng.randint(0, 40)
            piece = b[s:s + rng.randint(1, 40)]
            if rng.random() < 0.4 and piece:
                piece[rng.randrange(len(piece))] = "edit"
            parts += piece + [rng.choice("klm")] * rng.randint(0, 3)
        docs.append((rng.randint(10, 120), " ".join(parts)))
    for window, k in ((8, 3), (5, 5), (12, 4)):
        df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_words int").repartition(4)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df, window=window, k=k).collect()), key=str)
        assert got == brute(docs, window)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_a_long_text_leaves_no_long_tables_behind():
    powers = common._Powers(5)
    long, short = 3 * powers.KEPT, 1000
    up, down = powers.get(long)
    assert len(up) == long and len(down) == long + 1 and bool((up[1:] * down[1:-1] == 1).all())
    assert len(powers.tables[0]) <= powers.KEPT + 1
    assert all(np.array_equal(a, b[:len(a)]) for a, b in zip(powers.get(short), (up, down)))
    assert len(powers.tables[0]) > short
