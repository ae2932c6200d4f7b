import re
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from test_jaccard import brute as brute_groups
from test_packing import check as check_packing
from test_substrings import brute as brute_substrings
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as C
from callscope.llm import common


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = []
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        out.append(docs)
    first = rows(spark.read.parquet(f"{sf}/documents.parquet"))
    good, unique, short, clean = map(rows, out[:4])
    for df in out[:4]:
        assert df.columns == list(C.COLUMNS) and df.count() == len(rows(df))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert set(good) <= set(first) and all(good[k] == first[k] for k in good)
    assert np.mean([(k in good) == bool(q) for k, q in labels.items()]) > 0.95
    groups = brute_groups([(k, r.text) for k, r in good.items()], 5, 4, 5)
    assert set(unique) == {k for k, _, c in groups if k == c} and all(unique[k] == good[k] for k in unique)
    cut = {k: (n, g, t) for k, n, g, t in brute_substrings([(k, r.text) for k, r in unique.items()], 50)}
    assert set(short) == {k for k, (n, g, _) in cut.items() if g < n or not g}
    assert all(r.text == (cut[k][2] if cut[k][1] else unique[k].text) for k, r in short.items())
    assert set(clean) == set(short)
    for k, r in clean.items():
        pieces = r.text.split("[SECRET]")
        assert re.fullmatch(".*".join(map(re.escape, pieces)), short[k].text, re.S)
        assert not re.search(r"[0-9a-f]{24}|AKIA[A-Z0-9]{16}", r.text) and r.n_chars == len(r.text)
    check_packing({k: [r.text] for k, r in clean.items()}, out[4].collect(), 1024)


def test_edge_cases(spark):
    sf = "/root/testdata/sf0.001"
    given = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "plain words of a text " * 3, "en", None, 66), (3, "plain words of a text " * 3, "en", None, 66),
             (None, "no id here at all", "en", "s", 17), (4, "token = abcdef123456 and words", "en", "s", 30)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (given, []):
        docs = spark.createDataFrame(data, kind).withColumn("component_id", F.lit(1)).withColumn("n_words", F.lit("x"))
        for _, stage in C.STAGES[1:4]:
            docs = stage(spark, docs, sf)
            assert docs.columns == list(C.COLUMNS)
        got = docs.collect()
        assert len(got) == (5 if data else 0)
        pieces = C.packed(spark, docs, sf).collect()
        assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
        assert C.good(spark, spark.createDataFrame(data, kind), sf).columns == list(C.COLUMNS)


def test_near_copies_by_row(spark):
    """Removal goes by row where ids are repeated or null."""
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    near = lambda name: text(name) + " changed"
    given = [(1, text("a")), (5, near("a")), (5, text("clean")), (7, text("b")), (7, near("b")), (None, text("c")), (None, near("c")),
             (None, near("a")), (None, text("alone")), (8, text("d")), (8, text("d")), (9, None), (9, None), (9, " "), (None, None), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in C.unique(spark, docs.repartition(4), "").collect()]
    assert len(got) == 10 and (1, text("a")) in got and (5, text("clean")) in got and (None, text("alone")) in got and (8, text("d")) in got
    assert not {(5, near("a")), (None, near("a"))} & set(got)
    assert sum(t in (text("b"), near("b")) for _, t in got) == sum(t in (text("c"), near("c")) for _, t in got) == 1
    assert got.count((9, None)) == 1 and got.count((9, " ")) == 1 and got.count((None, None)) == 2


def test_registered():
    assert entry.queries()["pipeline"] is C.run
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert zlib.crc32(np.array(tok.encode("a").ids, "<u4").tobytes()) > 0


def test_rows_that_stay_are_not_shuffled(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "t" * i, None if i % 3 else i) for i in range(500)], "doc_id long, text string, n int")
    gone = spark.createDataFrame([(i,) for i in [*range(0, 500, 7), *range(0, 500, 7), 900]], "doc_id long")
    want = sorted(tuple(r) for r in rows.collect() if r.doc_id % 7)
    assert sorted(map(tuple, common.without(rows, gone, "doc_id").collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    monkeypatch.setattr(common, "FILTER_BITS", 128)  # a full bitmap
    assert sorted(map(tuple, common.without(rows, gone, "doc_id").collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    assert common.without(rows, gone.limit(0), "doc_id").count() == 500
    assert C.without is common.without
