import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from callscope.llm import packing, queries

TOKENIZER = packing._Tokenizer(queries.packing_tokenizer())


def reference():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def check(docs, pieces, size):
    """docs: key -> list of texts; pieces: rows."""
    tok = reference()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for key, texts in docs.items():
        want = sorted([*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts)
        assert sorted(len(w) for w in want) == sorted(p.doc_tokens for p in by_doc[key] if p.start == 0)
        if len(want) == 1:
            at = 0
            for p in sorted(by_doc[key], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(want[0])
                assert p.ids_crc32 == zlib.crc32(np.array(want[0][at:at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(want[0])
    last = max(by_sequence)
    assert sorted(by_sequence) == list(range(last + 1))
    for s, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size and (s == last or at == size)
        assert {p.sequence_tokens for p in own} == {at if at & (at - 1) == 0 else size}


def test_query_small(spark, sf_small):
    docs = {r.doc_id: [r.text] for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    check(docs, queries.op2_packing(spark, sf_small).collect(), 1024)


def test_edge_cases(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "a", 7), (3, "a", 7), (4, "<|endoftext|> x  y\n z", 7),
            (7, "a<|endoftext|>b", 7), (8, "it's <|endoftext|><|endoftext|>  <|endoftext", 7), (9, " <|endoftext|>", 7), (5, "word " * 5000, 7),
            (None, "nobody", 7)] + [(i, f"text {i}", 0) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    docs = defaultdict(list)
    for k, t, _ in rows:
        docs[k].append(t)
    got = packing.pack(df, queries.packing_tokenizer(), size=16).collect()
    check(docs, got, 16)
    assert packing.pack(df.limit(0), queries.packing_tokenizer()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "\r", "a", "bé", "ж", "×", "'s", ".", "_", "1", "²", "日", " "]),
                                              max_size=9).map("".join)), max_size=5))
def test_pieces_have_the_ids_of_whole_texts(texts):
    tok = TOKENIZER.model
    got = TOKENIZER.encode(pa.array(texts, pa.string()), 0).to_pylist()
    assert [np.frombuffer(x, np.uint16).tolist() for x in got] == [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_pieces_of_a_batch_are_told_apart_before_they_are_objects():
    model = packing._Tokenizer(queries.packing_tokenizer())
    asked = []
    missing = model.known.missing
    model.known.missing = lambda names: missing(asked.append(len(names)) or names)
    model.encode(pa.array([" ".join(f"Wort {i}." for i in range(40))] * 100), 0)
    assert asked == [42]  # Wort with and without a space, 40 numbers


def test_free_memory_goes_back():
    """A worker does not keep what a batch has needed for its later tasks."""
    import re as regex
    from pathlib import Path

    import pyarrow as pa

    from callscope.llm import common

    def mb():
        return sum(map(int, regex.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1000

    for _ in common.small_batches([pa.record_batch({"text": ["a"]})], "text"):
        before = mb()
        many = [bytes(1000) for _ in range(300_000)]
        last = bytes(1000)  # behind them on the heap
        full = mb()
        del many
    assert full - before > 200 and mb() - before < 100 and len(last) == 1000
