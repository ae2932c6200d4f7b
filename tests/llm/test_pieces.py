import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from callscope.llm import pieces, queries

MODEL = pieces.read_model(P.path("piece_bpe_32k.model"))
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
VOCABULARY = pieces.Vocabulary(MODEL)
CASES = [None, "", " ", "  ", "     a", "a ", "a  b \n c", "it's 42\t\tnow", "ééé ßß 日本語 🙂🙂 é", "▁a ▁▁b", "<s> </s> <unk> <0x0A>", "x" * 3000,
         "ab" * 2000, " " * 100, "\x00\x01", "line one\nline two\n\n\n  three", "🙂" * 50, "　x y﻿", "�"]


ENCODER = pieces.Encoder(VOCABULARY, check=True)


def run(encoder, texts):
    return [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts, b"")]


def test_cases_and_extra_columns(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(CASES + CASES[-3:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int").repartition(3)
    out = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = LIBRARY.encode(r.text or "", add_eos=True)
        assert list(r.ids) == ids, r.text
        assert r.decoded == LIBRARY.decode(ids)
    assert [list(r.ids) for r in pieces.encode(df.where("text is null"), MODEL, add_end=False).collect()] == [[]]
    assert pieces.decode(pieces.encode(df.limit(0), MODEL), MODEL).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("  \n▁abcdeinorst's.1é日🙂"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_equals_the_library(texts):
    assert run(ENCODER, texts) == LIBRARY.encode(texts)


def test_words_long_parts_and_a_small_cache(spark, sf_small):
    texts = [r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert run(pieces.Encoder(VOCABULARY, check=False, cache_bytes=10_000), texts) == LIBRARY.encode([t or "" for t in texts])
    rng = random.Random(5)
    long = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=50_000)), "".join(rng.choices("etaoin▁ .,\n", k=50_000)),
            "".join(chr(rng.randrange(0x80, 0x3000)) for _ in range(5_000))]
    assert run(pieces.Encoder(VOCABULARY, check=False), long) == LIBRARY.encode(long)


def test_any_ids_decode_like_the_library():
    decoder, rng = pieces.Decoder(VOCABULARY), random.Random(3)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 28705, 259, 1, 2]) for _ in range(rng.randrange(8))]
        assert decoder.decode(ids).decode() == LIBRARY.decode(ids), ids


def test_a_difference_ends_the_job():
    wrong = pieces.Vocabulary(MODEL)
    del wrong.texts["▁the"], wrong.scores["▁the"]
    with pytest.raises(ValueError, match="differently"):
        pieces.Encoder(wrong, check=True).encode(["the theme"], b"")


def test_query_small(spark, sf_small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = queries.op12_pieces(spark, sf_small).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = LIBRARY.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
