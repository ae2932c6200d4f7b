import base64
import hashlib

import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callscope.llm import bpe, queries
from callscope.llm.common import distinct_slices, part_text, parts, space_cuts, text_bytes

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


CASES = [None, "", " ", "  ", "a", " a", "a ", "  a", "a  b", "a \n b", "\n\n  x", "x\n y", "it's 42 o'clock\t\tnow",
         "ééé ßß 日本語 🙂🙂", "<|endoftext|>", "a  b", "　 　x", "x   y", "١٢٣ ²³", "thth" * 3000,
         "!" * 2000, "line one\nline two\n\n\nline three   ", "\x1c x\x1d y", "a\r\n b"]


def test_cases_and_extra_columns(spark):
    enc = reference()
    rows = [(i, t, "x") for i, t in enumerate(CASES + CASES[-3:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert len(out) == len(rows)
    for r in out:
        assert list(r.ids) == enc.encode_ordinary(r.text or ""), r.text
        assert bytes(r.decoded) == (r.text or "").encode()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t ab'sé1.²日\x1c"), max_size=14), max_size=4))
def test_parts_never_change_the_words(texts):
    import regex
    split = regex.compile(P.PATTERN).findall
    for t in texts:
        cut = [part_text(p) for p in parts(t)]
        assert "".join(cut) == t
        assert [w for p in cut for w in split(p)] == split(t)


def test_long_words_equal_single_steps():
    coder = bpe._Coder(bpe.Vocabulary(PATH, P.PATTERN))
    enc = reference()
    words = ["a" * 7, "aaaa" * 50, "th" * 300 + "e", "abcabcab" * 40, "reontionthere" * 30, "!?" * 99 + "!", "é" * 101,
             "zqxj" * 70, "0" * 333, "ing" * 100 + "in" * 50, "=" * 1000, "ab" * 20_000]
    for w, raw in zip(words, coder._merge(bpe.ENCODE_LONG, [w.encode() for w in words])):
        assert list(memoryview(raw).cast("i")) == enc.encode_ordinary(w), w[:20]


def test_query_small(spark, sf_small):
    enc = reference()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = queries.op1_bpe(spark, sf_small).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = enc.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(" \n\t ab'sé1.²日\x1c　“\x85 ×"), max_size=14)), max_size=5), st.integers(0, 2))
def test_slices_of_a_batch_never_change_the_words(texts, skip):
    import regex
    split = regex.compile(P.PATTERN).findall
    col = pa.array(texts, pa.string()).slice(skip)
    data, at = text_bytes(col)
    names, which, at = distinct_slices(data, space_cuts(data, at), at, pa.string())
    assert len(set(names)) == len(names)
    for t, a, b in zip(col.to_pylist(), at, at[1:]):
        cut = [names[i] for i in which[a:b]]
        assert "".join(cut) == (t or "")
        assert [w for p in cut for w in split(p)] == split(t or "")


def test_a_batch_makes_no_object_for_every_word():
    """100 texts of the same 40 words: slices are told apart before they are Python's."""
    coder = bpe._Coder(bpe.Vocabulary(PATH, P.PATTERN))
    asked = []
    missing = coder.parts.missing
    coder.parts.missing = lambda names: missing(asked.append(len(names)) or names)
    text = " ".join(f"word{i}" for i in range(40))
    ids = coder.encode(pa.array([text] * 100))
    assert asked == [40]
    assert coder.decode(ids).to_pylist() == [text.encode()] * 100
