"""The registered queries: thin wrappers that apply the operators of this
subpackage, with production parameters, to whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import (ann, bpe, divergence, fim, html_blocks, jaccard, oracle, packing, pieces, quality, rabitq, secrets, substrings,
                           warc)
from callscope.llm.common import table
from callscope.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op3_warc": oracle.WARC, "op4_jaccard": oracle.JACCARD, "op7_substrings": oracle.SUBSTRINGS,
                         "op10_near_vectors": oracle.NEAR_VECTORS, "op11_fim": oracle.FIM, "op13_divergence": oracle.DIVERGENCE}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document, and back."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])
    both = bpe.decode(ids, path, public_tokenizers.PATTERN)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def packing_tokenizer() -> str:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), packing_tokenizer(), size=1024, end=0)
    return pieces.drop("ids")


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages into archives, and back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4()}"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Scores from which a document counts as good.
QUALITY_LEAST = 0.3


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; a fifth of the labels is never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), may_learn=~held_out())
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


@query
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    texts = html_blocks.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"), count("markov"))


@query
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word spans that an earlier one has."""
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=50, keep=["doc_id"])
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every 50th."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


@query
def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with a cosine of 0.9 or more."""
    return rabitq.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a similarity of 0.85 or more."""
    return jaccard.similarity_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


@query
def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents with a middle moved to the end, and back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    moved = fim.transform(docs, keep=["doc_id"])
    back = fim.restore(moved, keep=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


@query
def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and back."""
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.decode(pieces.encode(docs, model, keep=["doc_id"]), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and by which terms."""
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"), min_docs=30)
