"""The corpus pipeline: documents in, packed token sequences out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import jaccard, packing, quality, secrets, substrings
from callscope.llm.common import table, without
from callscope.llm.queries import QUALITY_LEAST, held_out, packing_tokenizer
from callscope.session import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle, and the similarity (as a fraction) of near-duplicates.
SHINGLE, SIMILARITY = 5, (4, 5)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these and the labels, accepts."""
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), may_learn=~held_out())
    return quality.score(docs.select(*COLUMNS), model, out="__score").where(F.col("__score") >= QUALITY_LEAST).select(*COLUMNS)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, a row
    without one last; of rows that repeat an id, one.  Texts without words are no group:
    rows of an id that repeat one are kept once."""
    docs = docs.select(*COLUMNS)
    similar = {"k": SHINGLE, "num": SIMILARITY[0], "den": SIMILARITY[1]}
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        gone = jaccard.similarity_components(docs, **similar).where("doc_id <> component_id").select("doc_id")
        return without(docs, gone, "doc_id")
    # ids do not name rows: numbers, written once, do
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rows-{uuid.uuid4()}"
    docs.withColumn("__row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row").alias("__key")
    groups = jaccard.similarity_components(rows.select(key, "text"), key="__key", **similar)
    kept = rows.join(groups.where("__key <> component_id").select("__key.__row"), "__row", "left_anti").select(*COLUMNS)
    again = F.col("doc_id").isNotNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return kept.where(~again).unionByName(kept.where(again).dropDuplicates(["doc_id", "text"]))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word spans that an earlier one has; the others as they
    were.  Documents of which nothing stays go."""
    kept = substrings.remove_repeats(docs.select(*COLUMNS), out="__kept")
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("__kept")).otherwise(F.col("text"))
    return (kept.where("n_removed = 0 or n_removed < n_words")
            .select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length("__kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    ratios = secrets.train(docs, table(spark, sf_dir, "labels"))
    found = secrets.redact(secrets.scan(docs.select(*COLUMNS), ratios, out="__spans"), spans="__spans")
    return found.select("doc_id", "text", "lang", "source", F.when(F.size("__spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in sequences of 1024 tokens: one row per piece, with its ids."""
    return packing.pack(docs, packing_tokenizer(), size=1024, end=0)


STAGES = [("quality classifier", good), ("n-gram Jaccard join", unique), ("substring dedup", without_repeats),
          ("secret scans", without_secrets), ("packing", packed)]

#: No SQL expresses the classifier, the Markov models or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what each returns is written to the shared
    folder of checkpoints and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
