"""Call-record JSON scan, media listing, CSV stage files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.scalar import file_stem

UTTERANCE = T.StructType([
    T.StructField("startAt", T.LongType()),
    T.StructField("endAt", T.LongType()),
    T.StructField("speaker", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

CALL_RECORD = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("symptom", T.ArrayType(T.StringType())),
    T.StructField("utterances", T.ArrayType(UTTERANCE)),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_calls(spark: SparkSession, path: str, keep_rejects: bool = False,
               multi_line: bool = True) -> DataFrame:
    """One row per call file.  The declared schema turns a non-list ``symptom``
    (or a missing key) into NULL instead of failing; ``symptom_guard`` drops it.
    ``multi_line=True`` reads one JSON document per file (the call-record
    layout); ``False`` reads JSON Lines.
    Executors parse the files in parallel; the path comes from ``_metadata``."""
    df = (spark.read.schema(CALL_RECORD)
          .option("multiLine", multi_line).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record")
          .json(path)
          .withColumn("json_path", F.col("_metadata.file_path")))
    if not keep_rejects:
        df = df.drop("_corrupt_record")
    return df


def media_listing(spark: SparkSession, path: str, ext: str = "wav") -> DataFrame:
    """Names of existing media files: ``(media_path, stem)``; only the path
    column is selected, so file contents are never read.  (Spark's file listing
    skips zero-byte files: an empty media file counts as missing.)"""
    return (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}")
            .load(path).select(F.col("path").alias("media_path"))
            .withColumn("stem", file_stem("media_path")))


def with_media(calls: DataFrame, media: DataFrame, path_col: str = "json_path") -> DataFrame:
    """Keep a call only when a media file with the same stem exists."""
    c = calls.withColumn("stem", file_stem(path_col))
    return (c.join(media.select("stem", "media_path").dropDuplicates(["stem"]), "stem", "inner")
            .drop("stem"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV stage file with a declared schema; an index column is a normal key."""
    return (spark.read.schema(schema).option("header", True).option("encoding", "UTF-8")
            .option("multiLine", True).option("escape", '"').csv(path))


__all__ = ["CALL_RECORD", "UTTERANCE", "read_calls", "media_listing", "with_media",
           "read_csv"]
