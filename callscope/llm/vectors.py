"""Helpers of the operators on embeddings: usable rows, a bounded sample, and blocks
of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that models of the vectors' distribution are fitted on, at most.
SAMPLE = 4096


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows whose vector is not null, not zero, and all finite."""
    v = F.col("v")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
            .where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0)))


def sample(rows: DataFrame, n: int = SAMPLE) -> np.ndarray:
    """Unit vectors of at most ``n`` rows, in the order of a hash of the id."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(n).select("v").collect()
    return unit(np.array([r.v for r in got], float)) if got else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal vectors give equal results wherever they lie."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def matrix(col: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column (of one length, without nulls)."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 0))


def in_blocks(rows: DataFrame, group: str, columns: list[str], size: int) -> DataFrame:
    """(group, block, rows): the rows of each group in blocks of about ``size``, each a
    list of structs.  Large groups have many blocks, so no list outgrows a task."""
    counts = rows.groupBy(group).agg(F.ceil(F.count("*") / size).alias("__blocks"))
    split = rows.join(counts, group).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("__blocks")).cast("int"))
    return split.groupBy(group, "block").agg(F.collect_list(F.struct(*columns)).alias("rows"))
