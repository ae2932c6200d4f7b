"""K1: feature standardisation with train statistics.

Features are handled long ``(id, dim, x)``: the per-dimension statistics are a
grouped aggregate (partial aggregation), and the statistics table has one row
per dimension, so it is broadcast with a bound given by the feature count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, features: str = "features", id_col: str = "id") -> DataFrame:
    return df.select(id_col, F.posexplode(features).alias("dim", "x")).withColumn("dim", F.col("dim").cast("int"))


def fit_scaler(train_long: DataFrame) -> DataFrame:
    """Mean and *population* std per dimension; zero std becomes 1."""
    return (train_long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
            .withColumn("std", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))))


def apply_scaler(long: DataFrame, scaler: DataFrame, out: str = "z") -> DataFrame:
    s = F.broadcast(scaler.select("dim", "mean", "std"))
    return (long.join(s, "dim").withColumn(out, (F.col("x") - F.col("mean")) / F.col("std"))
            .drop("mean", "std"))


def apply_to_vectors(df: DataFrame, scaler: DataFrame, features: str = "features", out: str = "features") -> DataFrame:
    """Standardised vectors, without a shuffle of the rows: the statistics become one
    row of arrays (as long as a vector) and are zipped with each vector."""
    one = scaler.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("__scaler"))
    z = F.zip_with(features, "__scaler", lambda x, s: (x - s["mean"]) / s["std"])
    return df.crossJoin(F.broadcast(one)).withColumn(out, z).drop("__scaler")


def to_vectors(long: DataFrame, value: str = "z", id_col: str = "id", out: str = "features") -> DataFrame:
    """Long -> dense ``ARRAY<DOUBLE>`` ordered by dim (one row per id)."""
    return (long.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("dim", value))).alias("__v"))
            .select(id_col, F.transform("__v", lambda s: s[value]).alias(out)))
