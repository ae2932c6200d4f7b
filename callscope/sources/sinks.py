"""Result sinks.  Parquet is primary; CSV is an export format."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """A5: one table per result kind; run parameters are partition columns instead
    of being encoded in file names.  Missing parameter columns are skipped."""
    keys = [c for c in ("model", "method", "window", "time_cut") if c in df.columns]
    write_parquet(df, path, keys or None)


def save_model(model, path: str) -> None:
    """Fitted ``pyspark.ml`` stages are persisted with their own writer."""
    model.write().overwrite().save(path)
