"""Per-call smoothing and pooling of segment scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.plans import blocked


def moving_average(df: DataFrame, window: int, cols: Sequence[str] = ("p",),
                   id_col: str | Sequence[str] = "id", seq: str = "seq",
                   suffix: str = "", dense: bool = True) -> DataFrame:
    """trailing mean over the last ``window`` segments of the same id (short
    heads average what exists; window 0 or 1 = identity).  With ``dense`` the
    ``seq`` column is taken as the 0..n-1 position; ``dense=False`` first ranks
    ``seq`` within the id (blocked row number), for positions with gaps.  Runs
    as a blocked window with a halo, so a huge call is spread over many tasks."""
    part = [id_col] if isinstance(id_col, str) else list(id_col)
    if not dense:
        d = blocked.row_number(df, part, [seq], blocked.seq_block(seq), out="__pos")
        out = blocked.trailing_mean(d, part, "__pos", window, {c + suffix: c for c in cols})
        return out.drop("__pos")
    return blocked.trailing_mean(df, part, seq, window,
                                 {c + suffix: c for c in cols})


def moving_average_arrays(df: DataFrame, window: int, col: str = "p", id_col: str | Sequence[str] = "id",
                          seq: str = "seq") -> DataFrame:
    """F2 for an array of scores (one element for each configuration): the elements' trailing
    means.  A row is shuffled once, whatever the number of configurations."""
    if window <= 1:
        return df
    part = [id_col] if isinstance(id_col, str) else list(id_col)
    framed = blocked.trailing_frames(df, part, seq, window, col, "__frame")
    rest = F.slice("__frame", F.lit(2), F.size("__frame") - 1)
    total = F.aggregate(rest, F.get("__frame", F.lit(0)), lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))
    return framed.withColumn(col, F.transform(total, lambda s: s / F.size("__frame"))).drop("__frame")


def call_score(df: DataFrame, method: str = "max", col: str = "p",
               id_col: str = "id", out: str | None = None) -> DataFrame:
    """One score per call, the max or the mean of the segment scores."""
    poolings = {"max": F.max, "average": F.avg}
    if method not in poolings:
        raise ValueError(f"unknown pooling {method!r}; known: {sorted(poolings)}")
    agg = poolings[method](col)
    return df.groupBy(id_col).agg(agg.cast("double").alias(out or col))


def sample_unit_mean(df: DataFrame, cols: Sequence[str], id_col: str = "id") -> DataFrame:
    """Mean of every listed numeric column per id."""
    return df.groupBy(id_col).agg(*[F.avg(c).alias(c) for c in cols])
