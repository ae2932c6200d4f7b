"""Skew-safe ordered computations over a group.

A plain ``Window.partitionBy(key)`` puts a whole group into one task.  When one
key can hold a third of all rows that task becomes the job.  The helpers here
split every group into *blocks* — a column that is monotone in the sort order
(for example ``seq div 4096`` or ``floor(u * 2**20)`` for a uniform hash u) —
and compute

* block summaries with a grouped aggregate (partial aggregation, map-side),
* exclusive prefixes over the small block table (one row per block), and
* the local running value inside each ``(key, block)`` window,

then add the two.  Every window therefore holds at most one block, and the
block table is bounded by ``#keys x #blocks``.  Joins are on the one struct
``(key, block)`` that the local window is partitioned by, so its hash partitioning
is reused (the rows are shuffled once) and AQE may turn the join into a broadcast when the block table is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLK = "__blk"
_KEY = "__key"

#: default block width for integer sequence positions (utterances, tokens)
SEQ_BLOCK = 4096
#: default number of blocks for a uniform hash in [0, 1)
HASH_BLOCKS = 1 << 20


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def seq_block(seq: str | Column, width: int = SEQ_BLOCK) -> Column:
    c = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(c / F.lit(width)).cast("long")


def hash_block(u: str | Column, blocks: int = HASH_BLOCKS) -> Column:
    c = F.col(u) if isinstance(u, str) else u
    return F.least(F.floor(c * F.lit(blocks)).cast("long"), F.lit(blocks - 1))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Null-safe equi-join on ``keys`` (a NULL key is a group, as in a window)."""
    r = right.select(*[F.col(k).alias("__r_" + k) for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(r["__r_" + k]) for k in keys]
    return left.join(r, cond, how).drop(*["__r_" + k for k in keys])


def _keyed(df: DataFrame, part: Sequence[str], block: Column) -> DataFrame:
    """Adds the block key: one struct of the group's columns and the block.  Structs
    compare null-safe under plain equality, so windows, aggregates and joins on it
    share one hash partitioning and the rows are shuffled once."""
    return df.withColumn(_KEY, F.struct(*[F.col(p).alias(f"g{i}") for i, p in enumerate(part)], block.alias("b")))


def _prior_window(part: Sequence[str]):
    return (Window.partitionBy(*[F.col(f"{_KEY}.g{i}") for i in range(len(part))]).orderBy(F.col(f"{_KEY}.b"))
            .rowsBetween(Window.unboundedPreceding, -1))


def _local_window(order: Sequence[str | Column]):
    return Window.partitionBy(_KEY).orderBy(*_cols(order))


def row_number(df: DataFrame, part: Sequence[str], order: Sequence[str | Column],
               block: Column, out: str = "rn") -> DataFrame:
    """1-based ``row_number() over (partition by part order by order)``."""
    d = _keyed(df, part, block)
    offs = (d.groupBy(_KEY).agg(F.count(F.lit(1)).alias("__n"))
            .select(_KEY, F.coalesce(F.sum("__n").over(_prior_window(part)), F.lit(0)).alias("__off")))
    return (d.withColumn("__loc", F.row_number().over(_local_window(order))).join(offs, _KEY)
            .withColumn(out, (F.col("__loc") + F.col("__off")).cast("long"))
            .drop(_KEY, "__off", "__loc"))


def running_sum(df: DataFrame, part: Sequence[str], order: Sequence[str | Column],
                block: Column, cols: dict[str, str | Column]) -> DataFrame:
    """Inclusive running sums ``out = sum(expr) over (... rows unbounded preceding)``."""
    d = _keyed(df, part, block)
    for name, expr in cols.items():
        d = d.withColumn("__v_" + name, F.col(expr) if isinstance(expr, str) else expr)
    tot = d.groupBy(_KEY).agg(*[F.sum("__v_" + n).alias("__t_" + n) for n in cols])
    offs = tot.select(_KEY, *[F.coalesce(F.sum("__t_" + n).over(_prior_window(part)), F.lit(0)).alias("__o_" + n)
                              for n in cols])
    local = _local_window(order).rowsBetween(Window.unboundedPreceding, 0)
    for n in cols:
        d = d.withColumn("__l_" + n, F.sum("__v_" + n).over(local))
    d = d.join(offs, _KEY)
    for n in cols:
        d = d.withColumn(n, F.col("__l_" + n) + F.col("__o_" + n))
    return d.drop(_KEY, *[p + n for n in cols for p in ("__v_", "__l_", "__o_")])


def running_max(df: DataFrame, part: Sequence[str], order: Sequence[str | Column],
                block: Column, col: str | Column, out: str) -> DataFrame:
    """Inclusive running maximum of ``col``."""
    d = _keyed(df, part, block).withColumn("__v", F.col(col) if isinstance(col, str) else col)
    offs = (d.groupBy(_KEY).agg(F.max("__v").alias("__t"))
            .select(_KEY, F.max("__t").over(_prior_window(part)).alias("__o")))
    local = _local_window(order).rowsBetween(Window.unboundedPreceding, 0)
    return (d.withColumn("__l", F.max("__v").over(local)).join(offs, _KEY)
            .withColumn(out, F.greatest("__l", "__o"))
            .drop(_KEY, "__v", "__l", "__o"))


def forward_fill(df: DataFrame, part: Sequence[str], order: Sequence[str | Column],
                 block: Column, col: str | Column, out: str) -> DataFrame:
    """Latest non-null value of ``col`` up to and including the current row."""
    d = _keyed(df, part, block).withColumn("__v", F.col(col) if isinstance(col, str) else col)
    last_in_block = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*_cols(order))))
    offs = (d.groupBy(_KEY).agg(last_in_block.alias("__t"))
            .select(_KEY, F.last("__t", ignorenulls=True).over(_prior_window(part)).alias("__o")))
    local = _local_window(order).rowsBetween(Window.unboundedPreceding, 0)
    return (d.withColumn("__l", F.last("__v", ignorenulls=True).over(local)).join(offs, _KEY)
            .withColumn(out, F.coalesce("__l", "__o"))
            .drop(_KEY, "__v", "__l", "__o"))


def trailing_mean(df: DataFrame, part: Sequence[str], seq: str, window: int,
                  cols: dict[str, str], width: int = SEQ_BLOCK) -> DataFrame:
    """``avg(c) over (partition by part order by seq rows between window-1 preceding
    and current row)`` for a dense integer ``seq``.

    Blocks of ``width`` positions; the last ``window-1`` rows of each block are
    copied into the next block as a halo, so every frame lies inside one block.
    Shuffle volume grows by ``(window-1)/width`` only.
    """
    if window <= 1:
        out = df
        for name, src in cols.items():
            out = out.withColumn(name, F.col(src).cast("double"))
        return out
    both, w = _with_halo(df, part, seq, window, width)
    for name, src in cols.items():
        both = both.withColumn(name, F.avg(F.col(src).cast("double")).over(w))
    return both.filter(~F.col("__halo")).drop(_BLK, "__halo")


def trailing_frames(df: DataFrame, part: Sequence[str], seq: str, window: int, col: str, out: str,
                    width: int = SEQ_BLOCK) -> DataFrame:
    """``out``: the values of ``col`` in the same frame as ``trailing_mean``'s, oldest first."""
    both, w = _with_halo(df, part, seq, max(window, 1), width)
    return both.withColumn(out, F.collect_list(col).over(w)).filter(~F.col("__halo")).drop(_BLK, "__halo")


def _with_halo(df: DataFrame, part: Sequence[str], seq: str, window: int, width: int):
    """Blocks with the halo rows of the block before, and the window over them."""
    halo = window - 1
    if halo >= width:
        width = halo + 1
    blk = F.floor(F.col(seq) / F.lit(width)).cast("long")
    # one pass: every row keeps its block; the last `halo` rows of a block are
    # also emitted into the next block as halo rows (explode, no union / rescan)
    own = F.struct(blk.alias("b"), F.lit(False).alias("h"))
    nxt = F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))
    tail = F.pmod(F.col(seq), F.lit(width)) >= F.lit(width - halo)
    both = (df.withColumn("__c", F.explode(F.when(tail, F.array(own, nxt)).otherwise(F.array(own))))
            .withColumn(_BLK, F.col("__c.b")).withColumn("__halo", F.col("__c.h")).drop("__c"))
    return both, Window.partitionBy(*part, _BLK).orderBy(seq).rowsBetween(-halo, 0)
