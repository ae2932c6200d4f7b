"""Splits, resampling and bootstrap summaries.

Random choices are seeded hash draws ``u = md5('<seed>:<key>')`` so that they
are reproducible in any engine and independent of partitioning.  Ranks over a
whole stratum (a third of the rows, for a 3-class label) use the blocked
row number of ``plans.blocked`` with blocks of the hash itself, so no stratum
is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.scalar import uniform_hash
from callscope.plans import blocked


def _ranked(df: DataFrame, part: Sequence[str], seed: int | str, key: str, out: str) -> DataFrame:
    d = df.withColumn("__u", uniform_hash(seed, key))
    return blocked.row_number(d, list(part), ["__u", key], blocked.hash_block("__u"), out=out).drop("__u")


def _with_counts(df: DataFrame, part: Sequence[str], out: str = "__n") -> DataFrame:
    n = df.groupBy(*part).agg(F.count(F.lit(1)).alias(out))
    # null-safe on the stratum (a NULL label is a stratum); one row without parts
    return blocked.join_null_safe(df, n, list(part)) if part else df.crossJoin(F.broadcast(n))


def split_cuts(df: DataFrame, id_col: str = "id", stratum: str = "label1", seed: int = 42,
               test_size: float = 0.2, valid_size: float = 0.2) -> DataFrame:
    """Per stratum, the last ``(u, id)`` key of the test and of the valid share
    (``ceil(test_size*n)`` lowest hash ranks are test, the next
    ``ceil(valid_size*(n-n_test))`` valid).  Only ``(id, stratum)`` is ranked;
    the result has one row per stratum."""
    ids = df.select(id_col, stratum)
    r = _with_counts(_ranked(ids, [stratum], seed, id_col, "__r"), [stratum])
    n_test = F.ceil(F.col("__n") * F.lit(test_size))
    n_valid = F.ceil((F.col("__n") - n_test) * F.lit(valid_size))
    key = F.struct(uniform_hash(seed, id_col).alias("u"), F.col(id_col).alias("k"))
    r = r.withColumn("__key", key)
    test = r.filter(F.col("__r") == n_test).select(stratum, F.col("__key").alias("test_cut"))
    valid = r.filter(F.col("__r") == n_test + n_valid).select(stratum, F.col("__key").alias("valid_cut"))
    strata = ids.select(stratum).distinct()

    def left_ns(a, b):  # null-safe left join on the stratum (a NULL label is a stratum)
        b2 = b.withColumnRenamed(stratum, "__k")
        return a.join(b2, a[stratum].eqNullSafe(b2["__k"]), "left").drop("__k")
    return left_ns(left_ns(strata, test), valid)


def apply_split(df: DataFrame, cuts: DataFrame, id_col: str = "id", stratum: str = "label1",
                seed: int = 42, out: str = "split") -> DataFrame:
    """Tag rows by comparing their ``(u, id)`` key with the stratum's cut keys.
    The cut table has one row per stratum and is broadcast, so the tagged
    table (texts and all) is never shuffled."""
    c = F.broadcast(cuts.withColumnRenamed(stratum, "__s"))
    key = F.struct(uniform_hash(seed, id_col).alias("u"), F.col(id_col).alias("k"))
    d = df.join(c, df[stratum].eqNullSafe(c["__s"]), "left")
    tag = (F.when(F.col("test_cut").isNotNull() & (key <= F.col("test_cut")), F.lit("test"))
           .when(F.col("valid_cut").isNotNull() & (key <= F.col("valid_cut")), F.lit("valid"))
           .otherwise(F.lit("train")))
    return d.withColumn(out, tag).drop("__s", "test_cut", "valid_cut")


def stratified_split(df: DataFrame, id_col: str = "id", stratum: str = "label1", seed: int = 42,
                     test_size: float = 0.2, valid_size: float = 0.2, out: str = "split",
                     tag_in_place: bool = False) -> DataFrame:
    """Per stratum, the ``ceil(test_size*n)`` lowest hash ranks are test,
    the next ``ceil(valid_size*(n-n_test))`` valid, the rest train (64/16/20).

    Default: blocked ranks joined back (right for narrow index tables).
    ``tag_in_place=True`` ranks ``(id, stratum)`` only and tags the rows against
    per-stratum cut keys with a broadcast of one row per stratum, so wide rows
    (texts) are never shuffled."""
    if tag_in_place:
        return apply_split(df, split_cuts(df, id_col, stratum, seed, test_size, valid_size),
                           id_col, stratum, seed, out)
    r = _with_counts(_ranked(df, [stratum], seed, id_col, "__r"), [stratum])
    n_test = F.ceil(F.col("__n") * F.lit(test_size))
    n_valid = F.ceil((F.col("__n") - n_test) * F.lit(valid_size))
    return (r.withColumn(out, F.when(F.col("__r") <= n_test, F.lit("test"))
                         .when(F.col("__r") <= n_test + n_valid, F.lit("valid"))
                         .otherwise(F.lit("train")))
            .drop("__r", "__n"))


def stratified_kfold(df: DataFrame, k: int = 5, id_col: str = "id", stratum: str = "label1",
                     seed: int = 42, out: str = "fold") -> DataFrame:
    """fold = (stratified hash rank - 1) mod k."""
    r = _ranked(df, [stratum], seed, id_col, "__r")
    return r.withColumn(out, ((F.col("__r") - 1) % k).cast("int")).drop("__r")


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42, out: str = "position") -> DataFrame:
    """An explicit random order as a 1-based position column."""
    return _ranked(df, [], seed, key, out)


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by key (a distributed top-n)."""
    return df.orderBy(key).limit(n)


def replicates(df: DataFrame, k: int, col: str = "k") -> DataFrame:
    """Cross product with ``k`` replicate numbers (a fixed-size broadcast side)."""
    r = df.sparkSession.range(k).select(F.col("id").cast("int").alias(col))
    return df.crossJoin(F.broadcast(r))


def bootstrap_rows(df: DataFrame, key: str, k: int = 10, rate: float = 0.75,
                   seed: int = 42) -> DataFrame:
    """``k`` subsamples of ``round(rate*n)`` rows each, without replacement
    (replicate ``i`` ranks rows by the hash seeded ``seed + i``).  Apply to
    call-level rows: the cost is ``k x`` the input."""
    rep = replicates(df, k)
    rep = rep.withColumn("__u", uniform_hash(F.col("k") + F.lit(seed), key))
    rk = blocked.row_number(rep, ["k"], ["__u", key], blocked.hash_block("__u"), out="__r")
    rk = _with_counts(rk, ["k"])
    return (rk.filter(F.col("__r") <= F.bround(F.col("__n") * F.lit(rate), 0))
            .drop("__u", "__r", "__n"))


def indexed_ids(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Distinct ids with a dense random index ``idx`` in 0..n-1 and ``n``."""
    ids = df.select(id_col).distinct()
    r = _ranked(ids, [], seed, id_col, "__r")
    return _with_counts(r, [], "n").select(id_col, (F.col("__r") - 1).alias("idx"), "n")


def bootstrap_ids(df: DataFrame, id_col: str = "id", k: int = 10, rate: float = 0.75,
                  seed: int = 42, distinct: bool = True) -> DataFrame:
    """Per replicate ``i`` draw ``int(rate * #ids)`` ids *with* replacement
    (draw ``d`` picks index ``floor(u(seed+i, d) * n)``).  ``distinct=True``
    keeps each drawn id once (membership test semantics); ``False`` keeps the
    multiplicity (lookup semantics).  The id table itself generates the draws,
    so nothing is produced in a single task.  Returns ``(k, id)``."""
    ix = indexed_ids(df, id_col, seed)
    draws = (replicates(ix.select("idx", "n"), k)
             .filter(F.col("idx") < F.floor(F.col("n") * F.lit(rate)))
             .select("k", F.floor(uniform_hash(F.col("k") + F.lit(seed), "idx") * F.col("n"))
                     .cast("long").alias("idx")))
    out = draws.join(ix.select("idx", id_col), "idx").select("k", id_col)
    return out.distinct() if distinct else out


def upsample(df: DataFrame, id_col: str = "id", label: str = "label", rate: float = 0.35,
             target: int = 1, by_id: bool = True, row_key: str | None = None,
             seed: int = 42) -> DataFrame:
    """Append copies of target-class rows — all rows of ``int(#ids*rate)``
    hash-chosen target ids (``by_id``) or ``round(rate*#rows)`` hash-chosen target
    rows — flagged ``is_copy``.  ``rate == 0`` passes the data through."""
    base = df.withColumn("is_copy", F.lit(False))
    if rate == 0:
        return base
    tgt = df.filter(F.col(label) == F.lit(target))
    if by_id:
        ids = _with_counts(_ranked(tgt.select(id_col).distinct(), [], seed, id_col, "__r"), [])
        chosen = ids.filter(F.col("__r") <= F.floor(F.col("__n") * F.lit(rate))).select(id_col)
        copies = tgt.join(chosen, id_col, "left_semi")
    else:
        key = row_key or id_col
        r = _with_counts(_ranked(tgt, [], seed, key, "__r"), [])
        copies = r.filter(F.col("__r") <= F.bround(F.col("__n") * F.lit(rate), 0)).drop("__r", "__n")
    return base.unionByName(copies.withColumn("is_copy", F.lit(True)))


def upsample_prevalence(upsampled: DataFrame, label: str = "label", target: int = 1) -> DataFrame:
    """The target class's share before and after ``upsample`` (one row)."""
    hit = (F.col(label) == F.lit(target)).cast("double")
    return upsampled.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_copy").alias("n_copies"),
                         F.avg(F.when(~F.col("is_copy"), hit)).alias("prevalence_before"), F.avg(hit).alias("prevalence"))


def bootstrap_summary(per_rep: DataFrame, metrics: Sequence[str], group: Sequence[str] = (),
                      display_digits: int = 3) -> DataFrame:
    """Mean and population std over replicates, plus ``mean±std`` text."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    s = per_rep.groupBy(*group).agg(*aggs)
    fmt = f"%.{display_digits}f"
    for m in metrics:
        s = s.withColumn(f"{m}_text", F.concat(F.format_string(fmt, f"{m}_mean"), F.lit("±"),
                                               F.format_string(fmt, f"{m}_std")))
    return s
