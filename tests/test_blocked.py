"""Blocked (skew-safe) ordered computations equal plain window functions,
whatever the block width and the physical partitioning."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from callscope.plans import blocked


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    rows = []
    for g in range(5):
        n = rnd.choice([1, 3, 17, 60])  # one group much larger than the others
        for s in range(n):
            rows.append((g, s, rnd.random(), rnd.choice([None, None, rnd.randint(0, 3)])))
    return spark.createDataFrame(rows, "g int, s int, v double, m int")


@pytest.mark.parametrize("width,parts", [(1, 1), (4, 3), (7, 17), (4096, 2)])
def test_row_number_and_running_sum(spark, data, width, parts):
    d = data.repartition(parts)
    w = Window.partitionBy("g").orderBy("s")
    ref = {(r.g, r.s): (r.rn, r.cs) for r in data.select(
        "g", "s", F.row_number().over(w).alias("rn"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cs")).collect()}
    rn = {(r.g, r.s): r.rn for r in blocked.row_number(d, ["g"], ["s"], blocked.seq_block("s", width)).collect()}
    cs = {(r.g, r.s): r.cs for r in blocked.running_sum(d, ["g"], ["s"], blocked.seq_block("s", width),
                                                        {"cs": "v"}).collect()}
    assert rn == {k: v[0] for k, v in ref.items()}
    assert cs == pytest.approx({k: v[1] for k, v in ref.items()})


@pytest.mark.parametrize("width", [1, 2, 5])
def test_forward_fill_and_running_max(spark, data, width):
    w = Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    ref = {(r.g, r.s): (r.ff, r.mx) for r in data.select(
        "g", "s", F.last("m", ignorenulls=True).over(w).alias("ff"), F.max("v").over(w).alias("mx")).collect()}
    ff = {(r.g, r.s): r.ff for r in blocked.forward_fill(data, ["g"], ["s"], blocked.seq_block("s", width),
                                                         "m", "ff").collect()}
    mx = {(r.g, r.s): r.mx for r in blocked.running_max(data, ["g"], ["s"], blocked.seq_block("s", width),
                                                        "v", "mx").collect()}
    assert ff == {k: v[0] for k, v in ref.items()}
    assert mx == {k: v[1] for k, v in ref.items()}


@pytest.mark.parametrize("window,width", [(2, 1), (3, 2), (3, 3), (5, 4)])
def test_trailing_mean(spark, data, window, width):
    w = Window.partitionBy("g").orderBy("s").rowsBetween(-(window - 1), 0)
    ref = {(r.g, r.s): r.a for r in data.select("g", "s", F.avg("v").over(w).alias("a")).collect()}
    got = {(r.g, r.s): r.a for r in blocked.trailing_mean(data, ["g"], "s", window, {"a": "v"}, width).collect()}
    assert got == pytest.approx(ref)


def test_random_layouts_match_windows(spark):
    """Hypothesis-generated groups, gaps in positions and block widths."""
    from hypothesis import given, settings, strategies as st

    cases = []

    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 200), st.integers(-5, 5)), min_size=1, max_size=40,
                    unique_by=lambda t: (t[0], t[1])),
           st.integers(1, 50))
    def collect(rows, width):
        cases.append((rows, width))

    collect()
    rows = [(c, g, s, v) for c, (rs, _) in enumerate(cases) for g, s, v in rs]
    df = spark.createDataFrame(rows, "case int, g int, s int, v int")
    width_of = {c: w for c, (_, w) in enumerate(cases)}
    w = Window.partitionBy("case", "g").orderBy("s")
    ref = {(r.case, r.g, r.s): (r.rn, r.cs) for r in df.select(
        "case", "g", "s", F.row_number().over(w).alias("rn"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cs")).collect()}
    wexpr = F.element_at(F.create_map(*[x for c, wd in width_of.items() for x in (F.lit(c), F.lit(wd))]), F.col("case"))
    blk = F.floor(F.col("s") / wexpr).cast("long")
    rn = {(r.case, r.g, r.s): r.rn for r in blocked.row_number(df, ["case", "g"], ["s"], blk).collect()}
    cs = {(r.case, r.g, r.s): r.cs for r in blocked.running_sum(df, ["case", "g"], ["s"], blk, {"cs": "v"}).collect()}
    assert rn == {k: v[0] for k, v in ref.items()}
    assert cs == {k: v[1] for k, v in ref.items()}


def test_null_group_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), (1, 1, 5.0)], "g int, s int, v double")
    rn = {(r.g, r.s): r.rn for r in blocked.row_number(df, ["g"], ["s"], blocked.seq_block("s", 1)).collect()}
    assert rn == {(None, 1): 1, (None, 2): 2, (1, 1): 1}
    cs = {(r.g, r.s): r.cs for r in blocked.running_sum(df, ["g"], ["s"], blocked.seq_block("s", 1), {"cs": "v"}).collect()}
    assert cs == {(None, 1): 1.0, (None, 2): 3.0, (1, 1): 5.0}
