"""One call holding a third of all rows: the ordered operators stay exact and
the hot call is processed by several tasks, not one."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from callscope.operators import hits, sequence, smoothing
from callscope.plans import blocked


@pytest.fixture(scope="module")
def skewed(spark):
    # 60 ordinary calls of 100 segments + one hot call of 3000 segments (1/3 of all rows)
    base = spark.range(6000).select((F.col("id") % 60).alias("id"), (F.col("id") / 60).cast("long").alias("seq"))
    hot = spark.range(3000).select(F.lit(999).cast("long").alias("id"), F.col("id").alias("seq"))
    d = base.unionByName(hot)
    return d.select("id", "seq", (F.abs(F.hash("id", "seq")) % 1000 / 1000.0).alias("p"),
                    (F.col("seq") * 1000).alias("starttime"), (F.col("seq") * 1000 + 900).alias("endtime"),
                    (F.col("id") % 3).cast("int").alias("label1"))


def test_hot_call_spread_over_tasks(spark, skewed):
    width = 256
    out = blocked.trailing_mean(skewed, ["id"], "seq", 3, {"m": "p"}, width=width)
    parts = (out.filter(F.col("id") == 999).select(F.spark_partition_id().alias("pid"))
             .distinct().count())
    assert parts > 1  # the hot call's windows ran in more than one task
    ref = skewed.select("id", "seq", F.avg("p").over(
        Window.partitionBy("id").orderBy("seq").rowsBetween(-2, 0)).alias("m"))
    got = {(r.id, r.seq): r.m for r in out.select("id", "seq", "m").collect()}
    assert got == pytest.approx({(r.id, r.seq): r.m for r in ref.collect()})


def test_hot_call_ordered_ops_exact(spark, skewed):
    d = skewed.withColumn("pred", (F.col("p") > 0.995).cast("int"))
    h = {r.id: (r.s_num, r.starttime) for r in hits.first_hits(d).collect()}
    first = (d.filter("pred = 1").groupBy("id").agg(F.min("seq").alias("s")).collect())
    for r in first:
        assert h[r.id] == (r.s + 1, r.s * 1000)
    ords = sequence.segment_ordinal(skewed.select("id", "seq"))
    assert ords.filter(F.col("s_num") != F.col("seq") + 1).count() == 0
    cut = sequence.time_cut(skewed.withColumnRenamed("endtime", "end_ms"), 1_000_000)
    assert cut.filter("id = 999").count() == 1000  # seq 0..999 end by 999_900 ms
    ma = smoothing.moving_average(skewed, 1)
    assert ma.count() == skewed.count()
