"""Row-level label rules and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions import fixed_values as FV
from callscope.functions.scalar import col_, k_of_group


def symptom_guard(calls: DataFrame, col: str = "symptom") -> DataFrame:
    """B2: keep a record only if its symptom field is a list (non-list -> NULL)."""
    return calls.filter(F.col(col).isNotNull())


def label_columns(df: DataFrame, symptoms: str = "symptom",
                  arrest: str = FV.ARREST_SYMPTOM,
                  emergency: Sequence[str] = FV.EMERGENCY_SYMPTOMS,
                  emergency_groups: Sequence[Sequence[str]] = (FV.EMERGENCY_SYMPTOMS_GROUP1,
                                                               FV.EMERGENCY_SYMPTOMS_GROUP2),
                  cardiac: Sequence[str] = FV.CARDIAC_SYMPTOMS) -> DataFrame:
    """``label`` (arrest present), ``label1`` (1 arrest, 2 emergency by the
    k-of-group rule, else 0) and ``label2`` (any cardiac symptom)."""
    a = F.col(symptoms)
    has_arrest = F.coalesce(F.array_contains(a, F.lit(arrest)), F.lit(False))
    return (df.withColumn("label", has_arrest)
            .withColumn("label1", F.when(has_arrest, F.lit(1))
                        .when(k_of_group(a, emergency, emergency_groups), F.lit(2))
                        .otherwise(F.lit(0)).cast("int"))
            .withColumn("label2", k_of_group(a, cardiac)))


def binarise(c: str | Column, positive: int = 1) -> Column:
    """1 if the label equals ``positive`` else 0."""
    return F.when(col_(c) == F.lit(positive), F.lit(1)).otherwise(F.lit(0)).cast("int")


def select_label(df: DataFrame, label_col: str, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Pick one of ``label | label1 | label2`` as ``y``."""
    if label_col not in ("label", "label1", "label2"):
        raise ValueError("label must be one of label, label1, label2")
    return df.select(*keys, F.col(label_col).alias("y"))


def feature_columns(df: DataFrame, exclude: Sequence[str] = ("Unnamed: 0", "id", "s_id")) -> DataFrame:
    """Every column except the helper/key columns."""
    return df.drop(*[c for c in exclude if c in df.columns])


def predict(p: str | Column, threshold: float | Column) -> Column:
    """``p >= t`` as 0/1."""
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return (col_(p) >= t).cast("int")


def threshold_table(spark: SparkSession) -> DataFrame:
    """Operating thresholds as a small dimension table (fixed size)."""
    rows = [(m, tc, w, meth, model, float(t))
            for (m, tc, w, meth), d in FV.OPERATING_THRESHOLDS.items() for model, t in d.items()]
    schema = T.StructType([T.StructField("mode", T.StringType()),
                           T.StructField("time_cut", T.IntegerType()),
                           T.StructField("window", T.IntegerType()),
                           T.StructField("method", T.StringType()),
                           T.StructField("model", T.StringType()),
                           T.StructField("threshold", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def apply_thresholds(scores: DataFrame, thresholds: DataFrame, keys: Sequence[str],
                     fallback: str | Column, p: str = "p", out: str = "pred") -> DataFrame:
    """Look the threshold up by ``keys`` (broadcast: the dimension has a
    fixed size); rows without an entry use ``fallback`` (label frequency)."""
    t = F.broadcast(thresholds.select(*keys, F.col("threshold").alias("__t")))
    return (scores.join(t, list(keys), "left")
            .withColumn("threshold", F.coalesce(F.col("__t"), col_(fallback)))
            .withColumn(out, predict(p, F.col("threshold"))).drop("__t"))


def outcome_category(pred: str | Column, label: str | Column) -> Column:
    """TP / FN / FP, everything else TN (a label 2 predicted 1 is TN)."""
    pr, lb = col_(pred), col_(label)
    return (F.when((pr == 1) & (lb == 1), F.lit("TP"))
            .when((pr == 0) & (lb == 1), F.lit("FN"))
            .when((pr == 1) & (lb == 0), F.lit("FP"))
            .otherwise(F.lit("TN")))


# --- fixed values: triage level -> binary label ------------------------------
TRIAGE_LABEL = {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}


def coalesce_triage(df: DataFrame, first: str, second: str, third: str) -> DataFrame:
    """First non-null of three triage levels, rows with none dropped,
    levels 1-3 -> 1 and 4-5 -> 0."""
    lv = F.coalesce(F.col(first), F.col(second), F.col(third))
    m = F.create_map(*[x for k, v in TRIAGE_LABEL.items() for x in (F.lit(k), F.lit(v))])
    return (df.filter(lv.isNotNull())
            .withColumn("triage_level", lv.cast("int"))
            .withColumn("triage_label", F.element_at(m, lv.cast("int")).cast("int")))
