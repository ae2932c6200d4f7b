"""Token-sequence operators.

Token tensors are modelled long: one row per ``(id, pos)`` with the token and
its class logits.  Running state along a sequence (speaker, segment number)
uses the blocked helpers, so one very long sequence is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.scalar import argmax, col_, softmax
from callscope.plans import blocked

#: whitespace that separates plain tokens
WHITESPACE = r"[ \t\n\r]+"
# --- fixed values: special tokens of the sequence model's tokenizer ----------
PAD, UNK, CLS, SEP = "<pad>", "<unk>", "<cls>", "<sep>"
SPECIAL_TOKENS = [PAD, UNK, CLS, SEP]
SPEAKER_TOKEN = r"^\[SPK([0-9]+)\]$"


def split_tokens(text: str | Column) -> Column:
    return F.filter(F.split(col_(text), WHITESPACE), lambda x: x != F.lit(""))


def pad_sequence(df: DataFrame, text: str, max_length: int, out: str = "tokens") -> DataFrame:
    """Whitespace tokens truncated to ``max_length`` and right-padded with
    ``<pad>``; ``attention_mask`` is 1 on real tokens."""
    toks = F.slice(split_tokens(text), 1, max_length)
    n = F.size("__t")
    return (df.withColumn("__t", toks)
            .withColumn(out, F.concat("__t", F.array_repeat(F.lit(PAD), F.lit(max_length) - n)))
            .withColumn("attention_mask", F.transform(out, lambda x, i: F.when(i < n, 1).otherwise(0)))
            .drop("__t"))


def valid_last_index(tokens: str | Column, length: int) -> Column:
    """C14: index before the first pad; without a pad the last index.  As in the
    source, a pad in position 0 wraps around to ``length - 1``."""
    first = F.array_position(col_(tokens), F.lit(PAD))
    return F.when(first == 0, F.lit(length - 1)).otherwise(F.pmod(first - 2, F.lit(length))).cast("int")


def valid_last_long(tok: DataFrame, id_col: str = "id", pos: str = "pos", token: str = "token",
                    pad: object = PAD, out: str = "valid_last") -> DataFrame:
    """C14 in long form: per id, the index before the first pad token (no pad:
    the last index; a pad at position 0 wraps to the last index)."""
    g = tok.groupBy(id_col).agg(F.min(F.when(F.col(token) == F.lit(pad), F.col(pos))).alias("__fp"),
                                F.count(F.lit(1)).alias("__len"))
    return g.select(id_col, F.when(F.col("__fp").isNull(), F.col("__len") - 1)
                    .otherwise(F.pmod(F.col("__fp") - 1, F.col("__len"))).cast("int").alias(out))


def speaker_fill(tok: DataFrame, id_col: str = "id", pos: str = "pos", token: str = "token",
                 out: str = "spk") -> DataFrame:
    """Every token gets the speaker of the latest ``[SPKn]`` token
    (initially 0); special tokens get 0 without changing the state."""
    n = F.regexp_extract(F.col(token), SPEAKER_TOKEN, 1)
    marker = F.when(n != "", n.cast("int"))
    filled = blocked.forward_fill(tok, [id_col], [pos], blocked.seq_block(pos), marker, "__spk")
    return (filled.withColumn(out, F.when(F.col(token).isin(*SPECIAL_TOKENS), F.lit(0))
                              .otherwise(F.coalesce("__spk", F.lit(0))).cast("int"))
            .drop("__spk"))


def segment_tokens(tok: DataFrame, id_col: str = "id", pos: str = "pos",
                   is_marker: str = "is_marker", valid_last: str | Column | None = None,
                   out: str = "seg") -> DataFrame:
    """Segment number per token — a split marker after position 0
    starts a new segment (a marker at 0 does not split off an empty head).
    Tokens are kept as the source model keeps them: everything before the last
    marker, plus the tail from the last marker up to the valid last index only
    if the last marker lies before it (a marker on the last valid token is
    dropped).  Without any marker the whole valid sequence is one segment."""
    mk = F.col(is_marker).cast("boolean")
    d = blocked.running_sum(tok, [id_col], [pos], blocked.seq_block(pos),
                            {out: F.when(mk & (F.col(pos) > 0), 1).otherwise(0)})
    vl = valid_last if valid_last is not None else "__vl"
    stats = tok.groupBy(id_col).agg(F.max(F.when(mk, F.col(pos))).alias("__mlast"),
                                    (F.count(F.lit(1)) - 1).alias("__vl"))
    d = d.join(stats, id_col)
    vlc = col_(vl)
    keep = (F.when(F.col("__mlast").isNull(), F.col(pos) <= vlc)
            .otherwise((F.col(pos) < F.col("__mlast")) |
                       ((F.col("__mlast") < vlc) & (F.col(pos) <= vlc))))
    return d.filter(keep).withColumn(out, F.col(out).cast("int")).drop("__mlast", "__vl")


def segment_mean(tok: DataFrame, cols: Sequence[str], id_col: str = "id", seg: str = "seg",
                 carry: Sequence[str] = ()) -> DataFrame:
    """Mean of each class column over the tokens of a segment."""
    return tok.groupBy(id_col, seg).agg(*[F.avg(c).alias(c) for c in cols],
                                        *[F.first(c).alias(c) for c in carry])


def class_max(seg_df: DataFrame, cols: Sequence[str], id_col: str = "id",
              carry: Sequence[str] = ()) -> DataFrame:
    """Per-class maximum over the segments of an id."""
    return seg_df.groupBy(id_col).agg(*[F.max(c).alias(c) for c in cols],
                                      *[F.first(c).alias(c) for c in carry])


def accuracy_and_loss(df: DataFrame, logits: str, label: str,
                      group: Sequence[str] = ()) -> DataFrame:
    """E23/E24 with I3/I4: argmax accuracy and mean cross-entropy of logits."""
    p = softmax(logits)
    d = df.select(*group, (argmax(logits) == F.col(label)).cast("double").alias("__hit"),
                  (-F.log(F.get(p, F.col(label)))).alias("__ce"))
    return d.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg("__hit").alias("accuracy"),
                                 F.avg("__ce").alias("cross_entropy"))


def softmax_class(cols: Sequence[str], k: int) -> Column:
    """Softmax over per-class columns, class ``k``."""
    return F.get(softmax(F.array(*[F.col(c) for c in cols])), k)
