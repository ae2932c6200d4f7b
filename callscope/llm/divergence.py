"""Audit of how far the sources of a language differ, by cube partitioning.

Term counts are added up inside the tasks and then by Spark.  The smoothed integer
shares p of every (language, source) group are cut into slices of a term block, and
tasks own the cells (group block, group block, term block) of a cube: every slice is
copied to the cells of its group block's row and column, a cell works out the partial
divergences of its pairs of groups over its terms, and the partial sums are reduced
along the term axis.  A second report lists the terms by which a group exceeds its
language.

Terms are the runs of letters A-Z, a-z and of all characters beyond ASCII; only A-Z are
lower-cased.  A language keeps the terms that at least ``min_docs`` of its rows hold.
Shares are ``1 + floor(scale * (count + prior) / (N + prior * V))`` in exact decimals.

Defined results: null text, language and source count as ''; a repeated row counts each
time; groups without terms take part with the shares of absent terms; a language without
kept terms has pairs of value 0 and no terms; ties go to the smaller item in UTF-8 order;
an empty table gives an empty table; other columns are not read.  The number of pairs of a
language is the square of its number of sources, by the result's definition.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import column, small_batches
from callscope.session import cut_lineage

#: Shares that a language's terms are dealt to when they meet its totals.
SALTS = 64
#: Groups and terms of a block, on average.
GROUP_BLOCK, TERM_BLOCK = 32, 4096
#: Counted terms that a task holds before it hands them on, and bytes of a text scanned at once.
HELD, WINDOW = 200_000, 1 << 20

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_OTHER = re.compile(rb"[^a-z\x80-\xff]")


def windows(raw: bytes):
    """Pieces of about WINDOW bytes of a text, cut between terms."""
    start = 0
    while start < len(raw):
        stop = len(raw)
        if stop - start > WINDOW:
            other = _OTHER.search(raw, start + WINDOW)
            stop = other.start() if other else stop
        yield raw[start:stop]
        start = stop


def term_counts(df: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows with the term, added up in the
    tasks as far as HELD allows, so a key may occur in several rows.  The null term
    counts the group's rows."""
    def run(batches):
        held, size = {}, 0

        def out():
            rows = [(*g, t, c, docs[t]) for g, (n, docs) in held.items() for t, c in n.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()).cast(pa.string()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in small_batches(batches, "text"):
            for g0, g1, raw in zip(column(batch, "lang").to_pylist(), column(batch, "source").to_pylist(),
                                   column(batch, "text").cast(pa.binary()).to_pylist(), strict=True):
                n, docs = held.setdefault((g0, g1), (Counter(), Counter()))
                before, own = len(n), set()
                for piece in windows(raw.lower()):
                    terms = _TERM.findall(piece)
                    n.update(terms)
                    own.update(terms)
                docs.update(own)
                n[None] += 0
                docs[None] += 1
                size += len(n) - before
                if size > HELD:
                    yield out()
                    held, size = {}, 0
        yield out()

    plain = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    return plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count, total, terms, scale: int, prior: int):
    """Exact: the counts of a large corpus times the scale go beyond 64 bits."""
    top = F.lit(scale).cast("decimal(10,0)") * (count + prior).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (total + prior * terms).cast("decimal(20,0)"))


def _cells(table: pa.Table) -> pa.Table:
    """Partial divergences of a cell's pairs: sums of absolute differences over its terms."""
    lang, a, b, part = [], [], [], []
    names, sides = table.column("source").to_pylist(), table.column("side").to_numpy()
    shares = np.empty((table.num_rows, table.column("terms")[0].as_py()), np.int64)
    shares[:] = table.column("absent").to_numpy()[:, None]
    for i, (at, own) in enumerate(zip(table.column("at"), table.column("shares"), strict=True)):
        if at.is_valid and len(at):
            shares[i, at.values.to_numpy()] = own.values.to_numpy()
    for i in np.flatnonzero(sides != 1):
        others = np.flatnonzero(sides == 1) if sides[i] == 0 else np.arange(i + 1, len(sides))
        for j in others:
            lang.append(table.column("lang")[0].as_py())
            a.append(names[i])
            b.append(names[j])
            part.append(int(np.abs(shares[i] - shares[j]).sum()))
    return pa.table({"lang": pa.array(lang, pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()),
                     "part": pa.array(part, pa.int64())})


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 30, scale: int = 1_000_000_000,
          prior: int = 5, top: int = 50, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank).  Part ``pair``: the language's other
    sources by the sum of absolute differences of shares; part ``term``: the group's ``top``
    terms whose share exceeds the language's, by the difference."""
    counts = cut_lineage(term_counts(df, lang, source, text).groupBy("lang", "source", "term")
                         .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    groups = counts.where("term is null").select("lang", "source")
    terms = (counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
             .where(F.col("docs") >= min_docs).select("lang", "term", "lang_n"))
    langs = (groups.groupBy("lang").agg(F.count("*").alias("sources"))
             .join(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left")
             .na.fill(0, ["v", "lang_total"]))
    langs = cut_lineage(langs.select(
        "lang", "v", "lang_total", F.ceil(F.col("sources") / group_block).alias("group_blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("v") / term_block)).alias("term_blocks")))
    # places of the terms in their blocks; a block is a share of the terms by hash
    block = F.pmod(F.xxhash64("term"), "term_blocks")
    salt = F.pmod(F.xxhash64("term", F.lit(1)), F.lit(SALTS)).cast("int")
    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = terms.withColumn("salt", salt).join(salted, ["lang", "salt"]).select("lang", "term", "v", block.alias("block"),
                                              _share(F.col("lang_n"), F.col("lang_total"), F.col("v"), scale, prior).alias("q"))
    placed = cut_lineage(placed.withColumn("at", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1))
    kept = cut_lineage(counts.where("n > 0").select("lang", "source", "term", "n").join(placed, ["lang", "term"]))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut_lineage(groups.join(langs, "lang").join(sums, ["lang", "source"], "left").na.fill(0, ["total"]))
    shares = kept.join(groups.select("lang", "source", "total"), ["lang", "source"]).select(
        "lang", "source", "term", "block", "at", "q", _share(F.col("n"), F.col("total"), F.col("v"), scale, prior).alias("p"))

    group = Window.partitionBy("lang", "source")
    ranked = lambda part, rows: rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value",
        F.row_number().over(group.orderBy(F.desc("value"), "item")).cast("int").alias("rank"))
    above = ranked("term", shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")))

    # slices: a group's shares in a term block, also where it has none of the terms
    sizes = placed.groupBy("lang", "block").agg(F.count("*").cast("int").alias("terms"))
    own = shares.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("at", "p")).alias("own"))
    slices = (groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)))
              .join(sizes, ["lang", "block"], "left").join(own, ["lang", "source", "block"], "left")
              .select("lang", "source", "block", F.coalesce("terms", F.lit(0)).alias("terms"), F.col("own.at").alias("at"), F.col("own.p").alias("shares"),
                      F.coalesce(F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.greatest("v", F.lit(1)), scale, prior)), F.lit(0)).alias("absent"),
                      F.pmod(F.xxhash64("source"), "group_blocks").alias("row"), "group_blocks"))
    copies = slices.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("group_blocks") - 1)))
    cells = copies.select("lang", "source", "block", "terms", "at", "shares", "absent", F.least("row", "other").alias("i"), F.greatest("row", "other").alias("j"),
                          F.when(F.col("row") < F.col("other"), 0).when(F.col("row") > F.col("other"), 1).otherwise(2).alias("side"))
    partial = cells.groupBy("lang", "i", "j", "block").applyInArrow(_cells, "lang string, a string, b string, part long")
    pairs = partial.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("part").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                  F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    return ranked("pair", both.select("lang", "x.source", "x.item", "value")).unionByName(above.where(F.col("rank") <= top))
