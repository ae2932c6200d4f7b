"""Near-duplicate embeddings by randomly rotated binary codes.

Equal vectors are first put together.  The others are divided into cells around pivots
(rows of a bounded sample) and compared block by block; a pair of cells whose angle
less their radii exceeds the threshold's angle cannot hold a link and is left out.  In
a block, a unit vector x is rotated at random and stored as its signs b (scaled to unit
length) with the factor f = <x, b>.  For another vector y, <b, y> / f estimates <x, y>
without bias.  Two bounds on its error decide which pairs are computed exactly from
the original vectors: the confidence bound e * sqrt((1 - f^2) / f^2) / sqrt(d - 1), and
the angle between x and b, which no pair can escape; ``e`` is so large that the
confidence bound does not lose pairs either.

A block pair yields no pairs: for each row the links, and the edges of a spanning
forest, from which the components are made.

Defined results: vectors that are null, zero, or hold null or non-finite components
link with nothing; rows that repeat an id are rows of their own with the component of
any of them; a null id takes part with links but is the smallest of none; an empty
table gives an empty table.  All usable vectors must have one length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import column, components
from callscope.llm.vectors import cosines, in_blocks, matrix, sample, unit, usable
from callscope.session import cut_lineage

#: Rows of a block, and rows of a cell that the number of cells aims at.
BLOCK, CELL_ROWS, MOST_CELLS = 4096, 4096, 512
#: Width of the confidence bound, in standard errors (and some).
CONFIDENCE = 6.0
_TILE = 1024


class Codes:
    """The binary codes of unit vectors, their factors, and the least <b, y> of a pair
    that may reach the threshold."""

    def __init__(self, x: np.ndarray, rotation: np.ndarray, threshold: float, confidence: float = CONFIDENCE):
        d = x.shape[1]
        turned = x @ rotation
        self.bits = np.packbits(turned >= 0, axis=1)
        self.factor = np.abs(turned).sum(1) / d ** 0.5
        self.d = d
        f = np.clip(self.factor, 1e-6, 1)
        angle = np.arccos(f)
        by_angle = np.where(angle + np.arccos(threshold) < np.pi, np.cos(np.minimum(angle + np.arccos(threshold), np.pi)), -1.0)
        error = confidence * np.sqrt((1 - f * f) / (f * f)) / max(d - 1, 1) ** 0.5
        self.least = np.maximum(by_angle, f * (threshold - error)) - 1e-5

    def signs(self) -> np.ndarray:
        return ((np.unpackbits(self.bits, axis=1, count=self.d).astype(np.float32) * 2 - 1) / np.float32(self.d ** 0.5))

    def estimate(self, turned: np.ndarray) -> np.ndarray:
        """<b, y> / f for rotated unit vectors y."""
        return (self.signs() @ turned.T.astype(np.float32)) / self.factor[:, None]


def rotation(d: int, seed: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def links(a: np.ndarray, b: np.ndarray | None, threshold: float, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of a and b (of a with itself for None, each pair once)
    whose cosine reaches the threshold."""
    ua = unit(a)
    codes = Codes(ua, turn, threshold)
    signs, other = codes.signs(), a if b is None else b
    turned = (unit(other) @ turn).astype(np.float32)
    out = [(np.empty(0, int), np.empty(0, int))]
    for i in range(0, len(a), _TILE):
        for j in range(i if b is None else 0, len(other), _TILE):
            s = signs[i:i + _TILE] @ turned[j:j + _TILE].T
            x, y = np.divmod(np.flatnonzero(s >= codes.least[i:i + _TILE, None].astype(np.float32)), s.shape[1])
            x, y = x + i, y + j
            if b is None:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), 1 << 17):  # what the bounds cannot decide
                p, q = x[at:at + (1 << 17)], y[at:at + (1 << 17)]
                hit = cosines(a[p], other[q]) >= threshold
                out.append((p[hit], q[hit]))
    return tuple(np.concatenate(c) for c in zip(*out))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n vertices, the smallest vertex of its component."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        new = root.copy()
        np.minimum.at(new, ra, low)
        np.minimum.at(new, rb, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, seed: int = 0) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: the other rows with a cosine of
    at least ``threshold``, the smallest key that links lead to, and whether that is
    the row's own.  Keys are longs (or ints)."""
    rows = usable(df, key, vector)
    copies = cut_lineage(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("id0", F.monotonically_increasing_id()))
    pivots = sample(copies, MOST_CELLS)
    base = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    if not len(pivots):
        return base.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    pivots = pivots[:max(1, min(len(pivots), copies.count() // CELL_ROWS))]
    turn = rotation(pivots.shape[1], seed)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                s = unit(matrix(column(batch, "v"))) @ pivots.T
                cell = s.argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.arccos(np.clip(s.max(1), -1, 1))), column(batch, "id0"),
                                                  column(batch, "copies"), column(batch, "v")], ["cell", "angle", "id", "copies", "v"])

    placed = cut_lineage(copies.select("id0", "copies", "v").mapInArrow(place, "cell int, angle double, id long, copies long, v array<double>"))
    radius = {r.cell: r.radius for r in placed.groupBy("cell").agg(F.max("angle").alias("radius")).collect()}  # at most MOST_CELLS rows
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    reach = np.arccos(threshold) + 1e-9
    near = [(i, j) for i in radius for j in radius if i <= j and between[i, j] - radius[i] - radius[j] <= reach]
    blocks = in_blocks(placed, "cell", ["id", "copies", "v"], BLOCK)
    pairs = df.sparkSession.createDataFrame(near, "cell int, cell2 int")
    left = blocks.select("cell", F.col("block").alias("b1"), F.col("rows").alias("r1"))
    right = blocks.select(F.col("cell").alias("cell2"), F.col("block").alias("b2"), F.col("rows").alias("r2"))
    met = left.join(pairs, "cell").join(right, "cell2").where("cell < cell2 or b1 <= b2")

    def compare(batches):
        for batch in batches:
            same = zip(*(column(batch, c).to_pylist() for c in ("cell", "cell2", "b1", "b2")), strict=True)
            for (c1, c2, b1, b2), r1, r2 in zip(same, column(batch, "r1"), column(batch, "r2"), strict=True):
                alone = (c1, b1) == (c2, b2)
                parts = [r1.values] if alone else [r1.values, r2.values]
                x = [matrix(p.field("v")) for p in parts]
                ids = np.concatenate([p.field("id").to_numpy() for p in parts])
                copies = np.concatenate([p.field("copies").to_numpy() for p in parts])
                i, j = links(x[0], None if alone else x[1], threshold, turn)
                if not len(i):
                    continue
                if not alone:
                    j = j + len(x[0])
                n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at].astype(np.int64)), pa.array(ids[forest(len(ids), i, j)[at]])],
                                                 ["id0", "links", "root"])

    found = cut_lineage(met.mapInArrow(compare, "id0 long, links long, root long"))
    linked = found.groupBy("id0").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id0").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("id0"), "component")
    known = (copies.join(linked, "id0", "left").join(groups, "id0", "left")
             .select("id0", "id", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id0").alias("component")))
    smallest = known.groupBy("component").agg(F.min("id").alias("component_id"))
    named = known.join(smallest, "component").select("v", "n_links", "component_id")
    out = base.join(named, "v", "left").select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                                               F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
