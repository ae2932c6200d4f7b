"""Approximate nearest neighbours by learned partitions.

The index is fitted on a bounded sample: its neighbour graph is cut into balanced
parts (each vertex moves to the part that most of its neighbours are in, while there
is room), and a small classifier learns the share of each part among a vector's
neighbours.  Every row is put into its most probable part.  A query is sent to its
most probable parts, as many as the sample shows to hold the wanted share of its
neighbours, and is compared there with all rows, in blocks and in double precision.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part; a query is never its own neighbour (rows of its id are left out);
equal scores go to the smaller id; fewer candidates than ``k`` are all returned; an
empty table gives an empty table.  All usable vectors must have one length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import column
from callscope.llm.vectors import SAMPLE, cosines, in_blocks, matrix, sample, unit, usable

#: Rows of a part that the number of parts aims at, and the bounds of that number.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 2048, 8, 256
#: Rows of a block of candidates, and of queries.
BLOCK, QUERY_BLOCK = 4096, 512


@dataclass
class Index:
    weights: list[np.ndarray]
    parts: int
    probes: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(_logits(self.weights, x)[1])


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _logits(w, x):
    h = np.maximum(x @ w[0] + w[1], 0)
    return h, h @ w[2] + w[3]


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of every row of a sample (of unit vectors)."""
    out = []
    for at in range(0, len(x), 512):  # of a bounded sample, some rows at a time
        s = x[at:at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -2
        out.append(np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05, seed: int = 0) -> np.ndarray:
    """Parts of the neighbour graph of nearly equal size with few edges between them."""
    random = np.random.default_rng(seed)
    n, room = len(x), int(np.ceil(slack * len(x) / parts))
    centres = x[random.choice(n, parts, replace=False)]
    part = np.zeros(n, int)
    for _ in range(8):  # a balanced start: rows choose centres, those with most to lose first
        s = x @ centres.T
        order = np.argsort(np.sort(s, 1)[:, -2:].sum(1) - 2 * s.max(1))
        size = np.zeros(parts, int)
        for i in order:
            for p in np.argsort(-s[i]):
                if size[p] < room:
                    part[i] = p
                    size[p] += 1
                    break
        centres = unit(np.array([x[part == p].sum(0) if size[p] else x[random.integers(n)] for p in range(parts)]) + 1e-12)
    both = [[] for _ in range(n)]
    for i, own in enumerate(near.tolist()):
        for j in own:
            both[i].append(j)
            both[j].append(i)
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in random.permutation(n):
            votes = np.bincount(part[both[i]], minlength=parts)
            best = int(np.argmax(np.where((size < room) | (np.arange(parts) == part[i]), votes, -1)))
            if votes[best] > votes[part[i]]:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


def _train(x: np.ndarray, wanted: np.ndarray, hidden: int = 128, steps: int = 600, size: int = 512, rate: float = 3e-3, seed: int = 0) -> list[np.ndarray]:
    random = np.random.default_rng(seed)
    w = [random.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden),
         random.normal(0, (1 / hidden) ** 0.5, (hidden, wanted.shape[1])), np.zeros(wanted.shape[1])]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, steps + 1):
        rows = random.integers(0, len(x), size)
        h, z = _logits(w, x[rows])
        g = (_softmax(z) - wanted[rows]) / size
        back = (g @ w[2].T) * (h > 0)
        for i, d in enumerate((x[rows].T @ back + 1e-5 * w[0], back.sum(0), h.T @ g + 1e-5 * w[2], g.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            w[i] = w[i] - rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    return w


def fit(rows: DataFrame, k: int = 5, recall: float = 0.97, n_sample: int = SAMPLE, graph: int = 10, seed: int = 0) -> Index | None:
    """An index for ``usable`` rows, fitted on at most ``n_sample`` of them.  A quarter
    of the sample is kept from the classifier; on it, the number of parts that a query
    visits is chosen so that they hold ``recall`` of the k nearest sample rows."""
    x = sample(rows, n_sample)
    total = rows.count()
    if not len(x):
        return None
    parts = int(np.clip(total // PART_ROWS, LEAST_PARTS, MOST_PARTS))
    if len(x) < 8 * parts:
        return Index([np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1, 1)
    held = np.arange(len(x)) % 4 == 0
    near = neighbours(x, graph)
    part = balanced_parts(x, near, parts, seed=seed)
    wanted = (np.eye(parts)[part] + np.eye(parts)[part[near]].sum(1)) / (1 + near.shape[1])
    w = _train(x[~held], wanted[~held], seed=seed)
    p = _softmax(_logits(w, x)[1])
    home = p.argmax(1)
    rank = np.argsort(np.argsort(-p[held], axis=1), axis=1)
    visits = np.sort(np.take_along_axis(rank, home[neighbours(x, k)[held]], axis=1).ravel())
    return Index(w, parts, min(parts, int(visits[int(np.ceil(recall * len(visits))) - 1]) + 1))


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5,
           index: Index | None = None) -> DataFrame:
    """(query_id, rank, <key>, score): the k nearest rows by cosine of every row for
    which ``is_query`` (an expression of the column ``id``) holds."""
    rows = usable(df, key, vector)
    kind = df.schema[key].dataType.simpleString()
    index = index or fit(rows, k)
    if index is None:
        return df.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score double")

    def routed(frame: DataFrame, probes: int) -> DataFrame:
        """A row for each of the most probable parts."""
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    x = matrix(column(batch, "v"))
                    best = np.argsort(-index.probabilities(unit(x)), axis=1, kind="stable")[:, :probes]
                    which = pa.array(np.repeat(np.arange(len(x)), best.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(best.ravel().astype(np.int32)), column(batch, "id").take(which),
                                                      column(batch, "v").take(which)], ["part", "id", "v"])
        return frame.mapInArrow(run, f"part int, id {kind}, v array<double>")

    there = in_blocks(routed(rows, 1), "part", ["id", "v"], BLOCK).select("part", F.col("rows").alias("there"))
    asked = in_blocks(routed(rows.where(is_query), index.probes), "part", ["id", "v"], QUERY_BLOCK).select("part", F.col("rows").alias("asked"))

    def compare(batches):
        for batch in batches:
            for q, c in zip(column(batch, "asked"), column(batch, "there"), strict=True):
                q, c = q.values, c.values
                qx, cx = matrix(q.field("v")), matrix(c.field("v"))
                qid, cid = (np.array(a.field("id").to_pylist(), object) for a in (q, c))
                s = unit(qx) @ unit(cx).T
                s[qid[:, None] == cid[None, :]] = -3
                top = np.sort(s, axis=1)[:, -min(k, len(cid))][:, None]
                i, j = np.nonzero((s >= top - 1e-9) & (s > -2))
                yield pa.RecordBatch.from_arrays([pa.array(qid[i].tolist()), pa.array(cid[j].tolist()), pa.array(cosines(qx[i], cx[j]))],
                                                 ["query_id", "found", "score"])

    pairs = asked.join(there, "part")
    found = pairs.select("asked", "there").mapInArrow(compare, f"query_id {kind}, found {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "found")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("found").alias(key), "score"))
