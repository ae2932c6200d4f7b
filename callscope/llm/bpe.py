"""Byte-level BPE with DuckDB recursive queries inside Spark tasks.

Texts are cut at places that the split pattern never crosses (before a space that
a non-space follows), on the bytes of a batch.  Its distinct parts are split into words, and the
distinct words are encoded by a recursive query: token-position rows join the merge
table, and the leftmost pair of lowest rank of each word is contracted until no word
has such a pair.  Decoding cuts ids into runs, joins the distinct runs with the
vocabulary and aggregates the bytes in order of position.

Defined results: a null or empty text has no ids, and no ids decode to no bytes; a
repeated row has equal ids; an empty table gives an empty table; an input column
that has the name of an output column is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from callscope.llm.common import ByteGenerations, column, distinct_slices, joined, paused_gc, small_batches, space_cuts, text_bytes

#: Bytes of distinct words (or ids of distinct runs) in one DuckDB query.
BYTES_PER_QUERY = 400_000
#: Bytes of a generation of a task's caches: of parts, words and decoded runs.
PART_CACHE, WORD_CACHE, RUN_CACHE = 64 << 20, 32 << 20, 64 << 20
#: Bytes of text, and ids, that are worked on together.
BATCH, IDS = 2 << 20, 1 << 20
#: One word's positions are told apart from its ranks by this factor.
STRIDE = 1 << 31

ENCODE = f"""
WITH RECURSIVE state(step, word, pos, next_pos, id, next_id) AS (
    SELECT 0, word, pos, lead(pos) OVER w, id, lead(id) OVER w
    FROM start WINDOW w AS (PARTITION BY word ORDER BY pos)
    UNION ALL
    SELECT s.step + 1, s.word, s.pos,
           CASE WHEN s.pos = best.at THEN best.after ELSE s.next_pos END,
           CASE WHEN s.pos = best.at THEN best.merged ELSE s.id END,
           CASE WHEN s.pos = best.at THEN best.after_id
                WHEN s.next_pos = best.at THEN best.merged ELSE s.next_id END
    FROM state s JOIN (
        SELECT pair.word, (pair.key % {STRIDE})::INT AS at, (pair.key // {STRIDE})::INT AS merged,
               pair.gone, right_side.next_pos AS after, right_side.next_id AS after_id
        FROM (SELECT word, min(rank * {STRIDE}::BIGINT + pos) AS key,
                     arg_min(next_pos, rank * {STRIDE}::BIGINT + pos) AS gone
              FROM state JOIN merges ON a = id AND b = next_id GROUP BY word) pair
        JOIN state right_side ON right_side.word = pair.word AND right_side.pos = pair.gone
    ) best ON s.word = best.word
    WHERE s.pos <> best.gone
)
SELECT step, word, pos, id FROM state
"""

#: For long words: all non-overlapping pairs of the lowest rank at a time, up to the
#: first whose merged token forms a pair of lower rank with a neighbour.  That is what
#: contracting them one by one comes to.
ENCODE_LONG = """
WITH RECURSIVE state(step, word, pos, id) AS (
    SELECT 0, word, pos, id FROM start
    UNION ALL
    SELECT step + 1, word, pos, CASE WHEN chosen THEN rank ELSE id END FROM (
        SELECT *, coalesce(lag(chosen) OVER (PARTITION BY word ORDER BY pos), false) AS gone FROM (
            SELECT *, hit AND coalesce(risks, 0) = 0 AND (nth - first_nth) % 2 = 0 AS chosen FROM (
                SELECT *, max(CASE WHEN hit AND NOT prev_hit THEN nth END) OVER so_far AS first_nth,
                       sum(risky::INT) OVER (PARTITION BY word ORDER BY pos
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS risks
                FROM (
                    SELECT p.step, p.word, p.pos, p.id, p.rank, p.hit,
                           coalesce(lag(hit) OVER so_far, false) AS prev_hit, sum(hit::INT) OVER so_far AS nth,
                           hit AND (p.self_low OR coalesce(l.rank < p.rank, false)
                                    OR coalesce(r.rank < p.rank, false)) AS risky
                    FROM (
                        SELECT *, coalesce(rank = min(rank) OVER (PARTITION BY word), false) AS hit,
                               min(rank) OVER (PARTITION BY word) AS best
                        FROM (SELECT *, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, lead(id, 2) OVER w AS after_id
                              FROM state WINDOW w AS (PARTITION BY word ORDER BY pos))
                        LEFT JOIN merges ON a = id AND b = next_id) p
                    LEFT JOIN merges l ON p.hit AND l.a = p.prev_id AND l.b = p.rank
                    LEFT JOIN merges r ON p.hit AND r.a = p.rank AND r.b = p.after_id
                    WHERE best IS NOT NULL
                    WINDOW so_far AS (PARTITION BY p.word ORDER BY p.pos ROWS UNBOUNDED PRECEDING))
                WINDOW so_far AS (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING))))
    WHERE NOT gone
)
SELECT step, word, pos, id FROM state
"""
#: Bytes from which a word is long.
LONG = 96

DECODE = """
SELECT run, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes
FROM runs JOIN vocab USING (id)
GROUP BY run
"""


class Vocabulary:
    """Ranks of a byte-level vocabulary, and the pairs that merge to a rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = pattern
        self.key = hashlib.sha1(repr((sorted(self.ranks.items()), pattern)).encode()).hexdigest()
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items()
                 for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.merges = np.array(pairs, np.int32).reshape(-1, 3)
        own = dict(zip(map(tuple, self.merges[:, :2].tolist()), self.merges[:, 2].tolist(), strict=True))
        self.self_low = np.array([own.get((r, r), r) < r for r in self.merges[:, 2].tolist()], bool)


class _Coder:
    """A task's DuckDB connection and what it has encoded and decoded so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.ranks = vocabulary.ranks
        self.split = regex.compile(vocabulary.pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        self.starts_run = np.zeros(size, bool)
        for token, rank in self.ranks.items():
            self.starts_run[rank] = token[:1] == b" "
        self.parts, self.words, self.runs = ByteGenerations(PART_CACHE), ByteGenerations(WORD_CACHE), ByteGenerations(RUN_CACHE)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "160MB"})
        a, b, rank = vocabulary.merges.T.copy()
        merges = pa.table({"a": a, "b": b, "rank": rank, "self_low": vocabulary.self_low})  # noqa: F841  read by name
        tokens = pa.table({"id": pa.array(self.ranks.values(), pa.int32()),  # noqa: F841
                           "hex": pa.array([t.hex() for t in self.ranks])})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM tokens")

    def __enter__(self) -> _Coder:
        return self

    def __exit__(self, *error) -> None:
        self.db.close()

    # encoding -------------------------------------------------------------------

    def encode(self, texts: pa.Array) -> pa.ListArray:
        data, at = text_bytes(texts)
        names, which, at = distinct_slices(data, space_cuts(data, at), at, pa.string())
        self._encode_parts(self.parts.missing(names))
        ids, ends = joined([*map(self.parts.new.__getitem__, names)], which, at)
        return pa.ListArray.from_arrays(pa.array(ends // 4), pa.Array.from_buffers(pa.int32(), int(ends[-1]) // 4, [None, ids]))

    def _encode_parts(self, new) -> None:
        new = list(new)
        words = list(map(self.split, new))
        missing = list(self.words.missing(chain.from_iterable(words)))
        known, raws = self.words.new, [w.encode() for w in missing]
        ranks = list(map(self.ranks.get, raws))
        own = [i for i, r in enumerate(ranks) if r is not None]
        self.words.put_all([missing[i] for i in own], [ranks[i].to_bytes(4, sys.byteorder) for i in own])
        size = np.array([len(raw) if r is None else 0 for raw, r in zip(raws, ranks, strict=True)], np.int64)
        for query, todo in ((ENCODE, np.flatnonzero((size > 0) & (size < LONG))), (ENCODE_LONG, np.flatnonzero(size >= LONG))):
            for chunk in _chunks(todo, size[todo]):
                self.words.put_all([missing[i] for i in chunk], self._merge(query, [raws[i] for i in chunk]))
        self.parts.put_all(new, [known[its[0]] if len(its) == 1 else b"".join([known[w] for w in its]) for its in words])

    def _merge(self, query: str, words: list[bytes]) -> list[bytes]:
        size = np.array([len(w) for w in words])
        first = np.repeat(np.cumsum(size) - size, size)
        start = pa.table({  # noqa: F841  read by name
            "word": np.repeat(np.arange(len(words), dtype=np.int32), size),
            "pos": (np.arange(size.sum()) - first).astype(np.int32),
            "id": self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]})
        step, word, pos, ids = self.db.execute(query).fetchnumpy().values()
        last = np.zeros(len(words), step.dtype)
        np.maximum.at(last, word, step)
        final = np.flatnonzero(step == last[word])
        final = final[np.lexsort((pos[final], word[final]))]
        ends = np.cumsum(np.bincount(word[final], minlength=len(words))) * 4
        raw = np.ascontiguousarray(ids[final], np.int32).tobytes()
        return [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    # decoding -------------------------------------------------------------------

    def decode(self, lists: pa.ListArray) -> pa.BinaryArray:
        """Runs of ids are cut before tokens that begin with a space."""
        if lists.null_count:
            lists = pc.fill_null(lists, pa.scalar([], lists.type))
        ids = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False))
        at = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        cut = np.append(self.starts_run[ids], False)
        cut[at] = True
        names, which, at = distinct_slices(ids.view(np.uint8), cut[:-1], at, pa.binary(), 4)
        new = list(self.runs.missing(names))
        for chunk in _chunks(np.arange(len(new)), np.array([len(r) for r in new], np.int64)):
            keys = [new[i] for i in chunk]
            ids = np.frombuffer(b"".join(keys), np.int32)
            sizes = [len(r) // 4 for r in keys]
            runs = pa.table({"run": np.repeat(np.arange(len(keys)), sizes), "pos": np.arange(len(ids)), "id": ids})  # noqa: F841  read by name
            rows = self.db.execute(DECODE).fetchall()
            self.runs.put_all([keys[i] for i, _ in rows], [raw for _, raw in rows])
        raw, ends = joined([*map(self.runs.new.__getitem__, names)], which, at)
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), raw])


def _chunks(items: np.ndarray, size: np.ndarray):
    """Lists of items of about BYTES_PER_QUERY together."""
    whose = np.cumsum(size) // BYTES_PER_QUERY
    for own in np.split(items, np.flatnonzero(whose[1:] > whose[:-1]) + 1):
        if len(own):
            yield own.tolist()


def _by_ids(batch: pa.RecordBatch, ids: str):
    """Slices of a batch of about IDS ids."""
    whose = np.cumsum(column(batch, ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) // IDS
    ends = [0, *(np.flatnonzero(whose[1:] > whose[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(ends, ends[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _schema(df: DataFrame, keep: list[str], name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name in keep and f.name != name]
                        + [T.StructField(name, kind)])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids",
           keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (array of int): the text encoded by the rank file, without
    special tokens.  ``keep``: the columns to pass on (all).  The rank file is read
    on the driver and goes to the tasks (a vocabulary is of bounded size)."""
    vocabulary = Vocabulary(ranks_path, pattern)
    schema = _schema(df, keep if keep is not None else df.columns, ids, T.ArrayType(T.IntegerType(), False))
    passed = schema.names[:-1]

    def run(batches):
        with paused_gc(), _Coder(vocabulary) as coder:
            for batch in small_batches(batches, text, BATCH):
                yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in passed), coder.encode(column(batch, text))], schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """Adds ``out`` (binary): the bytes that the ids stand for.  Null ids give none."""
    vocabulary = Vocabulary(ranks_path, pattern)
    schema = _schema(df, keep if keep is not None else df.columns, out, T.BinaryType())
    passed = schema.names[:-1]

    def run(batches):
        with paused_gc(), _Coder(vocabulary) as coder:
            for batch in batches:
                for part in _by_ids(batch, ids):
                    yield pa.RecordBatch.from_arrays([*(column(part, c) for c in passed), coder.decode(column(part, ids))], schema.names)

    return df.mapInArrow(run, schema)
