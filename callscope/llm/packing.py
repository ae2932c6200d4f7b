"""Packing of tokenised documents into sequences: concatenate and cut.

The documents are tokenised once into a checkpoint that notes, for every document,
its partition and the tokens before it there.  A prefix sum over the token totals of
the partitions (one row each) turns those into offsets in the whole; then every
document is cut where a window of the sequence length ends, so that a document that
lies across a boundary gives one record on each side of it.

Defined results: a null or empty text is the end id alone; repeated rows are packed
each for itself; an empty table gives an empty table.  All sequences but the last are
full; ``sequence_tokens`` is what a sequence is padded to: the size, or the number of
its tokens where that is a power of two.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import ByteGenerations, column, distinct_slices, give_back, joined, paused_gc, small_batches, space_cuts, text_bytes
from callscope.session import cut_lineage

#: Bytes of a generation of a task's cache of encoded pieces.
PIECE_CACHE = 32 << 20


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


#: Byte-level tokenizers always cut between a letter and a mark, and after a lone line end
#: before a letter: by bytes of ASCII, and of letters of two bytes (Latin, Cyrillic; C3 97
#: and C3 B7 are none, so what ends like them does not count).
_LETTER, _SOLID, _MARK = _bytes((65, 90), (97, 122)), _bytes((0x21, 0x7E)), _bytes((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x5E), (0x60, 0x60), (0x7B, 0x7E))
_LEAD, _FOLLOWS = _bytes((0xC3, 0xC9), (0xD0, 0xD1)), _bytes((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))


class _Tokenizer:
    def __init__(self, definition: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition)
        self.kind = np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32
        self.known = ByteGenerations(PIECE_CACHE)
        added = json.loads(definition).get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens that take their neighbourhood into account are not supported")
        # added tokens are cut out before anything else, the longest where several begin
        self.added = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.find_added = re.compile(b"|".join(map(re.escape, self.added))).finditer if added else None

    def _cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which bytes the pieces of texts begin at."""
        cut = space_cuts(data, at)
        if len(data) > 2:
            one, two, three = data[:-2], data[1:-1], data[2:]
            letter = _LETTER[one]
            letter[1:] |= _LEAD[data[:-3]] & _FOLLOWS[one[1:]]
            cut[1:-1] |= letter & _MARK[two]
            cut[2:] |= (letter | _SOLID[one]) & (two == 0x0A) & (_LETTER[three] | _LEAD[three])
        if self.find_added:
            raw = data.tobytes()
            if any(name in raw for name in self.added):
                self._cut_added(raw, at, cut)
        return cut

    def _cut_added(self, raw: bytes, at: np.ndarray, cut: np.ndarray) -> None:
        """Names of added tokens are pieces of their own, and what is before one ends there."""
        for a, b in zip(at.tolist(), at[1:].tolist()):
            last = a
            for m in self.find_added(raw[a:b]):
                x, y = a + m.start(), a + m.end()
                if x - 1 > last and raw[x - 1] == 0x20:
                    cut[x - 1] = False
                cut[x + 1:y] = False
                cut[x] = True
                cut[y:y + 1] = True  # a text's end is cut in any case
                last = y

    def encode(self, texts: pa.Array, end: int) -> pa.BinaryArray:
        """The packed ids of each text, with the id ``end``."""
        data, at = text_bytes(texts)
        names, which, at = distinct_slices(data, self._cuts(data, at), at, pa.string())
        new = list(self.known.missing(names))
        code = np.dtype(self.kind).char
        for i in range(0, len(new), 20_000):
            some = new[i:i + 20_000]
            self.known.put_all(some, [array(code, got.ids).tobytes() for got in self.model.encode_batch_fast(some, add_special_tokens=False)])
        values = [*map(self.known.new.__getitem__, names), self.kind(end).tobytes()]
        ids, ends = joined(values, np.insert(which, at[1:], len(names)), at + np.arange(len(at)))
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), ids])


def tokenise(df: DataFrame, definition: str, key: str, text: str, end: int) -> DataFrame:
    """(key, part, before, n, ids): ids as packed unsigned integers (16 bits for a
    vocabulary that fits them, else 32), with the end id; ``before``: the tokens of the
    same partition that come before the document."""
    schema = T.StructType([df.schema[key], T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        with paused_gc():
            model = _Tokenizer(definition)
            width, before, part = np.dtype(model.kind).itemsize, 0, TaskContext.get().partitionId()
            for batch in small_batches(batches, text, 4 << 20):
                ids = model.encode(column(batch, text), end)
                n = pc.binary_length(ids).to_numpy().astype(np.int64) // width
                yield pa.RecordBatch.from_arrays([column(batch, key), pa.array(np.full(len(n), part, np.int32)),
                                                  pa.array(before + np.cumsum(n) - n), pa.array(n), ids], schema.names)
                before += int(n.sum())
        del model
        give_back()

    return df.select(key, text).mapInArrow(run, schema)


def pack(df: DataFrame, definition: str, key: str = "doc_id", text: str = "text", size: int = 1024,
         end: int = 0) -> DataFrame:
    """One row per piece: key, start (the document's tokens before it), length,
    ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset,
    sequence_tokens, ids.

    ``definition``: the JSON text of a byte-level tokenizer of the tokenizers library.
    No special tokens are added; the name of one in a text has its id, as the library
    encodes it by default.  Each document is followed by the id ``end``.
    """
    tokens = cut_lineage(tokenise(df, definition, key, text, end))
    totals = tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    every = Window.orderBy("part")
    offsets = totals.select("part", (F.sum("total").over(every.rowsBetween(Window.unboundedPreceding, 0))
                                     - F.col("total")).alias("base"),
                            F.sum("total").over(Window.partitionBy()).alias("all_tokens"))
    placed = tokens.join(F.broadcast(offsets), "part")  # a row for each partition
    schema = T.StructType([df.schema[key], *(T.StructField(c, T.LongType()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")),
        T.StructField("ids", T.BinaryType())])

    def cut(batches):
        for batch in small_batches(batches, "ids"):
            at = pc.add(column(batch, "base"), column(batch, "before")).to_pylist()
            rows = []
            for i, (g, n, raw, whole) in enumerate(zip(at, column(batch, "n").to_pylist(), column(batch, "ids").to_pylist(),
                                                       column(batch, "all_tokens").to_pylist(), strict=True)):
                ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(g + start, size)
                    length = min(n - start, size - offset)
                    piece = ids[4 * start:4 * (start + length)]
                    filled = min(size, whole - sequence * size)
                    rows.append((i, start, length, zlib.crc32(piece), n, sequence, offset,
                                 filled if filled & (filled - 1) == 0 else size, piece))
                    start += length
            which, *cols, ids = zip(*rows)
            yield pa.RecordBatch.from_arrays([column(batch, key).take(pa.array(which)), *(pa.array(c, pa.int64()) for c in cols),
                                              pa.array(ids, pa.binary())], schema.names)

    return placed.select(key, "base", "before", "n", "all_tokens", "ids").mapInArrow(cut, schema)
