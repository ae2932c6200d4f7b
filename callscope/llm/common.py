"""Helpers shared by the text operators: word hashes, Arrow batches, checkpoints,
and distributed connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import types
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.session import cut_lineage

def worker_cache(name: str, make):
    """An object that lives as long as the Python worker, so that tasks that run
    one after the other in a worker share what they have computed."""
    holder = sys.modules.setdefault("_callscope_worker_cache", types.ModuleType("_callscope_worker_cache"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def _malloc_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def give_back() -> None:
    """Returns to the system what Arrow and the C library hold free: workers live on, and
    an executor would keep it for each of them through all later stages."""
    pa.default_memory_pool().release_unused()
    trim = worker_cache("malloc_trim", _malloc_trim)
    if trim is not None:
        trim(0)


#: White space, by byte.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(raws: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes other than white space) of a batch of
    texts, and where each text's words begin and end among them; ``lower``: A-Z count
    as a-z.  All at once, by prefix sums of powers of an odd number times a random
    value for each byte."""
    buf = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
    space = SPACE[buf]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    powers = worker_cache("powers_word", lambda: _Powers(99)).get(len(buf))
    values = np.random.default_rng(77).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * powers[0], dtype=np.uint64, out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * powers[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at = np.cumsum([1, *(len(r) + 1 for r in raws)])
    return hashes, np.searchsorted(start, at)


def _multipliers(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a sum depend on all inputs."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` words (none for fewer words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(_multipliers(k, seed)):
        out += words[j:j + n] * c
    return mix(out)


class Spans:
    """Hashes of any spans of a document's words, by prefix sums: their cost does not
    grow with the spans' length."""

    def __init__(self, words: np.ndarray, seed: int = 1):
        powers = worker_cache(f"powers_{seed}", lambda: _Powers(seed))
        up, self.down = powers.get(len(words))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words) * up, dtype=np.uint64, out=self.sums[1:])

    def hash(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, k: int) -> np.ndarray:
        """The hash of every run of ``k`` words (none for fewer words)."""
        n = max(len(self.sums) - k, 0)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n else np.empty(0, np.uint64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64; a worker keeps them up to a
    length, not those of one very long text."""

    KEPT = 1 << 19

    def __init__(self, seed: int):
        base = int(_multipliers(1, seed)[0])
        self.bases = [base, pow(base, -1, 2**64)]
        self.tables = [np.ones(1, np.uint64)] * 2

    def get(self, n: int) -> list[np.ndarray]:
        tables = self.tables
        if len(tables[0]) < n + 1:
            tables = []
            for base in self.bases:
                powers = np.full(min(2 * n, max(n, self.KEPT)) + 1, base, np.uint64)
                powers[0] = 1
                tables.append(np.cumprod(powers, dtype=np.uint64))
            if n <= self.KEPT:
                self.tables = tables
        return [t[:n] if i == 0 else t[:n + 1] for i, t in enumerate(tables)]


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The minimum of every ``k`` neighbours, by doubling."""
    if len(x) < k:
        return x[:0]
    width = 1
    while 2 * width <= k:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:len(x) - (k - width)], x[k - width:]) if k > width else x


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def small_batches(batches, text: str, max_bytes: int = 8 << 20):
    """Cut Arrow batches so that one holds about ``max_bytes`` of a text column
    (one very long text still makes a batch of its own)."""
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pc.binary_length(column(batch, text)).fill_null(0).to_pylist()):
            if size and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
        give_back()


_CUT = re.compile(r" (?=\S)")


def parts(text: str | None) -> list:
    """Cut before every space that a character other than white space follows.  Such a
    part is given without its space; what comes before the first is a 1-tuple."""
    if not text:
        return []
    out = _CUT.split(text)
    if out[0]:
        out[0] = (out[0],)
        return out
    return out[1:]


def part_text(part) -> str:
    return part[0] if isinstance(part, tuple) else " " + part


#: Bytes that begin a character other than white space, whatever follows them, and those that white space begins with too.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x80] = _SOLID[0xC3:] = True
_MIXED = np.zeros(256, bool)
_MIXED[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SOLID &= ~_MIXED


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts (or of binary values), without copies where they lie
    together, and where each value begins, with the end; a null has none."""
    if col.type not in (pa.string(), pa.binary()):
        col = col.cast(pa.binary() if pa.types.is_large_binary(col.type) else pa.string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8), at - at[0]


def space_cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which bytes the parts of texts begin at: a text's first, and every space that a
    character of the same text, other than white space or a control character, follows."""
    cut = np.zeros(len(data) + 1, bool)
    here = np.flatnonzero(data[:-1] == 0x20)
    first = data[here + 1]
    ok = _SOLID[first]
    unsure = np.flatnonzero(_MIXED[first])
    if len(unsure):
        near = np.append(data, np.zeros(3, np.uint8))
        a, b, c = (near[here[unsure] + i] for i in (1, 2, 3))
        white = (((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
                 | ((a == 0xE2) & ((b == 0x81) | ((b == 0x80) & ((c <= 0x8A) | (c >= 0xA8))))))
        ok[unsure] = ~white
    cut[here[ok]] = True
    cut[at[1:][at[1:] > 0] - 1] = False  # what follows is another text's
    cut[at] = True
    return cut[:-1]


def distinct_slices(data: np.ndarray, cut: np.ndarray, at: np.ndarray, kind: pa.DataType, width: int = 1) -> tuple[list, np.ndarray, np.ndarray]:
    """The distinct slices of a buffer that is cut before the items of ``width`` bytes
    where ``cut`` is true, which of them each slice is, and where the slices of each value
    (whose items ``at`` bounds) begin, with the end."""
    starts = np.flatnonzero(cut)
    ends = np.append(starts, len(cut)).astype(np.int32) * width
    found = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), np.searchsorted(starts, at)


def joined(values: list[bytes], which: np.ndarray, at: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of ``values[which]`` one after the other, and where those from
    ``which[at[i]]`` on begin."""
    if not len(which):
        return pa.py_buffer(b""), np.zeros(len(at), np.int32)
    _, offsets, data = pa.array(values, pa.binary()).take(pa.array(which)).buffers()
    return data if data is not None else pa.py_buffer(b""), np.frombuffer(offsets, np.int32)[at]


class ByteGenerations:
    """A cache of two generations, each bounded by an estimate of its bytes: what was not
    asked for while a generation filled up is dropped, so that frequent keys stay.  It
    belongs to a task and goes with it."""

    #: Bytes of a dict entry and of the objects' own headers, about.
    ENTRY = 220

    def __init__(self, max_bytes: int):
        self.max_bytes, self.size, self.new, self.old = max_bytes, 0, {}, {}

    def missing(self, keys) -> set:
        """Moves the known keys into the new generation; returns the others, which the
        caller is to ``put``."""
        if self.size > self.max_bytes:
            self.old, self.new, self.size = self.new, {}, 0
        todo = set(keys).difference(self.new)
        found = todo.intersection(self.old)
        self.put_all(found, [self.old[k] for k in found])
        return todo.difference(found)

    def put(self, key, value: bytes) -> None:
        self.new[key] = value
        self.size += self.ENTRY + len(key) + len(value)

    def put_all(self, keys, values: list[bytes]) -> None:
        self.new.update(zip(keys, values, strict=True))
        self.size += self.ENTRY * len(values) + sum(map(len, keys)) + sum(map(len, values))


@contextmanager
def paused_gc():
    """Work that makes many small objects and no cycles, without collector runs."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bits of a filter of ids.
FILTER_BITS = 1 << 22


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size, by the ids' remainder: whoever is not in it is not among
    the ids (longs); others may be in it too."""
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in _filter_words(ids).collect():  # of a fixed number
        out[r.w] = r.m
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _word(i: str) -> Column:
    return F.expr(f"cast(pmod({i}, {FILTER_BITS}) div 64 as int)")


def _bit(i: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod({i}, {FILTER_BITS}) % 64 as int))")


def _filter_words(ids: DataFrame) -> DataFrame:
    """(w, m): the words of the bitmap that are not 0."""
    return ids.select(_word("id").alias("w"), _bit("id").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key (not null) is not among the keys of ``gone``.  Only rows that a
    bitmap of fixed size takes for such are shuffled; the others stay where they are read."""
    gone = cut_lineage(gone.select(key).distinct())
    words = cut_lineage(_filter_words(gone.select(F.xxhash64(key).alias("id"))))
    marked = (rows.withColumn("__id", F.xxhash64(key)).withColumn("__w", _word("__id"))
              .join(F.broadcast(words), F.col("__w") == F.col("w"), "left"))  # of a fixed number
    hit = F.coalesce(F.col("m").bitwiseAND(_bit("__id")) != 0, F.lit(False))
    clear, maybe = marked.where(~hit).select(*rows.columns), marked.where(hit).select(*rows.columns)
    return clear.unionByName(maybe.join(gone, key, "left_anti").select(*rows.columns))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list of longs: (id, component), component
    being the smallest id that can be reached; ids without an edge do not appear.

    Alternates two star contractions: every vertex hands its larger neighbours to
    its smallest neighbour, then its smaller ones.  Minima are aggregated before
    the shuffle and then joined, so no neighbour list is ever gathered; rounds are
    cut by reliable checkpoints.  Null ends are dropped.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    while True:
        signature = _signature(e)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = cut_lineage(small)
        if _signature(e) == signature:
            break
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = stars.select(F.col("component").alias("id"), "component").distinct()
    return stars.unionByName(roots)


def _signature(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
