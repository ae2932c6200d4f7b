"""Removal of long repeated word spans by compacted paths of k-mer representatives.

They stand for the De Bruijn graph of all k-mers, which would shuffle an edge for every
word: k-mers are not edges, and no in- or out-degrees are computed.

Each window of words has one representative, the least hash among its shorter k-mers,
so that equal windows in any document have the same one.  Windows that follow one
another with the same representative are a path: an edge of the graph, known by its
representative and the hash of all its words.

* A representative that lies in one document only cannot hold a repeat.
* Paths that are equal throughout compact into one, with the smallest document as the
  source.  Where a representative has a single path, or where the path has an earlier
  source, all windows of the path are decided at once.
* Where paths branch, the windows of the first copy of each path are compared by
  their own hashes, again against the smallest document that has them.

Documents are split into words in three passes of tasks; only hashes and document ids
are shuffled, aggregated before each shuffle, and the texts once by their id.  A window
is known by 128 bits: its representative and its own hash.

Defined results: a null text has no words; documents with a null id are neither
changed nor a source; rows that repeat an id are judged alike, against smaller ids; an
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import Spans, as_long, column, id_filter, mix, sliding_min, small_batches, word_hashes
from callscope.session import cut_lineage

#: Bytes of text that are worked on together.
BATCH = 1 << 18


class _Document:
    """The paths of a document's words: representative, hash, first window, end."""

    def __init__(self, words: np.ndarray, window: int, k: int):
        self.path = self.whole = np.empty(0, np.int64)
        self.start = self.end = np.empty(0, np.int64)
        if len(words) < window:
            return
        self.spans = Spans(words)
        least = sliding_min(self.spans.every(k), window - k + 1)
        self.start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        self.end = np.r_[self.start[1:], len(least)]
        self.path = as_long(least[self.start])
        length = (self.end - self.start).astype(np.uint64)
        self.whole = as_long(mix(self.spans.hash(self.start, self.end + window - 1) + length))
        self.window = window

    def windows(self, i: int) -> np.ndarray:
        """The hashes of the windows of the i-th path."""
        at = np.arange(self.start[i], self.end[i])
        return as_long(self.spans.hash(at, at + self.window))


def _documents(texts: list[str | None], window: int, k: int) -> list[_Document]:
    hashes, at = word_hashes([(t or "").encode() for t in texts])
    return [_Document(hashes[a:b], window, k) for a, b in zip(at, at[1:])]


def _longs(*names):
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def _paths(docs: DataFrame, key: str, text: str, window: int, k: int) -> DataFrame:
    """(path, whole, doc): the paths of every document, each once."""
    schema = _longs("path", "whole", "doc")

    def run(batches):
        for batch in small_batches(batches, text, BATCH):
            rows = []
            for doc, d in zip(column(batch, key).to_pylist(), _documents(column(batch, text).to_pylist(), window, k), strict=True):
                if doc is not None and len(d.path):
                    own = np.unique(np.column_stack([d.path, d.whole]), axis=0)
                    rows.append(np.column_stack([own, np.full(len(own), doc)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in np.concatenate(rows).T], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def _structs(col: pa.Array, names: tuple[str, ...]) -> list[dict[str, np.ndarray]]:
    """The fields of each list of structs as arrays; a null list is empty."""
    sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = col.flatten()
    cut = np.cumsum(sizes)[:-1]
    fields = [np.split(flat.field(n).to_numpy(zero_copy_only=False), cut) for n in names]
    return [dict(zip(names, own, strict=True)) for own in zip(*fields, strict=True)]


def _branching_windows(docs: DataFrame, key: str, text: str, window: int, k: int) -> DataFrame:
    """(path, own, doc): the windows of the branching paths whose first copy a document has."""
    schema = _longs("path", "own", "doc")

    def run(batches):
        for batch in small_batches(batches, text, BATCH):
            rows = []
            flags = _structs(column(batch, "flags"), ("path", "whole", "source"))
            for doc, d, f in zip(column(batch, key).to_pylist(), _documents(column(batch, text).to_pylist(), window, k), flags, strict=True):
                mine = f["source"] == doc
                first = set(zip(f["path"][mine].tolist(), f["whole"][mine].tolist(), strict=True))
                if first:
                    for i, own in enumerate(zip(d.path.tolist(), d.whole.tolist(), strict=True)):
                        if own in first:
                            first.discard(own)
                            hashes = np.unique(d.windows(i))
                            rows.append(np.column_stack([np.full(len(hashes), own[0]), hashes, np.full(len(hashes), doc)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in np.concatenate(rows).T], schema.names)

    return docs.mapInArrow(run, schema)


def _kept(t: str | None, d: _Document, doc, flags: dict, later: dict, window: int) -> tuple[str, int, int]:
    words = (t or "").encode().split()
    if not len(flags["path"]):
        return b" ".join(words).decode(), len(words), 0
    old = flags["source"] < doc
    decided = set(zip(flags["path"][old].tolist(), flags["whole"][old].tolist(), strict=True))
    some = {}
    order = np.argsort(later["path"], kind="stable")
    paths, at = np.unique(later["path"][order], return_index=True)
    for p, own in zip(paths.tolist(), np.split(later["own"][order], at[1:])):  # of no path, one empty part
        some[p] = own
    change = np.zeros(len(words) + 1, np.int64)
    for i, (path, whole) in enumerate(zip(d.path.tolist(), d.whole.tolist(), strict=True)):
        if (path, whole) in decided:
            change[d.start[i]] += 1
            change[d.end[i] + window - 1] -= 1
        elif path in some:
            hit = d.start[i] + np.flatnonzero(np.isin(d.windows(i), some[path]))
            np.add.at(change, hit, 1)
            np.add.at(change, hit + window, -1)
    stay = np.cumsum(change[:-1]) == 0
    kept = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
    return b" ".join(kept).decode(), len(words), len(words) - len(kept)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, k: int = 20,
                   out: str = "kept", keep: list[str] | None = None) -> DataFrame:
    """Adds ``out`` (the words that stay, joined by one space), ``n_words`` and
    ``n_removed``: every word goes that is covered by a window of ``window`` words whose
    words also start somewhere in a document with a smaller id (a long or int).

    ``k``: words of the k-mers that represent windows, at most ``window``.
    """
    keep = docs.columns if keep is None else keep
    texts = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    paths = _paths(texts, "__key", "__text", window, k)
    whole = paths.groupBy("path", "whole").agg(F.min("doc").alias("source"), F.max("doc").alias("last"))
    repeated = (whole.groupBy("path").agg(F.min("source").alias("a"), F.max("last").alias("b"), (F.count("*") > 1).alias("branching"))
                .where("a <> b").select("path", "branching"))
    # (a repeated path that does not branch has a later copy; both sides read one exchange)
    known = whole.join(repeated, "path").where("branching or last > source").select("path", "whole", "source", "branching")
    flags = cut_lineage(paths.join(known, ["path", "whole"]).where("source < doc or branching").groupBy("doc")
                        .agg(F.collect_list(F.struct("path", "whole", "source")).alias("flags")))  # at most a document's paths

    # only documents with the first copy of a path are asked for its windows
    firsts = flags.where(F.exists("flags", lambda f: f["source"] == F.col("doc")))
    wanted = id_filter(firsts.select(F.col("doc").alias("id")))

    def asked(batches):
        for batch in batches:
            keys = column(batch, "__key").to_pylist()
            yield batch.filter(pa.array([x is not None and bool(wanted[x % len(wanted)]) for x in keys], pa.bool_()))

    some = texts.mapInArrow(asked, texts.schema)
    first = some.join(firsts, F.col("__key") == F.col("doc")).select("__key", "__text", "flags")
    windows = _branching_windows(first, "__key", "__text", window, k)
    twice = (windows.groupBy("path", "own").agg(F.min("doc").alias("source"), F.max("doc").alias("last"))
             .where("source <> last").select("path", "own", "source"))
    later = (windows.join(twice, ["path", "own"]).where("doc > source").groupBy(F.col("doc").alias("doc2"))
             .agg(F.collect_list(F.struct("path", "own")).alias("later")))  # at most a document's windows
    marks = flags.join(later, F.col("doc") == F.col("doc2"), "left").select("doc", "flags", "later")

    others = [c for c in keep if c not in (out, "n_words", "n_removed")]
    rows = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"),
                       *[F.col(c).alias(f"__{i}") for i, c in enumerate(others) if c not in (key, text)])
    marked = rows.join(marks, F.col("__key") == F.col("doc"), "left").drop("doc")
    source = ["__key" if c == key else "__text" if c == text else f"__{i}" for i, c in enumerate(others)]
    schema = T.StructType([*(T.StructField(c, T.LongType() if c == key else docs.schema[c].dataType) for c in others),
                           T.StructField(out, T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches):
        for batch in small_batches(batches, "__text", BATCH):
            flags, later = (_structs(column(batch, c), n) for c, n in (("flags", ("path", "whole", "source")), ("later", ("path", "own"))))
            texts = column(batch, "__text").to_pylist()
            got = [_kept(t, d, doc, f, x, window) for t, d, doc, f, x in zip(
                texts, _documents(texts, window, k), column(batch, "__key").to_pylist(), flags, later, strict=True)]
            texts, n, gone = zip(*got)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in source), pa.array(texts, pa.string()),
                                              pa.array(n, pa.int64()), pa.array(gone, pa.int64())], schema.names)

    return marked.mapInArrow(run, schema)
