"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The characters of a normalised text are symbols; an agenda holds the pairs of adjacent
symbols that form a piece, best score first, of equal scores the leftmost.  The pair on
top is merged, unless one of its symbols has changed since, and the pairs that the merged
symbol forms with its neighbours join the agenda.  Long parts have a heap; the many short
ones have their agendas in common arrays and take one entry each at a time.  What is no piece in the end becomes
byte pieces or the unknown id.

No merge can cross two characters that stand side by side in no piece.  So texts are cut
before the mark of a space and around a line's end, where the vocabulary allows it, and
every distinct part of a task is encoded once.  With ``check``, every such part is also encoded by the sentencepiece library, a
batch at a time, and a difference ends the job: a check, not another way to the ids.

Defined results: a null or empty text has the end id alone (no ids without one); null ids
decode to an empty text; repeated rows have equal ids; an empty table gives an empty
table; an input column that has the name of the output column is replaced.
"""

from __future__ import annotations

import re
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from callscope.llm.common import ByteGenerations, column, paused_gc, small_batches

#: What a space becomes, and a character that no piece holds with others.
SPACE_MARK, SEPARATOR = "▁", "\n"
#: Bits of a symbol in a pair's key, and of one place and two in an agenda's entry.
PAIR, PLACE, TWO_PLACES = 24, 31, 62
AT = (1 << PLACE) - 1
#: Symbols of characters that merge with none, and of those merged into their left neighbour.
ALONE, GONE = -1, -2
#: The priority of a pair that forms no piece.
NONE = (1 << 31) - 1
#: Characters of a part beyond which it has an agenda of its own.
LONG = 64
#: Bytes of text that are worked on together, and of each generation of a task's cache.
BATCH, CACHE_BYTES = 2 << 20, 80 << 20


class Vocabulary:
    """Pieces, scores and settings of a merge-type model, read through the library."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.model, self.unknown, self.end = model, library.unk_id(), library.eos_id()
        self.texts, self.scores, self.bytes, self.control, self.size = {}, {}, {}, set(), library.get_piece_size()
        for i in range(self.size):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif library.is_control(i):
                self.control.add(i)
            elif not library.is_unknown(i):
                self.texts[piece] = i
                self.scores[piece] = library.get_score(i)
        if any(library.is_unused(i) for i in self.texts.values()):
            raise ValueError("models with unused pieces are not supported")
        if library.encode("a  " + SPACE_MARK) == library.encode("a ") or library.normalize("Ａ ") != SPACE_MARK + "Ａ" + SPACE_MARK:
            raise ValueError("only models that keep characters and white space, with a mark before the text, are supported")

    def merges(self) -> tuple[dict[str, int], dict[int, int], dict[int, int]]:
        """Symbols of characters, and by the PAIR key of two symbols that form a piece its
        priority (best score first, equal scores alike) and its symbol.  Symbols are the
        pieces' ids; a character that occurs only inside of pieces has one beyond them."""
        order = {s: i for i, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        symbols = dict(self.texts)
        for c in sorted({c for p in self.texts for c in p}):
            symbols.setdefault(c, self.size + len(symbols))
        pairs = {symbols[p[:i]] << PAIR | symbols[p[i:]]: (order[self.scores[p]], own)
                 for p, own in self.texts.items() for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols}
        return ({c: i for c, i in symbols.items() if len(c) == 1}, {k: p for k, (p, _) in pairs.items()},
                {k: i for k, (_, i) in pairs.items()})


class Encoder:
    """Encodes distinct parts by agenda."""

    def __init__(self, vocabulary: Vocabulary, check: bool, cache_bytes: int = CACHE_BYTES):
        self.vocabulary = vocabulary
        self.symbols, self.priorities, self.merged = vocabulary.merges()
        inside = {p[i:i + 2] for p in vocabulary.texts for i in range(len(p) - 1)}
        self.agendas = Agendas(self.priorities, self.merged)
        self.symbol_of = np.full(0x110000, vocabulary.size, np.int32)  # what is no piece: the size or more
        for c, i in self.symbols.items():
            self.symbol_of[ord(c)] = i
        line = "" if any("\n" in n for n in inside) else "\n"
        if any(n[1] == SPACE_MARK and n[0] != SPACE_MARK for n in inside):
            self.cut = lambda marked: [marked]
        else:
            self.cut = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}{line}]*|[^{SPACE_MARK}{line}]+" + (line and f"|{line}")).findall
        self.known = ByteGenerations(cache_bytes)
        self.library = None
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)

    def encode(self, texts: list[str | None], tail: bytes) -> list[bytes]:
        """Packed int32 ids of every text, followed by ``tail``."""
        cut = [self._parts(t) for t in texts]
        new = list(self.known.missing(set().union(*cut)))
        for at in range(0, len(new), 20_000):
            some = new[at:at + 20_000]
            ids = self._encode_parts(some)
            if self.library is not None:
                self._compare(some, ids)
            self.known.put_all(some, ids)
        get = self.known.new.__getitem__
        return [b"".join(map(get, its)) + tail for its in cut]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Short parts of known characters have their agendas in common arrays; the others
        have one each."""
        sizes = np.array([len(p) for p in parts])
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        symbols = self.symbol_of[codes]
        ends = np.cumsum(sizes)
        alone = np.flatnonzero((sizes > LONG) | np.logical_or.reduceat(symbols >= self.vocabulary.size, ends - sizes))
        out = [b""] * len(parts)
        for i in alone.tolist():
            out[i] = array("i", self._ids(parts[i])).tobytes()
        many = np.ones(len(parts), bool)
        many[alone] = False
        if many.any():
            merged, counts = self.agendas.merge(symbols[np.repeat(many, sizes)].astype(np.int64), sizes[many])
            raw = merged.astype(np.int32).tobytes()
            ends = np.cumsum(counts) * 4
            for i, a, b in zip(np.flatnonzero(many).tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                out[i] = raw[a:b]
        return out

    def _parts(self, text: str | None) -> list[str]:
        """Parts of a text, in order; the marks that begin a part stay with it."""
        return self.cut(SPACE_MARK + text.replace(" ", SPACE_MARK)) if text else []

    def _ids(self, part: str) -> list[int]:
        symbol, size = self.symbols.get, self.vocabulary.size
        merged = agenda_merge([symbol(c, ALONE) for c in part], self.priorities, self.merged)
        out = [s for s in merged if s != GONE]
        if min(out) >= 0 and max(out) < size:
            return out
        out, missing = [], False
        for at, s in enumerate(merged):
            if 0 <= s < size:
                out.append(s)
                missing = False
            elif s != GONE:  # a single character
                if self.vocabulary.bytes:
                    out.extend(self.vocabulary.bytes[b] for b in part[at].encode())
                elif not missing:  # neighbouring unknown symbols are one
                    out.append(self.vocabulary.unknown)
                missing = True
        return out

    def _compare(self, parts: list[str], ids: list[bytes]) -> None:
        """The library puts a mark before a text itself: a part is given to it without its
        first mark, or behind a separator, whose ids are known."""
        head = array("i", self.library.encode(SEPARATOR)).tobytes()
        lone = array("i", [self.vocabulary.texts[SPACE_MARK]]).tobytes()
        own = b"".join(i if p[0] == SPACE_MARK else head + i for p, i in zip(parts, ids, strict=True))
        found = chain.from_iterable(self.library.encode([p[1:] if p[0] == SPACE_MARK else SEPARATOR + p for p in parts], num_threads=1))
        if SPACE_MARK in parts:  # without its mark it is empty
            at = parts.index(SPACE_MARK)
            own = b"".join([lone, *(i if p[0] == SPACE_MARK else head + i for k, (p, i) in enumerate(zip(parts, ids, strict=True)) if k != at)])
            found = chain(array("i", ids[at]), found)
        if array("i", found).tobytes() != own:
            bad = next(p for p, i in zip(parts, ids, strict=True) if i != (lone if p == SPACE_MARK else self._library_ids(p, head)))
            raise ValueError(f"the sentencepiece library encodes {bad[:80]!r} differently")

    def _library_ids(self, part: str, head: bytes) -> bytes:
        if part[0] == SPACE_MARK:
            return array("i", self.library.encode(part[1:])).tobytes()
        return array("i", self.library.encode(SEPARATOR + part)).tobytes()[len(head):]


class Agendas:
    """The agendas of many texts in common arrays: an entry for every pair of adjacent
    symbols, ordered by its priority and place.  In a round every text takes its top
    entry, merges that pair and renews the entries of the merged symbol's two pairs;
    texts with an empty agenda are done."""

    def __init__(self, priorities: dict[int, int], merged: dict[int, int]):
        keys = np.array(sorted(priorities), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.priority = np.array([priorities[k] for k in keys.tolist()] + [NONE], np.int64)
        self.merged = np.array([merged[k] for k in keys.tolist()] + [GONE], np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the tables; the last place stands for no piece."""
        key = left << PAIR | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of every text (of ``sizes`` symbols each), and how many symbols."""
        text = np.repeat(np.arange(len(sizes)), sizes)
        pair = np.full(len(symbols), len(self.keys) - 1)  # with the symbol to the right
        inner = np.flatnonzero(text[1:] == text[:-1])
        pair[inner] = self._find(symbols[inner], symbols[inner + 1])
        done = []
        while len(symbols):
            place = np.arange(len(symbols))
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            top = np.minimum.reduceat(self.priority[pair] << PLACE | place, first)
            busy = top >> PLACE != NONE
            if not busy.all():
                rest = np.repeat(~busy, np.diff(np.r_[first, len(symbols)]))
                done.append((text[rest], symbols[rest]))
                stay = ~rest
                moved = np.cumsum(stay) - 1
                top = moved[top[busy] & AT]
                text, symbols, pair = text[stay], symbols[stay], pair[stay]
            else:
                top = top & AT
            if not len(symbols):
                break
            symbols[top] = self.merged[pair[top]]
            keep = np.ones(len(symbols), bool)
            keep[top + 1] = False
            at = (np.cumsum(keep) - 1)[top]
            text, symbols, pair = text[keep], symbols[keep], pair[keep]
            pair[at] = len(self.keys) - 1
            right = at[np.r_[text, -1][at + 1] == text[at]]
            pair[right] = self._find(symbols[right], symbols[right + 1])
            left = at[at > 0]
            left = left[text[left - 1] == text[left]]
            pair[left - 1] = self._find(symbols[left - 1], symbols[left])
        texts = np.concatenate([t for t, _ in done])
        order = np.argsort(texts, kind="stable")
        return np.concatenate([s for _, s in done])[order], np.bincount(texts, minlength=len(sizes))


def agenda_merge(symbols: list[int], priorities: dict[int, int], merged: dict[int, int]) -> list[int]:
    """The symbols when no two neighbours form a piece; what was merged into its left
    neighbour is GONE.  An entry of the agenda is a number: the priority, the place of the
    left symbol and that of the right one.  An entry is stale unless the symbols there
    still have its priority."""
    n, agenda, get = len(symbols), [], priorities.get
    last = symbols[0]
    for i in range(1, n):
        p = get(last << PAIR | (last := symbols[i]))
        if p is not None:
            agenda.append(p << TWO_PLACES | i - 1 << PLACE | i)
    if not agenda:
        return symbols
    heapify(agenda)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while agenda:
        top = heappop(agenda)
        left, right = top >> PLACE & AT, top & AT
        key = symbols[left] << PAIR | symbols[right]
        if get(key) != top >> TWO_PLACES:
            continue
        new = symbols[left] = merged[key]
        symbols[right] = GONE
        end = after[left] = after[right]
        if end < n:
            before[end] = left
            p = get(new << PAIR | symbols[end])
            if p is not None:
                heappush(agenda, p << TWO_PLACES | left << PLACE | end)
        start = before[left]
        if start >= 0:
            p = get(symbols[start] << PAIR | new)
            if p is not None:
                heappush(agenda, p << TWO_PLACES | start << PLACE | left)
    return symbols


class Decoder:
    """Texts of ids: pieces joined, marks as spaces, without the mark before the text."""

    def __init__(self, vocabulary: Vocabulary):
        self.texts = [b""] * vocabulary.size
        for p, i in vocabulary.texts.items():
            self.texts[i] = p.replace(SPACE_MARK, " ").encode()
        for b, i in vocabulary.bytes.items():
            self.texts[i] = bytes([b])
        self.texts[vocabulary.unknown] = " ⁇ ".encode()
        self.bytes = frozenset(vocabulary.bytes.values())
        self.control = frozenset(vocabulary.control)

    def decode(self, ids: list[int]) -> bytes:
        start, stop = 0, len(ids)
        while start < stop and ids[start] in self.control:
            start += 1
        while stop > start and ids[stop - 1] in self.control:
            stop -= 1
        ids = ids[start:stop]
        if not ids:
            return b""
        joined = b"".join(map(self.texts.__getitem__, ids))
        try:
            joined.decode()
            runs = self.control.isdisjoint(ids)
        except UnicodeDecodeError:
            runs = False
        if not runs:  # each run of byte pieces is made valid for itself
            joined = b"".join(_valid(b"".join(self.texts[i] for i in run)) if of_bytes else b"".join(self.texts[i] for i in run)
                              for of_bytes, run in groupby(ids, self.bytes.__contains__))
        return joined[1:] if ids[0] not in self.bytes and joined[:1] == b" " else joined


def _valid(raw: bytes) -> bytes:
    """Bytes that are no UTF-8 become a replacement character each."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + n].decode())
                    at += len(raw[at:at + n])
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out).encode()


def _schema(df: DataFrame, keep: list[str] | None, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name in (df.columns if keep is None else keep) and f.name != name]
                        + [T.StructField(name, kind)])


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", add_end: bool = True, check: bool = True,
           keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (array of int).  ``model``: the model file's bytes, which go to the
    tasks (a vocabulary is of bounded size).  ``add_end``: the end id follows every text.
    ``keep``: the columns to pass on (all)."""
    schema = _schema(df, keep, ids, T.ArrayType(T.IntegerType(), False))
    passed = schema.names[:-1]

    def run(batches):
        with paused_gc():
            vocabulary = Vocabulary(model)
            encoder = Encoder(vocabulary, check)
            tail = np.array([vocabulary.end], np.int32).tobytes() if add_end else b""
            for batch in small_batches(batches, text, BATCH):
                got = encoder.encode(column(batch, text).to_pylist(), tail)
                ends = np.cumsum([0, *(len(g) // 4 for g in got)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(got), np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in passed), pa.ListArray.from_arrays(pa.array(ends), values)], schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the text that the ids stand for."""
    schema = _schema(df, keep, out, T.StringType())
    passed = schema.names[:-1]

    def run(batches):
        decoder = Decoder(Vocabulary(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [decoder.decode(x) if x else b"" for x in column(part, ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in passed), pa.array(texts, pa.binary()).cast(pa.string())], schema.names)

    return df.mapInArrow(run, schema)
