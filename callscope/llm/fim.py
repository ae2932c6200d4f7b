"""Fill-in-middle by rotating blocks in place.

A text's UTF-8 bytes are scanned for unit ends (a unit is a word with the white space
before it, or the white space at the end).  Two drawn cuts make a prefix, a middle and
a suffix.  Sentinels are inserted into a bytearray, as ``<P>prefix<M>middle<S>suffix``,
and one rotation by three reversals exchanges two neighbouring blocks: the middle's and
the suffix's (psm), or all that comes before the suffix and the suffix (spm).  The
inverse rotation and the removal of the sentinels restore the text byte by byte.

Draws are the first four 8-digit groups of sha256 of ``seed:key``, so they do not depend
on partitions, order or retries.

Defined results: a null text counts as empty; an empty text, or one that holds a
sentinel, stays plain; a null key is drawn as the empty string; repeated rows give
repeated results; an empty table gives an empty table; an input column that has the name
of an output column is replaced.  Scans go window by window and reversals swap pieces
of bounded size, so that a very long text costs little more than its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from callscope.llm.common import SPACE, column, small_batches

#: Prefix, suffix and middle sentinels.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of a scan's window, and of what a reversal swaps at once.
WINDOW, SWAP = 1 << 20, 1 << 16


def unit_ends(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Where units end that have their last byte in [start, stop), the text's end left out."""
    space = SPACE[data[start:stop + 1]]
    return np.flatnonzero(~space[:-1] & space[1:]) + (start + 1)


class Cuts:
    """The number of units of a text, and where the k-th ends."""

    def __init__(self, raw: bytes):
        self.data = np.frombuffer(raw, np.uint8)
        self.starts = range(0, max(len(raw) - 1, 0), WINDOW)
        inner = [len(self._window(a)) for a in self.starts]
        self.before = np.cumsum([0, *inner])
        self.n = int(self.before[-1]) + (len(raw) > 0)

    def _window(self, a: int) -> np.ndarray:
        return unit_ends(self.data, a, min(a + WINDOW, len(self.data) - 1))

    def end(self, k: int) -> int:
        if k == 0:
            return 0
        if k == self.n:
            return len(self.data)
        w = int(np.searchsorted(self.before, k)) - 1
        return int(self._window(self.starts[w])[k - 1 - self.before[w]])


def reverse(view: np.ndarray, a: int, b: int) -> None:
    """Reverses [a, b) in place."""
    while b - a > 1:
        k = min(SWAP, (b - a) // 2)
        left = view[a:a + k].copy()
        view[a:a + k] = view[b - k:b][::-1]
        view[b - k:b] = left[::-1]
        a, b = a + k, b - k


def rotate(view: np.ndarray, a: int, middle: int, b: int) -> None:
    """Exchanges [a, middle) and [middle, b) in place, by three reversals."""
    reverse(view, a, middle)
    reverse(view, middle, b)
    reverse(view, a, b)


def arrange(raw: bytes, low: int, high: int, form: str, sentinels: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text with its sentinels, in the order of the form."""
    prefix, suffix, middle = sentinels
    out = bytearray(raw)
    out[high:high] = suffix
    out[low:low] = middle
    out[0:0] = prefix
    at_middle = len(prefix) + low
    at_suffix = at_middle + len(middle) + high - low
    rotate(np.frombuffer(out, np.uint8), at_middle if form == "psm" else 0, at_suffix, len(out))
    return out


def rearrange(raw: bytes, form: str, sentinels: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text that :func:`arrange` was given."""
    prefix, suffix, middle = sentinels
    out, size = bytearray(raw), len(raw)
    if form == "psm":
        at_middle, end = raw.index(suffix), raw.index(middle)
        rotate(np.frombuffer(out, np.uint8), at_middle, end, size)
        at_suffix = at_middle + size - end
    else:
        end = raw.index(prefix)
        at_middle, at_suffix = raw.index(middle) - end, size - end
        rotate(np.frombuffer(out, np.uint8), 0, end, size)
    del out[at_suffix:at_suffix + len(suffix)]
    del out[at_middle:at_middle + len(middle)]
    del out[:len(prefix)]
    return out


def characters(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return sum(int(np.count_nonzero((data[a:a + WINDOW] & 0xC0) != 0x80)) for a in range(0, len(data), WINDOW))


def _sentinels(sentinels: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """As bytes.  They have to be found again wherever texts meet them, so each begins
    with a byte that no other place of a sentinel has."""
    raw = tuple(s.encode() for s in sentinels)
    if len(set(raw)) < 3 or not all(raw) or any(s[0] in other[1:] for s in raw for other in raw):
        raise ValueError("sentinels must differ, and none may hold another's first byte inside")
    return raw


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80,
              sentinels: tuple[str, str, str] = SENTINELS, keep: list[str] | None = None) -> DataFrame:
    """Adds n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if
    plain) and output.  ``percent`` of the texts are rearranged, ``spm_percent`` of these
    as spm.  ``keep``: the columns to pass on (all)."""
    marks = _sentinels(sentinels)
    own = T.StructType().add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    passed = [f for f in df.schema.fields if f.name in (df.columns if keep is None else keep) and f.name not in own.names]
    schema = T.StructType([*passed, *own.fields])

    def one(k, raw: bytes):
        digest = hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
        cuts = Cuts(raw)
        if not raw or h3 % 100 >= percent or any(m in raw for m in marks):
            return cuts.n, "plain", None, None, raw
        low, high = sorted((h1 % (cuts.n + 1), h2 % (cuts.n + 1)))
        low, high = cuts.end(low), cuts.end(high)
        form = "spm" if h4 % 100 < spm_percent else "psm"
        return (cuts.n, form, characters(cuts.data[:low]), characters(cuts.data[low:high]),
                bytes(arrange(raw, low, high, form, marks)))

    def run(batches):
        for batch in small_batches(batches, text):
            texts = column(batch, text).cast(pa.binary()).to_pylist()
            n, form, prefix, middle, output = zip(*(one(k, t or b"") for k, t in zip(column(batch, key).to_pylist(), texts, strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in passed), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                                              pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def restore(df: DataFrame, output: str = "output", form: str = "form", out: str = "restored",
            sentinels: tuple[str, str, str] = SENTINELS, keep: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the exact text that ``output`` was made from (null: empty)."""
    marks = _sentinels(sentinels)
    passed = [f for f in df.schema.fields if f.name in (df.columns if keep is None else keep) and f.name != out]
    schema = T.StructType([*passed, T.StructField(out, T.StringType())])

    def run(batches):
        for batch in small_batches(batches, output):
            texts = column(batch, output).cast(pa.binary()).to_pylist()
            forms = column(batch, form).to_pylist()
            back = [bytes(rearrange(t, f, marks)) if f in ("psm", "spm") else t or b"" for t, f in zip(texts, forms, strict=True)]
            yield pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in passed), pa.array(back, pa.binary()).cast(pa.string())], schema.names)

    return df.mapInArrow(run, schema)
