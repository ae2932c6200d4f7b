"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text (no negatives) train a classifier of the
form of a text.  A first classifier tells positives from unlabelled texts; the
smallest ratio of their shares above a threshold estimates the class prior.  The
final one minimises the non-negative unbiased risk at that prior.

Defined results: a null text counts as empty; an empty text is scored by its features
like any other; repeated rows have equal scores; without any trusted positive or
unlabelled text every score is 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import column, small_batches

#: Bound of each of the two training samples (positives, unlabelled): the fit's size.
SAMPLE = 20_000
FEATURES = ("upper", "digit", "exclamation", "bar", "symbol", "stop", "line", "repeat", "echo", "distinct", "long_word",
            "words", "word_bytes", "wide", "entropy")

_CLASS = np.zeros(256, np.int64)
for _at, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"#$%&*@^~<>{}[]\\=+_/`", b".,;:?", b"\n"), 1):
    _CLASS[list(_chars)] = _at
_CLASS[128:] = 8


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of characters and words; of a fixed number, whatever the text."""
    raw = (text or "").encode()
    words = raw.split()
    n = max(len(words), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digit, shout, bar, symbol, stop, line, wide = np.bincount(_CLASS, counts, 9)[1:]
    size = max(len(raw), 1)
    share = counts[counts > 0] / size
    again = sum(map(bytes.__eq__, words, words[1:]))
    echo = sum(map(bytes.__eq__, words, words[2:]))
    return np.array([upper / size, digit / size, shout / n, bar / n, symbol / n, stop / n, line / n, again / n, echo / n,
                     len(set(words)) / n ** 0.9 if words else 1.0, max(map(len, words), default=0) > 40,
                     np.log1p(len(words)), len(raw) / n, wide / size, -(share * np.log(share)).sum()], np.float64)


class Model:
    """A classifier with one hidden layer over the standardised features."""

    def __init__(self, mean, scale, weights, prior):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return _sigmoid(_forward(self.weights, (x - self.mean) / self.scale)[1])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(w, x):
    hidden = np.tanh(x @ w[0] + w[1])
    return hidden, hidden @ w[2] + w[3]


def _train(gradient, width: int, size: int, steps: int, seed: int, hidden: int = 12, rate: float = 0.02, decay: float = 1e-4):
    """Adam over ``gradient(scores, part)``, the risk's derivative by each score."""
    random = np.random.default_rng(seed)
    w = [random.normal(0, width ** -0.5, (width, hidden)), np.zeros(hidden), random.normal(0, 0.1, hidden), np.zeros(())]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, steps + 1):
        x, by_score = gradient(random, lambda x: _forward(w, x))
        h = np.tanh(x @ w[0] + w[1])
        back = by_score[:, None] * w[2] * (1 - h * h)
        grads = [x.T @ back + decay * w[0], back.sum(0), h.T @ by_score + decay * w[2], by_score.sum()]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    return w


def _batches(p, u, random, size=2048):
    return p[random.integers(0, len(p), size)], u[random.integers(0, len(u), size)]


def _positive_or_unlabelled(p, u, seed):
    def gradient(random, _):
        a, b = _batches(p, u, random)
        x = np.concatenate([a, b])
        y = np.r_[np.ones(len(a)), np.zeros(len(b))]
        return x, (_sigmoid(_(x)[1]) - y) / len(x)

    return _train(gradient, p.shape[1], len(p) + len(u), 400, seed)


def estimate_prior(p: np.ndarray, u: np.ndarray, seed: int = 0) -> float:
    """The share of positives among the unlabelled rows: over thresholds, the smallest
    ratio of the unlabelled to the positive share above it (with a margin for the
    sample's size).  Each half is scored by the classifier of the other half."""
    ratios = []
    for k in (0, 1):
        w = _positive_or_unlabelled(p[k::2], u[k::2], seed)
        sp, su = (np.sort(_forward(w, x[1 - k::2])[1]) for x in (p, u))
        at = np.quantile(sp, np.linspace(0, 0.9, 91))
        qp, qu = (1 - np.searchsorted(s, at) / len(s) for s in (sp, su))
        margin = 1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su))
        ratios.append((qu[np.argmin((qu + margin) / qp)]) / qp[np.argmin((qu + margin) / qp)])
    return float(np.clip(np.mean(ratios), 0.05, 0.99))


def fit_matrix(p: np.ndarray, u: np.ndarray, seed: int = 0) -> Model:
    if len(p) < 2 or len(u) < 2:
        return Model(None, None, None, None)
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (p - mean) / scale, (u - mean) / scale
    prior = estimate_prior(p, u, seed)

    def gradient(random, forward):
        a, b = _batches(p, u, random)
        x = np.concatenate([a, b])
        s = _sigmoid(forward(x)[1])
        sa, sb = s[:len(a)], s[len(a):]
        loss_negative = lambda s: -np.log(np.maximum(1 - s, 1e-12))
        negative = loss_negative(sb).mean() - prior * loss_negative(sa).mean()
        # derivatives of the logistic losses by the score: s - 1 as a positive, s as a negative
        as_positive = np.r_[prior * (sa - 1) / len(a), np.zeros(len(b))]
        as_negative = np.r_[-prior * sa / len(a), sb / len(b)]
        return x, as_positive + as_negative if negative >= 0 else -as_negative

    return Model(mean, scale, _train(gradient, p.shape[1], len(p) + len(u), 1200, seed, rate=0.01), prior)


def _features_of(df: DataFrame, text: str) -> DataFrame:
    def run(batches):
        for batch in small_batches(batches, text):
            x = [features(t) for t in column(batch, text).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in x], pa.list_(pa.float64()))], ["x"])

    return df.select(text).mapInArrow(run, "x array<double>")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        may_learn=None, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` trusted positives (label 1) and as many rows without a
    label, both taken in the order of a hash of the key, of those keys for which
    ``may_learn`` (a column expression of ``key``) holds.  Labels of 0 are not used."""
    allowed = F.lit(True) if may_learn is None else may_learn
    order = [F.xxhash64(key), F.col(key)]
    known = labels.select(key, F.col(label).alias("__label")).where(F.col(key).isNotNull() & allowed)
    trusted = known.where("__label = 1").select(key).distinct().orderBy(order).limit(sample)
    plain = (docs.select(key).where(F.col(key).isNotNull() & allowed).join(labels.select(key), key, "left_anti")
             .distinct().orderBy(order).limit(sample))
    x = []
    for ids in (trusted, plain):
        chosen = docs.select(key, text).join(F.broadcast(ids), key)  # at most ``sample`` keys
        rows = _features_of(chosen, text).limit(sample).collect()
        x.append(np.array([r.x for r in rows], np.float64).reshape(-1, len(FEATURES)))
        x[-1] = x[-1][np.lexsort(x[-1].T)]  # the same order in every run
    return fit_matrix(*x)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds ``out`` (double, 0 to 1): how likely a text is a positive."""
    keep = docs.columns if keep is None else keep
    schema = T.StructType([f for f in docs.schema.fields if f.name in keep and f.name != out] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        for batch in small_batches(batches, text):
            x = np.array([features(t) for t in column(batch, text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in schema.names[:-1]), pa.array(model.score(x), pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)
