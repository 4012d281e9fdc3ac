"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

n-gram indicators are scaled by the log-count ratio of the classes, and a linear hinge-loss model over them is fitted by
dual coordinate descent (Hsieh et al., 2008). The n-grams are words, word endings, and up to five word shapes in a row; a
shape says how a word is written and whether it repeats the one before. A logistic fit on held-back margins,
weighted to the true class counts, makes the margin a probability.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .learn import add_scores, labelled_texts, platt, sigmoid
from .words import SLICE_BYTES, cuts, mix, slices, text_bytes, trim, trimmed, window_hashes, words

BITS = 15
PER_CLASS = 2500  # labelled rows of each class learned from
THRESHOLD = 0.3

_UPPER, _DIGIT, _PUNCT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


class Model(NamedTuple):
    weights: np.ndarray  # by n-gram: ratio times linear weight
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float


SHAPES = (1, 2, 3, 5)  # words in an n-gram of shapes


def indicators(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which hashed n-grams each row holds: bool (rows, 1 << BITS). A long row is read range by range."""
    if len(at) != 2 or at[-1] <= 2 * SLICE_BYTES:
        return _indicators(data, at, None)[0]
    out, before = np.zeros((1, 1 << BITS), bool), None
    for a, b in cuts(data, 0, int(at[-1])):
        has, before = _indicators(data[a:b], np.array([0, b - a]), before)
        out |= has
    return out


def _indicators(data: np.ndarray, at: np.ndarray, before: tuple[np.ndarray, np.uint64] | None) -> tuple[np.ndarray, tuple | None]:
    """Also the last shapes and the last word's hash, which the next part of the same row takes as `before`."""
    out = np.zeros((len(at) - 1, 1 << BITS), bool)
    w = words(data, at)
    if not len(w.starts):
        return out, before
    row = np.repeat(np.arange(len(at) - 1), np.diff(w.ptr))
    count = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[w.ends] - c[w.starts]
    size, upper, digit, punct = w.ends - w.starts, count(_UPPER[data]), count(_DIGIT[data]), count(_PUNCT[data])
    repeats = np.zeros(len(size), bool)
    repeats[1:] = (w.hashes[1:] == w.hashes[:-1]) & (row[1:] == row[:-1])
    if before is not None:
        repeats[0] = w.hashes[0] == before[1]
    letters = size - digit - punct
    shape = (upper * 2 > letters) & (letters > 1) | (_UPPER[data[w.starts]]) << 1 | (digit > 0) << 2 | np.minimum(punct, 3) << 3 | (letters == 0) << 5 | repeats << 6
    u = np.uint64
    feats = [(w.hashes ^ u(1), row), (w.range_hash(np.maximum(w.ends - 2, w.starts), w.ends) ^ u(2), row)]
    lead = 0
    if before is not None:
        lead, shape = len(before[0]), np.concatenate([before[0], shape])
        row = np.zeros(len(shape), np.int64)
    for k in SHAPES:
        h = window_hashes(shape.astype(u), k) ^ u(10 + k)
        same = row[k - 1 :] == row[: max(0, len(row) - k + 1)]
        same[: max(0, lead - k + 1)] = False  # seen in the part before
        feats.append((h[same], row[: len(row) - k + 1][same]))
    for h, r in feats:
        out[r, (mix(h) >> u(64 - BITS)).astype(np.int64)] = True
    return out, (shape[-(max(SHAPES) - 1) :], w.hashes[-1])


def _features(texts: pa.Array):
    data, at = text_bytes(texts)
    for i, j in slices(at):
        yield i, j, indicators(data[at[i] : at[j]], at[i : j + 1] - at[i])


def margins(weights: np.ndarray, ratio: np.ndarray, bias: float, has: np.ndarray) -> np.ndarray:
    """Of rows of indicators: the weights of what they hold, by the length of its ratios."""
    spot = np.flatnonzero(has)
    row, gram = spot >> BITS, spot & (1 << BITS) - 1
    norm = np.sqrt(np.bincount(row, ratio[gram].astype(float) ** 2, len(has)))
    return np.bincount(row, weights[gram], len(has)) / np.maximum(norm, 1e-6) + bias


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, width: int, epochs: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of the hinge-loss model with these sparse rows and cost of each, by dual coordinate descent."""
    w, alpha = np.zeros(width + 1), np.zeros(len(y))
    square = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            g = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[rows[i]] += d * values[i]
                w[-1] += d
                alpha[i] = new
    return w


def _fit(sets: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    totals = [np.bincount(np.concatenate([s for s, c in zip(sets, y, strict=True) if c == k] or [np.zeros(0, int)]), minlength=1 << BITS) + 1.0 for k in (0, 1)]
    n = [max(1, int((y == k).sum())) + 2.0 for k in (0, 1)]
    ratio = np.log(totals[1] / n[1]) - np.log(totals[0] / n[0])
    values = [((v := ratio[s]) / max(float(np.sqrt(v @ v)), 1e-6)).astype(np.float32) for s in sets]
    cost = np.where(y == 1, len(y) / (2 * n[1]), len(y) / (2 * n[0]))
    w = dual_descent(sets, values, np.where(y == 1, 1.0, -1.0), cost, 1 << BITS)
    return (w[:-1] * ratio).astype(np.float32), ratio.astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, test_fold: int = 0, per_class: int = PER_CLASS) -> Model:
    """Learns from labelled documents outside the test fold, at most per_class of each class. With one class or none the score is its share (0.5 if none)."""
    texts, counts = labelled_texts(docs, labels, label, folds, test_fold, per_class)

    def featured(batches):
        for b in batches:
            for i, j, has in _features(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([np.packbits(r).tobytes() for r in has], pa.binary())], ["y", "x"])

    got = sorted((r[1], int(r[0])) for r in texts.mapInArrow(trimmed(featured), "y int, x binary").collect())
    zero = np.zeros(1 << BITS, np.float32)
    y = np.array([r[1] for r in got], int)
    if len(set(y.tolist())) < 2:
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    order = np.random.default_rng(5).permutation(len(y))
    sets = [np.flatnonzero(np.unpackbits(np.frombuffer(got[i][0], np.uint8))).astype(np.int32) for i in order]
    y = y[order]
    del got
    held = np.arange(len(y)) % 4 == 0
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held[:] = True
        part = _fit(sets, y)
    else:
        part = _fit([s for s, h in zip(sets, held, strict=True) if not h], y[~held])
    margin = np.array([part[0][s].sum() / max(float(np.sqrt((part[1][s] ** 2).sum())), 1e-6) + part[2] for s, h in zip(sets, held, strict=True) if h])
    weight = np.array([counts[int(c)] / max(1, int((y == c).sum())) for c in y[held]])
    slope, offset = platt(margin, y[held].astype(float), weight / weight.mean())
    weights, ratio, bias = _fit(sets, y)
    del sets
    trim()
    return Model(weights, ratio, bias, slope, offset)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 of each text; null counts as empty."""
    out = np.zeros(len(texts))
    for i, j, has in _features(texts):
        out[i:j] = sigmoid(model.slope * margins(model.weights, model.ratio, model.bias, has) + model.offset)
    return out


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs' other columns with score and predicted instead of text, a row for each row; columns of these names are replaced.
    Null counts as empty; equal texts have equal scores; ids aren't read. A text takes a few times its bytes of a worker."""

    def run(texts: pa.Array) -> list[pa.Array]:
        s = scores(model, texts)
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return add_scores(docs, "text", run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that score below the threshold."""
    model = fit(docs, labels)
    return add_scores(docs, "text", lambda t: [scores(model, t)], [], keep=lambda m: m[0] >= threshold)
