"""Toxicity: a convolutional text classifier (after Kim, 2014) trained in numpy, with thresholds calibrated by language.

A word's embedding is the sum of hashed rows for the word and for its first 4, 5 and 6 bytes. Filters of several
widths run over the words; each is max-pooled over the text, and a logistic layer reads the maxima. The language comes from
the text alone (langid); each language's threshold is chosen on all labelled rows that the network didn't learn from and moved to a
score of 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import langid
from .learn import add_scores, labelled_split, sigmoid
from .words import SLICE_BYTES, Words, cuts, slices, text_bytes, trim, trimmed, words

BITS, DIM, WIDTHS, FILTERS = 15, 8, (1, 2, 3), 8
PER_CLASS = 2500  # labelled rows of each class learned from
MOST_BYTES = 16 << 20  # of text of each class learned from, and one row more: of long rows fewer are drawn, and all are whole
EPOCHS, BATCH = 8, 32
THRESHOLD = 0.5
GRID, FAR = 256, 64  # steps of a logit in which rows are counted for the thresholds; logits beyond FAR count as FAR


class Model(NamedTuple):
    table: np.ndarray  # (1 << BITS, DIM)
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: np.ndarray  # of the filters
    out: np.ndarray
    out_bias: float
    cuts: np.ndarray  # logit threshold by predicted language; the last for none
    lang: langid.Model | None


def word_keys(w: Words) -> np.ndarray:
    """Four table rows of each word: int32 (words, 4)."""
    keys = [w.hashes] + [w.range_hash(w.starts, np.minimum(w.starts + n, w.ends)) * np.uint64(2 * n + 1) for n in (4, 5, 6)]
    return np.stack([(k >> np.uint64(64 - BITS)).astype(np.int32) for k in keys], axis=1)


def _responses(m: Model, keys: np.ndarray, ptr: np.ndarray, beyond: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Maxima over each row's words of every filter, after the rectifier, and the word where each maximum begins (-1: none).

    A row shorter than a filter is padded with zero embeddings at its end. Of a single row `beyond` more words may follow, over which
    filters that begin in the row reach.
    """
    emb = m.table[keys[:, 0]] + m.table[keys[:, 1]] + m.table[keys[:, 2]] + m.table[keys[:, 3]]
    rows, n = len(ptr) - 1, len(emb)
    best, where = np.zeros((rows, len(m.bias)), np.float32), np.full((rows, len(m.bias)), -1)
    full = np.flatnonzero(np.diff(ptr) > 0)
    if not len(full):
        return best, where
    left = n - np.arange(n) if beyond else np.repeat(ptr[1:], np.diff(ptr)) - np.arange(n)  # words left in the row, this one included
    for k, f in enumerate(m.filters):
        a = k * FILTERS
        act = emb @ f[0]
        for j in range(1, len(f)):
            act[:-j] += np.where((left[:-j] > j)[:, None], emb[j:] @ f[j], 0)
        top = np.maximum.reduceat(act[: ptr[-1]], ptr[:-1][full], axis=0)
        best[full, a : a + FILTERS] = top
        if rows <= BATCH:  # in training the place of the maximum is needed too
            for r in full:
                where[r, a : a + FILTERS] = ptr[r] + act[ptr[r] : ptr[r + 1]].argmax(axis=0)
    return np.maximum(best + np.where(np.isin(np.arange(rows), full)[:, None], m.bias, 0), 0), where


def logits(m: Model, keys: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    return _responses(m, keys, ptr)[0] @ m.out + m.out_bias


def _parts(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Word keys of one row, range by range."""
    for a, b in cuts(data, 0, int(at[-1])):
        yield word_keys(words(data[a:b], np.array([0, b - a])))


def row_keys_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word keys of some rows, and where each row's begin. A long row is read range by range."""
    if len(at) != 2 or at[-1] <= 2 * SLICE_BYTES:
        w = words(data, at)
        return word_keys(w), w.ptr
    keys = np.concatenate(list(_parts(data, at)))
    return keys, np.array([0, len(keys)])


def row_logits(m: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """logits() of some rows; of a long row range by range, with the words of the range before that filters still reach over."""
    if len(at) != 2 or at[-1] <= 2 * SLICE_BYTES:
        return logits(m, *row_keys_of(data, at))
    best, over, held = np.zeros((1, len(m.bias)), np.float32), max(WIDTHS) - 1, np.zeros((0, 4), np.int32)
    for keys in _parts(data, at):
        held = np.concatenate([held, keys])
        if len(held) > over:
            best = np.maximum(best, _responses(m, held, np.array([0, len(held) - over]), beyond=over)[0])
            held = held[-over:]
    best = np.maximum(best, _responses(m, held, np.array([0, len(held)]))[0])
    return best @ m.out + m.out_bias


class _Adam:
    def __init__(self, x: np.ndarray, rate: float):
        self.x, self.rate, self.m, self.v, self.t = x, rate, np.zeros_like(x), np.zeros_like(x), 0

    def step(self, g: np.ndarray, at: np.ndarray | None = None) -> None:
        """With `at`: g holds the gradients of these rows only, and only they move."""
        self.t += 1
        i = slice(None) if at is None else at
        self.m[i] = 0.9 * self.m[i] + 0.1 * g
        self.v[i] = 0.99 * self.v[i] + 0.01 * g * g
        self.x[i] -= self.rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.99**self.t)) + 1e-8)


class Gradients(NamedTuple):
    rows: np.ndarray  # of the table
    table: np.ndarray  # by these rows
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float


def gradients(m: Model, keys: np.ndarray, ptr: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Gradients:
    """Of the mean weighted logistic loss over at most BATCH rows; a maximum passes its gradient to the place it was found at."""
    top, where = _responses(m, keys, ptr)
    d = (weight * (sigmoid(top @ m.out + m.out_bias) - y) / len(y)).astype(np.float32)
    back = d[:, None] * m.out * (top > 0)
    g_rows, g_vals, g_filters = [], [], []
    for k, f in enumerate(m.filters):
        a, gf = k * FILTERS, np.zeros_like(f)
        b, w = back[:, a : a + FILTERS], where[:, a : a + FILTERS]
        for j in range(len(f)):
            r, c = np.nonzero((b != 0) & (w >= 0) & (w + j < ptr[1:][:, None]))
            word = keys[w[r, c] + j]
            np.add.at(gf[j].T, c, b[r, c][:, None] * m.table[word].sum(axis=1))
            g_rows.append(word.reshape(-1))
            g_vals.append(np.repeat(b[r, c][:, None] * f[j][:, c].T, 4, axis=0))
        g_filters.append(gf)
    rows, spot = np.unique(np.concatenate(g_rows), return_inverse=True)
    g = np.zeros((len(rows), DIM), np.float32)
    np.add.at(g, spot, np.concatenate(g_vals))
    return Gradients(rows, g, g_filters, back.sum(axis=0), top.T @ d, float(d.sum()))


def train(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 11) -> Model:
    """docs: word keys of each. The first embedding column starts as the log-odds of the hashed row, the rest at random."""
    rng = np.random.default_rng(seed)
    seen = [np.ones(1 << BITS), np.ones(1 << BITS)]
    for d, c in zip(docs, y, strict=True):
        seen[int(c)][np.unique(d)] += 1
    n = [float((y == c).sum()) + 2 for c in (0, 1)]
    table = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
    table[:, 0] = 0.25 * np.clip(np.log(seen[1] / n[1]) - np.log(seen[0] / n[0]), -4, 4)
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.2
    width = FILTERS * len(WIDTHS)
    bias, out, out_bias = np.zeros(width, np.float32), np.full(width, 0.1, np.float32), np.full(1, -1.0, np.float32)
    m = Model(table, filters, bias, out, -1.0, np.zeros(1), None)
    opt_table, opt_out, opt_ob, opt_bias, opt_f = _Adam(table, 0.02), _Adam(out, 0.02), _Adam(out_bias, 0.02), _Adam(bias, 0.01), [_Adam(f, 0.01) for f in filters]
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            keys, ptr = np.concatenate([docs[k] for k in some]), np.concatenate([[0], np.cumsum([len(docs[k]) for k in some])])
            g = gradients(m._replace(out_bias=float(out_bias[0])), keys, ptr, y[some], weight[some])
            for f, opt, gf in zip(filters, opt_f, g.filters, strict=True):
                opt.step(gf + 1e-4 * f)
            if len(g.rows):
                opt_table.step(g.table + 1e-5 * table[g.rows], g.rows)
            opt_out.step(g.out + 1e-4 * out)
            opt_ob.step(np.array([g.out_bias], np.float32))
            opt_bias.step(g.bias)
    return m._replace(out_bias=float(out_bias[0]))


def _cuts(logit: np.ndarray, y: np.ndarray, weight: np.ndarray, lang: np.ndarray, langs: int, n: np.ndarray | None = None) -> np.ndarray:
    """For each language the threshold with the least weighted error on held-back rows, in the middle of the best gap; with under
    five rows of either class, the threshold over all languages. An item stands for n rows, weight is that of all of them."""
    n = np.ones(len(y), np.int64) if n is None else n

    def best(rows: np.ndarray) -> float:
        order = np.argsort(logit[rows])
        x, t, w = logit[rows][order], y[rows][order], weight[rows][order]
        # below the threshold: toxic rows are errors; above: clean ones
        errors = np.concatenate([[0], np.cumsum(np.where(t == 1, w, -w))]) + w[t == 0].sum()
        edges = np.concatenate([[x[0] - 2], x, [x[-1] + 2]])
        errors[edges[1:] == edges[:-1]] = np.inf  # equal logits can't be parted
        low = np.flatnonzero(errors <= errors.min() + 1e-9 * max(1, w.sum()))
        i = low[np.argmax(edges[low + 1] - edges[low])]
        return float((edges[i] + edges[i + 1]) / 2)

    every = best(np.arange(len(y))) if len(set(y.tolist())) == 2 else 0.0
    out = np.full(langs + 1, every)
    for k in range(langs):
        rows = np.flatnonzero(lang == k)
        if min(n[rows][y[rows] == 0].sum(), n[rows][y[rows] == 1].sum()) >= 5:
            out[k] = best(rows)
    return out


def _step(logit: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(logit, -FAR, FAR) * GRID).astype(np.int32)


def _counted(rest: DataFrame, model: Model) -> np.ndarray:
    """How many of rest(doc_id, y, text) fall into each step, by language and class: int64 rows (lang, y, step, n). Rows are
    scored where they are, and of those that share a doc_id one counts, as in learn.one_each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(_languages(model.lang, texts), pa.int32()), pa.array(_step(_text_logits(model, texts)))], ["doc_id", "h", "y", "lang", "step"])

    out = T.StructType([rest.schema["doc_id"], *(T.StructField(c, t) for c, t in (("h", T.LongType()), ("y", T.IntegerType()), ("lang", T.IntegerType()), ("step", T.IntegerType())))])
    steps = rest.select("doc_id", F.xxhash64("text").alias("h"), F.col("y").cast("int").alias("y"), "text").mapInArrow(trimmed(run), out)
    one = steps.groupBy("doc_id").agg(F.min_by(F.struct("lang", "y", "step"), "h").alias("r"))
    got = one.groupBy("r.lang", "r.y", "r.step").count().collect()
    return np.array([tuple(r) for r in got], np.int64).reshape(-1, 4)


def _languages(lang: langid.Model | None, texts: pa.Array) -> np.ndarray:
    return langid.predict(lang, texts)[0] if lang else np.full(len(texts), -1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, test_fold: int = 0, per_class: int = PER_CLASS) -> Model:
    """Learns from labelled documents outside the test fold. The network learns from three quarters of a sample of at most per_class of
    each class, and about MOST_BYTES of their text; the thresholds come from all the other labelled documents, however many there are.

    docs(doc_id, text, lang): lang serves to learn the language model. With one class or none nothing counts as toxic
    unless all labels say so.
    """
    lang = langid.fit(langid.learnable(docs, folds, test_fold))
    texts, rest, counts = labelled_split(docs, labels, label, folds, test_fold, per_class, MOST_BYTES)

    def featured(batches):
        for b in batches:
            tongue = _languages(lang, b.column(1))
            data, at = text_bytes(b.column(1))
            for i, j in slices(at):
                keys, ptr = row_keys_of(data[at[i] : at[j]], at[i : j + 1] - at[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int32()), pa.array(tongue[i:j], pa.int32()), pa.array([keys[ptr[r] : ptr[r + 1]].astype(np.uint16).tobytes() for r in range(j - i)], pa.binary())], ["y", "lang", "x"])

    got = sorted((bytes(r[2]), int(r[0]), int(r[1])) for r in texts.mapInArrow(trimmed(featured), "y int, lang int, x binary").collect())
    y = np.array([r[1] for r in got], float)
    langs = len(lang.langs)
    if len(set(y.tolist())) < 2:
        zero = Model(np.zeros((1 << BITS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0, np.zeros(langs + 1), lang)
        return zero._replace(out_bias=4.0 if len(y) and y[0] == 1 else -4.0)
    order = np.random.default_rng(5).permutation(len(y))
    rows, y, tongue = [np.frombuffer(got[i][0], np.uint16).reshape(-1, 4) for i in order], y[order], np.array([got[i][2] for i in order])
    weight = np.array([counts[int(c)] / max(1, int((y == c).sum())) for c in y])
    weight = np.sqrt(weight / weight.mean())
    del got
    held = np.arange(len(y)) % 4 == 0
    if min((y[held] == 0).sum(), (y[held] == 1).sum(), (y[~held] == 0).sum(), (y[~held] == 1).sum()) < 2:
        model, held = train(rows, y, weight), np.ones(len(y), bool)
    else:
        model = train([r for r, h in zip(rows, held, strict=True) if not h], y[~held], weight[~held])
    some = [r for r, h in zip(rows, held, strict=True) if h]
    ptr = np.concatenate([[0], np.cumsum([len(r) for r in some])])
    logit = np.concatenate([logits(model, np.concatenate(some[i:j]), ptr[i : j + 1] - ptr[i]) for i, j in slices(ptr, 1 << 16)])
    left = sum(counts.values()) - len(y)  # labelled rows that weren't drawn
    del rows, some
    trim()
    model = model._replace(lang=lang)
    own = np.stack([tongue[held], y[held].astype(np.int64), _step(logit), np.ones(int(held.sum()), np.int64)], axis=1)
    lang_of, y_of, step, n = np.concatenate([own, _counted(rest, model)] if left else [own]).T
    # a class weighs as much as in training, dealt over all rows it has here
    each = {c: float(weight[y == c].sum()) / max(1, int(n[y_of == c].sum())) for c in (0, 1)}
    cuts = _cuts((step + 0.5) / GRID, y_of, n * np.where(y_of == 1, each[1], each[0]), lang_of, langs, n)
    return model._replace(cuts=cuts)


def _text_logits(m: Model, texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts))
    data, at = text_bytes(texts)
    for i, j in slices(at):
        out[i:j] = row_logits(m, data[at[i] : at[j]], at[i : j + 1] - at[i])
    return out


def scores(m: Model, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 of each text, 0.5 at its language's threshold; null counts as empty."""
    return sigmoid(_text_logits(m, texts) - m.cuts[_languages(m.lang, texts)])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs' other columns with score and predicted instead of text, a row for each row; columns of these names are replaced.
    Null counts as empty; equal texts have equal scores; ids aren't read. A text takes a few times its bytes of a worker."""

    def run(texts: pa.Array) -> list[pa.Array]:
        s = scores(model, texts)
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return add_scores(docs, "text", run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that score at or above the threshold."""
    model = fit(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), labels)
    return add_scores(docs, "text", lambda t: [scores(model, t)], [], keep=lambda m: m[0] < threshold)
