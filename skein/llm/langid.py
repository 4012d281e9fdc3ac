"""Language identification with error-correcting output codes.

Each language has a codeword. A linear classifier over byte 1-, 2- and 3-grams predicts each bit; decoding takes the
codeword with the smallest sum of logistic losses, each bit weighted by how well it did on held-back rows, and flags
a text whose second-best codeword is nearly as close.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learn import add_scores, fold, one_each, sample
from .tables import bounded
from .words import LOWER, SLICE_BYTES, slices, text_bytes, trim, trimmed

BITS2, BITS3 = 11, 12
WIDTH = 256 + (1 << BITS2) + (1 << BITS3)
ROWS = 2000  # rows learned from, over all languages
LANGS = 512  # languages at most; more is an error
NONE = "und"


class Model(NamedTuple):
    langs: list[str]
    code: np.ndarray  # (languages, bits) of +1 and -1
    weights: np.ndarray  # (WIDTH, bits)
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding
    margin: float  # a smaller difference of losses is ambiguous


def _counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of the n-grams of each row: float32 (rows, WIDTH)."""
    n, low = len(at) - 1, LOWER[data].astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(at))
    last = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))  # bytes left in the row
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :256] = np.bincount(row * 256 + low, minlength=n * 256).reshape(n, 256)
    pair = (low[:-1] << 8 | low[1:])[last[:-1] > 1] if len(low) else low
    spot = (pair * 0x9E3B >> 5 & (1 << BITS2) - 1) + (row[:-1][last[:-1] > 1] << BITS2) if len(low) else pair
    out[:, 256 : 256 + (1 << BITS2)] = np.bincount(spot, minlength=n << BITS2).reshape(n, -1)
    three = last[:-2] > 2
    triple = (low[:-2] << 16 | low[1:-1] << 8 | low[2:])[three] if len(low) > 2 else low[:0]
    spot = (triple * 0x9E3779B1 >> 15 & (1 << BITS3) - 1) + (row[:-2][three] << BITS3) if len(low) > 2 else triple
    out[:, 256 + (1 << BITS2) :] = np.bincount(spot, minlength=n << BITS3).reshape(n, -1)
    return out


def grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of the n-gram counts of each row, at unit length: float32 (rows, WIDTH). A long row is counted part by part."""
    if len(at) != 2 or at[-1] <= 2 * SLICE_BYTES:
        out = _counts(data, at)
    else:
        out, n = np.zeros((1, WIDTH)), int(at[-1])
        for a in range(0, n, SLICE_BYTES):
            b = min(a + SLICE_BYTES, n)
            # two bytes of the next part complete the n-grams that begin in this one; what lies in those bytes alone counts there
            out += _counts(data[a : b + 2], np.array([0, min(b + 2, n) - a]))
            if b < n:
                out -= _counts(data[b : b + 2], np.array([0, min(b + 2, n) - b]))
        out = out.astype(np.float32)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def codewords(n: int) -> np.ndarray:
    """The exhaustive code for up to five classes; else the random code, of 200 from a fixed seed, whose closest words lie furthest apart."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        return np.array([[1 if j >> i & 1 else -1 for j in range(1, 1 << (n - 1))] for i in range(n)], np.int8)
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], np.int8), (n, int(np.ceil(10 * np.log2(n)))))
        d = ((c[:, None] != c[None]).sum(axis=2) + np.eye(n, dtype=int) * 999).min()
        if d > far and (abs(c.sum(axis=0)) < n).all():
            best, far = c, d
    return best


def fit(rows: DataFrame, max_rows: int = ROWS) -> Model:
    """rows(doc_id, text, lang): learns from at most max_rows of them, as many of each language. Null texts, languages or ids are left
    out; of rows that share an id and a language one is read. More than LANGS languages are an error."""
    rows = bounded(rows).where("lang is not null and text is not null").select("doc_id", "text", "lang")
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(LANGS + 1).collect())
    if len(langs) > LANGS:
        raise ValueError(f"more than {LANGS} languages")
    if not langs:
        return Model([], np.zeros((0, 1)), np.zeros((WIDTH, 1), np.float32), np.zeros(1), np.ones(1), 0.0)

    def featured(batches):
        for b in batches:
            data, at = text_bytes(b.column(1))
            for i, j in slices(at):
                x = grams(data[at[i] : at[j]], at[i : j + 1] - at[i]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    ids = F.broadcast(sample(rows.select("doc_id", "lang").where("doc_id is not null").distinct(), "lang", langs, max(8, max_rows // len(langs))))
    got = one_each(rows.join(ids, ["doc_id", "lang"]), "doc_id", "lang").select("lang", "text").mapInArrow(trimmed(featured), "lang string, x binary").collect()
    got.sort(key=lambda r: (r[1], r[0]))
    order = np.random.default_rng(1).permutation(len(got))
    x = np.stack([np.frombuffer(got[i][1], np.float16) for i in order]).astype(np.float32)
    y, code = np.array([langs.index(got[i][0]) for i in order]), codewords(len(langs))
    del got
    held = np.arange(len(y)) % 5 == 0
    if len(y) < 20:
        held[:] = False
    w, b = _train(x[~held], code[y[~held]].astype(np.float32))
    right = ((x[held] @ w + b) * code[y[held]] > 0).mean(axis=0) if held.any() else np.ones(code.shape[1])
    trust = np.maximum(right - 0.5, 0.01)
    model = Model(langs, code, w, b, trust / trust.sum(), 0.0)
    if held.any() and len(langs) > 1:
        loss = np.sort(losses(model, x[held]), axis=1)
        model = model._replace(margin=float(np.quantile(loss[:, 1] - loss[:, 0], 0.02)))
    del x
    trim()
    return model


def _train(x: np.ndarray, t: np.ndarray, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of the columns of t (+1, -1) on x: Adam over all rows."""
    w, b = np.zeros((x.shape[1], t.shape[1]), np.float32), np.zeros(t.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, steps + 1):
        g = -t / (1 + np.exp(np.clip(t * (x @ w + b), -30, 30))) / len(x)
        gw = x.T @ g + 1e-5 * w
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        w -= 0.3 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        b -= g.sum(axis=0)
    return w, b


def losses(model: Model, x: np.ndarray) -> np.ndarray:
    """Weighted sum of logistic losses of each row to each codeword."""
    f = x @ model.weights + model.bias
    return np.stack([np.logaddexp(0, -f * c) @ model.trust for c in model.code], axis=1)


def predict(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language (-1: none), confidence and ambiguity of each text."""
    data, at = text_bytes(texts)
    n = len(at) - 1
    best, score, unsure = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
    if model.langs:
        for i, j in slices(at):
            loss = losses(model, grams(data[at[i] : at[j]], at[i : j + 1] - at[i]))
            near = np.exp(-8 * (loss - loss.min(axis=1, keepdims=True)))
            best[i:j] = loss.argmin(axis=1)
            score[i:j] = 1 / near.sum(axis=1)
            if len(model.langs) > 1:
                two = np.sort(loss, axis=1)
                unsure[i:j] = two[:, 1] - two[:, 0] < model.margin
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    best[~letters] = -1
    score[best < 0] = 0
    unsure[best < 0] = True
    return best, score, unsure


def identify(docs: DataFrame, learn_from: DataFrame) -> DataFrame:
    """docs' other columns with lang_pred, score and ambiguous instead of text; learn_from(doc_id, text, lang).

    A text that is null or without a letter gets `und`, and so does every text if there is nothing to learn from. Rows may repeat
    and ids may be null; columns of docs named like the results are replaced.
    """
    model = fit(learn_from)
    names = pa.array([*model.langs, NONE])

    def score(texts: pa.Array) -> list[pa.Array]:
        best, conf, unsure = predict(model, texts)
        return [names.take(pa.array(np.where(best < 0, len(model.langs), best))), pa.array(conf), pa.array(unsure)]

    return add_scores(docs, "text", score, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def learnable(docs: DataFrame, folds: int, test_fold: int) -> DataFrame:
    return docs.where(fold("doc_id", folds) != test_fold).select("doc_id", "text", "lang")
