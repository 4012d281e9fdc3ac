"""The classifiers' parts against independent computations, their odd rows, and the queries' columns on the smallest tables."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import langid, learn, quality, queries, toxicity
from skein.llm import words as W

D = "/root/testdata/sf0.001"


def test_codewords():
    for n in range(2, 12):
        c = langid.codewords(n)
        apart = min((c[i] != c[j]).sum() for i in range(n) for j in range(i))
        assert c.shape[0] == n and len({tuple(x) for x in c}) == n and (n <= 2 or apart >= 2) and all(abs(col.sum()) < n for col in c.T)
    # the exhaustive code: each split of the classes once
    assert langid.codewords(4).shape == (4, 7) and len({tuple(x * x[0]) for x in langid.codewords(4).T}) == 7


def test_decoding_is_the_nearest_codeword():
    rng = np.random.default_rng(2)
    code = langid.codewords(5)
    bits = code.shape[1]
    m = langid.Model(list("abcde"), code, rng.normal(0, 1, (langid.WIDTH, bits)).astype(np.float32), rng.normal(0, 1, bits), rng.random(bits), 0.05)
    texts = pa.array(["alpha beta", "ünïcode", "zzz", "1 2", None, "", "x" * 400])
    best, score, unsure = langid.predict(m, texts)
    for i, t in enumerate(texts.to_pylist()):
        raw = (t or "").lower().encode()
        if not any(c.isalpha() for c in t or ""):
            assert best[i] == -1 and score[i] == 0 and unsure[i]
            continue
        x = np.sqrt(langid._counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].astype(float))
        f = x / np.linalg.norm(x) @ m.weights + m.bias
        loss = [sum(w * np.log1p(np.exp(-b * v)) for w, b, v in zip(m.trust, word, f, strict=True)) for word in code]
        first, second = sorted(loss)[:2]
        assert best[i] == int(np.argmin(loss)) and 0 < score[i] <= 1 and (unsure[i] == (second - first < m.margin) or abs(second - first - m.margin) < 1e-4)


def test_grams_are_counts():
    raw = "abcab\u00fc ab".encode()
    got = langid._counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    assert got[:256].sum() == len(raw) and got[256 : 256 + (1 << langid.BITS2)].sum() == len(raw) - 1 and got[256 + (1 << langid.BITS2) :].sum() == len(raw) - 2 and got[ord("a")] == 3


def test_hinge_solver_reaches_the_optimum():
    """The dual optimum by projected gradients on the whole kernel, and the gap between primal and dual."""
    rng = np.random.default_rng(5)
    n, width = 60, 30
    rows = [np.sort(rng.choice(width, 6, replace=False)).astype(np.int32) for _ in range(n)]
    values = [rng.normal(0, 1, 6).astype(np.float32) for _ in range(n)]
    y, cost = np.where(rng.random(n) < 0.5, 1.0, -1.0), np.where(np.arange(n) % 3 == 0, 2.0, 0.7)
    w = quality.dual_descent(rows, values, y, cost, width, epochs=400)
    x = np.zeros((n, width + 1))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[i, r] = v
        x[i, -1] = 1
    loss = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    k, alpha = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(n)
    step = 1 / np.linalg.eigvalsh(k).max()
    for _ in range(60_000):
        alpha = np.clip(alpha + step * (1 - k @ alpha), 0, cost)
    dual = alpha.sum() - 0.5 * alpha @ k @ alpha
    assert abs(loss(w) - dual) < 1e-3 * dual


def test_ratios_scale_the_indicators():
    sets, y = [np.array([1, 2], np.int32), np.array([1, 3], np.int32), np.array([2, 3], np.int32), np.array([1], np.int32)], np.array([1, 1, 0, 0])
    _, ratio, _ = quality._fit(sets, y)
    want = np.log((2 + 1) / (2 + 2)) - np.log((1 + 1) / (2 + 2))
    assert abs(ratio[1] - want) < 1e-6


def test_gradients_are_numeric(monkeypatch):
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 1 << toxicity.BITS, (n, 4)).astype(np.int32) for n in (1, 2, 5, 9, 0)]
    keys, ptr = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    y, weight = np.array([1.0, 0, 1, 0, 1]), np.array([1.0, 2, 0.5, 1, 1])
    width = toxicity.FILTERS * len(toxicity.WIDTHS)
    m = toxicity.Model(rng.normal(0, 1, (1 << toxicity.BITS, toxicity.DIM)), [rng.normal(0, 1, (k, toxicity.DIM, toxicity.FILTERS)) for k in toxicity.WIDTHS], rng.normal(0, 1, width), rng.normal(0, 1, width), 0.3, np.zeros(1), None)

    def loss(m):
        z = toxicity._responses(m, keys, ptr)[0] @ m.out + m.out_bias
        return (weight * (np.logaddexp(0, z) - y * z)).mean()

    def slope(x, at, m):
        x[at] += 1e-3
        up = loss(m)
        x[at] -= 2e-3
        down = loss(m)
        x[at] += 1e-3
        return (up - down) / 2e-3

    g = toxicity.gradients(m, keys, ptr, y, weight)
    near = lambda a, b: abs(a - b) < 2e-3 + 0.02 * abs(b)
    assert all(near(g.out[i], slope(m.out, i, m)) and near(g.bias[i], slope(m.bias, i, m)) for i in range(width))
    assert all(near(gf[i], slope(f, i, m)) for f, gf in zip(m.filters, g.filters, strict=True) for i in [(j, d, c) for j in range(len(f)) for d in (0, 5) for c in (0, 3, 7)])
    assert all(near(g.table[i, d], slope(m.table, (r, d), m)) for i, r in enumerate(g.rows[:20]) for d in (0, 4))
    assert near(g.out_bias, (loss(m._replace(out_bias=0.301)) - loss(m._replace(out_bias=0.299))) / 2e-3)


def test_convolution_by_hand():
    """Maxima of the filters by loops, for rows shorter than a filter too."""
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << toxicity.BITS, (n, 4)) for n in (0, 1, 2, 7)]
    keys, ptr = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    width = toxicity.FILTERS * len(toxicity.WIDTHS)
    m = toxicity.Model(rng.normal(0, 1, (1 << toxicity.BITS, toxicity.DIM)), [rng.normal(0, 1, (k, toxicity.DIM, toxicity.FILTERS)) for k in toxicity.WIDTHS], rng.normal(0, 1, width), rng.normal(0, 1, width), 0.3, np.zeros(1), None)
    got = toxicity._responses(m, keys, ptr)[0]
    for r, d in enumerate(docs):
        emb = np.concatenate([m.table[d].sum(axis=1), np.zeros((3, toxicity.DIM))])
        want = np.concatenate([np.max([[sum(emb[i + j] @ f[j][:, c] for j in range(len(f))) for c in range(toxicity.FILTERS)] for i in range(len(d))], axis=0) for f in m.filters]) + m.bias if len(d) else np.zeros(width)
        assert np.allclose(got[r], np.maximum(want, 0), atol=1e-4)


def test_thresholds_by_language():
    rng = np.random.default_rng(3)
    lang, y = np.repeat([0, 1], 200), np.tile([0, 1], 200)
    logit = np.where(lang == 0, 1.0, -4.0) + np.where(y == 1, 2.0, 0.0) + rng.uniform(-0.5, 0.5, 400)
    cuts = toxicity._cuts(logit, y, np.ones(400), lang, 3)
    assert 1.5 < cuts[0] < 2.5 and -3.5 < cuts[1] < -2.5 and cuts[2] == cuts[3]
    for k in (0, 1):
        assert ((logit[lang == k] > cuts[k]) == (y[lang == k] == 1)).all()


LONG = ["Short text, here.", "word " * 10, " \n"]


@pytest.mark.parametrize("size", [400, 3000])
def test_long_texts_in_parts(monkeypatch, size):
    """Read range by range, a text gives what it gives at once."""
    rng = np.random.default_rng(size)
    text = " ".join(rng.choice(["Alpha", "beta,", "GAMMA", "x9", "\u00e9t\u00e9", "...", "dup dup", "a" * 90, "J\u030c", "<|endoftext|>"], 2500).tolist()) + " " * 50
    data, at = W.text_bytes(pa.array([text]))
    lang = langid.Model(["a", "b"], langid.codewords(2), rng.normal(0, 1, (langid.WIDTH, 1)).astype(np.float32), np.zeros(1), np.ones(1), 0.0)
    width = toxicity.FILTERS * len(toxicity.WIDTHS)
    cnn = toxicity.Model(rng.normal(0, 1, (1 << toxicity.BITS, toxicity.DIM)), [rng.normal(0, 1, (k, toxicity.DIM, toxicity.FILTERS)) for k in toxicity.WIDTHS], rng.normal(0, 1, width), rng.normal(0, 1, width), 0.3, np.zeros(1), None)
    tok = queries.packing.WordTokenizer(queries.tokenizer_path())

    def all_of():
        return [W.hashed(data, at)[0], langid.grams(data, at), quality.indicators(data, at), toxicity.row_logits(cnn, data, at), toxicity.row_keys_of(data, at)[0], tok(data, at)[0], langid.predict(lang, pa.array([text]))[1]]

    whole = all_of()
    parts = list(W.cuts(data, 0, len(data), size))
    assert len(parts) > 5 and parts[0][0] == 0 and parts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(parts[:-1], parts[1:], strict=True))
    for module in (W, langid, quality, toxicity, queries.packing):
        monkeypatch.setattr(module, "SLICE_BYTES", size)
    monkeypatch.setattr(W.cuts, "__defaults__", (size,))
    for a, b in zip(whole, all_of(), strict=True):
        assert np.allclose(np.asarray(a, float), np.asarray(b, float), rtol=1e-4, atol=1e-6)


def test_memory_of_long_texts():
    """A text of 8 MB: the classifiers hold a part of it at a time, its words' hashes take some bytes each."""
    rng = np.random.default_rng(2)
    text = " ".join(f"w{x}" for x in rng.integers(0, 40_000, 1_250_000).tolist())
    data, at = W.text_bytes(pa.array([text]))
    width = toxicity.FILTERS * len(toxicity.WIDTHS)
    cnn = toxicity.Model(np.zeros((1 << toxicity.BITS, toxicity.DIM), np.float32), [np.zeros((k, toxicity.DIM, toxicity.FILTERS), np.float32) for k in toxicity.WIDTHS], np.zeros(width), np.zeros(width), 0.0, np.zeros(1), None)
    runs = {"grams": lambda: langid.grams(data, at), "indicators": lambda: quality.indicators(data, at), "logits": lambda: toxicity.row_logits(cnn, data, at), "hashes": lambda: W.hashed(data, at)}
    for name, run in runs.items():
        run()
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 90 << 20, name


def test_odd_rows_of_classifiers(spark):
    """Repeated rows, null ids, equal texts, columns named like the results, empty tables."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["vile", "good", "nice", "fine"], 12).tolist()) for _ in range(60)]
    rows = [(i, t, "en", 5.0, "x") for i, t in enumerate(texts)] + [(0, texts[1], "en", 5.0, "x"), (None, texts[2], "en", 5.0, "x"), (None, texts[2], None, None, None), (7, None, "en", 1.0, "x")] + [(3, texts[3], "en", 5.0, "x")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score double, lang_pred string")
    marks = spark.createDataFrame([(i, int("vile" not in t.split()[:3]), int("vile" in t)) for i, t in enumerate(texts)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for out in (quality.score(docs, quality.fit(docs, marks)), toxicity.score(docs, toxicity.fit(docs, marks))):
        got = out.collect()
        assert sorted(out.columns) == sorted(["doc_id", "lang", "lang_pred", "score", "predicted"]) and len(got) == len(rows)
        assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1 and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (None, 2)}) == 1
    named = langid.identify(docs, langid.learnable(docs, 4, 2))
    assert sorted(named.columns) == sorted(["doc_id", "lang", "lang_pred", "score", "ambiguous"]) and {r["lang_pred"] for r in named.collect()} == {"en", "und"}
    assert quality.keep_good(docs, marks).columns == docs.columns and toxicity.drop_toxic(docs, marks).columns == docs.columns
    assert toxicity.drop_toxic(docs.limit(0), marks).count() == quality.keep_good(docs.limit(0), marks).count() == 0


def test_one_text_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, "other") for i in range(2, 30)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic int")
    for most in (None, 1 << 20):
        assert learn.labelled_texts(docs, marks, "toxic", 5, 9, 100, most)[0].count() == 29


def test_query_columns(spark):
    """Every query over the smallest tables: its rows, folds and digests."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = {n: q(spark, D).collect() for n, q in queries.queries().items() if n[:3] in ("op1", "op4", "op5", "op6", "op7", "op8", "op3") and n[:4] != "op10"}
    by = {n.split("_")[0]: rows for n, rows in got.items()}
    crc = lambda i: zlib.crc32(str(i).encode())
    assert all(sorted(r["doc_id"] for r in by[n]) == sorted(docs) for n in ("op1", "op5", "op6", "op7", "op8"))
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and r["lang_pred"] in {"en", "de", "fr", "es", "und"} for r in by["op5"])
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in by["op5"] if r["held_out"]]) > 0.8
    for n, cut in (("op6", 0.3), ("op7", 0.5)):
        assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and r["predicted"] == int(r["score"] >= cut) for r in by[n])
    assert all(r["n_bytes"] == len(docs[r["doc_id"]]["text"].encode()) and r["payload_bytes"] % 576 == 0 and len(r["tensors_sha256"]) == 64 for r in by["op1"])
    assert all(r["size"] == len(docs[r["doc_id"]]["text"].encode()) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]]["text"].encode()) and r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16 for r in by["op8"])
    assert {r["doc_id"] for r in by["op4"]} == set(docs) and all(0 <= r["offset"] <= 4096 - r["length"] for r in by["op4"])
    assert all(r["similarity"] >= 0.8 for r in by["op3"])
