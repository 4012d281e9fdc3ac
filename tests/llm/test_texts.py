"""The text operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import decontaminate, jpeg, langid, media, overlap, packing, quality, queries, toxicity
from skein.llm import words as W

SCHEMA = "doc_id long, text string, lang string, sig string, key string"
ODD = [None, "", " \t\n", "a", "a b", "A  b", "é ß 漢字 a", "x" * 5000, "w " * 3000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", "k") for i, t in enumerate(texts)], SCHEMA)


def sets_of(texts, k):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def brute_components(sets, num, den):
    up = list(range(len(sets)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def family(rng, n, size, edits):
    base = [f"w{x}" for x in rng.integers(0, 10**6, size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, edits))):
            w[int(rng.integers(0, size))] = f"z{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_shingles_are_words_in_order():
    data, at = W.text_bytes(pa.array(["a b c d", "a b d c", "A B C D", "abcd", "a bcd"]))
    h, _ = W.shingles(*W.hashed(data, at), 4)
    assert h[0] == h[2] and len(set(h.tolist())) == 4


@pytest.mark.parametrize("blocks", [None, (3, 2, 400)])
def test_jaccard(spark, monkeypatch, blocks):
    if blocks:
        for name, v in zip(("BLOCK_ROWS", "QUERY_ROWS", "BLOCK_TOKENS"), blocks, strict=True):
            monkeypatch.setattr(overlap, name, v)
    rng = np.random.default_rng(2)
    texts = ODD + ODD + family(rng, 30, 60, 6) + family(rng, 20, 40, 4) + family(rng, 12, 200, 14) + [" ".join(rng.choice(["p", "q", "r"], 12)) for _ in range(20)]
    sets = sets_of(texts, 4)
    got = sorted(overlap.shingle_components(frame(spark, texts), 4, 85, 100).collect())
    assert [tuple(r) for r in got] == [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, brute_components(sets, 85, 100), strict=True))]


def test_jaccard_edges(spark):
    assert overlap.shingle_components(frame(spark, []), 4, 85, 100).count() == 0
    twice = spark.createDataFrame([(7, "a b c"), (3, "a b c"), (3, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert {r["component_id"] for r in overlap.shingle_components(twice).collect()} == {3}
    assert [r["doc_id"] for r in overlap.keep_one(twice.where("doc_id is not null")).collect()] == [3]


def test_one_row_stays(spark):
    """Rows are decided on, not ids: shared and null ids, repeated rows, extra columns of clashing names."""
    t, u = "a b c d e f g", "other words that have no copy"
    rows = [(1, t, 1), (5, t, 2), (5, u, 3), (None, t, 4), (None, t, 5), (None, "alone here", 6), (None, None, 7), (None, None, 8), (5, "", 9), (5, "", 10), (9, "Same ROW", 11), (9, "Same ROW", 12), (8, "same row", 13), (7, "x y", 14), (7, "x y", 15)]
    docs = spark.createDataFrame([(*r, r[2]) for r in rows], "doc_id long, text string, _k1 int, sig int")
    kept = sorted(r["_k1"] for r in overlap.keep_one(docs).collect())
    assert kept[:-1] == [1, 3, 6, 7, 8, 9, 10, 13] and kept[-1] in (14, 15)
    assert overlap.keep_one(docs).columns == docs.columns
    assert overlap.keep_one(docs.limit(0)).count() == 0


def test_names_of_sets():
    u, v = (np.unique(np.arange(i, i + 9, dtype=np.uint64)) for i in (1, 2))
    (a, x), (b, y) = overlap._signature(u), overlap._signature(v)
    assert a != b and x != y
    other = overlap._signature(u, frozenset([a]))
    assert other[0] != a and other[1] == x and overlap._signature(v, frozenset([a])) == (b, y)


def test_repeated_fingerprints(monkeypatch):
    """A range dealt from two chunks, counted at once and part by part."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 30))).astype(np.uint64) * np.uint64(2**58 // 7)) for _ in range(400)]
    docs = [[int(x) for x in s] for s in sets]
    seen = {}
    for s in docs:
        for x in s:
            seen[x >> 30] = seen.get(x >> 30, 0) + 1
    want = [sum(seen[x >> 30] > 1 for x in s) for s in docs]

    class Here:
        @staticmethod
        def get():
            return Here

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(overlap, "TaskContext", Here)
    for tokens in (1 << 22, 50):
        monkeypatch.setattr(overlap, "RANGE_TOKENS", tokens)
        dealt = []
        for chunk, part in ((0, sets[:150]), (1, sets[150:])):
            monkeypatch.setattr(overlap, "_doc_sets", lambda *_, part=part: iter([(None, 0, part)]))
            for b in overlap._dealt(4, 2, frozenset())(iter([])):
                dealt += [{**r, "chunk": chunk} for r in pa.Table.from_batches([b]).to_pylist()]
        got = [np.zeros(0, np.int64)] * 2
        for chunk, n in ((0, 150), (1, 250)):
            got[chunk] = np.zeros(n, np.int64)
        schema = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("prints", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])
        for p in {r["part"] for r in dealt if r["part"] >= 0}:
            for r in overlap._repeated(pa.Table.from_pylist([r for r in dealt if r["part"] == p], schema)).to_pylist():
                got[r["chunk"]][overlap._places(r["docs"])] += overlap._unpacked(r["found"])
        assert np.concatenate(got).tolist() == want


def test_divide_skip():
    rng = np.random.default_rng(4)
    for _ in range(200):
        index = {t: sorted(rng.choice(40, int(rng.integers(0, 30)), replace=False).tolist()) for t in range(12)}
        query, least = rng.choice(14, 9, replace=False).tolist(), int(rng.integers(1, 8))
        count = {}
        for t in query:
            for i in index.get(t, []):
                count[i] = count.get(i, 0) + 1
        assert list(overlap.divide_skip(query, index, least)) == [(i, n) for i, n in sorted(count.items()) if n >= least]


def test_decontamination(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 5000, n))
    items = [text(n) for n in (14, 30, 30, 59, 3)] + ["", None]
    docs = [text(300) for _ in range(20)] + ODD
    docs[2] += " " + items[1]
    docs[4] = items[3].upper() + " " + docs[4]
    docs[5] = docs[5] + " " + " ".join(items[2].split()[:-1] + ["changed"]) + " end"
    docs[6] += " " + items[4]
    docs[7] = text(50) + " " + " ".join(items[0].split()[:8])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contamination(frame(spark, docs), bench).collect()}
    assert set(got) == {(2, 1), (4, 3), (5, 2), (6, 4)} and got[2, 1]["start_word"] == 300 and got[2, 1]["similarity"] == 1.0
    left = {r["doc_id"] for r in decontaminate.decontaminate(frame(spark, docs), bench).collect()}
    assert left == set(range(len(docs))) - {2, 4, 5, 6}
    assert decontaminate.contamination(frame(spark, docs), bench.limit(0)).count() == 0


def test_hamming_search_is_complete():
    rng = np.random.default_rng(6)
    index = decontaminate.Index(20, [W.window_hashes(rng.integers(0, 2**63, 20).astype(np.uint64), 5) for _ in range(60)])
    q = index.prints[rng.integers(0, 60, 200)] ^ np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 30)), replace=False)) for _ in range(200)], np.uint64)
    want = {(a, b) for a in range(200) for b in range(60) if int(q[a] ^ index.prints[b]).bit_count() <= decontaminate.RADIUS}
    assert set(zip(*(x.tolist() for x in index.search(q)), strict=True)) == want


@pytest.mark.parametrize("n", [14, 20, 59, 200])
def test_fingerprints_miss_few(n):
    """Of windows just similar enough, how many lie beyond the radius."""
    rng, seen, far = np.random.default_rng(n), 0, 0
    while seen < 1500:
        words = rng.integers(0, 2**63, n).astype(np.uint64)
        other = words.copy()
        for _ in range(max(1, n // 45)):
            other[rng.integers(0, n)] = rng.integers(0, 2**63)
        cut = int(rng.integers(0, max(1, n // 20) + 1))
        other = np.concatenate([rng.integers(0, 2**63, cut).astype(np.uint64), other[: n - cut]])
        a, b = W.window_hashes(words, 5), W.window_hashes(other, 5)
        if 0.8 <= decontaminate.similarity(decontaminate.Counter(a.tolist()), decontaminate.Counter(b.tolist())) < 0.9:
            seen += 1
            far += (decontaminate.simhash(a) ^ decontaminate.simhash(b)).bit_count() > decontaminate.RADIUS
        elif n < 20:
            seen += 1  # too short for a change that leaves so much
    assert far / seen < 0.02


def test_stretches_cover_all_windows():
    rng = np.random.default_rng(7)
    for _ in range(60):
        words, reach = int(rng.integers(1, 90_000)), int(rng.integers(1, 3000))
        places = np.unique(rng.integers(0, words, int(rng.integers(1, 12))))
        got = list(decontaminate._stretches(places, words, reach))
        if words < reach:
            assert got == [(0, words)]
            continue
        starts = np.concatenate([np.arange(a, b) for a, b in got])
        want = np.unique(np.concatenate([np.arange(max(0, p - reach + 1), p + 1) for p in places]))
        assert len(starts) == len(set(starts.tolist())) and set(want.tolist()) <= set(starts.tolist()) and len(starts) == len(want)


def test_one_row_is_removed(spark):
    """Rows are decided on, not ids; long and repeated passages, short items, clashing names, empty tables."""
    rng = np.random.default_rng(15)
    text = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 5000, n))
    items = [text(20), text(31), "two words"]
    rows = [(1, f"{text(40)} {items[0]} {text(9)}"), (1, text(60)), (None, f"{items[1]} {text(20_000)} {items[1]}"), (None, text(50)), (None, None), (3, f"x {items[2]} y"), (3, f"x {items[2]} y"), (4, "")]
    docs = spark.createDataFrame([(*r, i, "w") for i, r in enumerate(rows)], "doc_id long, text string, row int, words string")
    bench = spark.createDataFrame([*enumerate(items), (0, items[0])], "item_id long, text string")
    left = decontaminate.decontaminate(docs, bench)
    assert sorted(r["row"] for r in left.collect()) == [1, 3, 4, 7] and left.columns == docs.columns
    hits = sorted((r["item_id"], r["start_word"], r["similarity"]) for r in decontaminate.contamination(docs, bench).collect())
    assert hits == [(0, 40, 1.0), (1, 0, 1.0), (2, 1, 1.0), (2, 1, 1.0)]
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_packing(spark):
    path = queries.tokenizer_path()
    texts = [*ODD, "Hello, world. It's <|endoftext|> A.B <|ENDOFTEXT|>", "mot. " * 900] + [f"word{i} and more" * (i % 7) for i in range(60)]
    got = packing.pack(packing.cut(packing.token_pieces(frame(spark, texts), path, 64, with_ids=True)), 64).collect()
    tok = packing._tokenizer(path)
    fill = {}
    for i, t in enumerate(texts):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == want and [r["start"] for r in mine] == list(range(0, len(want), 64))
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in mine)
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(fill) <= -(-sum(r["length"] for r in got) // 64) + 1


def test_packing_odd_rows(spark):
    """Null and repeated ids, repeated rows, an empty table, columns named like the results."""
    rows = [(None, "a b"), (None, "a b"), (1, None), (1, "x"), (1, "x"), (2, "")] + [(3, "same text here")] * 50
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, length int, _row int")
    got = packing.pack_documents(docs, queries.tokenizer_path(), 16).collect()
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["piece"] == 0 for r in got) == len(rows) and "_row" not in got[0]
    assert all([a for a, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 16 for p in fill.values())
    assert packing.pack_documents(docs.limit(0), queries.tokenizer_path(), 16).count() == 0


def test_reduction_keeps_the_optimum():
    """Against exhaustive packing of small instances: the fixed sequences belong to some best packing."""

    def best(sizes, cap):
        sizes, found = sorted(sizes, reverse=True), [len(sizes)]

        def go(i, bins):
            if len(bins) >= found[0]:
                return
            if i == len(sizes):
                found[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + sizes[i] <= cap and bins[b] not in bins[:b]:
                    bins[b] += sizes[i]
                    go(i + 1, bins)
                    bins[b] -= sizes[i]
            go(i + 1, [*bins, sizes[i]])

        go(0, [])
        return found[0]

    rng = np.random.default_rng(8)
    for _ in range(150):
        cap = int(rng.integers(8, 30))
        sizes = [int(x) for x in rng.integers(1, cap + 1, int(rng.integers(1, 9)))]
        counts = {s: sizes.count(s) for s in set(sizes)}
        plan = packing.Plan(dict(counts), cap)
        left = []
        for s, first, n, seq, _, _ in plan.rows:
            left += [s] * n if seq >= plan.fixed else []
        assert plan.fixed + (best(left, cap) if left else 0) == best(sizes, cap)


def test_media(spark):
    texts = [*ODD, "é" * 700]
    rows = {r["doc_id"]: r for r in media.decode_media(media.encode_media(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert all(len(x["rgb"]) == x["height"] * x["width"] * 3 for x in r["tensors"]) and len(r["tensors"]) == 1
    assert rows[0]["media_sha256"] == rows[1]["media_sha256"]
    bad = spark.createDataFrame([(1, 5, b"junk"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [r["feature"] for r in media.decode_media(bad).collect()] == ["invalid"] * 2


def test_general_progressive_scans():
    """A hand-made stream with runs, end-of-band codes, both signs and refinement, coded symbol by symbol."""
    coef = np.zeros((4, 64), np.int64)
    coef[0, [0, 1, 5, 63]] = [40, -3, 2, 1]
    coef[1, [0, 20]] = [-12, 5]
    coef[3, [0, 2, 3]] = [7, 1, -1]
    dc, ac = {n: 4 for n in range(12)}, {s: 8 for s in [*range(1, 4), *(r << 4 | s for r in range(1, 16) for s in (1, 2)), 0x00, 0xF0, 0x10, 0x20, 0x13]}
    codes = lambda t: jpeg._codes(tuple(sorted(t.items(), key=lambda x: x[1])))

    def put(bits, v, n):
        bits += [v >> i & 1 for i in range(n - 1, -1, -1)]

    def sym(bits, t, s):
        put(bits, *codes(t)[s])

    def mag(bits, v):
        n = abs(v).bit_length()
        put(bits, v if v > 0 else v + (1 << n) - 1, n)
        return n

    scans, bits, last = [], [], 0
    for b in range(4):
        d, last = int(coef[b, 0]) - last, int(coef[b, 0])
        sym(bits, dc, abs(d).bit_length())
        mag(bits, d)
    scans.append((bits, 0, 0, 0, 0))
    first, refine = [], []
    high = np.where(coef >= 0, coef >> 1, -(-coef >> 1))
    for b in range(4):
        run = 0
        for k in range(1, 64):
            if not high[b, k]:
                run += 1
                continue
            while run > 15:
                sym(first, ac, 0xF0)
                run -= 16
            v = int(high[b, k])
            sym(first, ac, run << 4 | abs(v).bit_length())
            mag(first, v)
            run = 0
        if run:
            sym(first, ac, 0)
    scans.append((first, 1, 63, 0, 1))
    for b in range(4):
        run, held = 0, []
        end = max([k for k in range(1, 64) if abs(int(coef[b, k])) == 1], default=0)
        for k in range(1, 64):
            if high[b, k]:
                held.append(abs(int(coef[b, k])) & 1)
            elif abs(int(coef[b, k])) == 1:
                sym(refine, ac, run << 4 | 1)
                put(refine, int(coef[b, k] > 0), 1)
                refine += held
                run, held = 0, []
            else:
                run += 1
                if run == 16 and k < end:
                    sym(refine, ac, 0xF0)
                    refine += held
                    run, held = 0, []
        if end < 63:
            sym(refine, ac, 0)
            refine += held
    scans.append((refine, 1, 63, 1, 0))
    out = jpeg._HEAD + b"\xff\xc2" + (11).to_bytes(2, "big") + b"\x08\x00\x10\x00\x10\x01\x01\x11\x00" + jpeg._dht(0, 0, dc) + jpeg._dht(1, 0, ac)
    for bits, *band in scans:
        out += jpeg._sos([(1, 0, 0)], *band) + jpeg._stuff(jpeg._pad(np.array(bits, np.uint8)))
    img = jpeg.decode(out + b"\xff\xd9")
    assert (img.comps[0].coef == coef).all()
    flat = jpeg.decode(jpeg._HEAD + b"\xff\xc2" + (11).to_bytes(2, "big") + b"\x08\x00\x10\x00\x10\x01\x01\x11\x00" + b"\xff\xd9")
    assert (flat.rgb() == 128).all()


def test_classifiers(spark):
    rng = np.random.default_rng(9)
    tongues = {"aa": ["ba", "ke", "lo"], "bb": ["stri", "nof", "ür"], "cc": ["que", "ción", "ar"]}
    word = lambda t: "".join(rng.choice(tongues[t], int(rng.integers(1, 4))))
    rows, labels = [], []
    for i in range(600):
        t = ("aa", "bb", "cc")[i % 3]
        w = [word(t) for _ in range(int(rng.integers(20, 80)))]
        bad, toxic = i % 5 == 0, i % 7 == 0
        w = [x + "***" for x in w] if bad else w
        if toxic:
            w[int(rng.integers(0, len(w)))] = "vile" + word(t)
        rows.append((i, " ".join(w), t))
        labels.append((i, 0 if bad else 1, int(toxic)))
    rows += [(1000 + i, x, None) for i, x in enumerate([*ODD, "123 !!"])]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {r[0]: r for r in labels}
    test = {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    q = {r["doc_id"]: r for r in quality.score(docs.select("doc_id", "text"), quality.fit(docs, marks)).collect()}
    t = {r["doc_id"]: r for r in toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, marks)).collect()}
    lang = {r["doc_id"]: r for r in langid.identify(docs.select("doc_id", "text"), langid.learnable(docs, 5, 0)).collect()}
    assert len(q) == len(t) == len(lang) == len(rows) and all(0 <= x["score"] <= 1 for d in (q, t, lang) for x in d.values())
    share = lambda right: np.mean([right(i) for i in test])
    assert share(lambda i: q[i]["predicted"] == truth[i][1]) > 0.95
    assert share(lambda i: t[i]["predicted"] == truth[i][2]) > 0.9
    assert share(lambda i: lang[i]["lang_pred"] == ("aa", "bb", "cc")[i % 3]) > 0.95
    assert [lang[1000 + i]["lang_pred"] for i in (0, 1, 2, len(ODD))] == ["und"] * 4
    none = marks.limit(0)
    assert {r["predicted"] for r in toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, none)).collect()} == {0}
    assert quality.score(docs.limit(0).select("doc_id", "text"), quality.fit(docs, none)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.select("doc_id", "text"), docs.where("lang = 'x'")).collect()} == {"und"}
