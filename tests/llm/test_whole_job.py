"""Inputs on which an operator once did less than the whole job."""

from collections import Counter

import numpy as np

from skein.llm import decontaminate, learn, packing, queries, toxicity


def marked(spark, rng, sizes, every=3):
    """Documents of these sizes, each `every`th with one toxic word, and their labels."""
    rows, labels = [], []
    for i, n in enumerate(sizes):
        w = [f"w{x}" for x in rng.integers(0, 400, n)]
        if toxic := i % every == 0:
            w[int(rng.integers(0, n))] = f"vile{rng.integers(0, 9)}"
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def right(docs, marks, model):
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    return np.mean([got[r["doc_id"]] == r["toxic"] for r in marks.collect()])


def test_toxicity_learns_from_long_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs, marks = marked(spark, rng, [2100 + i % 50 for i in range(240)])
    assert right(docs, marks, toxicity.fit(docs, marks)) > 0.9
    # only one class is long
    docs, marks = marked(spark, rng, [2200 if i % 3 == 0 else 150 for i in range(240)])
    assert right(docs, marks, toxicity.fit(docs, marks)) > 0.9
    # fewer rows are drawn, of both classes and of all lengths
    docs, marks = marked(spark, rng, [3000 if i % 2 else 30 for i in range(400)])
    texts, counts = learn.labelled_texts(docs, marks, "toxic", 5, 0, 2500, 400_000)
    drawn = [(r["y"], len(r["text"].split())) for r in texts.collect()]
    for y in (0, 1):
        have = [n for c, n in drawn if c == y]
        assert set(have) == {30, 3000} and 20 < len(have) < counts[y]


def similar(text, item):
    """(similarity, start, words) of the best window by brute force; a shorter text is one window."""
    w, k = text.split(), item.split()
    grams = lambda x: Counter(tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4)))
    want, n, best = grams(k), min(len(w), len(k)), (0.0, 0, 0)
    for i in range(len(w) - n + 1):
        have = grams(w[i : i + n])
        both = (have & want).total()
        best = max(best, (both / (have.total() + want.total() - both), -i, n))
    return best[0], -best[1], best[2]


def test_text_shorter_than_the_item(spark):
    rng = np.random.default_rng(4)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 5000, n)]
    items = [word(n) for n in (59, 30, 14, 200, 4)]
    docs = []
    for k in items:
        for cut in (1, 2, 3, 4, 6, 9, 12, 30):
            docs += [k[:-cut], k[cut:], k[cut // 2 : len(k) - (cut - cut // 2)]]
        docs += [k, k[:-3] + word(2), [*k[: len(k) // 2], "changed", *k[len(k) // 2 : -2]], [*k[:-1], *word(20)]]
    docs = [" ".join(d) for d in docs]
    items = [" ".join(k) for k in items]
    want = {}
    for d, text in enumerate(docs):
        for i, k in enumerate(items):
            if text and (hit := similar(text, k))[0] >= 0.8:
                want[d, i] = hit
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"], r["n_words"]) for r in decontaminate.contamination(frame, bench).collect()}
    assert got == want and any(n < len(items[i].split()) for (_, i), (_, _, n) in want.items())
    left = {r["doc_id"] for r in decontaminate.decontaminate(frame, bench).collect()}
    assert left == set(range(len(docs))) - {d for d, _ in want}
    # the reviewer's case
    assert any(docs[d] == " ".join(items[0].split()[:55]) for d, i in want if not i)


def test_capitals_with_marks_of_their_own(spark):
    letters = [chr(c) for c in range(65, 91)]
    marks = [chr(c) for c in [*range(0x300, 0x370), 0x5B0, 0x591, 0x1DC0, 0x20D0]]
    texts = [f"x{a}{m} {a}{m}b. {a.lower()}{m} {a}\u05b0{m}" for a in letters for m in marks]
    texts += ["J\u030c", "H\u0331 T\u0308", "Ends in J", "\u030c starts", "ÀB ÉCOLE L’ÉTÉ. IJ\u030c, \u0130I\u0307 \u212aK", "MIXED. Case, A\u030a."]
    path = queries.tokenizer_path()
    tok = packing._tokenizer(path)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in packing.token_pieces(frame, path, 4096, with_ids=True).collect()}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert got[len(letters) * len(marks)] == [329, 136, 490, 1]


def test_only_labels_of_the_documents_are_drawn(spark):
    docs = spark.createDataFrame([(i * 100, f"text {i}") for i in range(120)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 300 == 0)) for i in range(12_000)], "doc_id long, toxic int")
    for most in (None, 10_000):
        texts, counts = learn.labelled_texts(docs, marks, "toxic", 5, 0, 20, most)
        assert sorted(r["y"] for r in texts.collect()) == [0] * 20 + [1] * 20
        there = [r["doc_id"] for r in docs.where(learn.fold("doc_id", 5) != 0).collect()]
        assert counts == {1: sum(i % 300 == 0 for i in there), 0: sum(i % 300 > 0 for i in there)}
