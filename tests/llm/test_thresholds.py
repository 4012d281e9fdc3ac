"""Toxicity thresholds come from every labelled row that the network didn't learn from."""

import numpy as np
import pyarrow as pa

from skein.llm import learn, toxicity
from tests.llm.test_whole_job import marked


def test_all_labelled_rows_count(spark, monkeypatch):
    docs, marks = marked(spark, np.random.default_rng(4), [20 + i % 30 for i in range(900)])
    docs = docs.union(docs.where("doc_id < 50"))  # rows that share an id count once
    texts, rest, counts = learn.labelled_split(docs, marks, "toxic", 5, 0, 40, toxicity.MOST_BYTES)
    assert texts.count() == 80 and rest.select("doc_id").distinct().count() == sum(counts.values()) - 80
    seen, cuts = [], toxicity._cuts

    def spy(logit, y, weight, lang, langs, n=None):
        seen.append((logit, y, weight, np.ones(len(y), int) if n is None else n))
        return cuts(logit, y, weight, lang, langs, *([] if n is None else [n]))

    monkeypatch.setattr(toxicity, "_cuts", spy)
    model = toxicity.fit(docs, marks, per_class=40)
    ((logit, y, weight, n),) = seen
    assert n.sum() == sum(counts.values()) - 60  # 60 of the 80 drawn are learned from
    for c in (0, 1):
        assert counts[c] - 40 < n[y == c].sum() < counts[c]
    # no other threshold errs less on them
    err = lambda cut: weight[(logit >= cut) != (y == 1)].sum()
    assert err(model.cuts[0]) <= min(map(err, np.linspace(-20, 20, 4001))) + 1e-6
    # counted as scoring them one by one does
    want = {}
    for r in {r["doc_id"]: r for r in rest.collect()}.values():
        step = int(toxicity._step(toxicity._text_logits(model, pa.array([r["text"]])))[0])
        want[r["y"], step] = want.get((r["y"], step), 0) + 1
    got = {(int(c), int(s)): int(k) for _, c, s, k in toxicity._counted(rest, model)}
    assert sum(got.values()) == sum(want.values())
    assert sum(abs(got.get(k, 0) - want.get(k, 0)) for k in {*got, *want}) <= 4  # sums of another order may fall beside a step


def test_equal_logits_are_not_parted():
    logit, y = np.array([0.0, 1.0, 1.0, 2.0]), np.array([0, 0, 1, 1])
    n = np.array([9, 3, 8, 9])
    assert toxicity._cuts(logit, y, n.astype(float), np.zeros(4, int), 1, n)[0] == 0.5
    assert toxicity._cuts(logit, y, np.array([9.0, 8.0, 3.0, 9.0]), np.zeros(4, int), 1, n)[0] == 1.5
