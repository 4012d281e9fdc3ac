"""Every stage of the pipeline on the smallest tables with odd rows among them, each held against brute force on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from skein.llm import quality, toxicity
from skein.llm.tables import cut, table
from tests.llm.test_texts import brute_components, sets_of

D = "/root/testdata/sf0.001"


def windows(text, item):
    w, k = text.lower().split(), item.lower().split()
    grams = lambda x: Counter(tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4)))
    want = grams(k)
    for i in range(max(1, len(w) - len(k) + 1)):
        have = grams(w[i : i + len(k)])
        both = (have & want).total()
        if both and both >= 0.8 * (have.total() + want.total() - both):
            return True
    return False


def odd_rows(docs):
    """Rows that share an id with another text, have none, repeat, are empty; benchmark passages among them."""
    d = {r["doc_id"]: r for r in docs.collect()}
    items = [r["text"] for r in table(docs.sparkSession, D, "benchmark").collect()]
    texts = [(None, d[3]["text"]), (None, d[3]["text"]), (5, d[20]["text"] + " and some more words at the end"), (5, " ".join(reversed(d[21]["text"].split()))), (8, d[8]["text"]), (8, d[8]["text"]), (None, " ".join(reversed(d[22]["text"].split()))), (9, None), (10, ""), (None, None), (11, f"{d[11]['text']} {items[0]}"), (None, items[1]), (12, " ".join(items[2].split()[:-2]))]
    return [(i, t, "en", "odd", len(t or "")) for i, t in texts]


def multiset(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


@pytest.fixture(scope="module")
def stages(spark):
    docs, seen = table(spark, D, "documents"), []
    docs = cut(docs.unionByName(spark.createDataFrame(odd_rows(docs), docs.schema)))
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.collect(), docs.columns
        # odd rows go into every stage, so that each is tried on them
        docs = cut(stage(spark, docs, D))
        seen.append((name, before, columns, docs))
    return seen


def test_all_but_the_last_keep_the_columns(stages):
    assert [n for n, *_ in stages] == ["quality", "toxicity", "near duplicates", "decontamination", "packing"]
    assert all(docs.columns == columns for _, _, columns, docs in stages[:-1])


@pytest.mark.parametrize("at", [0, 1])
def test_classifiers_decide_by_row(spark, stages, at):
    _, before, _, after = stages[at]
    docs = spark.createDataFrame(before, after.schema)
    labels = table(spark, D, "labels")
    module, good = (quality, 1) if at == 0 else (toxicity, 0)
    scored = module.score(docs.withColumn("own", docs["text"]), module.fit(docs, labels)).where(f"predicted = {good}").collect()
    assert multiset(after.collect()) == Counter((r["doc_id"], r["own"]) for r in scored)


def test_one_row_of_each_group(spark, stages):
    _, before, _, after = stages[2]
    for rows, kept in ((before, after.collect()), *[(r, corpus_pipeline.drop_copies(spark, spark.createDataFrame(r, after.schema), D).collect()) for r in [before[:40] + [x for x in stages[0][1] if x["source"] == "odd"]]]):
        sets = sets_of([r["text"] for r in rows], 5)
        roots = brute_components(sets, 80, 100)
        groups = {}
        for r, s, root in zip(rows, sets, roots, strict=True):
            groups.setdefault(root if s else ("alone", len(groups)), []).append(r)
        left = multiset(kept)
        assert sum(left.values()) == len(groups)
        for g in groups.values():
            least = min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
            mine = {(r["doc_id"], r["text"]) for r in g if r["doc_id"] == least["doc_id"]}
            assert sum(left[m] > 0 for m in mine) >= 1
            others = {(r["doc_id"], r["text"]) for r in g} - mine
            assert not any(left[o] for o in others)


def test_leaked_rows_go(spark, stages):
    items = [r["text"] for r in table(spark, D, "benchmark").collect()]
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
    heads = {x for t in items for w in [words(t)] for x in zip(*(w[i:] for i in range(5)), strict=False)}
    leaked = lambda t: any(x in heads for w in [words(t)] for x in zip(*(w[i:] for i in range(5)), strict=False)) and any(windows(t, i) for i in items)
    schema = stages[3][3].schema
    for rows, kept in ((stages[3][1], stages[3][3].collect()), *[(r, corpus_pipeline.drop_leaks(spark, spark.createDataFrame(r, schema), D).collect()) for r in [[x for x in stages[0][1] if x["source"] == "odd"]]]):
        assert multiset(kept) == multiset([r for r in rows if not leaked(r["text"])])
        assert len(kept) < len(rows)


def test_packing(stages):
    _, before, _, packed = stages[4]
    out, load = packed.collect(), Counter()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in before} and sum(r["piece"] == 0 for r in out) == len(before)
    for r in out:
        load[r["sequence_id"]] += r["length"]
    assert max(load.values()) <= 4096 and len(load) <= -(-sum(load.values()) // 4096) + 1


def test_empty_table(spark):
    docs = table(spark, D, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, D))
        assert docs.count() == 0
