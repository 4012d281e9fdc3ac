"""Sharding, URL filters and chat formatting against brute force and SQL."""

import math
import random
import time

import duckdb
import pytest

from skein.llm import chat, queries, sharding, urls

SCHEMA = "doc_id long, text string, lang string, key string"


def brute_capacity(sizes, shards):
    low, high = max([*sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        used, room = 1, mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("n,hot", [(0, 0), (1, 0), (7, 0), (400, 0), (300, 150)])
def test_minimax(spark, n, hot):
    rows = [(i, "same text here" if i < hot else ("x" * (i * 37 % 211) + str(i % 120) if i % 19 else None), "en", "k") for i in range(n)] + [(5, "twice", "en", "k")] * (2 if n else 0)
    got = sharding.minimax_shards(spark.createDataFrame(rows, SCHEMA), 16).collect()
    assert len(got) == len(rows)
    by_key, of_shard, slots = {}, {}, {}
    for r in got:
        of_shard.setdefault(r["key"], set()).add(r["shard"])
        by_key[r["key"]] = by_key.get(r["key"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in of_shard.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    if rows:
        sizes = [by_key[k] for k in sorted(by_key)]
        load = {}
        for r in got:
            load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        assert max(load.values()) == brute_capacity(sizes, 16) and set(load) <= set(range(16))


def test_url_rules(spark):
    rows = [(i, u) for i, u in enumerate(["https://A.Example.COM/en/1?x#y", "http://www.example.com/en/2", "http://x.net/es/", "http://x.net", None, "no scheme", "http://net/fr/a", "http://xnet/fr/a", "http://b.com/q"])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    none = spark.createDataFrame([], "url string, block boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, none, queries.URL_RULES).collect()}
    assert got == {0: ("a.example.com", "/en/1", "example.com/en/", "block"), 1: ("www.example.com", "/en/2", "www.example.com/en/", "allow"), 2: ("x.net", "/es/", "net/es/", "block"), 3: ("x.net", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("net", "/fr/a", "net/fr/", "block"), 7: ("xnet", "/fr/a", None, "allow"), 8: ("b.com", "/q", "com/", "allow")}


def tokens_of(url):
    """The tokens of a URL, by plain Python."""
    if not url or "://" not in url:
        return set()
    scheme, rest = url.split("://", 1)
    rest, _, query = rest.partition("#")[0].partition("?")
    host, *path = rest.split("/")
    labels = {f"label{i}={x}" for i, x in enumerate(reversed(host.lower().split(".")))}
    return {f"scheme={scheme.lower()}", *labels, *(f"path={x}" for x in path if x), *("query=" + x.split("=")[0] for x in query.split("&") if x)}


def brute_confidence(seen, pages, support, confidence):
    """Confidence of the best rule that matches each page, from all combinations of tokens."""
    rows = [(tokens_of(u), b) for u, b in seen if b is not None]
    least, out, known = max(1, math.ceil(support * len(rows))), {}, {}
    for url in pages:
        mine, best = sorted(tokens_of(url)), None
        for m in range(1, 1 << len(mine)):
            s = frozenset(x for i, x in enumerate(mine) if m >> i & 1)
            if s not in known:
                held = [b for t, b in rows if s <= t]
                known[s] = sum(held) / len(held) if sum(held) >= least else 0
            if known[s] >= confidence:
                best = max(best or 0, known[s])
        out[url] = best
    return out


def test_mined_rules(spark):
    rng = random.Random(4)
    make = lambda: f"http{rng.choice(['', 's'])}://{rng.choice(['www.', ''])}{rng.choice(['casino', 'ok', 'news'])}.{rng.choice(['a', 'b'])}.org/{rng.choice(['ads', 'en', 'x/y'])}/{rng.randrange(9)}{rng.choice(['', '?ref=1', '?ref=2&p=3#z'])}"
    seen = []
    for _ in range(300):
        u = make()
        bad = ("casino" in u and "/ads/" in u) or ("b.org" in u and "p=3" in u)
        seen.append((u, bad if rng.random() < 0.9 else not bad if rng.random() < 0.7 else None))
    pages = sorted({make() for _ in range(120)}) + ["http://other.net/ads/1", "no scheme", ""]
    frame = spark.createDataFrame(seen, "url string, block boolean")
    mined = urls.mine_rules(frame, 0.02, 0.75)
    rules = [(frozenset(r["items"]), r["confidence"]) for r in mined.rules.collect()]
    assert len(rules) >= 2 and not any(s < t and c >= d for s, c in rules for t, d in rules)
    got = {r["url"]: r["confidence"] for r in urls.match_rules(spark.createDataFrame([(p,) for p in [*pages, *pages, None]], "url string"), mined).collect()}
    want = {u: c for u, c in brute_confidence(seen, pages, 0.02, 0.75).items() if c}
    assert got == want and 0 < len(want) < len(pages)
    # the rules decide the verdict where no fixed rule does, whatever the table's other columns are called
    judged = spark.createDataFrame([(i, p, "x", 1.0) for i, p in enumerate(pages)] + [(None, pages[0], "x", 1.0)] * 2, "page_id long, url string, key string, confidence double")
    out = urls.judge_urls(judged, frame, [], 0.02, 0.75).collect()
    assert len(out) == len(pages) + 2 and all((r["verdict"] == "block") == (pages[r["page_id"] or 0] in want) for r in out)
    assert urls.judge_urls(judged.limit(0), frame, []).count() == 0


def test_tokens_that_stand_together_are_one(spark):
    """Twenty shared path segments, and as many that each second URL lacks."""
    rows = [("http://a.bad.org/" + "/".join(f"s{k}" for k in range(20)) + ("/" + "/".join(f"t{k}" for k in range(20)) if i % 2 else "") + f"/{i}", i % 2 == 1) for i in range(100)]
    began = time.time()
    mined = urls.mine_rules(spark.createDataFrame(rows, "url string, block boolean"), 0.05, 0.9)
    assert [r["confidence"] for r in mined.rules.collect()] == [1.0] and time.time() - began < 60
    hit = urls.match_rules(spark.createDataFrame([("http://x.org/t7",), ("http://x.org/s7",)], "url string"), mined)
    assert [r["url"] for r in hit.collect()] == ["http://x.org/t7"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_sql(spark, name):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want, got = c.sql(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, d).toPandas()
    plain = lambda df: sorted(repr([None if x is None or x != x else float(x) if isinstance(x, int | float) else x for x in r]) for r in df[sorted(want.columns)].astype(object).itertuples(index=False, name=None))
    assert plain(got) == plain(want) and len(want)


def test_trees(spark):
    rows = [("t", 1, None, "user", "a<|im_end|>\\<\\|", 0.0), ("t", 2, 1, "assistant", "b", 1.0), ("t", 3, 1, "assistant", "c\n<|im_start|>user\n", 5.0), ("t", 4, 3, "user", None, 0.0), ("u", 1, 9, None, "", None), ("v", 1, 2, "user", "x", 0.0), ("v", 2, 1, "user", "y", 0.0)]
    m = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"]): r for r in chat.format_trees(m, None).select("tree", "leaf", chat.parse_turns(chat.F.col("formatted")).alias("turns"), chat.masked_text(chat.F.col("formatted"), chat.F.col("loss")).alias("learnt")).collect()}
    assert set(got) == {("t", 2), ("t", 4), ("u", 1)}
    assert [tuple(x) for x in got["t", 4]["turns"]] == [("user", "a<|im_end|>\\<\\|"), ("assistant", "c\n<|im_start|>user\n"), ("user", "")]
    assert got["t", 4]["learnt"] == "c\n<|im_start|>user\n" and [tuple(x) for x in got["u", 1]["turns"]] == [("", "")]
    assert [r["leaf"] for r in chat.format_trees(m, 1).where("tree = 't'").collect()] == [4]
    assert chat.format_trees(m.limit(0), 1).count() == 0


def test_branches_and_chains(spark):
    """Ties between branches, repeated turns, null ids, columns of other names, a conversation that several tasks number."""
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "b", 1.0), ("t", 3, 1, "assistant", "c", 1.0), (None, 1, None, "user", "n", 0.0)]
    m = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    assert sorted(((r["tree"] or "", r["leaf"], r["branch"]) for r in chat.format_trees(m, 2).collect())) == [("", 1, 1), ("t", 2, 1), ("t", 3, 2)]
    assert [r["leaf"] for r in chat.format_trees(m, 1).where("tree = 't'").collect()] == [2]
    talk = [("big", i // 2, "user", f"{i // 2:04}") for i in range(600)] + [("big", None, None, None), (None, 1, "user", "x"), ("one", 1, "user", "y")]
    c = chat.chains(spark.createDataFrame(talk, "tree_id string, n long, role string, text string"), "tree_id", "n").collect()
    big = sorted((r["id"], r["text"], r["parent"]) for r in c if r["tree"] == "big")
    assert [x[1] for x in big] == [None, *sorted(t[3] for t in talk[:600])] and [x[0] for x in big] == list(range(1, 602)) and [x[2] for x in big] == [None, *range(1, 601)]
    assert sorted((r["tree"] or "", r["id"]) for r in c if r["tree"] != "big") == [("", 1), ("one", 1)]


def test_shards_of_odd_rows(spark):
    rows = [(None, "a", "s", 1), (None, "a", "s", 1), (3, None, "s", 2), (3, "", "s", 3)] + [(4, "same", "s", 4)] * 40
    got = sharding.minimax_shards(spark.createDataFrame(rows, "doc_id long, text string, shard string, _row int"), 3).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 44 and all(sorted(s) == list(range(len(s))) for s in slots.values())
