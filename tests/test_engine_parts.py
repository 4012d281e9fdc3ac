"""Token counters, providers, the cache in the engine, the stream, the command line, ranking of many rows."""

import os

import pytest
from pyspark.sql import functions as F

from skein import __main__ as cli
from skein.functions import text as T
from skein.functions import tokens
from skein.functions.retry import retry
from skein.operators import cache, chunk, durable, embed, providers, select
from skein.plans import engine
from skein.streaming.refresh import follow

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def fold(rows, cap):
    total, taken = 0, set()
    for rank, t in sorted(rows):
        if total + t <= cap:
            total, taken = total + t, taken | {rank}
    return taken


@pytest.mark.parametrize("cap", [0, 7, 60, 5000])
def test_greedy_is_the_fold(spark, cap):
    rows = [(i, i * 7919 % 23 if i % 11 else 0) for i in range(1, 400)]
    got = select.greedy(spark.createDataFrame(rows, "rank int, tokens int"), cap)
    assert {r["rank"] for r in got.collect()} == fold(rows, cap)


def test_ranked(spark):
    rows = [(f"p{i % 50:02}", i, float(i % 3)) for i in range(500)]
    got = select.ranked(spark.createDataFrame(rows, "path string, start_line int, score double"), ["path", "start_line"]).collect()
    want = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))
    assert [(r["path"], r["start_line"]) for r in sorted(got, key=lambda r: r["rank"])] == [r[:2] for r in want]
    assert sorted(r["rank"] for r in got) == list(range(1, 501))


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_token_counter(spark):
    df = spark.createDataFrame([("hello world, again",), ("",), (None,)], "t string")
    n = [r[0] for r in df.select(tokens.counter(VOCABULARY)("t")).collect()]
    assert n[0] > 2 and n[1:] == [0, 0]
    assert [r[0] for r in df.select(tokens.truncated(VOCABULARY, n[0])("t")).collect()] == ["hello world, again", "", None]
    assert "hello world, again".startswith(df.select(tokens.truncated(VOCABULARY, 1)("t")).first()[0])


def test_bag_and_summary(spark):
    texts = ["getUserName my_var utf8 a1b .execute 9ab_c __x1_y2_ a1_", "", "A-B_C"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(sorted(a) == sorted(b) for a, b in df.select(T.bag_p(F.col("t")), T.tokenize_p(F.col("t"))).collect())
    notes = ["x = 1\n  # what it does\ny", '"""Doc."""\n', "\n\nfirst\nsecond", "a\nb\nc\nd\ne\n# late"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in notes], "t string").select(T.summary_line(F.col("t"))).collect()]
    assert got == ["what it does", "Doc.", "first", "a"]


def test_retry():
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return 7

    assert retry(call, 2, 0) == 7
    with pytest.raises(ZeroDivisionError):
        retry(lambda: 1 / 0, 1, 0)


def test_vectors(spark):
    rows = spark.createDataFrame([("a:1", "a", "file", None, "x"), ("b:1", "b", "function", "f", "boom"), ("c:1", "c", "class", "C", "known")], "chunk_id string, path string, chunk_type string, name string, content string")
    assert [r[0] for r in rows.select(embed.enriched("P")).collect()] == ["File: a\n---\nx", "File: b\nType: function\nName: f\n---\nboom", "File: c\nType: class\nName: C\n---\nknown"]
    assert [r[0] for r in rows.select(embed.enriched("B")).collect()] == ["File: a\nx", "File: b\nfunction: f\nboom", "File: c\nclass: C\nknown"]
    known = rows.where("path = 'c'").select(F.sha2(embed.enriched("P"), 256).alias("text_hash"), F.array(F.lit(5.0)).alias("vector"))
    good = embed.vectors(rows, lambda ts: [[float(len(t))] for t in ts], "P", known, delay=0)
    assert {r["chunk_id"]: r["vector"] for r in good.collect()} == {"a:1": [13.0], "b:1": [39.0], "c:1": [5.0]}
    bad = lambda ts: 1 / 0
    assert {r["vector"] is None for r in embed.vectors(rows, bad, "P", delay=0).collect()} == {True}
    assert {tuple(r["vector"]) for r in embed.vectors(rows, bad, "B", delay=0).collect()} == {(0.0,) * embed.ZEROS}


SCHEMA = "path string, content string, language string, mtime double"


def held(rows):
    return {(r["path"], r["content"]) for r in rows.collect()}


def test_refresh_by_content(spark, tmp_path):
    store = cache.ChunkCache(spark, str(tmp_path / "c"), 4)
    asked = []

    def chunker(files):
        asked.append({r["path"] for r in files.collect()})
        return chunk.chunk_p(files)

    made = lambda rows, now: held(store.refresh(spark.createDataFrame(rows, SCHEMA), chunker, now))
    assert made([("a", "1", None, 5.0), ("b", "2", None, 5.0)], 100) == {("a", "1"), ("b", "2")}
    assert made([("a", "1", None, 9.0), ("b", "3", None, 5.0), ("d", "4", "python", None)], 200) == {("a", "1"), ("b", "3"), ("d", "4")}
    assert asked == [{"a", "b"}, {"b", "d"}]
    # a hit counts as an access, though nothing was chunked
    assert made([("d", "4", "python", None)], 40 * 86_400) == {("d", "4")} and asked[-1] == set()
    assert {r["path"]: (r["last_accessed"], r["n_chunks"], r["size"], r["language"]) for r in store.files().collect()} == {"a": (200.0, 1, 1, None), "b": (200.0, 1, 1, None), "d": (40 * 86_400.0, 1, 1, "python")}
    store.prune(40 * 86_400)
    assert [r["path"] for r in store.files().collect()] == ["d"] and held(store.chunks()) == {("d", "4")}
    store.clear()
    assert store.files().count() == 0 and store.chunks() is None
    store.prune(0)


def test_refresh_by_time(spark, tmp_path):
    store = cache.ChunkCache(spark, str(tmp_path / "c"), 4)
    made = lambda rows: held(store.refresh(spark.createDataFrame(rows, SCHEMA), lambda f: chunk.chunk_b(f).drop("id", "tokens"), 1, "B"))
    assert made([("a", "1", None, 5.0), ("b", "2", None, 5.0)]) == {("a", "1"), ("b", "2")}
    # no newer file, so its content isn't looked at
    assert made([("a", "x", None, 5.0), ("b", "y", None, 6.0)]) == {("a", "1"), ("b", "y")}


def test_stream(spark, tmp_path):
    """The newest of a path's versions wins, within a batch and against what is cached."""
    feed, at = str(tmp_path / "in"), str(tmp_path / "s")

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        follow(spark.readStream.schema(SCHEMA).parquet(feed), chunk.chunk_p, at, str(tmp_path / "k")).awaitTermination(120)
        return held(cache.ChunkCache(spark, at).chunks())

    assert run([("s", "new", None, 2.0), ("s", "old", None, 1.0), ("t", "x", None, None)]) == {("s", "new"), ("t", "x")}
    assert run([("s", "stale", None, 1.5), ("t", "y", None, 1.0)]) == {("s", "new"), ("t", "y")}
    assert run([("s", "newest", None, 3.0)]) == {("s", "newest"), ("t", "y")}


def test_providers(spark):
    rows = spark.createDataFrame([("a", "x" * 3000), ("b", "# note\ncode"), ("c", None)], "chunk_id string, content string")
    judge = lambda q, t: {3000: 1, 2000: 7.0, 11: 1 / 4}[len(t)]
    assert {r[0]: r[1] for r in providers.relevance(rows, "q", judge).collect()} == {"a": 1.0, "b": 0.25, "c": 0.5}
    assert {r[0]: r[1] for r in providers.summaries(rows, lambda ts: [t[:2] for t in ts], size=2).collect()} == {"a": "xx", "b": "# ", "c": ""}
    assert {r[0]: r[1] for r in providers.summaries(rows, lambda ts: 1 / 0).collect()} == {"a": "x" * 200, "b": "note", "c": ""}
    assert providers.expand_query("q", lambda q: " a \n\nb\nc\nd\ne") == ["q", "a", "b", "c", "d"] and providers.expand_query("q", lambda q: 1 / 0) == ["q"]
    assert providers.batches([1, 2, 3], 2) == [[1, 2], [3]]


def test_tables_go(spark):
    a = durable.written(spark.range(3))
    assert a.count() == 3 and durable.folder(spark) in a._skein_table
    durable.drop(a)
    with pytest.raises(Exception):
        spark.read.parquet(a._skein_table)


def test_no_folder_on_a_cluster():
    class Context:
        master = "spark://a:7077"

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError):
        durable.folder(Session)


def test_engine_with_providers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.py").write_text("from .b import g\n\ndef f():\n    return 'token'\n")
    (tmp_path / "t/b.py").write_text("def g():\n    pass\n")
    asked = []
    vector = lambda t: asked.append(t) or [1.0, 0.0]
    e = engine.ContextEngine(spark, "P", "1k", embed=lambda c: embed.vectors(c, lambda ts: [[1.0, 0.0]] * len(ts), "P"), embed_query=vector, imagine=lambda q: "made up", cache_dir=str(tmp_path / "cache"))
    first = e.build(str(tmp_path / "t"), "token")
    assert e.stats["files_scanned"] == 2 and e.stats["files_included"] == 2 and e.stats["budget"] == 1000
    assert "## a.py:L1-5" in first and "## b.py" in first and asked == ["token\n---\nmade up"]
    assert e.build(str(tmp_path / "t"), "token") == first
    assert engine.fetch_context(spark, str(tmp_path / "t"), "token", include=["*.zig"]) == engine.NO_FILES
    assert engine.ask(spark, str(tmp_path / "t"), "token", lambda c, q: q + str("## a.py" in c)) == "tokenTrue"
    cli.main([str(tmp_path / "t"), "token", "-p", "P", "-f", "xml", "-o", str(tmp_path / "out")])
    assert '<file path="a.py"' in (tmp_path / "out").read_text()


def test_reranking_reads_the_best_only(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"f{i:02}.py").write_text("token\n" * (i + 1))
    seen = []

    def judge(chunks, query):
        seen.append(chunks.count())
        return providers.relevance(chunks, query, lambda q, t: float(len(t) > 100))

    e = engine.ContextEngine(spark, "P", "100k", judge=judge)
    got = e.score(e.scan(str(tmp_path)), "token").select("chunk_id", "reranked", "score").collect()
    assert seen == [50] and sum(r["reranked"] for r in got) == 50 and len(got) == 60


def test_fold_by_numbers():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        n, cap = int(rng.integers(0, 40)), float(rng.integers(0, 200))
        rank, tokens, full = np.arange(n), rng.integers(1, 60, n).astype(float), float(rng.integers(1, 300))
        total, want = 3.0, []
        for r, t in zip(rank, tokens, strict=True):
            if total + t <= cap and total < full:
                total, want = total + t, [*want, int(r)]
        at, got, sofar = int(rng.integers(0, n + 1)), [], 3.0
        for a, b in ((0, at), (at, n)):  # in two batches
            part, sofar = select.fold(rank[a:b], tokens[a:b], sofar, cap, full)
            got += part.tolist()
        assert got == want and sofar == total
