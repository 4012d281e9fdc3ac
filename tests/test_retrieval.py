"""Hand-derived cases: tokens, importance, scores, selection, the source and the engine."""

import fnmatch
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from skein.functions import patterns
from skein.functions import text as T
from skein.operators import graph, rank, select
from skein.plans.engine import ContextEngine
from skein.sources import github

LINE = "getUserName my_var utf8 a1b .execute"


def one(spark, col):
    return spark.range(1).select(col).first()[0]


def test_tokens(spark):
    assert one(spark, T.tokenize_p(F.lit(LINE))) == "getusername my_var my var utf8 a1b a b execute".split()
    assert one(spark, T.tokenize_b(F.lit(LINE))) == "get user name my var utf8 a1b execute".split()
    assert one(spark, T.tokenize_b(F.lit(LINE), stems=True)) == "get user nam my var utf8 a1b execut".split()
    q = "explain the flow in which the .execute method is called"
    assert T.query_tokens_b(q) == ["flow", "execut", "method"] and T.important_terms(q) == {"execute"}


@pytest.mark.parametrize("word,want", [("execution", "execut"), ("implementation", "implementat"), ("dies", "die"), ("execute", "execut"), ("worker", "work"), ("tools", "tool"), ("user", "user")])
def test_stem(spark, word, want):
    assert one(spark, T.stem(F.lit(word))) == T.stem_word(word) == want


@pytest.mark.parametrize("path,p,b", [("main.py", 0.95, 0.8), ("src/index.ts", 1.0, 0.9), ("tests/test_a.py", 0.3, 0.3), ("a/b/c/d/e/f.py", 0.4, 0.4), ("config.yaml", 0.4, 0.45), ("pkg/__init__.py", 0.6, 0.8), ("package.json", 0.8, 0.75), ("src/utils/x.py", 0.4, 0.6)])
def test_importance(spark, path, p, b):
    got = spark.range(1).select(T.importance_p(F.lit(path)), T.importance_b(F.lit(path))).first()
    assert [round(x, 6) for x in got] == [p, b]


def test_bm25(spark):
    docs = spark.createDataFrame([("d1", "alpha beta alpha"), ("d2", "beta"), ("d3", "gamma gamma")], "path string, content string")
    got = {r[0]: round(r[1], 6) for r in rank.bm25(docs, "alpha beta").select("path", "bm25").collect()}
    assert got == {"d1": 1.590851, "d2": 0.606456, "d3": 0.0}


def test_selection(spark):
    df = spark.createDataFrame([(1, "a", 40), (2, "b", 50), (3, "c", 20), (4, "d", 30)], "rank int, path string, tokens int")
    assert sorted(r[0] for r in select.greedy(df.where("rank < 4"), 70).collect()) == [1, 3]
    edges = spark.createDataFrame([("a", "d")], "src string, dst string")
    assert {r["path"]: r["pass"] for r in select.pack_two_pass(df, 100, edges).collect()} == {"a": 1, "c": 1, "d": 2}
    assert sorted(r["path"] for r in select.pack_single(df, 300).collect()) == ["a", "b", "c"]


def test_related_and_normalize(spark):
    e = spark.createDataFrame([("core", "util"), ("core", "deep")], "src string, dst string")
    near = lambda d: {r[0] for r in graph.related(e, spark.createDataFrame([("util",)], "path string"), d).collect()}
    assert near(1) == {"util", "core"} and near(2) == {"util", "core", "deep"}
    assert one(spark, graph.normalize(F.lit("web/../pkg/./x.ts"))) == "pkg/x.ts"


def test_budget_and_github():
    assert [T.parse_budget(x) for x in ("50k", "1.5m", 700)] == [50_000, 1_500_000, 700]
    with pytest.raises(ValueError):
        T.parse_budget("many")
    assert github.parse("https://github.com/a/b.git") == ("a", "b", None, None)
    assert github.parse("git@github.com:a/b") == ("a", "b", None, None)
    assert github.parse("github.com/a/b/tree/main/x/y/") == ("a", "b", "main", "x/y")
    assert github.parse("https://www.github.com/a/b/blob/main/x.py?raw=1") == github.parse("a/b") == ("a", "b", None, None)
    for bad in ("github.com/a", "https://github.com", "a", "a/b/c", "https://gitlab.com/a/b", "git@github.com:a"):
        with pytest.raises(ValueError):
            github.parse(bad)


def test_clone(tmp_path):
    def git(*args):
        subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True, cwd=tmp_path)

    git("init", "-q", "-b", "main", "o/r.git")
    (tmp_path / "o/r.git/f").write_text("1")
    git("-C", "o/r.git", "add", ".")
    git("-C", "o/r.git", "commit", "-qm", "1")
    for profile in ("P", "B"):
        get = lambda age: github.clone(github.Repo("o", "r"), str(tmp_path / profile), age, profile, f"file://{tmp_path}")  # noqa: E731, B023
        at = get(3600)
        was = open(f"{at}/f").read()
        (tmp_path / "o/r.git/f").write_text(was + "+")
        git("-C", "o/r.git", "commit", "-qam", "2")
        assert open(f"{get(3600)}/f").read() == was and open(f"{get(-1)}/f").read() == was + "+"
        if profile == "B":  # what can't be brought up to date is cloned again
            (tmp_path / "B/o/r/.git/HEAD").write_text("broken")
            assert open(f"{get(-1)}/f").read() == was + "+"


@pytest.mark.parametrize("pattern,fit,miss", [("[ab].py", ["a.py", "x/b.py"], ["c.py", "[ab].py"]), ("[!a]*", ["b", "b/a"], ["a"]), ("x[]]y", ["x]y"], ["xy"]), ("[", ["["], ["a"]), ("a[z-b]", [], ["az", "a"]), ("[a-c]?", ["bq"], ["dq", "b"]), ("*.t[x^]", ["a/b.tx", "c.t^"], ["a.ty"]), ("a&&b[&&]", ["a&&b&"], ["a&&b"])])
def test_glob_p(spark, pattern, fit, miss):
    want = {p: fnmatch.fnmatch(p, pattern) or fnmatch.fnmatch(p.rsplit("/", 1)[-1], pattern) for p in fit + miss}
    assert want == {**dict.fromkeys(fit, True), **dict.fromkeys(miss, False)}
    got = spark.createDataFrame([(p,) for p in want], "p string").select("p", T.matches_p(F.col("p"), [pattern]))
    assert {r[0]: r[1] for r in got.collect()} == want and {p: any(patterns.fits(patterns.glob_p(pattern), x) for x in (p, p.rsplit("/", 1)[-1])) for p in want} == want


@pytest.mark.parametrize("pattern,fit,miss", [("src/[a-c]*.ts", ["src/b.ts", "src/cab.ts"], ["src/d.ts", "src/a/b.ts"]), ("**/x.{py,js}", ["x.py", "a/b/x.js"], ["a/x.ts"]), ("a\\*b", ["a*b"], ["axb"]), ("[!/]b", ["ab"], ["/b"]), ("a/**", ["a/b", "a/b/c"], ["b/a"]), ("{a,b", ["a", "b"], ["c"])])
def test_glob_b(spark, pattern, fit, miss):
    got = spark.createDataFrame([(p,) for p in fit + miss], "p string").select("p", T.matches_b(F.col("p"), [pattern]))
    want = {**dict.fromkeys(fit, True), **dict.fromkeys(miss, False)}
    assert {r[0]: r[1] for r in got.collect()} == want and {p: patterns.fits(patterns.glob_b(pattern), p) for p in want} == want


RULES = ["*.py[cod]", "\\#hash", "logs/", "/top.txt", "doc/*.html", "{a,b}.txt", "**/deep/x", "all/**", "mid/**/end", "*.log", "!keep.log", "# comment", "  ", "space\\ ", "trail   ", "!logs/in.txt", "q?z", "[!x]only"]
PATHS = "a.pyc a.py b/c.pyo #hash logs x/logs/f logs/in.txt top.txt a/top.txt doc/i.html x/doc/i.html doc/s/i.html {a,b}.txt a.txt deep/x a/b/deep/x all/1 all/2/3 mid/end mid/1/2/end x.log keep.log s/keep.log space trail qaz q/z xonly yonly logs2/f".split()


def test_ignore_files_like_git(tmp_path):
    """The ignored files are those that git ignores."""
    (tmp_path / ".gitignore").write_text("\n".join(RULES))
    files = [p for p in [*PATHS, "space "] if not any(q.startswith(p + "/") for q in PATHS)]
    for p in files:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    subprocess.run(["git", "init", "-q"], check=True, cwd=tmp_path)
    out = subprocess.run(["git", "status", "--porcelain", "-uall", "-z"], check=True, cwd=tmp_path, capture_output=True, text=True).stdout
    kept = {x[3:] for x in out.split("\0") if x} - {".gitignore"}
    ignored = patterns.Ignore(RULES)
    assert {p for p in files if not ignored(p)} == kept and 5 < len(kept) < len(files) - 5


@pytest.fixture
def tree(tmp_path):
    files = {"main.py": b"from .util import f\nprint('alpha token')\n", "__init__.py": b"", "_priv.py": b"x = 1", "__tests__/a.test.ts": b"token", ".hid/h.py": b"y", "bad.py": b"\xff\xfeabc", "node_modules/m.js": b"no", "util.py": b"def f():\n    return 'token'\n", "logs/x.log": b"log", "a.map": b"{}"}
    for name, data in files.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "logs/.gitignore").write_text("*.log\n")
    return str(tmp_path)


def test_source(spark, tree):
    p = {r["path"]: r for r in ContextEngine(spark, "P").scan(tree).collect()}
    assert {"main.py", "__init__.py", "_priv.py", "__tests__/a.test.ts", ".hid/h.py", "bad.py", "util.py", "logs/x.log", "a.map"} == set(p)
    assert p["bad.py"]["content"] == "��abc" and p["main.py"]["language"] == "python"
    b = {r["path"] for r in ContextEngine(spark, "B").scan(tree).collect()}
    assert b == {"main.py", "__init__.py", "_priv.py", "__tests__/a.test.ts", "bad.py", "util.py"}
    assert {r["path"] for r in ContextEngine(spark, "P").scan(tree, include=["*.ts"]).collect()} == {"__tests__/a.test.ts"}


@pytest.mark.parametrize("profile", ["P", "B"])
def test_engine(spark, tree, profile):
    text = ContextEngine(spark, profile, "1k").build(tree, "token")
    assert "## " in text and "token" in text
    if profile == "P":
        assert '<file path="util.py"' in ContextEngine(spark, "P", "1k").build(tree, "token", fmt="xml")


def test_source_lists_below_on_executors(spark, tmp_path):
    """Folders deeper than the driver lists, ignore files in them, folders that are not entered."""
    for name in ("a/b/c/d/e.py", "a/b/c/d/no.tmp", "a/b/c/.gitignore", "a/node_modules/x/y.js", "a/b/keep/z.py", "a/b/c/d/f/.gitignore", "a/b/c/d/f/g.py", "a/b/c/d/f/h.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("*.tmp\n/d/f/h.py\n!d/f/g.py" if name.endswith("c/.gitignore") else "g.py" if "gitignore" in name else "x")
    paths = lambda **o: {r["path"] for r in ContextEngine(spark, "B").spark.read.format("codebase").options(path=str(tmp_path), profile="B", **o).load().collect()}
    ContextEngine(spark, "B").scan(str(tmp_path))
    want = {"a/b/c/d/e.py", "a/b/keep/z.py"}
    assert paths() == paths(depth="0") == paths(depth="9") == want


def test_python_modules_in_profile_b(spark):
    files = spark.createDataFrame([("p/a.py", "from .b import x\nimport p.c\nfrom ..q.d import y\nfrom . import b\nimport os", "python"), ("p/b.py", "", "python"), ("p/c/__init__.py", "", "python"), ("q/d.py", "", "python"), ("p/__init__.py", "", "python")], "path string, content string, language string")
    found = graph.extract_imports_b(files)
    assert {r["dst"] for r in graph.resolve_b(found, files, strict=False).collect()} == {"p/b.py", "p/c/__init__.py", "q/d.py", "p/__init__.py"}
    # as paths only the folder itself is one
    assert [tuple(r) for r in graph.resolve_b(found, files).collect()] == [("p/a.py", "p/__init__.py")]
    # profile P counts the dots too unless strict
    up = graph.extract_imports_p(files)
    assert "q/d.py" in {r["dst"] for r in graph.resolve_p(up, files, strict=False).collect()} and "q/d.py" not in {r["dst"] for r in graph.resolve_p(up, files).collect()}
