"""Scans of trees with many folders: equal rows however the levels are dealt, and tasks that hold many folders."""

import hashlib
import os
from pathlib import Path

import pytest

from skein.plans.engine import ContextEngine
from skein.sources import codebase

FOLDERS = ["src", "src/core", "docs/guide/deep", "a/b/c/d/e", "models", "tools"]


@pytest.fixture
def tree(tmp_path) -> Path:
    for i in range(600):
        at = tmp_path / FOLDERS[i % 6] / str(i)
        at.mkdir(parents=True)
        (at / f"{['main', 'index', 'x'][i % 3]}.{['py', 'ts', 'md', 'png'][i % 4]}").write_text(f"line {i}\r\nmore")
    (tmp_path / ".gitignore").write_text("/tools/\n*.md\n!x.md\n")
    (tmp_path / "models/.gitignore").write_text("index.*\n!index.ts\n")
    (tmp_path / "models/4/.gitignore").write_text("")
    os.symlink("loop", tmp_path / "src/loop")
    (tmp_path / "top.py").write_text("x")
    return tmp_path


def _brute(tree: Path, profile: str) -> set:
    out = set()
    for f in tree.rglob("*"):
        rel = str(f.relative_to(tree))
        if f.is_symlink() or not f.is_file() or f.suffix == ".png" or f.name == ".gitignore":
            continue
        if profile == "B":
            if f.name.startswith(".") or rel.startswith("tools/") or (f.suffix == ".md" and f.name != "x.md"):
                continue
            if rel.startswith("models/") and f.name.startswith("index.") and f.name != "index.ts":
                continue
        text = f.read_bytes().decode()
        out.add((rel, hashlib.md5((text.replace("\r\n", "\n") if profile == "P" else text).encode()).hexdigest(), f.stat().st_size))
    return out


@pytest.mark.parametrize("profile", ["P", "B"])
@pytest.mark.parametrize("few", [0, 20, 1 << 20])
def test_levels(spark, tree, monkeypatch, profile, few):
    """Listed by the driver, by executors and by both: as a plain walk finds them."""
    monkeypatch.setattr(codebase, "FEW", few)
    got = [(r["path"], hashlib.md5(r["content"].encode()).hexdigest(), r["size"]) for r in ContextEngine(spark, profile).scan(str(tree)).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(tree, profile)


def test_tasks_hold_many_folders(spark, tree):
    assert len(codebase.CodebaseReader({"path": str(tree), "profile": "P"}).partitions()) <= 12
    spark.dataSource.register(codebase.Codebase)
    rows = spark.read.format("codebase").options(path=str(tree), profile="P").load()
    assert {(r["path"], r["size"]) for r in rows.collect()} == {(p, n) for p, _, n in _brute(tree, "P")}


def test_batches_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(codebase, "BATCH_CHARS", 1000)
    for i in range(30):
        (tmp_path / f"{i}.py").write_text("x" * 300)
    reader = codebase.CodebaseReader({"path": str(tmp_path), "profile": "P"})
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [4] * 7 + [2]


def test_empty_or_missing_folder(spark, tmp_path):
    assert ContextEngine(spark, "B").scan(str(tmp_path)).count() == 0
    assert ContextEngine(spark, "P").scan(str(tmp_path / "none")).count() == 0
