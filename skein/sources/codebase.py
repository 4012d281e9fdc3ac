"""A Python data source for source trees: `spark.read.format("codebase")`. Spark's own file readers leave out names that begin with _ or .

Options: path, profile (P or B), include and exclude (comma-separated globs), forceLarge, dot, depth. Folders down to `depth` levels
are listed on the driver, what lies deeper and the files themselves on the executors, so the tree must be on a file system that
all of them see. Ignored folders are not entered.

A data source plans its partitions once, so a task keeps whatever lies below its folders. scan() returns the same rows for trees of any
shape: a level of folders is a job, and what it finds is dealt anew.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.functions import fixed
from skein.functions.patterns import Ignore, glob_b, glob_p
from skein.operators.durable import written

SCHEMA = "path string, content string, language string, size bigint, mtime_ms double"
PART_FILES, PART_ENTRIES = 1024, 8192  # files to read (or, for the data source, folders to go through), entries of a level in a partition
BATCH_ROWS, BATCH_CHARS = 1024, 8 << 20  # of a batch of files
FEW = 2048  # files and folders of a level that the driver goes through itself
LEVEL = "path binary, kind string, above array<binary>"  # names need not be UTF-8; kind: file or folder (not yet filtered), read (a file to read)


def suffix(name: str) -> str:
    """What follows the last dot, in small letters; nothing for a name that only begins with one."""
    return name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""


def split_globs(text: str) -> list[str]:
    """What stands between commas, but for those in braces."""
    return [x for x in re.split(r",(?![^{}]*\})", text) if x]


class Filter:
    """Which files and folders of a tree are read. Ignore files found on the way down come as (folder, rules)."""

    def __init__(self, profile: str, include: list[str], exclude: list[str], dot: bool):
        self.profile, self.include, self.exclude, self.dot = profile, include, exclude, dot
        regexes = lambda ps: [re.compile(f"(?s:{(glob_p if profile == 'P' else glob_b)(p)})") for p in ps]
        self.included, self.excluded = regexes(include), regexes(exclude if profile == "P" else [])
        self.root = Ignore([*fixed.EXCLUDES_B, *exclude]) if profile == "B" else None

    def with_root(self, lines: list[str]) -> None:
        """The root's own ignore file comes after the patterns given, and may take them back."""
        self.root = Ignore([*fixed.EXCLUDES_B, *self.exclude, *lines])

    def enters(self, rel: str, nested: list[tuple[str, Ignore]]) -> bool:
        name = rel.rsplit("/", 1)[-1]
        if name[0] == "." and not self.dot:
            return False
        if self.profile == "P":
            return name not in fixed.IGNORE_DIRS
        return not self.root.folder(rel) and not any(rules.folder(rel.removeprefix(at)) for at, rules in nested)

    def reads(self, rel: str, nested: list[tuple[str, Ignore]]) -> bool:
        name = rel.rsplit("/", 1)[-1]
        if name[0] == "." and not self.dot:
            return False
        if self.profile == "P":
            hit = lambda rs: any(r.fullmatch(x) for r in rs for x in (rel, name))
            ignored = name in fixed.IGNORE_DIRS or name in fixed.IGNORE_FILES or suffix(name) in fixed.BINARY_P
            return not ignored and (not self.included or hit(self.included)) and not hit(self.excluded)
        if self.root(rel) or any(rules(rel.removeprefix(at)) for at, rules in nested):
            return False
        return rel.rsplit(".", 1)[-1].lower() not in fixed.BINARY_B and (not self.included or any(r.fullmatch(rel) for r in self.included))


class _Part(InputPartition):
    """Files to read and folders to go through, with the ignore files above them."""

    def __init__(self, files: list[str], folders: list[str], ignores: list[tuple[str, list[str]]]):
        self.files, self.folders, self.ignores = files, folders, ignores


FILES = pa.schema([("path", pa.string()), ("content", pa.string()), ("language", pa.string()), ("size", pa.int64()), ("mtime_ms", pa.float64())])
ENTRIES = pa.schema([("path", pa.binary()), ("kind", pa.string()), ("above", pa.list_(pa.binary()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _kind(entry: os.DirEntry) -> str | None:
    try:
        return "file" if entry.is_file() else "folder" if entry.is_dir(follow_symlinks=False) else None
    except OSError:  # a link to itself
        return None


class CodebaseReader(DataSourceReader):
    def __init__(self, options):
        get = lambda k, d="": options.get(k, d)
        self.root, self.profile = os.path.abspath(get("path", ".")), get("profile", "P").upper()
        self.include, self.exclude = split_globs(get("include")), split_globs(get("exclude"))
        self.force = get("forceLarge", "false").lower() == "true"
        self.dot = get("dot", "true" if self.profile == "P" else "false").lower() == "true"
        self.depth = int(get("depth", "2"))

    def _filter(self) -> Filter:
        out = Filter(self.profile, self.include, self.exclude, self.dot)
        if self.profile == "B" and (lines := self._ignore_file("")):
            out.with_root(lines)
        return out

    def _ignore_file(self, folder: str) -> list[str]:
        try:
            with open(os.path.join(self.root, folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                return f.read().split("\n")
        except OSError:
            return []

    def _walk(self, folder: str, wanted: Filter, ignores: list[tuple[str, list[str]]], depth: int) -> Iterator[tuple[str, list[str], list[str], list]]:
        """(folder, files, folders not entered because of the depth, ignore files above), top down; unreadable folders have nothing."""
        if folder and self.profile == "B" and (lines := self._ignore_file(folder)):
            ignores = [*ignores, (folder + "/", lines)]
        nested = [(at, Ignore(lines)) for at, lines in ignores]
        try:
            entries = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
        except OSError:
            return
        rel = lambda e: f"{folder}/{e.name}" if folder else e.name
        files = [rel(e) for e in entries if _kind(e) == "file" and wanted.reads(rel(e), nested)]
        below = [rel(e) for e in entries if _kind(e) == "folder" and wanted.enters(rel(e), nested)]
        yield folder, files, below if depth == 0 else [], ignores
        for b in below if depth else []:
            yield from self._walk(b, wanted, ignores, depth - 1)

    def partitions(self):
        files, parts = [], []
        for _, found, below, ignores in self._walk("", self._filter(), [], self.depth):
            files += found
            parts += [_Part([], below[i : i + PART_FILES], ignores) for i in range(0, len(below), PART_FILES)]
        parts += [_Part(files[i : i + PART_FILES], [], []) for i in range(0, len(files), PART_FILES)]
        return parts or [_Part([], [], [])]

    def read(self, partition):
        wanted = self._filter() if partition.folders else None

        def files() -> Iterator[str]:
            yield from partition.files
            for folder in partition.folders:
                for _, found, _, _ in self._walk(folder, wanted, partition.ignores, 1 << 30):
                    yield from found

        yield from self.batches(files())

    def batches(self, files: Iterable[str]) -> Iterator[pa.RecordBatch]:
        """The files' rows; a batch holds BATCH_CHARS and a file more at most."""
        rows, chars = [], 0
        for rel in files:
            for row in self._row(rel):
                rows.append(row)
                chars += len(row[1])
            if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield _batch(rows, FILES)
                rows, chars = [], 0
        if rows:
            yield _batch(rows, FILES)

    def step(self, level: Iterable[tuple[str, str, list[str]]]) -> Iterator[tuple[str, str, list[str]]]:
        """Of entries (path, kind, folders above with ignore files) those files that are to be read, and what is in those folders that are entered."""
        wanted = self._filter()
        rules = lru_cache(1 << 10)(lambda at: Ignore(self._ignore_file(at)))
        for rel, kind, above in level:
            nested = [(at + "/", rules(at)) for at in above]
            if kind == "file":
                if wanted.reads(rel, nested):
                    yield rel, "read", []
            elif not rel or wanted.enters(rel, nested):
                full = os.path.join(self.root, rel)
                if rel and self.profile == "B" and os.path.isfile(os.path.join(full, ".gitignore")):
                    above = [*above, rel]
                try:
                    with os.scandir(full) as entries:
                        for e in entries:
                            if found := _kind(e):
                                yield f"{rel}/{e.name}" if rel else e.name, found, above
                except OSError:  # unreadable folders have nothing
                    continue

    def _row(self, rel: str) -> Iterator[tuple]:
        """The file's row; none if it can't be read or is too large."""
        full = os.path.join(self.root, rel)
        try:
            at = os.stat(full)
            if at.st_size > fixed.MAX_BYTES and not self.force:
                return
            with open(full, "rb") as f:
                text = f.read().decode("utf-8", "replace")
        except OSError:
            return
        if self.profile == "P":
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if len(text.splitlines() if self.profile == "P" else text.split("\n")) > fixed.MAX_FILE_LINES and not self.force:
            return
        if self.profile == "P":
            lang = fixed.LANGUAGES_P.get(suffix(rel.rsplit("/", 1)[-1]))
        else:
            lang = fixed.LANGUAGES_B.get(rel.rsplit(".", 1)[-1].lower(), "text")
        yield rel, text, lang, at.st_size, at.st_mtime * 1000


class Codebase(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codebase"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return CodebaseReader(self.options)


def _encoded(entry: tuple[str, str, list[str]]) -> tuple[bytes, str, list[bytes]]:
    return os.fsencode(entry[0]), entry[1], [os.fsencode(x) for x in entry[2]]


def _dealt(rows: DataFrame, n: int, part: int) -> DataFrame:
    """n rows over tasks of about `part`, on each core at least one."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, n // part))


def scan(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """The rows of format("codebase"). Levels are listed here while they hold up to FEW entries; from the first wider one on they are
    dealt over the executors, each one anew. The files to read are stored, and dealt before they are read."""
    reader = CodebaseReader(options)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple[str, str, list[str]]]:
            for b in batches:
                for path, kind, above in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield os.fsdecode(path), kind, [os.fsdecode(x) for x in above]

        rows = []
        for e in reader.step(entries()):
            rows.append(_encoded(e))
            if len(rows) >= 1 << 13:
                yield _batch(rows, ENTRIES)
                rows = []
        if rows:
            yield _batch(rows, ENTRIES)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from reader.batches(os.fsdecode(x) for b in batches for x in b.column(0).to_pylist())

    level, found = [("", "folder", [])], []
    while level and len(out := list(islice(reader.step(level), FEW + 1))) <= FEW:
        found += [e for e in out if e[1] == "read"]
        level = [e for e in out if e[1] != "read"]
    tables, n = [spark.createDataFrame([_encoded(e) for e in found], LEVEL)], len(found)
    rest, left = spark.createDataFrame([_encoded(e) for e in level], LEVEL), len(level)
    while left:
        table = written(_dealt(rest, left, PART_ENTRIES).mapInArrow(step, LEVEL))
        counts = {r[0]: r[1] for r in table.groupBy("kind").count().collect()}
        tables.append(table.where("kind = 'read'"))
        rest, left, n = table.where("kind != 'read'"), counts.get("file", 0) + counts.get("folder", 0), n + counts.get("read", 0)
    return _dealt(reduce(DataFrame.union, tables).select("path"), n, PART_FILES).mapInArrow(contents, SCHEMA)
