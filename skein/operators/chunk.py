"""Chunks of files: one row-local expression per profile, then an explode; no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import fixed

_TYPE = "struct<first:int,last:int,chunk_type:string,name:string>"


def _found(line: Column, language: Column, patterns: dict, strict: bool) -> Column:
    """(type, name) of the first pattern of the language that fits the line, else null."""
    out = None
    for lang, ps in patterns.items():
        one = None
        for p, kind, *group in ps:
            name = F.regexp_extract(line, p, 1 if strict or not group else group[0])
            hit = F.struct(F.lit(kind).alias("chunk_type"), F.nullif(name, F.lit("")).alias("name"))
            one = (F if one is None else one).when(line.rlike(p), hit)
        out = (F if out is None else out).when(language == lang, one)
    return out


def _definitions(patterns: dict, strip: bool, strict: bool) -> Column:
    """Array of (first, chunk_type, name) over the column `lines`."""

    def at(line: Column, i: Column) -> Column:
        line = F.regexp_replace(line, r"^\s+|\s+$", "") if strip else line
        d = _found(line, F.col("language"), patterns, strict)
        return F.struct(i.alias("first"), d["chunk_type"].alias("chunk_type"), d["name"].alias("name"))

    return F.filter(F.transform("lines", at), lambda d: d["chunk_type"].isNotNull())


def _span(first: Column, last: Column, kind: Column, name: Column) -> Column:
    return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), kind.alias("chunk_type"), name.alias("name"))


def _sections(n: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.transform(F.sequence(F.lit(0), n - 1, F.lit(fixed.MAX_LINES)), lambda s: _span(s, F.least(s + fixed.MAX_LINES, n), F.lit("section"), none))


def _from_defs(n: Column) -> Column:
    return F.transform("defs", lambda d, k: _span(d["first"], F.coalesce(F.try_element_at("defs", k + 2)["first"], n), d["chunk_type"], d["name"]))


def _exploded(f: DataFrame, spans: Column) -> DataFrame:
    f = f.withColumn("c", F.explode(spans))
    content = F.array_join(F.slice("lines", F.col("c.first") + 1, F.col("c.last") - F.col("c.first")), "\n")
    return f.select("path", content.alias("content"), (F.col("c.first") + 1).alias("start_line"), F.col("c.last").alias("end_line"), F.col("c.chunk_type").alias("chunk_type"), F.col("c.name").alias("name"), "language")


def chunk_p(files: DataFrame, strict: bool = False) -> DataFrame:
    """files(path, content, language): one chunk up to 200 lines; else one for each definition, with what stands before the first; else sections.

    strict: names as the first group of a pattern, which for functions of Python is the word async or nothing.
    """
    n, none = F.size("lines"), F.lit(None).cast("string")
    f = files.withColumn("lines", F.split("content", "\n", -1)).withColumn("defs", F.when(n > fixed.MAX_LINES, _definitions(fixed.DEFINITIONS_P, True, strict)).otherwise(F.array().cast("array<struct<first:int,chunk_type:string,name:string>>")))
    first = F.try_element_at("defs", F.lit(1))["first"]
    head = F.array(_span(F.lit(0), first, F.lit("header"), none))
    has_head = (first > 0) & F.array_join(F.slice("lines", F.lit(1), first), "\n").rlike(r"\S")
    spans = F.when(n <= fixed.MAX_LINES, F.array(_span(F.lit(0), n, F.lit("file"), none)))
    spans = spans.when(F.size("defs") == 0, _sections(n)).when(has_head, F.concat(head, _from_defs(n))).otherwise(_from_defs(n))
    return _exploded(f, spans)


def chunk_b(files: DataFrame, min_lines: int = fixed.MIN_LINES, max_lines: int = fixed.MAX_LINES) -> DataFrame:
    """Definitions at any size; chunks under min_lines go if there are several, longer ones than max_lines are split; a beginning of
    min_lines or more is a section. Adds id (sha256 of path and first line from 0) and tokens."""
    n = F.size("lines")
    f = files.withColumn("lines", F.split("content", "\n", -1)).withColumn("defs", _definitions(fixed.DEFINITIONS_B, False, False))
    whole = F.filter(_from_defs(n), lambda c: (c["last"] - c["first"] >= min_lines) | (F.size("defs") == 1))

    def split(c: Column) -> Column:
        starts = F.sequence(c["first"], c["last"] - 1, F.lit(max_lines))
        return F.transform(starts, lambda s: _span(s, F.least(s + max_lines, c["last"]), c["chunk_type"], F.when(s == c["first"], c["name"]).otherwise(F.concat(c["name"], F.lit(" (continued)")))))

    first = F.try_element_at("defs", F.lit(1))["first"]
    head = F.array(_span(F.lit(0), first, F.lit("section"), F.lit("imports/preamble")))
    made = F.flatten(F.transform(whole, split))
    spans = F.when(F.size("defs") == 0, _sections(n)).when(first >= min_lines, F.concat(head, made)).otherwise(made)
    out = _exploded(f, spans)
    return out.withColumn("id", F.sha2(F.concat_ws(":", "path", (F.col("start_line") - 1).cast("string")), 256)).withColumn("tokens", F.ceil(F.length("content") / 4).cast("long"))
