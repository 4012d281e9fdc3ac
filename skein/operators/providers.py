"""Relevance, summaries and query terms from injected providers, plain functions that call a model; each has a default for failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import summary_line

# Characters of a chunk that are judged, what a failure counts as, terms added to a query.
JUDGED, UNKNOWN, TERMS = 2000, 0.5, 4


def batches(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def relevance(chunks: DataFrame, query: str, judge: Callable[[str, str], float], key: str = "chunk_id") -> DataFrame:
    """key, relevance: judge(query, beginning of the content), held between 0 and 1; 0.5 where it fails."""

    def one(text: str) -> float:
        try:
            got = float(judge(query, text))
        except Exception:
            return UNKNOWN
        return UNKNOWN if got != got else min(1.0, max(0.0, got))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "relevance": [one(t) for t in f["text"]]})

    rows = chunks.select(key, F.substring(F.coalesce("content", F.lit("")), 1, JUDGED).alias("text"))
    return rows.mapInPandas(run, f"{key} {chunks.schema[key].dataType.simpleString()}, relevance double")


def summaries(chunks: DataFrame, summarize: Callable[[list[str]], list[str]], key: str = "chunk_id", size: int = 5) -> DataFrame:
    """key, summary: summarize(contents) in batches of `size`; where it fails the chunk's own line (text.summary_line)."""

    def call(texts: list[str], lines: list[str]) -> list[str]:
        try:
            got = summarize(texts)
            return [g or x for g, x in zip(got, lines, strict=True)]
        except Exception:
            return lines

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), size):
                part = f.iloc[i : i + size]
                yield pd.DataFrame({key: part[key], "summary": call(part["text"].tolist(), part["line"].tolist())})

    content = F.coalesce("content", F.lit(""))
    rows = chunks.select(key, content.alias("text"), summary_line(content).alias("line"))
    return rows.mapInPandas(run, f"{key} {chunks.schema[key].dataType.simpleString()}, summary string")


def expand_query(query: str, suggest: Callable[[str], str]) -> list[str]:
    """The query, and up to four terms from the lines of suggest(query)."""
    try:
        return [query, *[t.strip() for t in suggest(query).strip().split("\n") if t.strip()][:TERMS]]
    except Exception:
        return [query]
