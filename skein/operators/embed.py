"""Vectors of chunks from a provider, a function of a list of texts to their vectors; texts embedded before are taken from a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.retry import retry

Provider = Callable[[list[str]], list[list[float]]]
# Fixed values by profile: texts in a call, retries, characters embedded, size of the zero vector that stands for a failure.
BATCH, RETRIES, LONGEST, ZEROS = {"P": 20, "B": 100}, {"P": 3, "B": 2}, 8000, 768


def enriched(profile: str) -> Column:
    """What is embedded of a chunk: its path, type and name, then its content."""
    name, line = F.coalesce("name", F.lit("")), lambda head, c: F.concat(F.lit(head), c, F.lit("\n"))
    head = line("File: ", F.col("path"))
    if profile == "B":
        return F.concat(head, F.when(name != "", F.concat("chunk_type", F.lit(": "), name, F.lit("\n"))).otherwise(""), F.substring("content", 1, LONGEST))
    kind = F.coalesce("chunk_type", F.lit(""))
    head = F.concat(head, F.when(~kind.isin("", "file"), line("Type: ", kind)).otherwise(""), F.when(name != "", line("Name: ", name)).otherwise(""))
    return F.concat(head, F.lit("---\n"), F.substring("content", 1, 2000))


def vectors(chunks: DataFrame, provider: Provider, profile: str = "P", known: DataFrame | None = None, key: str = "chunk_id", delay: float = 1.0) -> DataFrame:
    """key, text_hash, vector. known(text_hash, vector) is looked up first. A call that keeps failing gives null in profile P, zeros in B."""
    size, tries = BATCH[profile], RETRIES[profile]

    def call(texts: list[str]) -> list:
        try:
            return retry(lambda: provider(texts), tries, delay)
        except Exception:
            return [None if profile == "P" else [0.0] * ZEROS] * len(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), size):
                part = b.iloc[i : i + size]
                yield pd.DataFrame({key: part[key], "text_hash": part["text_hash"], "vector": call([t[:LONGEST] for t in part["text"]])})

    rows = chunks.select(key, enriched(profile).alias("text")).withColumn("text_hash", F.sha2("text", 256))
    schema = f"{key} {chunks.schema[key].dataType.simpleString()}, text_hash string, vector array<double>"
    if known is None:
        return rows.mapInPandas(run, schema)
    had = rows.join(known.select("text_hash", "vector").dropDuplicates(["text_hash"]), "text_hash").select(key, "text_hash", "vector")
    return had.unionByName(rows.join(known.select("text_hash").distinct(), "text_hash", "left_anti").select(key, "text_hash", "text").mapInPandas(run, schema))
