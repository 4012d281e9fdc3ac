"""Keeps the chunk cache up to date with a stream of files."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.cache import ChunkCache
from skein.operators.durable import written


def latest(files: DataFrame) -> DataFrame:
    """Of the rows of a path the one with the newest mtime (null is oldest); of those the one whose content has the largest hash."""
    rows = files.groupBy("path").agg(F.max(F.struct("mtime", F.sha2("content", 256).alias("h"), "content", "language")).alias("r"))
    return rows.select("path", "r.content", "r.language", "r.mtime")


def follow(files: DataFrame, chunker: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, profile: str = "P", **trigger) -> StreamingQuery:
    """files: a stream of (path, content, language, mtime in seconds). Each micro-batch's new and changed files are chunked into the
    cache at folder: of versions of a path the newest, and none that is older than what is cached. A repeated batch changes
    nothing, so a restart loses and doubles nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        cache = ChunkCache(rows.sparkSession, folder)
        newer = cache.files().select("path", F.col("mtime").alias("_cached"))
        rows = latest(rows).join(newer, "path", "left").where("_cached is null or mtime >= _cached").drop("_cached")
        cache.refresh(written(rows), chunker, time.time(), profile)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
