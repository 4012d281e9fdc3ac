"""Incremental chunk cache as two Parquet tables in a folder, both by bucket of the path: files(path, hash, mtime, size, last_accessed,
language, n_chunks) and chunks. Times are seconds since 1970."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import written

FILES = "path string, hash string, mtime double, size bigint, last_accessed double, language string, n_chunks bigint"


def hits(files: DataFrame, cached: DataFrame) -> DataFrame:
    """files(path, content) that are cached with the same content (P)."""
    return files.withColumn("hash", F.sha2("content", 256)).join(cached.select("path", "hash").distinct(), ["path", "hash"], "left_semi")


def misses(files: DataFrame, cached: DataFrame) -> DataFrame:
    return files.withColumn("hash", F.sha2("content", 256)).join(cached.select("path", "hash").distinct(), ["path", "hash"], "left_anti")


def fresh(files: DataFrame, cached: DataFrame) -> DataFrame:
    """files(path, mtime) whose cached mtime is not older and which have chunks (B). cached(path, mtime, n_chunks)."""
    known = cached.where("n_chunks > 0").select("path", F.col("mtime").alias("cached_mtime"))
    return files.join(known, "path").where("cached_mtime >= mtime").drop("cached_mtime")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """new rows, and old ones of paths that are not in new."""
    return old.join(new.select("path").distinct(), "path", "left_anti").unionByName(new)


def touch(cached: DataFrame, used: DataFrame, now: float) -> DataFrame:
    """cached files with the time of those that used(path) names set to now."""
    mark = used.select("path").distinct().withColumn("_now", F.lit(float(now)))
    return cached.join(mark, "path", "left").withColumn("last_accessed", F.coalesce("_now", "last_accessed")).drop("_now")


def prune(cached: DataFrame, now: float, days: int = 30) -> DataFrame:
    return cached.where(F.col("last_accessed") >= now - days * 86_400)


def cascade(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """chunks of the files that are kept."""
    return chunks.join(kept.select("path").distinct(), "path", "left_semi")


class ChunkCache:
    """The cache in a folder; buckets must not change between uses."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def _read(self, name: str) -> DataFrame | None:
        """The table, or None before the first write."""
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return None

    def files(self) -> DataFrame:
        got = self._read("files")
        return self.spark.createDataFrame([], FILES) if got is None else got.drop("bucket")

    def chunks(self) -> DataFrame | None:
        got = self._read("chunks")
        return None if got is None else got.drop("bucket")

    def _write(self, name: str, rows: DataFrame, gone: list[int] = ()) -> None:
        """Replaces the buckets that rows hold, which must be whole, and removes the buckets `gone`."""
        out = written(rows.withColumn("bucket", self._bucket()))
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        for b in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/bucket={b}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _among(self, rows: DataFrame, buckets: DataFrame) -> DataFrame:
        """rows of these buckets, of which there are at most as many as the cache has."""
        return rows.withColumn("_b", self._bucket()).join(F.broadcast(buckets), "_b", "left_semi").drop("_b")

    def refresh(self, files: DataFrame, chunker: Callable[[DataFrame], DataFrame], now: float, profile: str = "P") -> DataFrame:
        """Chunks of files(path, content, language, mtime in seconds or none): cached ones where the content is the same (P) or the
        file isn't newer (B) and there are any, new ones for the others, which are stored. Files that are used count as accessed now."""
        if "mtime" not in files.columns:
            files = files.withColumn("mtime", F.lit(None).cast("double"))
        known = self.files()
        if profile == "B":
            good = fresh(files.select("path", "mtime"), known).select("path")
            todo = files.join(good, "path", "left_anti")
        else:
            todo = misses(files, known.where("n_chunks > 0")).drop("hash")
        todo = written(todo)
        made = written(chunker(todo))
        counts = made.groupBy("path").agg(F.count("*").alias("n_chunks"))
        record = todo.select("path", F.sha2("content", 256).alias("hash"), "mtime", F.octet_length("content").cast("long").alias("size"), F.lit(float(now)).alias("last_accessed"), "language")
        record = record.join(counts, "path", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long")))
        self._write("files", upsert(touch(known, files, now), record))
        changed = todo.select(self._bucket().alias("_b")).distinct()
        old = self.chunks()
        if old is not None:
            made = made.unionByName(self._among(old, changed).join(todo.select("path"), "path", "left_anti"))
        self._write("chunks", made)
        return self.chunks().join(files.select("path").distinct(), "path", "left_semi")

    def prune(self, now: float, days: int = 30) -> None:
        """Forgets files not accessed for so many days, and their chunks."""
        known, chunks = self.files(), self.chunks()
        if chunks is None:
            return
        kept = written(prune(known, now, days))
        for name, old, left in (("chunks", chunks, cascade(chunks, kept)), ("files", known, kept)):
            left = written(left)
            had, have = ({r[0] for r in t.select(self._bucket().alias("b")).distinct().collect()} for t in (old, left))
            self._write(name, left, sorted(had - have))

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
