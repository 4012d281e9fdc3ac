"""Intermediate tables that outlive executors and keep plans short."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_cleared: set[str] = set()  # folders that are deleted when Python ends


def folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, in the checkpoint folder that the cluster shares.

    Where none is set a single machine uses its temporary folder; on a cluster that would split or lose data, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        root = f"{tempfile.gettempdir()}/skein-checkpoints"
    path = f"{root.rstrip('/')}/skein-{spark.sparkContext.applicationId}"
    if path not in _cleared:
        _cleared.add(path)
        atexit.register(_delete, spark, path, spark.sparkContext._jsc.hadoopConfiguration())
    return path


def _delete(spark: SparkSession, path: str, conf) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # the JVM may be gone already; the tables are only left over
        pass


def written(df: DataFrame) -> DataFrame:
    """df from a Parquet table in folder(); the table goes with drop() or when Python ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_table = path
    return out


def drop(table: DataFrame) -> None:
    """Deletes the table behind what written() returned; nothing may read it afterwards."""
    spark = table.sparkSession
    _delete(spark, table._skein_table, spark.sparkContext._jsc.hadoopConfiguration())


def spread(df: DataFrame) -> DataFrame:
    """A scan of a file or two, dealt over the cores: however many splits it has, one row group is read by one task. A scan
    with more splits than there are cores, as of any large table, stays as it is and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df
