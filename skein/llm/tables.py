"""Shared pieces of the llm operators: row keys, joins that split hot keys, slot ranks and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.durable import drop
from skein.operators.durable import written as cut

HOT = 256  # a key that holds over 1 / HOT of the rows is hot: there are fewer than HOT of them
BROADCAST_ROWS = 1 << 20  # narrow rows that may be broadcast; more are joined by a shuffle
SLOT_ROWS = 20_000  # rows that one task ranks


def bounded(df: DataFrame) -> DataFrame:
    """df, after the session was told to hand Python at most 1000 rows and 8 MB at a time, unless it asks for less already.

    By default a batch has 10,000 rows or 64 MB, which with whole texts takes much of a small executor."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = int(str(conf.get(key)).removesuffix("b"))
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to differ from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """128 bits that tell rows apart by id and text; rows that have both in common are the same row. Nulls differ from any value."""
    i, t = F.col(id_col), F.col(text_col)
    return tuple(F.xxhash64(F.lit(seed), i.isNull(), i, t.isNull(), t) for seed in (1, 2))


def small(stored: DataFrame) -> DataFrame:
    """A stored narrow table, marked for a broadcast if it has few enough rows."""
    return F.broadcast(stored) if stored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else stored


def without(df: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows whose row_keys are in the stored table gone(k1, k2)."""
    a, b = unused(df, "_k1", "_k2")
    k1, k2 = row_keys(id_col, text_col)
    keyed = df.withColumns({a: k1, b: k2})
    return keyed.join(small(gone.select(F.col("k1").alias(a), F.col("k2").alias(b))), [a, b], "left_anti").drop(a, b)


def hot_keys(stored: DataFrame, key: str) -> list[int]:
    """The values of a long column that hold over 1 / HOT of the rows, by a sketch of bounded size; what it overlooks costs balance only."""
    n, top = stored.agg(F.count(key), F.expr(f"approx_top_k({key}, {HOT}, {HOT * 32})")).first()
    return [r["item"] for r in top if r["item"] is not None and r["count"] * HOT > n]


def join_hot(stored: DataFrame, values: DataFrame, key: str, how: str = "inner", hot: list[int] | None = None) -> DataFrame:
    """stored joined with values, which has one row for each value of the long column `key`, so that no task gets all rows of a key.

    The rows of hot keys meet their few values by a broadcast, the others by a shuffle."""
    hot = hot_keys(stored, key) if hot is None else hot
    if not hot:
        return stored.join(values, key, how)
    among = F.col(key).isin(hot)
    return stored.where(F.coalesce(~among, F.lit(True))).join(values, key, how).unionByName(stored.where(among).join(F.broadcast(values.where(among)), key, how))


def rank_in(stored: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds a gapless rank from 0 among the rows of a key. A key's rows are dealt over buckets by `order`, counted and ranked
    there, and shifted by the counts of the buckets before. Their number follows that of the rows, so a task ranks about SLOT_ROWS
    rows however hot a key is, if `order` tells the rows apart."""
    buckets = max(16, -(-stored.count() // SLOT_ROWS))
    df = stored.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(key, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(key).alias("__k"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(key, "__b").orderBy(*order)) - 1)
    joined = ranked.join(counts, (F.col(key).eqNullSafe(F.col("__k"))) & (F.col("__b") == F.col("__c")))
    return joined.withColumn(name, (F.col("__before") + F.col("__r")).cast("long")).drop("__b", "__c", "__k", "__r", "__before")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b: long): root is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). A node's smallest neighbour is an aggregate with
    partial sums; it goes back to its edges by join_hot, so a hub's neighbours are never one task's group.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n, digest, top = both.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.expr(f"approx_top_k(u, {HOT}, {HOT * 32})")).first()
        if (n, digest) == last or not n:
            break
        last = n, digest
        hot = [r["item"] for r in top if r["count"] * HOT > n]
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_hot(both, least, "u", hot=hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = join_hot(large, small_min, "u", hot=hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_min.select("u", F.col("m").alias("v")))
        before, e = e, cut(small_star.where("u <> v").distinct())
        drop(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
