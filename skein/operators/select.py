"""Greedy selection under a token budget: rows in rank order, skipping what does not fit and trying what follows.

The choice is sequential, so one task makes it, streaming over (rank, tokens) and holding a batch at a time. What is left of the
budget only shrinks, so of the rows with t tokens those taken are the first ones by rank, and no more than budget / t: that many
of each length go to the task, at most about budget * ln(budget) pairs of numbers however many rows there are. Rows without
tokens always fit and don't go there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .durable import written

SPAN, STEP = 16, 8  # rows of one length are cut to size among 2 ** SPAN ranks at first, then among 2 ** STEP times as many


def ranked(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rank from 1 by score, ties by the keys.

    Rows are sorted by ranges, numbered in each and shifted by the sizes of the ranges before, so no task sees all rows. They are
    written, so that every use sees the same ranges: leave long columns out (see packed).
    """
    order = [F.desc("score"), *(F.col(k) for k in keys)]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()))  # the upper bits are the range
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(row) + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn("rank", F.col("_before") + row + 1).select(*scored.columns, "rank")


def fold(rank: np.ndarray, tokens: np.ndarray, total: float, cap: float, full: float) -> tuple[np.ndarray, float]:
    """Which of the rows, in rank order, are taken after `total`, and the total then. Nothing more is taken once it reaches `full`."""
    taken, i = [], 0
    while i < len(rank) and total < full:
        fits = i + np.flatnonzero(tokens[i:] <= cap - total)
        sums = total + np.cumsum(tokens[fits])
        before = np.concatenate([[total], sums[:-1]])
        stop = np.flatnonzero((sums > cap) | (before >= full))
        n = int(stop[0]) if len(stop) else len(fits)
        taken.append(rank[fits[:n]])
        total = float(sums[n - 1]) if n else total
        i = int(fits[n]) + 1 if len(stop) else len(rank)
    return np.concatenate(taken) if taken else rank[:0], total


def _gathered(df: DataFrame, most: float) -> DataFrame:
    """(rank, tokens) of the rows that a fold up to `most` could take. A length's rows are cut to size among neighbouring ranks, then further."""
    rows = df.where((F.col("tokens") > 0) & (F.col("tokens") <= most)).select("rank", F.col("tokens").cast("double").alias("tokens"))
    last, shift = df.agg(F.max("rank")).first()[0] or 0, SPAN
    spans = []
    while last >> shift:
        spans.append(shift)
        shift += STEP
    for by in [*(["tokens", F.shiftright("rank", s)] for s in spans), ["tokens"]]:
        n = F.row_number().over(Window.partitionBy(*by).orderBy("rank"))
        # the plain limit lets Spark drop rows before the shuffle
        rows = rows.withColumn("_n", n).where((F.col("_n") <= int(most)) & (F.col("_n") * F.col("tokens") <= most)).drop("_n")
    return rows


def _taken(df: DataFrame, cap: float, full: float = float("inf"), start: float = 0.0) -> DataFrame:
    """(rank) of the rows of df that the fold takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = start
        for b in batches:
            got, total = fold(b.column(0).to_numpy(), b.column(1).to_numpy(), total, cap, full)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], ["rank"])

    return _gathered(df, cap - start).select(F.col("rank").cast("long").alias("rank"), "tokens").repartition(1).sortWithinPartitions("rank").mapInArrow(run, "rank bigint")


def _picked(df: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows of df whose rank was taken (at most one for each token of the budget), and those without tokens."""
    marked = df.join(F.broadcast(taken.withColumn("_taken", F.lit(True))), "rank", "left")
    return marked.where((F.col("tokens") == 0) | F.col("_taken")).select(*df.columns)


def greedy(df: DataFrame, cap: float) -> DataFrame:
    """df(rank, tokens, ...): the rows taken, in one pass."""
    return _picked(df, _taken(df, float(cap)))


def pack_two_pass(df: DataFrame, budget: float, edges: DataFrame, depth: int = 1) -> DataFrame:
    """df(rank, path, tokens, ...), edges(src, dst): up to 0.7 of the budget by rank; then, up to all of it, chunks of files related to those taken. Adds pass (1 or 2)."""
    from .graph import related

    one = written(greedy(df, 0.7 * budget))
    files = one.select("path").distinct()
    near = related(edges, files, depth).join(files, "path", "left_anti")
    more = written(df.join(near, "path", "left_semi"))
    spent = float(one.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    two = _picked(more, _taken(more, float(budget), start=spent))
    return one.withColumn("pass", F.lit(1)).unionByName(two.withColumn("pass", F.lit(2)))


def pack_single(df: DataFrame, budget: int, overhead: int = 50) -> DataFrame:
    """One pass up to 0.95 of the budget with `overhead` tokens more for each chunk; done at 0.98 of that."""
    cap = float(int(0.95 * budget + 1e-9))
    costed = df.withColumn("tokens", F.col("tokens") + overhead)
    return df.join(F.broadcast(_taken(costed, cap, 0.98 * cap)), "rank", "left_semi")


def packed(scored: DataFrame, chunks: DataFrame, keys: list[str], choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of scored that choose(its ranked rows) takes, with rank, the columns that choose adds and content from chunks(keys, content).

    Rows are ranked and chosen without their contents. Those taken that have tokens are at most as many as the budget has, so they
    are broadcast to find their contents; those without tokens have empty ones.
    """
    taken = written(choose(ranked(scored.drop("content"), keys)))
    some = chunks.select(*keys, "content").join(F.broadcast(taken.where("tokens > 0")), keys)
    return some.unionByName(taken.where("tokens = 0").withColumn("content", F.lit("")))


def stats(files: DataFrame, selected: DataFrame, budget: int) -> DataFrame:
    """One row: files scanned and included, chunks and their tokens, the budget."""
    n = files.agg(F.count("*").alias("files_scanned"))
    s = selected.agg(F.countDistinct("path").alias("files_included"), F.count("*").alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"))
    return n.crossJoin(s).withColumn("budget", F.lit(budget).cast("long"))
