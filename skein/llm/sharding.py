"""Minimax contiguous partition of documents into shards (DataFrame functions only).

Equal texts form an atomic group; groups are ordered by the 64-bit hash of their text. The smallest capacity for
which a greedy pass over the ordered group sizes needs no more than the wanted shards is found by binary search,
and the order is cut there. The driver never holds all groups: it holds sums over ranges of the hash, and only the
ranges in which a cut can fall are counted more finely, until they are single groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, rank_in

FIRST_SHIFT = 52  # 4096 ranges of the hash at first
STEP = 8  # then each range that matters is cut in 256


class Range(NamedTuple):
    """Sums over the groups whose key >> shift is prefix."""

    start: int  # the smallest key
    prefix: int
    shift: int
    total: int
    largest: int
    groups: int


def _ranges(groups: DataFrame, shift: int, only: Column | None = None) -> list[Range]:
    of = groups if only is None else groups.where(only)
    rows = of.groupBy(F.shiftright("key", shift).alias("p")).agg(F.sum("bytes"), F.max("bytes"), F.count("*")).collect()
    return [Range(p << shift, p, shift, int(t), int(m), int(n)) for p, t, m, n in rows]


def _greedy(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where each shard begins (index of a range), or None if the capacity is too small."""
    begins, at = [], 0
    while at < len(sums) - 1:
        if len(begins) == shards:
            return None
        begins.append(at)
        nxt = bisect_right(sums, sums[at] + capacity) - 1
        if nxt == at:
            return None
        at = nxt
    return begins


def _search(low: int, high: int, feasible) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """groups(key: long, bytes: long), key unique. The first key of each shard, and the smallest capacity."""
    ranges = sorted(_ranges(groups, FIRST_SHIFT))
    if not ranges:
        return [], 0
    while True:
        sums = [0, *accumulate(r.total for r in ranges)]
        least = max(-(-sums[-1] // shards), max(r.largest for r in ranges))
        finer = {r for r in ranges if r.groups > 1 and r.total * 4 > least}
        if not finer:
            most = _search(least, sums[-1], lambda c: _greedy(sums, c, shards) is not None)
            # With a capacity between the two, cut k lies at least where a cut at range ends gets with the lower
            # one, and at most k times the higher one from the start.
            low = 0
            for k in range(1, shards):
                low = sums[max(bisect_right(sums, low + least) - 1, 0)]
                a, b = bisect_right(sums, low) - 1, bisect_left(sums, min(k * most, sums[-1]))
                finer.update(r for r in ranges[max(a, 0) : b + 1] if r.groups > 1)
                if low >= sums[-1]:
                    break
            if not finer or least == most:
                return [ranges[i].start for i in _greedy(sums, most, shards)], most
        kept = [r for r in ranges if r not in finer]
        for shift in {r.shift for r in finer}:
            kept += _ranges(groups, max(0, shift - STEP), F.shiftright("key", shift).isin([r.prefix for r in finer if r.shift == shift]))
        ranges = sorted(kept)


def minimax_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, key (the group), shard, slot (gapless from 0 within the shard).

    A null text counts as empty; an empty table gives no rows; equal texts (repeated rows too) share a shard, so a
    group larger than an even share makes its shard larger. Ids may be null or repeated. Other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = cut(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("_row")))
    groups = cut(base.groupBy("key").agg(F.sum("size").alias("bytes")))
    begins, _ = minimax_cuts(groups, shards)
    shard = sum(((F.col("key") >= F.lit(k)).cast("int") for k in begins[1:]), F.lit(0))
    return rank_in(base.withColumn("shard", shard), "shard", ["doc_id", "text_crc32", "size", "_row"], "slot").drop("_row")
