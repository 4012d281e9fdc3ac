"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

For each benchmark item, every window of a document with as many words as the item could hold it.

1. Items become a table of their words' hashes, and their word shingles a filter of bounded size.
2. One pass over the documents, at any number of items: the stretches of a document around shingles that pass the filter
   go out as word hashes. A join with the items' shingles tells which lengths of items may lie there (a similar window
   holds at least one shingle of its item).
3. Items of one length are dealt over blocks of ITEMS, and stretches go to the blocks of their lengths. In a block each
   window's 64-bit SimHash is looked up in four tables, one for each 16-bit block of the fingerprint: two fingerprints within
   RADIUS bits differ by at most RADIUS // 4 bits in some block, and each item stands in the tables under all values so close
   to its own, so no fingerprint within the radius is missed. Each candidate is then compared exactly by its weighted shingles.

A document with fewer words than an item has no such window: if it shares a shingle with the item, it is compared as a whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bounded, cut, join_hot, row_keys, small, without
from .words import hashed, slices, spread, text_bytes, trimmed, window_hashes

K = 5  # words in a shingle
RADIUS = 19  # bits, of 64
ITEMS = 2048  # items in a block
GATE_BITS = 20, 28  # bits of the filter, as powers of two: 32 for each shingle of the items, between the two; a fuller filter lets more pass
STRETCH = 8192  # windows of a stretch, at least
SIGNS = 4096  # windows whose sums are made at a time
GROUP_WORDS = 1 << 17  # words of stretches that a task holds for a block of items


def _signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _fold(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from sums over signs."""
    return np.packbits(sums > 0, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def simhash(h: np.ndarray) -> int:
    """Of weighted shingles: one that stands there n times has weight n."""
    return int(_fold(sum(_signs(h[i : i + SIGNS]).sum(axis=0, keepdims=True) for i in range(0, len(h), SIGNS)))[0])


def window_prints(h: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """SimHash of the `size` hashes from each of the ascending starts, from running sums over bounded stretches."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(starts, lo + SIGNS))
        run = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(h[lo : int(starts[j - 1]) + size]), axis=0, dtype=np.int32)])
        a = starts[i:j] - lo
        out[i:j] = _fold(run[a + size] - run[a])
        i = j
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller weights over the sum of the larger."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (a.total() + b.total() - both)


@lru_cache(4)
def _masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(16), r)], np.int64)


class Index:
    """A block of items of `words` words: their shingles, fingerprints and the four block tables."""

    def __init__(self, words: int, shingles: list[np.ndarray]):
        self.words, self.q = words, min(K, words)
        self.bags = [Counter(h.tolist()) for h in shingles]
        self.prints = np.array([simhash(h) for h in shingles], np.uint64)
        posts = sorted((x, i) for i, b in enumerate(self.bags) for x in b)
        self.post_key, self.post_item = np.array([p[0] for p in posts], np.uint64), np.array([p[1] for p in posts], np.int64)
        masks, self.tables = _masks(RADIUS // 4), []
        for b in range(4):
            value = (self.prints >> np.uint64(16 * b)).astype(np.int64) & 0xFFFF
            near = (value[:, None] ^ masks).reshape(-1).astype(np.uint16)
            order = np.argsort(near, kind="stable")
            at = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=1 << 16))])
            self.tables.append((at, (order // len(masks)).astype(np.int32)))

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) for all pairs within the radius."""
        found = []
        for b, (at, items) in enumerate(self.tables):
            value = (prints >> np.uint64(16 * b)).astype(np.int64) & 0xFFFF
            count = at[value + 1] - at[value]
            q, i = np.repeat(np.arange(len(prints)), count), items[spread(count, at[value])]
            near = np.bitwise_count(prints[q] ^ self.prints[i]) <= RADIUS
            found.append(q[near] * len(self.prints) + i[near])
        pair = np.unique(np.concatenate(found))
        return pair // len(self.prints), pair % len(self.prints)

    def windows(self, words: np.ndarray, starts: np.ndarray, threshold: float) -> dict[int, tuple]:
        """Best (similarity, start, hamming) by item over the windows at these starts, the first of equals."""
        best: dict[int, tuple] = {}
        h, size = window_hashes(words, self.q), self.words - self.q + 1
        for a in range(0, len(starts), SIGNS):
            some = starts[a : a + SIGNS]
            prints = window_prints(h, size, some)
            for v, i in zip(*(x.tolist() for x in self.search(prints)), strict=True):
                s = int(some[v])
                sim = similarity(Counter(h[s : s + size].tolist()), self.bags[i])
                if sim >= threshold and (i not in best or (sim, -s) > (best[i][0], -best[i][1])):
                    best[i] = sim, s, int(np.bitwise_count(prints[v] ^ self.prints[i]))
        return best

    def whole(self, words: np.ndarray, threshold: float) -> dict[int, tuple]:
        """(similarity, 0, hamming) of a row of fewer words with the items that share a shingle, whatever the fingerprint."""
        h = window_hashes(words, self.q)
        a, z = np.searchsorted(self.post_key, np.unique(h), "left"), np.searchsorted(self.post_key, np.unique(h), "right")
        bag, best = Counter(h.tolist()), {}
        for i in np.unique(self.post_item[spread(z - a, a)]).tolist():
            sim = similarity(bag, self.bags[i])
            if sim >= threshold:
                best[i] = sim, 0, (simhash(h) ^ int(self.prints[i])).bit_count()
        return best


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, words, shingles) of the items that have words."""
    for b in batches:
        data, at = text_bytes(b.column(1))
        rows = [(r, h) for r in range(b.num_rows) if len(h := hashed(data[at[r] : at[r + 1]], np.array([0, at[r + 1] - at[r]]))[0])]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r for r, _ in rows], pa.int64())), pa.array([len(h) for _, h in rows], pa.int64()), pa.array([window_hashes(h, min(K, len(h))).view(np.int64) for _, h in rows], pa.list_(pa.int64()))], ["item", "words", "shingles"])


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places in the filter of each hash."""
    mask = np.uint64((1 << bits) - 1)
    return [(h >> np.uint64(s) & mask).astype(np.int64) for s in (64 - bits, 18, 0)]


def _gate(shingles: DataFrame) -> np.ndarray:
    """The filter's bytes, from a stored table of distinct shingles."""
    bits = min(max(GATE_BITS[0], (32 * shingles.count() - 1).bit_length()), GATE_BITS[1])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.unique(np.concatenate(_probes(b.column(0).to_numpy().view(np.uint64), bits)))
            for p in np.unique(at >> 17).tolist():
                held.setdefault(p, np.zeros(1 << 17, bool))[at[at >> 17 == p] & (1 << 17) - 1] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["part", "bits"])

    out = np.zeros(1 << bits >> 3, np.uint8)
    for part, marks in shingles.repartition(16, "h").mapInArrow(marked, "part int, bits binary").collect():
        out[part << 14 : (part + 1) << 14] |= np.frombuffer(marks, np.uint8)
    return out


def _stretches(places: np.ndarray, words: int, reach: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of window starts that cover all windows of up to `reach` words with a shingle at one of the ascending places."""
    if words < reach:
        yield 0, words
        return
    first = np.maximum(places - reach + 1, 0)
    new = np.flatnonzero(np.concatenate([[True], first[1:] > places[:-1] + 1]))
    for i, j in zip(new, [*new[1:], len(places)], strict=True):
        for a in range(int(first[i]), int(places[j - 1]) + 1, max(STRETCH, 4 * reach)):
            yield a, min(a + max(STRETCH, 4 * reach), int(places[j - 1]) + 1)


def _finder(gate: np.ndarray, sizes: list[int], reach: int):
    """Stretches of the rows: their words' hashes, and the shingles (of `sizes` words) that pass the filter with their places."""
    bits = (8 * len(gate) - 1).bit_length()

    def passing(words: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        h = window_hashes(words, q)
        ok = np.ones(len(h), bool)
        for at in _probes(h, bits):
            ok &= (gate[at >> 3] & 128 >> (at & 7)) > 0
        p = np.flatnonzero(ok)
        return p, h[p]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        done = regions = 0
        for b in batches:
            data, at = text_bytes(b.column(3))
            for i, j in slices(at):
                words, ptr = hashed(data[at[i] : at[j]], at[i : j + 1] - at[i])
                made = [passing(words, q) for q in sizes]
                place, key = np.concatenate([p for p, _ in made]), np.concatenate([h for _, h in made])
                last = np.concatenate([p + q for (p, _), q in zip(made, sizes, strict=True)])
                row = np.searchsorted(ptr, place, "right") - 1
                inside = last <= ptr[row + 1]
                order = np.flatnonzero(inside)[np.argsort(place[inside], kind="stable")]
                place, key, row = place[order], key[order], row[order]
                out = []
                for r, lo, n in zip(*np.unique(row, return_index=True, return_counts=True), strict=True):
                    p, h = place[lo : lo + n] - ptr[r], key[lo : lo + n]
                    mine = words[ptr[r] : ptr[r + 1]]
                    for s, e in _stretches(p, len(mine), reach):
                        x, y = np.searchsorted(p, [s, e + reach])
                        out.append((int(r), base + regions, base + done + int(r), len(mine), s, e - s, mine[s : e + reach].tobytes(), (p[x:y] - s).astype(np.int32), h[x:y].view(np.int64)))
                        regions += 1
                done += j - i
                for a in range(0, len(out), 64):
                    cols = list(zip(*out[a : a + 64], strict=True))
                    own = [b.column(c).take(pa.array([i + r for r in cols[0]], pa.int64())) for c in range(3)]
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], ["doc_id", "k1", "k2", "region", "row", "row_words", "first", "starts", "words", "places", "keys"])

    return find


def _in_block(threshold: float):
    names = ["row", "item", "similarity", "before", "start_word", "n_words", "hamming"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def run(regions: pa.Table, items: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(regions) and len(items):
            ids = items.column("item").to_pylist()
            index = Index(items.column("size")[0].as_py(), [np.array(x.values, np.int64).view(np.uint64) for x in items.column("shingles")])
            n = index.words
            for r in regions.to_batches(max_chunksize=64):
                for row, total, first, starts, words, places in zip(*(r.column(c).to_pylist() if c not in ("words",) else r.column(c) for c in ("row", "row_words", "first", "starts", "words", "places")), strict=True):
                    w = np.frombuffer(words.as_buffer(), np.uint64)
                    if total < n:
                        best, length = index.whole(w, threshold), total
                    else:
                        p = np.unique(np.array(places, np.int64))
                        s = np.unique((p[:, None] - np.arange(n - index.q + 1)).reshape(-1))
                        best, length = index.windows(w, s[(s >= 0) & (s < starts) & (s + n <= len(w))], threshold), n
                    out += [(row, ids[i], sim, -(first + s), first + s, length, d) for i, (sim, s, d) in best.items()]
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def _hits(docs: DataFrame, benchmark: DataFrame, threshold: float, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """doc_id, k1, k2 (row keys), item_id, start_word, n_words, similarity, hamming of the best window of each row and item."""
    k1, k2 = row_keys(id_col, text_col)
    src = bounded(docs).select(F.col(id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    texts = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col("text")).where("text is not null").distinct()
    texts = cut(texts.withColumn("item", F.monotonically_increasing_id()))
    items = cut(texts.select("item", "text").mapInArrow(_items, "item bigint, words bigint, shingles array<bigint>"))
    # lengths of the items that hold a shingle; each length has items
    lengths = cut(items.select("words", F.explode("shingles").alias("h")).distinct())
    reach = items.agg(F.max("words")).first()[0] or 0
    sizes = sorted({min(K, r[0]) for r in items.where(f"words < {K}").select("words").distinct().collect()} | ({K} if reach >= K else set()))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, k1 bigint, k2 bigint, region bigint, row bigint, row_words bigint, first bigint, starts bigint, words binary, places array<int>, keys array<bigint>"
    gate = _gate(cut(lengths.select("h").distinct()))
    regions = cut(src.mapInArrow(trimmed(_finder(gate, sizes, reach)), schema)) if reach else docs.sparkSession.createDataFrame([], schema)
    # which lengths each stretch is to be searched for
    keyed = cut(regions.select("region", "row_words", F.explode(F.arrays_zip("places", "keys")).alias("z")).select("region", "row_words", "z.places", F.col("z.keys").alias("h")))
    # of a row with fewer words, the most that its shingles can be of the item's
    q = F.least(F.lit(K), F.col("words"))
    able = (F.col("words") <= F.col("row_words")) | ((F.col("row_words") - q + 1) / (F.col("words") - q + 1) >= threshold)
    wanted = join_hot(keyed, lengths, "h").where(able).groupBy("region", F.col("words").alias("size")).agg(F.array_sort(F.collect_set("places")).alias("places"))
    wanted = cut(wanted)
    load = regions.select("region", (F.length("words") / 8).cast("long").alias("load"))
    salts = wanted.join(load, "region").groupBy("size").agg(F.ceil(F.sum("load") / GROUP_WORDS).cast("int").alias("salts"))
    # one row for each length of item: at most as many as the longest item has words
    blocks = items.groupBy(F.col("words").alias("size")).agg(F.ceil(F.count("*") / ITEMS).cast("int").alias("blocks"))
    plan = small(cut(salts.join(blocks, "size")))
    asked = wanted.join(plan, "size").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("salt", F.pmod(F.xxhash64("region"), F.col("salts")))
    asked = asked.select("size", "block", "salt", "region", "places").join(regions.select("region", "row", "row_words", "first", "starts", "words"), "region")
    held = items.withColumnRenamed("words", "size").join(plan, "size").withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))).select("size", "block", "salt", "item", "shingles")
    by = ["size", "block", "salt"]
    found = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(_in_block(threshold), "row bigint, item bigint, similarity double, before bigint, start_word bigint, n_words bigint, hamming int")
    best = found.groupBy("row", "item").agg(F.max(F.struct("similarity", "before", "start_word", "n_words", "hamming")).alias("b")).select("row", "item", "b.*")
    rows = regions.select("row", "doc_id", "k1", "k2").dropDuplicates(["row"])
    return best.join(rows, "row").join(texts.select("item", "item_id"), "item").select("doc_id", "k1", "k2", "item_id", "start_word", "n_words", "similarity", "hamming")


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity, hamming: for each row of docs and each item, the most similar window
    (the first of equals) with weighted-shingle similarity of at least `threshold` and a fingerprint within RADIUS bits. A row with
    fewer words than the item is one window, with n_words of its own and any fingerprint.

    Items and texts without words, and null texts, have no hits; empty tables give no rows. Rows of docs may repeat and ids may
    be null or shared: each row has hits of its own. Repeated items are reported once. An item of under K words is one shingle.
    Other columns are not read. A text of n words takes some 40 n bytes of a worker.
    """
    return _hits(docs, benchmark, threshold, id_col, text_col, item_col).drop("k1", "k2")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without the rows that hold a benchmark item; another row with the same doc_id, or with none, stays."""
    return without(docs, cut(_hits(docs, benchmark, threshold, "doc_id", "text", "item_id").select("k1", "k2").distinct()))
