"""N-gram Jaccard join: documents whose shingle sets are similar, as connected components.

Equal sets are one node, named by a 64-bit signature; 64 more bits tell whether two sets share a name, and such names change.

1. Coverage. A document with a link shares most of its shingles, so those of which too few occur anywhere else are
   done. Shingle fingerprints are dealt by range, those seen twice are found there, and only counts by document go back.
2. Prefixes. Of the documents left, linked ones share a token among their first ones in any fixed order; the order
   here is by a counting sketch, frequent tokens last. The smallest node with a token is the token's hub; the nodes
   that share tokens with a hub form its group. Every link lies in some group.
3. Search. In a group every node is compared with a pivot; the nodes not linked to it are compared with the group,
   block by block, by T-occurrence search: short inverted lists are merged with a heap, long ones probed by
   binary search (DivideSkip), and what reaches the required overlap is checked exactly. The blocks of a large group are
   bands of set sizes, and only neighbouring bands can hold links. Links inside a component that is already known are
   skipped, so near copies cost one comparison each, not one for each pair.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bounded, components, cut, join_hot, row_keys, small, unused, without
from .words import hashed, mix, shingles, slices, text_bytes, trim, trimmed

PART = 1 << 14  # counters of the sketch in a row
SKETCH_BITS = 20, 24  # fewest and most counters, as powers of two: one for eight tokens, between the two
FILTER_BITS = 20, 28  # bits of the filter that picks the texts to read again, likewise: 16 for each text; beyond, all are read
RANGE_TOKENS = 1 << 22  # fingerprints of a range that are sorted at a time
BLOCK_ROWS, QUERY_ROWS, BLOCK_TOKENS = 128, 64, 100_000
RENAMED = 1 << 20  # most names that two sets share: with n sets some n * n / 2**65 are expected


def _doc_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """(batch, first row, sets of the rows from there), each set a sorted array of distinct hashes. The text is the last column."""
    for b in batches:
        data, at = text_bytes(b.column(b.num_columns - 1))
        for i, j in slices(at):
            h, ptr = shingles(*hashed(data[at[i] : at[j]], at[i : j + 1] - at[i]), k)
            yield b, i, [np.unique(h[x:y]) for x, y in zip(ptr[:-1], ptr[1:], strict=True)]


def _signature(u: np.ndarray, shared: frozenset[int] = frozenset()) -> tuple[int, int]:
    """Name of a set and the bits that tell it from others of that name, as signed numbers. Names in `shared` change by those bits."""
    a = mix(u).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(u))
    b = mix(u ^ np.uint64(0x51ED270B7A3F9D15)).sum(dtype=np.uint64, keepdims=True)
    name, check = mix(a ^ mix(b)), mix(b + mix(a ^ np.uint64(0x2545F4914F6CDD1D)))
    if int(name.astype(np.int64)[0]) in shared:
        name = mix(name ^ mix(check))
    return int(name.astype(np.int64)[0]), int(check.astype(np.int64)[0])


def _signed(k: int, shared: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, sets in _doc_sets(batches, k):
            names = [_signature(s, shared) for s in sets]
            own = [b.column(c).slice(i, len(sets)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [n for n, _ in names], [c for _, c in names]))], ["doc_id", "k1", "k2", "n", "sig", "chk"])

    return run


def _packed(n: np.ndarray) -> bytes:
    """uint32 counts, as single bytes where they are small; the first byte says which."""
    return b"\1" + n.astype(np.uint8).tobytes() if not len(n) or n.max() < 256 else b"\4" + n.astype(np.uint32).tobytes()


def _unpacked(c: bytes) -> np.ndarray:
    return np.frombuffer(c, np.uint8 if c[0] == 1 else np.uint32, offset=1).astype(np.int64)


def _gaps(at: np.ndarray) -> bytes:
    """Ascending places as the steps between them."""
    return _packed(np.diff(at, prepend=-1) - 1)


def _places(gaps: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(gaps) + 1) - 1


def _dealt(k: int, bits: int, shared: frozenset[int]):
    """Fingerprints by range of the hash: for each chunk of documents a row of each range (32-bit fingerprints in the
    documents' order, which documents they are of and how many of each) and one with the documents' names and sizes."""
    most = min(max(1 << 20, 32 << bits), 1 << 23)  # shingles of a chunk: enough for its rows not to be tiny

    def rows(chunk: int, sets: list[np.ndarray], names: list[int]) -> pa.RecordBatch:
        n = np.array([len(u) for u in sets])
        every = np.concatenate(sets)
        part = (every >> np.uint64(64 - bits)).astype(np.uint32)
        order = np.argsort(part, kind="stable")
        prints, part, doc = (every >> np.uint64(32 - bits)).astype(np.uint32)[order], part[order], np.repeat(np.arange(len(sets), dtype=np.uint32), n)[order]
        del every, order
        run = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])]))  # where a document's begin in a range
        size, run_part, run_doc = np.diff(run, append=len(part)), part[run], doc[run].astype(np.int64)
        used, first = np.unique(run_part, return_index=True)
        last = [*first[1:].tolist(), len(run)]
        at = [*run[first].tolist(), len(part)]
        m = len(used) + 1
        cols = [[prints[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], [_gaps(run_doc[x:y]) for x, y in zip(first, last, strict=True)], [_packed(size[x:y]) for x, y in zip(first, last, strict=True)]]
        own = [np.array(names, np.int64).tobytes(), b"", _packed(n)]
        return pa.RecordBatch.from_arrays([pa.array([chunk] * m, pa.int64()), pa.array([*used.tolist(), -1 - chunk], pa.int64()), *(pa.array([*c, o], pa.binary()) for c, o in zip(cols, own, strict=True))], ["chunk", "part", "prints", "docs", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        names: list[int] = []
        size, chunk = 0, TaskContext.get().partitionId() << 32
        for _, _, sets in _doc_sets(batches, k):
            for u in sets:
                if len(u) and (s := _signature(u, shared)[0]) not in seen:
                    seen.add(s)
                    held.append(u)
                    names.append(s)
                    size += len(u)
            if size > most:
                yield rows(chunk, held, names)
                held, names, size, chunk = [], [], 0, chunk + 1
        if held:
            yield rows(chunk, held, names)

    return run


def _repeated(t: pa.Table) -> pa.Table:
    """For a range of fingerprints: of the documents with some that occur in another document too, how many."""
    chunks = t.column("chunk")
    if t.column("part")[0].as_py() < 0:  # names and sizes of a chunk pass through
        return pa.table({"chunk": chunks, "names": t.column("prints"), "sizes": t.column("counts"), "docs": pa.nulls(len(t), pa.binary()), "found": pa.nulls(len(t), pa.binary())})
    every = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("prints")])
    steps = -(-len(every) // RANGE_TOKENS)
    twice = np.zeros(len(every), bool)
    for s in range(steps):  # a part of the range at a time
        low, high = (s << 32) // steps, ((s + 1) << 32) // steps
        mine = np.flatnonzero((every >= low) & (every < high)) if steps > 1 else np.arange(len(every))
        order = np.argsort(every[mine], kind="stable")
        ranked = every[mine][order]
        same = np.zeros(len(mine) + 1, bool)
        same[1:-1] = ranked[1:] == ranked[:-1]
        twice[mine[order]] = same[1:] | same[:-1]
    at, docs, found = 0, [], []
    for d, c in zip(t.column("docs").to_pylist(), t.column("counts").to_pylist(), strict=True):
        n, who = _unpacked(c), _places(d)
        f = np.add.reduceat(twice[at : at + int(n.sum())], np.cumsum(n) - n, dtype=np.int64)
        docs.append(_gaps(who[f > 0]))
        found.append(_packed(f[f > 0]))
        at += int(n.sum())
    return pa.table({"chunk": chunks, "names": pa.nulls(len(t), pa.binary()), "sizes": pa.nulls(len(t), pa.binary()), "docs": pa.array(docs, pa.binary()), "found": pa.array(found, pa.binary())})


def _covered(num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        cols = list(zip(*(t.column(c).to_pylist() for c in ("names", "sizes", "docs", "found")), strict=True))
        names, sizes = next((np.frombuffer(a, np.int64), _unpacked(n)) for a, n, _, _ in cols if a is not None)
        total = np.zeros(len(names), np.int64)
        for _, _, d, f in cols:
            if f is not None:
                total[_places(d)] += _unpacked(f)
        return pa.table({"sig": pa.array(names[total * den >= sizes * num], pa.int64())})

    return run


def _sketch(bits: int):
    """Counters of the tokens of all rows, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        for b in batches:
            every = b.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            place, n = np.unique(every, return_counts=True)
            counts[place.astype(np.int64)] += n.astype(np.int32)
        parts = counts.reshape(-1, PART)
        used = np.flatnonzero(parts.any(axis=1)).tolist()
        for i in range(0, len(used), 64):
            some = used[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[p].tobytes() for p in some], pa.binary())], ["part", "counts"])

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counters of each part, as rows come, and keeps a byte of each: the count up to 63, then by its logarithm."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for p, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            total[p] = total.get(p, 0) + np.frombuffer(c.as_buffer(), np.int32).astype(np.int64)
    level = [np.where(c < 64, c, np.minimum(255, 64 + 6 * (np.log2(np.maximum(c, 64)) - 6)).astype(np.int64)).astype(np.uint8).tobytes() for c in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(level, pa.binary())], ["part", "levels"])


def _prefixes(num: int, den: int, level: np.ndarray):
    shift = np.uint64(64 - (len(level) - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, sigs = [], []
            for s, u in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                u = u.values.to_numpy()
                n = len(u)
                first = np.argsort(level[(u.view(np.uint64) >> shift).astype(np.int64)], kind="stable")
                tokens.append(u[first[: n + num * n // -den + 1]])
                sigs.append(s)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array(sigs, np.int64), [len(t) for t in tokens]))], ["token", "sig"])

    return run


def _filter_bits(bits: int):
    """The filter's bits that rows of (sig) set, in parts of 2 ** 17."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            for p in np.unique(at >> np.uint64(17)).tolist():
                held.setdefault(p, np.zeros(1 << 17, bool))[(at[at >> np.uint64(17) == p] & np.uint64((1 << 17) - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["part", "bits"])

    return run


def _filter(covered: DataFrame) -> np.ndarray | None:
    """A bit for the leading bits of each name in the stored table; none if there are too many names for it to help."""
    bits = max(FILTER_BITS[0], (16 * covered.count() - 1).bit_length())
    if bits > FILTER_BITS[1]:
        return None
    out = np.zeros(1 << bits >> 3, np.uint8)
    for part, marks in covered.repartition(16, F.shiftrightunsigned("sig", 58)).mapInArrow(_filter_bits(bits), "part int, bits binary").collect():
        out[part << 14 : (part + 1) << 14] |= np.frombuffer(marks, np.uint8)
    return out


def _wanted_sets(k: int, wanted: np.ndarray | None, shared: frozenset[int]):
    shift = 64 - (8 * len(wanted) - 1).bit_length() if wanted is not None else 0

    def asked(s: int) -> bool:
        at = (s + (1 << 64) & (1 << 64) - 1) >> shift
        return bool(wanted[at >> 3] & 128 >> (at & 7))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, _, sets in _doc_sets(batches, k):
            out = []
            for u in sets:
                if len(u) and (s := _signature(u, shared)[0]) not in seen and (wanted is None or asked(s)):
                    seen.add(s)
                    out.append((s, u.astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([u for _, u in out], pa.list_(pa.int64()))], ["sig", "tokens"])

    return run


def divide_skip(query: list[int], index: dict[int, list[int]], least: int, mu: float = 0.01) -> Iterator[tuple[int, int]]:
    """(id, occurrences) of every id that stands in at least `least` of the query's inverted lists (ids ascending).

    The longest lists are left aside; the others are merged with a heap, and an id that could still get enough is looked
    up in the long ones by binary search.
    """
    lists = sorted((index[t] for t in query if t in index), key=len)
    if len(lists) < least:
        return
    aside = min(least - 1, int(least / (mu * np.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    for i, same in groupby(heapq.merge(*short)):
        n = sum(1 for _ in same)
        if n < least - aside:
            continue
        for left, x in zip(range(len(long), 0, -1), long, strict=True):
            if n + left < least:
                break
            at = bisect_left(x, i)
            n += at < len(x) and x[at] == i
        else:
            if n >= least:
                yield i, n


class _Union:
    def __init__(self, labels: list[int]):
        self.up = list(range(len(labels)))
        first: dict[int, int] = {}
        for i, x in enumerate(labels):
            if x >= 0:
                self.up[i] = first.setdefault(x, i)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def links_in_block(members: list[tuple[int, np.ndarray, int]], queries: list[tuple[int, np.ndarray]], num: int, den: int) -> list[tuple[int, int]]:
    """Links between queries (name, tokens) and members (name, tokens, label), enough of them to connect what all links
    connect. Members of the same label >= 0 are connected already."""
    index: dict[int, list[int]] = {}
    for i, (_, tokens, _) in enumerate(members):
        for t in tokens.tolist():
            index.setdefault(t, []).append(i)
    place = {name: i for i, (name, _, _) in enumerate(members)}
    names = [m[0] for m in members] + [q[0] for q in queries if q[0] not in place]
    label = [m[2] for m in members] + [-1] * (len(names) - len(members))
    where = {name: i for i, name in enumerate(names)}
    union, out = _Union(label), []
    for name, tokens in queries:
        me, n = where[name], len(tokens)
        for i, both in divide_skip(tokens.tolist(), index, -(-num * n // den)):
            if i != me and den * both >= num * (n + len(members[i][1]) - both):
                a, b = union.root(me), union.root(i)
                if a != b:
                    union.up[max(a, b)] = min(a, b)
                    out.append((name, names[i]))
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many of a's tokens b has too, both ascending without repetition."""
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


def _in_block(num: int, den: int):
    """Links within a block of a group: of its rows with the pivot, then of the rows not linked to it with the block.
    For groups of several blocks also each row's state, as (sig, null)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["copy", "sig"], ascending=[False, True]).drop_duplicates("sig")
        pivot, pivot_tokens = next(((s, t) for s, t, p in zip(pdf["sig"], pdf["tokens"], pdf["copy"], strict=True) if p))
        rows, found = [], []
        for s, t in zip(pdf["sig"], pdf["tokens"], strict=True):
            both = _common(t.view(np.uint64), pivot_tokens.view(np.uint64))
            linked = den * both >= num * (len(t) + len(pivot_tokens) - both)
            rows.append((s, t, 0 if linked else -1))
            if linked and s != pivot:
                found.append((s, pivot))
        asking = [(s, t) for s, t, x in rows if x < 0]
        if asking:
            found += links_in_block(rows, asking, num, den)
        if len(rows) > 100:
            trim()
        states = [(s, x == 0) for s, _, x in rows] if pdf["several"].iloc[0] else []
        return pd.DataFrame({"root": pdf["root"].iloc[0], "a": pd.array([x for x, _ in found] + [s for s, _ in states], "Int64"), "b": pd.array([x for _, x in found] + [None] * len(states), "Int64"), "linked": [True] * len(found) + [x for _, x in states]})

    return run


def _across(num: int, den: int):
    """Links between the rows of one block and rows of others that are not linked to the pivot."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["sig"], pdf["tokens"], pdf["linked"], pdf["asks"], strict=True))
        found = links_in_block([(s, t, 0 if x else -1) for s, t, x, q in rows if not q], [(s, t) for s, t, _, q in rows if q], num, den)
        return pd.DataFrame({"a": [x for x, _ in found], "b": [x for _, x in found]}, dtype="int64")

    return run


def _dealt_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows by the keys in as many parts as the session's shuffles have: searching takes time out of proportion to bytes, so small
    parts are not put together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class _Links:
    """What both operators share: rows (doc_id, k1, k2, n, sig) of the documents, stored, and the names of sets with their roots."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str):
        k1, k2 = row_keys(id_col, text_col)
        src = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
        self.k, self.num, self.den, self.shared = k, num, den, frozenset()
        while True:
            self.rows = cut(src.mapInArrow(trimmed(_signed(k, self.shared)), "doc_id bigint, k1 bigint, k2 bigint, n bigint, sig bigint, chk bigint"))
            named = self.rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first"), F.min("chk").alias("lo"), F.max("chk").alias("hi"))
            self.names = cut(named)
            more = {r[0] for r in self.names.where("lo <> hi").select("sig").limit(RENAMED + 1).collect()}
            if len(more) > RENAMED:
                raise ValueError("more sets share a name than chance can explain")
            if not more:
                break
            self.shared |= more
        links = self._search(src.select("text"))
        roots = components(links).select(F.col("node").alias("sig"), "root")
        self.roots = cut(self.names.join(roots, "sig", "left").select("sig", "first", F.coalesce("root", "sig").alias("root")))

    def _sets(self, texts: DataFrame) -> DataFrame:
        """(sig, tokens, n) of the sets of which enough occurs elsewhere."""
        k, num, den, shared = self.k, self.num, self.den, self.shared
        # as many ranges as keep a range's share of the fingerprints small at any size of the input
        bits = min(24, max(5, (2 * texts._jdf.rdd().getNumPartitions() - 1).bit_length()))
        dealt = texts.mapInArrow(trimmed(_dealt(k, bits, shared)), "chunk bigint, part bigint, prints binary, docs binary, counts binary")
        found = dealt.groupBy("part").applyInArrow(_repeated, "chunk bigint, names binary, sizes binary, docs binary, found binary")
        covered = cut(found.groupBy("chunk").applyInArrow(_covered(num, den), "sig bigint").distinct())
        sets = texts.mapInArrow(trimmed(_wanted_sets(k, _filter(covered), shared)), "sig bigint, tokens array<bigint>")
        sets = sets.join(small(covered), "sig", "left_semi").groupBy("sig").agg(F.first("tokens").alias("tokens"))
        return cut(sets.withColumn("n", F.size("tokens").cast("long")))

    def _search(self, texts: DataFrame) -> DataFrame:
        """(a, b): enough links between names to connect what all links connect."""
        num, den, sets = self.num, self.den, self._sets(texts)
        bits = min(max(SKETCH_BITS[0], int(sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] >> 3).bit_length()), SKETCH_BITS[1])
        level = np.zeros(1 << bits, np.uint8)
        for part, levels in sets.select("tokens").mapInArrow(trimmed(_sketch(bits)), "part int, counts binary").repartition(64, "part").mapInArrow(_levels, "part int, levels binary").collect():
            level[part * PART : (part + 1) * PART] = np.frombuffer(levels, np.uint8)
        posts = cut(sets.select("sig", "tokens").mapInArrow(trimmed(_prefixes(num, den, level)), "token bigint, sig bigint"))
        hubs = posts.groupBy("token").agg(F.min("sig").alias("hub"), F.max("sig").alias("other")).where("hub <> other").select("token", "hub")
        edges = join_hot(posts, hubs, "token").groupBy("sig", "hub").agg(F.count("*").alias("common"))
        sized = cut(edges.join(sets.select("sig", "n"), "sig").select("sig", F.col("hub").alias("root"), "common", "n"))
        # Groups, their pivots and blocks, from small rows; the pivot has the most in common with the hub: in a family of near
        # copies, one with few changes. A copy of it goes into every block.
        near = F.struct((F.col("sig") != F.col("root")).alias("other"), "common", "n", "sig")
        blocks = lambda rows, tokens: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(tokens / BLOCK_TOKENS)).cast("int")
        groups = sized.groupBy("root").agg(F.max(near).alias("best"), F.count("*").alias("m"), F.sum("n").alias("tokens")).where("m > 1")
        groups = cut(groups.select("root", F.col("best.sig").alias("pivot"), (blocks(F.col("m"), F.col("tokens")) > 1).alias("several")))
        # sets that link differ in size by at most den / num: they are in the same band or in neighbouring ones
        band = F.when(F.col("several"), F.floor(F.log(F.col("n").cast("double")) / max(1e-9, math.log(den / num) * (1 + 1e-9)))).otherwise(0).cast("long")
        placed = cut(join_hot(sized, groups, "root").select("sig", "root", "several", "n", "pivot", band.alias("band")))
        bands = cut(placed.groupBy("root", "band", "several", "pivot").agg(blocks(F.count("*"), F.sum("n")).alias("subs")).withColumn("subs", F.when(F.col("several"), F.col("subs")).otherwise(1)))
        wide = bands.where("subs > 1").select("root", "band", "subs")
        placed = placed.join(small(cut(wide)), ["root", "band"], "left").withColumn("sub", F.pmod(F.xxhash64("sig"), F.coalesce("subs", F.lit(1))).cast("int"))
        placed = placed.select("sig", "root", "several", "band", "sub", F.lit(False).alias("copy"))
        copies = bands.select(F.col("pivot").alias("sig"), "root", "several", "band", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.lit(True).alias("copy"))
        placed = cut(placed.unionByName(copies))
        by = ["root", "band", "sub"]
        first = cut(_dealt_by(sets.join(placed, "sig"), by).groupBy(*by).applyInPandas(_in_block(num, den), "root bigint, a bigint, b bigint, linked boolean"))
        links = first.where("b is not null").select("a", "b")
        return links.union(self._between_blocks(sets, placed.where("several and not copy").drop("several", "copy"), first.where("b is null"), bands.where("several").select("root", "band", "subs")))

    def _between_blocks(self, sets: DataFrame, members: DataFrame, states: DataFrame, bands: DataFrame) -> DataFrame:
        """Links across the blocks of a large group: rows not linked to the pivot ask the other blocks of their band and the two beside it."""
        states = states.groupBy(F.col("root"), F.col("a").alias("sig")).agg(F.max("linked").alias("linked"))
        members = cut(members.join(states, ["root", "sig"]))
        asking = members.where("not linked").groupBy("root", "band").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
        beside = lambda df, to: df.withColumn(to, F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
        # a task is a block that is asked (band, sub) and a part of the rows that ask (from, part)
        asked = beside(members, "from").join(asking.withColumnRenamed("band", "from"), ["root", "from"])
        asked = asked.select("root", "sig", "linked", F.lit(False).alias("asks"), "band", "sub", "from", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        asks = beside(members.where("not linked").join(asking, ["root", "band"]), "to").join(bands.withColumnRenamed("band", "to"), ["root", "to"])
        asks = asks.withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).where("_to <> sub or to <> band")
        asks = asks.select("root", "sig", "linked", F.lit(True).alias("asks"), F.col("to").alias("band"), F.col("_to").alias("sub"), F.col("band").alias("from"), F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int").alias("part"))
        rows = sets.join(asked.unionByName(asks), "sig")
        by = ["root", "band", "sub", "from", "part"]
        return _dealt_by(rows, by).groupBy(*by).applyInPandas(_across(self.num, self.den), "a bigint, b bigint")


def shingle_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included) for each row of docs.

    Two rows link when their sets of distinct k-word shingles have a Jaccard similarity of at least num / den. A text of
    fewer words is one shingle; one without words, or null, has an empty set, links with nothing and is its own component.
    Rows may repeat (they link); a null doc_id is passed over for the smallest; an empty table gives no rows; other columns are not read.
    A text of n words takes some 40 n bytes of a worker.
    """
    found = _Links(docs, k, num, den, id_col, text_col)
    least = found.roots.groupBy("root").agg(F.min("first").alias("component_id"))
    of_sig = join_hot(found.roots, least, "root").select("sig", "component_id")
    out = join_hot(found.rows, of_sig, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id (null last), of rows of one doc_id any one.

    Rows, not ids, are decided on: rows that share a doc_id, or have none, stay if nothing links them. Rows without words link with nothing, so all stay.
    """
    found = _Links(docs, k, num, den, id_col, text_col)
    rows = cut(join_hot(found.rows.where("n > 0"), found.roots.select("sig", "root"), "sig").select("doc_id", "k1", "k2", "root"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("b")).select("root", F.col("b.k1").alias("b1"), F.col("b.k2").alias("b2"))
    lost = cut(join_hot(rows, best, "root").where("k1 <> b1 or k2 <> b2").select("k1", "k2").distinct())
    out = without(docs, lost, id_col, text_col)
    again = rows.groupBy("k1", "k2").agg(F.count("*").alias("c")).where("c > 1").select("k1", "k2")
    again = cut(again.join(lost, ["k1", "k2"], "left_anti"))
    if again.isEmpty():
        return out
    a, b = unused(docs, "_k1", "_k2")
    k1, k2 = row_keys(id_col, text_col)
    repeated = docs.withColumns({a: k1, b: k2}).join(small(again.select(F.col("k1").alias(a), F.col("k2").alias(b))), [a, b], "left_semi")
    return without(out, again, id_col, text_col).unionByName(repeated.dropDuplicates([a, b]).drop(a, b))
