"""Best-fit packing of token pieces into sequences, after Martello and Toth's dominance reduction.

Documents are tokenised and cut into pieces in a stored table. Only the number of pieces of each length (one count
for each possible length) goes to the driver, where whole runs of equal pieces are planned at once; the plan says
which ranks of a length go to which sequences, and every piece finds its place from its rank.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bounded, cut, rank_in
from .words import LOWER, SLICE_BYTES, cuts, slices, text_bytes, trimmed, words

END_ID = 1
CACHE_WORDS = 600_000  # distinct words whose ids a Python worker keeps; beyond, it starts afresh


@lru_cache(4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins words across white space: each distinct word is encoded once.

    Words are runs without ASCII white space, with A-Z lowered as the tokenizer itself does, and with one `.` or `,` after an ASCII
    letter as a word of its own. A capital before a non-ASCII byte stays: the tokenizer composes marks (NFC) before it lowers, and some
    compose with the small letter only. A text with `<|` may hold a special token and is encoded as it is.
    """

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids: list[np.ndarray] = []
        for i in range(0, len(texts), 20_000):
            some = texts[i : i + 20_000]
            # one text, so that the call's cost is shared; a token's end says which word it belongs to
            e = self.tok.encode("\n".join(some), add_special_tokens=False)
            ends = np.cumsum([len(x) + 1 for x in some])
            which = np.searchsorted(ends, [a for a, _ in e.offsets], "right")
            ids += np.split(np.array(e.ids, np.uint32), np.searchsorted(which, np.arange(1, len(some))))
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self._clear()
        count = np.array([len(x) for x in ids], np.int64)
        at = np.cumsum(count) - count + len(self.flat)
        self.flat = np.concatenate([self.flat, *ids])
        spot = np.searchsorted(self.keys, keys)  # keys are in order
        self.keys, self.at, self.count = np.insert(self.keys, spot, keys), np.insert(self.at, spot, at), np.insert(self.count, spot, count)

    def __call__(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each row. A long row is read range by range, cut at white space, which no token goes over."""
        if len(at) != 2 or at[-1] <= 2 * SLICE_BYTES:
            return self._ids(data, at)
        return [np.concatenate([self._ids(data[a:b], np.array([0, b - a]))[0] for a, b in cuts(data, 0, int(at[-1]))])]

    def _ids(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        marked = np.zeros(len(data), bool)
        marked[:-1] = data[1:] >= 128
        w = words(np.where(marked, data, LOWER[data]), at, lower=False)
        last = w.data[w.ends - 1] if len(w.ends) else w.data[:0]
        before = w.data[np.maximum(w.ends - 2, 0)]
        split = ((last == 46) | (last == 44)) & (w.ends - w.starts > 1) & (before >= 97) & (before <= 122)
        starts = np.concatenate([w.starts, w.ends[split] - 1])
        ends = np.concatenate([w.ends - split, w.ends[split]])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        keys, first, inverse = np.unique(w.range_hash(starts, ends), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(spot, len(self.keys) - 1)] == keys
        if not known.all():
            fresh = len(self.keys) + int((~known).sum()) > CACHE_WORDS
            new = np.arange(len(keys)) if fresh else np.flatnonzero(~known)
            raw = w.data.tobytes()
            if fresh:
                self._clear()
            self._learn(keys[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            spot = np.searchsorted(self.keys, keys)
        count = self.count[spot][inverse]
        done = np.cumsum(count)
        flat = self.flat[np.repeat(self.at[spot][inverse] - done + count, count) + np.arange(int(done[-1]) if len(done) else 0)]
        edge = np.concatenate([[0], done])[np.searchsorted(starts, at)]
        out = np.split(flat, edge[1:-1])
        marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        for r in np.unique(np.searchsorted(at, marks, "right") - 1) if len(marks) else []:
            text = data[at[r] : at[r + 1]].tobytes().decode()
            out[r] = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
        return out


@lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, with the words it has seen."""
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids. A document's ids end with id 1, so an empty or null text has one."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(tokenizer)
        for b in batches:
            data, at = text_bytes(b.column(1))
            for i, j in slices(at):
                rows, piece, start, length, crc, kept = [], [], [], [], [], []
                for r, ids in enumerate(tok(data[at[i] : at[j]], at[i : j + 1] - at[i]), i):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for p in range(0, len(ids), capacity):
                        part = ids[p : p + capacity]
                        rows.append(r)
                        piece.append(p // capacity)
                        start.append(p)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            kept.append(part.astype(np.int64))
                cols = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.list_(pa.int64()))] if with_ids else [])], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return bounded(docs).select(id_col, text_col).mapInArrow(trimmed(cut_up), schema)


class Plan:
    """Rows (length, first rank, ranks, first sequence, copies in each sequence, offset of the first copy)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.rows = capacity, []
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.used = dict.fromkeys(self.count, 0)
        self.sequences = 0
        self.fixed = self._reduce()
        self._best_fit()

    def _place(self, size: int, n: int, sequence: int, per: int, offset: int) -> None:
        self.rows.append((size, self.used[size], n, sequence, per, offset))
        self.used[size] += n
        self.count[size] -= n

    def _fix(self, sizes: tuple[int, ...], n: int) -> None:
        """n sequences, each of one piece of each of these lengths."""
        at = 0
        for s in sizes:
            self._place(s, n, self.sequences, 1, at)
            at += s
        self.sequences += n

    def _reduce(self) -> int:
        """Dominance reduction: sequences that some best packing has. For the longest piece s left, with room r beside it:
        nothing fits: {s}; a piece fills r: {s, r}; only one more can fit: s with the longest t that fits; at most two more
        can fit, and t is as long as any two that fit: {s, t}. Otherwise s stays for best fit. In each case whatever else could
        stand beside s can take the place of t, so the set is in some best packing."""
        left = sorted(self.count)
        for s in reversed(sorted(self.count)):
            while self.count[s]:
                room, n = self.capacity - s, self.count[s]
                self.count[s] -= 1  # the piece itself; it may pair with another of its length
                while left and not self.count[left[0]] and left[0] != s:
                    left.pop(0)
                small = self._smallest(left, 3)
                t = self._longest(left, room)
                self.count[s] += 1
                if t is None:
                    self._fix((s,), n)
                    continue
                pairs = n // 2 if t == s else min(n, self.count[t])
                if t == room or sum(small[:2]) > room or (len(small) < 2):
                    self._fix((s, t), pairs)
                elif (len(small) < 3 or sum(small) > room) and t >= self._best_pair(left, s, room):
                    self._fix((s, t), 1)
                else:
                    break
            left = [x for x in left if self.count[x]] if not self.count[s] else left
        return self.sequences

    def _smallest(self, left: list[int], k: int) -> list[int]:
        out: list[int] = []
        for x in left:
            out += [x] * min(self.count[x], k - len(out))
            if len(out) == k:
                break
        return out

    def _longest(self, left: list[int], room: int) -> int | None:
        i = bisect_left(left, room + 1) - 1
        while i >= 0 and not self.count[left[i]]:
            i -= 1
        return left[i] if i >= 0 else None

    def _best_pair(self, left: list[int], s: int, room: int) -> int:
        """The largest sum of two pieces beside s that is at most room, or 0."""
        self.count[s] -= 1
        have, best = [x for x in left if self.count[x] and x <= room], 0
        i, j = 0, len(have) - 1
        while i <= j:
            total = have[i] + have[j]
            if total > room or (i == j and self.count[have[i]] < 2):
                j -= 1
            else:
                best = max(best, total)
                i += 1
        self.count[s] += 1
        return best

    def _best_fit(self) -> None:
        """Best fit, longest first, a whole run of open sequences with the same room at a time."""
        room_of: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, sequences)
        rooms: list[int] = []

        def leave(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in room_of:
                    insort(rooms, room)
                room_of.setdefault(room, []).append((first, n))

        for s in sorted(self.count, reverse=True):
            while self.count[s]:
                n, i = self.count[s], bisect_left(rooms, s)
                if i == len(rooms):
                    room, per = self.capacity, self.capacity // s
                    first, have = self.sequences, -(-n // per)
                    self.sequences += have
                else:
                    room = rooms[i]
                    per = room // s
                    first, have = room_of[room].pop()
                    if not room_of[room]:
                        del room_of[room]
                        rooms.pop(i)
                full = min(have, n // per)
                if full:
                    self._place(s, full * per, first, per, self.capacity - room)
                    leave(room - per * s, first, full)
                rest = min(n - full * per, per) if full < have else 0
                if rest:
                    self._place(s, rest, first + full, rest, self.capacity - room)
                    leave(room - rest * s, first + full, 1)
                leave(room, first + full + bool(rest), have - full - bool(rest))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces(doc_id, piece, start, length, ids_crc32, ...): adds sequence_id and offset. pieces must be a stored table; a column
    _row that tells its rows apart keeps equal rows from being ranked by one task, and is dropped."""
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    plan = Plan(counts, capacity)
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)
    key = rows[:, 0] << 40 | rows[:, 1]
    own = [c for c in pieces.columns if c == "_row"]
    ranked = rank_in(pieces, "length", ["doc_id", "piece", "start", "ids_crc32", *own], "rank").drop(*own)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            p = rows[np.searchsorted(key, size << 40 | rank, "right") - 1] if len(rows) else np.zeros((len(rank), 6), np.int64)
            nth = rank - p[:, 1]
            per = np.maximum(p[:, 4], 1)
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(p[:, 3] + nth // per), pa.array(p[:, 5] + nth % per * size)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row; the sequences' offsets are gapless.

    Null text counts as empty; ids may be null or repeated; an empty table gives no rows; other columns are not read.
    """
    return pack(cut(token_pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())), capacity)
