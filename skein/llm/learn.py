"""What the classifiers share: bounded labelled samples, deterministic folds, and scoring of whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import BROADCAST_ROWS, bounded
from .words import trimmed


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def sample(rows: DataFrame, label: str, values: list, per_class: int) -> DataFrame:
    """At most per_class of the rows of each label, those whose doc_id hashes lowest; for learning only. Each task offers its own lowest."""
    each = [rows.where(F.col(label) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in values]
    return reduce(DataFrame.union, each)


def _within(rows: DataFrame, most_bytes: int) -> DataFrame:
    """(doc_id, y) of the sampled rows(doc_id, y, text), drawn in the sample's order until their class has most_bytes of text.

    Rows count whole, whatever their length, so long rows make the sample smaller, not shorter."""
    sizes = rows.groupBy("doc_id", "y").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).withColumn("h", F.xxhash64("doc_id")).collect()
    have, drawn = {0: 0, 1: 0}, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if have[r["y"]] < most_bytes:
            have[r["y"]] += r["n"]
            drawn.append((r["doc_id"], r["y"]))
    return rows.sparkSession.createDataFrame(drawn, rows.select("doc_id", "y").schema)


def labelled_split(docs: DataFrame, labels: DataFrame, label: str, folds: int, test_fold: int, per_class: int, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Sampled (y, text) for 0/1 labels outside the test fold, all other labelled rows as (doc_id, y, text), and how many labelled
    documents of docs each class has.

    Of repeated labels of a document the largest counts, and of sampled rows that share a doc_id one is read; the others come as they are.
    At most 2 * per_class ids are sampled, so they are broadcast. With most_bytes fewer are drawn where a class's texts are longer than that together.
    """
    known = labels.where(F.col(label).isin(0, 1) & (fold("doc_id", folds) != test_fold)).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = known.where("doc_id is not null").join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {int(r[0]): int(r[1]) for r in known.groupBy("y").count().collect()}
    ids = sample(known, "y", [0, 1], per_class)
    texts = bounded(docs).select("doc_id", "text")
    if most_bytes is not None:
        ids = _within(one_each(texts.join(F.broadcast(ids), "doc_id"), "doc_id", "y"), most_bytes)
    others = known.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_anti")
    rest = texts.join(F.broadcast(others) if sum(counts.values()) <= BROADCAST_ROWS else others, "doc_id").select("doc_id", "y", "text")
    return one_each(texts.join(F.broadcast(ids), "doc_id"), "doc_id", "y").select("y", "text"), rest, counts


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, test_fold: int, per_class: int, most_bytes: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """labelled_split()'s sample and counts."""
    texts, _, counts = labelled_split(docs, labels, label, folds, test_fold, per_class, most_bytes)
    return texts, counts


def one_each(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the rows that share the keys the one whose text hashes lowest; tasks offer their own lowest."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def add_scores(rows: DataFrame, text: str, score: Callable[[pa.Array], list[pa.Array]], fields: list[T.StructField], keep: Callable[[list[pa.Array]], np.ndarray] | None = None) -> DataFrame:
    """rows with what score() makes of each batch's texts in place of the text and of columns named like that (whatever their case).
    With keep: rows as they are, those it says only."""
    made_too = {f.name.lower() for f in fields}
    left = [f for f in rows.schema if f.name != text and f.name.lower() not in made_too]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            made = score(b.column(b.schema.get_field_index(text)))
            if keep:
                good = pa.array(keep(made))
                for i in range(0, b.num_rows, 1000):
                    yield b.slice(i, 1000).filter(good.slice(i, 1000))
            else:
                own = [f.name for f in left]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in own), *made], [*own, *(f.name for f in fields)])

    bounded(rows)
    if keep:
        return rows.mapInArrow(trimmed(run), rows.schema)
    return rows.mapInArrow(trimmed(run), T.StructType(left + fields))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit of y to the margin, lightly held to small slopes; Newton steps."""
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)])
    for _ in range(50):
        p = sigmoid(a * margin + b)
        g = x @ (weight * (p - y)) + np.array([1e-2 * a, 1e-3 * b])
        h = (x * (weight * p * (1 - p))) @ x.T + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-6:
            break
    return a, b

