"""Media columns: bytes stored as progressive JPEGs, read back as coefficients, RGB tensors and features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .tables import bounded

OUT_BYTES = 4 << 20  # a batch of results is handed on at this size
IMAGE_BYTES = 7280 * jpeg.UNIT  # of payload in an image (some 4 MB): a longer text is several images, one after another
TENSORS = "array<struct<height:int,width:int,rgb:binary>>"


def _chunks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def encode(raw: bytes) -> bytes:
    """The stored form: images that hold the bytes, padded, one after another."""
    data = jpeg.pad(raw)
    return b"".join(jpeg.encode_bytes(data[i : i + IMAGE_BYTES]) for i in range(0, len(data), IMAGE_BYTES))


def encode_media(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded), media (progressive JPEGs that hold the text's padded UTF-8 losslessly).

    A null text counts as empty and becomes one unit of padding. Ids may be null or repeated; one row out for each in; an
    empty table gives no rows; other columns are not read. A text takes a few times its bytes of a worker, and 200 MB more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raw = b.column(0), b.column(1)
            for i, j in _chunks(pc.binary_length(raw).to_pylist(), OUT_BYTES):
                data = [x or b"" for x in raw.slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(map(len, data), pa.int64()), pa.array([encode(x) for x in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    src = bounded(rows).select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("raw"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


class _Feature:
    """Size of the first image and the number of images if there are several, mean of each channel and share of dark pixels in thousandths."""

    def __init__(self) -> None:
        self.size, self.images, self.pixels, self.dark, self.sums = "", 0, 0, 0, np.zeros(3, np.int64)

    def add(self, rgb: np.ndarray) -> None:
        self.size = self.size or f"{rgb.shape[0]}x{rgb.shape[1]}"
        self.images += 1
        self.pixels += rgb.shape[0] * rgb.shape[1]
        self.sums += rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
        self.dark += int(np.count_nonzero(rgb[..., 1] < 64))

    def __str__(self) -> str:
        many = f"*{self.images}" if self.images > 1 else ""
        return ":".join([self.size + many, *(str(int(s) * 1000 // self.pixels) for s in self.sums), str(self.dark * 1000 // self.pixels)])


def _read_back(media: bytes, tensors: bool) -> list:
    """What decode_media says of stored media; ValueError if they are broken."""
    digest, n, tail, feature, made = hashlib.sha256(), 0, b"", _Feature(), []
    for img in jpeg.decode_all(media):
        payload, rgb = jpeg.stored_bytes(img), img.rgb()
        digest.update(payload)
        n, tail = n + len(payload), (tail + payload)[-32:]
        feature.add(rgb)
        if tensors:
            made.append({"height": rgb.shape[0], "width": rgb.shape[1], "rgb": rgb.tobytes()})
    return [n, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), str(feature), *([made] if tensors else [])]


def decode_media(media: DataFrame, tensors: bool = True) -> DataFrame:
    """For each row (doc_id, n_bytes, media): payload size and digests, media size and digest, feature, and unless not wanted
    the full-resolution tensors of its images (height, width, RGB as bytes). Null or broken media give nulls and feature `invalid`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for doc, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                m = m.as_py() or b""
                try:
                    row = [doc, n, *_read_back(m, tensors)]
                except ValueError:
                    row = [doc, n, None, None, None, None, None, "invalid", *[None] * (len(names) - 8)]
                held += len(m) * (2 if tensors else 0) + 200
                for o, v in zip(out, row, strict=True):
                    o.append(v)
                if held > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names)
                    out, held = [[] for _ in names], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names)

    src = bounded(media).select("doc_id", "n_bytes", "media")
    schema = [("doc_id", src.schema["doc_id"].dataType.simpleString()), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string"), *([("tensors", TENSORS)] if tensors else [])]
    names = [n for n, _ in schema]
    wide = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "smallint": pa.int16(), "tinyint": pa.int8(), TENSORS: pa.list_(pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())]))}
    types = [wide[t] for _, t in schema]
    return src.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in schema))
