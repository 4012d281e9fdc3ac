"""Stored media: broken files, several images, pixels against an independent inverse transform."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from skein.llm import jpeg, media


def pixels(img):
    """RGB by the definition: cosine sums in double precision, each chroma sample over its 2 x 2 pixels, the YCbCr equations."""
    at, r, c = [], 0, 0
    for _ in range(64):  # the zigzag walk
        at.append((r, c))
        if (r + c) % 2:
            r, c = (r, c + 1) if r == 7 else (r + 1, max(c - 1, 0))
            c = c if at[-1][1] or r == at[-1][0] else 0
        else:
            r, c = (r + 1, c) if c == 7 else (max(r - 1, 0), c + 1)
    scale = lambda u: 0.5**0.5 if u == 0 else 1.0
    planes = []
    for c in img.comps:
        plane = np.zeros((c.rows * 8, c.cols * 8))
        for b in range(c.rows * c.cols):
            block = np.zeros((8, 8))
            for k in range(64):
                v = int(c.coef[b, k]) * int(img.quant[c.quant][k])
                if v:
                    r, s = at[k]
                    block += v * scale(r) * scale(s) / 4 * np.outer(np.cos((2 * np.arange(8) + 1) * r * np.pi / 16), np.cos((2 * np.arange(8) + 1) * s * np.pi / 16))
            y, x = divmod(b, c.cols)
            plane[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = np.clip(np.round(block) + 128, 0, 255)
        v, h = (max(getattr(o, k) for o in img.comps) // getattr(c, k) for k in ("v", "h"))
        planes.append(plane.repeat(v, 0).repeat(h, 1)[: img.height, : img.width])
    y, cb, cr = planes
    rgb = [y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)]
    return np.clip(np.round(np.stack(rgb, -1)), 0, 255)


@pytest.mark.parametrize("n", [1, 700, 2500])
def test_pixels(n):
    img = jpeg.decode(jpeg.encode_bytes(jpeg.pad(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes())))
    got, want = img.rgb().astype(int), pixels(img)
    assert got.shape == want.shape and np.abs(got - want).max() <= 1 and (got != want).mean() < 0.01


def test_gentle_pixels():
    """Small coefficients, so that few samples are clipped."""
    img, rng = jpeg.decode(jpeg.encode_bytes(jpeg.pad(b"x" * 2000))), np.random.default_rng(1)
    for c in img.comps:
        c.coef[:] = rng.integers(-9, 10, c.coef.shape)
    got, want = img.rgb().astype(int), pixels(img)
    assert np.abs(got - want).max() <= 1 and (got != want).mean() < 0.01 and len(np.unique(got)) > 50


def test_broken_files_are_invalid():
    """Cut off or changed anywhere, a file is decoded or refused, never anything else."""
    good, rng = media.encode(bytes(range(256)) * 3), np.random.default_rng(2)
    tries = [good[:i] for i in range(0, len(good), 3)] + [good + b"x", b"", b"\xff\xd8", b"\xff\xd8\xff\xd9"]
    for _ in range(600):
        i = int(rng.integers(0, len(good)))
        tries.append(good[:i] + bytes([int(rng.integers(0, 256))]) + good[i + 1 :])
    ok = 0
    for t in tries:
        try:
            ok += media._read_back(t, True)[0] >= 0
        except ValueError:
            pass
    assert 0 < ok < len(tries)
    head = good.index(b"\xff\xc2")
    for change in ({5: 255, 6: 255, 7: 255, 8: 255}, {11: 0x33}, {11: 0x41}):  # a huge image, odd sampling factors
        bad = bytearray(good)
        for k, v in change.items():
            bad[head + k] = v
        with pytest.raises(ValueError):
            jpeg.decode(bytes(bad))


def test_long_payloads_are_several_images(monkeypatch):
    monkeypatch.setattr(media, "IMAGE_BYTES", 2 * jpeg.UNIT)
    raw = np.random.default_rng(3).integers(0, 256, 5000, dtype=np.uint8).tobytes()
    stored = media.encode(raw)
    want = jpeg.pad(raw)
    n, digest, tail, size, own, feature, made = media._read_back(stored, True)
    assert (n, digest, tail, size, own) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]), len(stored), hashlib.sha256(stored).hexdigest())
    assert len(made) == 5 and "*5:" in feature and all(len(x["rgb"]) == 3 * x["height"] * x["width"] for x in made)


def test_odd_rows(spark):
    rows = [(None, "a", "m"), (1, None, "m"), (1, "", "m"), (1, "", "m"), (2, "b" * 3000, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = media.decode_media(media.encode_media(docs)).collect()
    assert len(out) == 5 and {r["payload_bytes"] for r in out} == {576, 3456} and len({r["media_sha256"] for r in out if r["doc_id"] == 1}) == 1
    assert media.decode_media(media.encode_media(docs.limit(0))).count() == 0
    broken = spark.createDataFrame([(1, 5, b"\xff\xd8" + struct.pack(">HH", 0xFFC0, 4)), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [(r["feature"], r["tensors"]) for r in media.decode_media(broken).collect()] == [("invalid", None)] * 2
