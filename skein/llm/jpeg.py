"""Progressive JPEG: scans accumulate into coefficient arrays; numpy does the inverse transform.

`decode` takes any 8-bit progressive Huffman JPEG of one or three components with sampling factors 1 or 2, of at most PIXELS pixels and without
restart intervals: spectral selection, successive approximation, end-of-band runs, interleaved DC scans. `encode_bytes` stores any
bytes losslessly as quantised coefficients, one byte in each: byte b is the coefficient 256 + b, sent as the top
seven bits in first scans (one spectral band 1-31, one 32-63) and the last two bits in refinement scans. All its
codes of one kind have the same length with their extra bits, so it and `decode` can treat whole scans as arrays.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

UNIT = 576
PIXELS = 1 << 26
#: The zigzag order of an 8 x 8 block (place in the block of each coefficient).
ZIGZAG = np.array([k for _, _, k in sorted((r + c, (r if (r + c) % 2 else c), r * 8 + c) for r in range(8) for c in range(8))])
_T = np.array([[(0.5 if u else 0.5 / 2**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)], np.float32)
#: pixels = coefficients in zigzag order @ IDCT
IDCT = np.einsum("xu,yv->uvxy", _T, _T).reshape(64, 64)[ZIGZAG].astype(np.float32)

# Tables of encode_bytes: symbol -> code length; codes follow in the order of length, then symbol.
_DC = {7: 2, 6: 3, 5: 4, 4: 5, 3: 6, 2: 7, 1: 8, 0: 9}
_AC = {7: 1}
_AC_REFINE = {**{n << 4: 4 for n in range(14)}, 0xE0: 4}


@lru_cache(64)
def _codes(lengths: tuple[tuple[int, int], ...]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol -> (code, length)."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths, key=lambda x: x[1]):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


def _dht(kind: int, ident: int, lengths: dict[int, int]) -> bytes:
    ordered = sorted(lengths.items(), key=lambda x: x[1])
    counts = bytes(sum(n == i for _, n in ordered) for i in range(1, 17))
    body = bytes([kind << 4 | ident]) + counts + bytes(s for s, _ in ordered)
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


def _sos(parts: list[tuple[int, int, int]], ss: int, se: int, ah: int, al: int) -> bytes:
    return b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(parts), len(parts)) + b"".join(bytes([c, d << 4 | a]) for c, d, a in parts) + bytes([ss, se, ah << 4 | al])


def _stuff(x: bytes) -> bytes:
    return x.replace(b"\xff", b"\xff\x00")


def _pad(bits: np.ndarray) -> bytes:
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def _dc_words() -> np.ndarray:
    """Nine bits for each difference from -127 to 127: the code of its size, then its extra bits."""
    codes, out = _codes(tuple(_DC.items())), np.zeros((255, 9), np.uint8)
    for d in range(-127, 128):
        n = abs(d).bit_length()
        code, length = codes[n]
        word = code << n | (d if d > 0 else d + (1 << n) - 1)
        out[d + 127] = [word >> i & 1 for i in range(8, -1, -1)]
    return out


_DC_WORDS = _dc_words()
_HEAD = b"\xff\xd8\xff\xdb\x00\x43\x00" + b"\x01" * 64
_TABLES = _dht(0, 0, _DC) + _dht(1, 0, _AC) + _dht(1, 1, _AC_REFINE)


def layout(n: int) -> tuple[int, int]:
    """Rows and columns of 16 x 16 pixel units that hold n coefficients (384 in a unit)."""
    units = -(-n // 384)
    cols = max(1, int(np.ceil(np.sqrt(units))))
    return -(-units // cols), cols


def pad(data: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of 576."""
    return data + b"\xff" * (UNIT if not data else -len(data) % UNIT)


def encode_bytes(payload: bytes) -> bytes:
    """A progressive JPEG (YCbCr, 4:2:0) with the bytes in its coefficients; a comment segment holds their number."""
    rows, cols = layout(len(payload))
    if max(rows, cols) > 4095:
        raise ValueError("too long for one image")
    units = rows * cols
    c = np.full(units * 384, 255, np.uint8)
    c[: len(payload)] = np.frombuffer(payload, np.uint8)
    # Coefficients lie component after component, in each block after block in scan order.
    y, cb, cr = c[: units * 256].reshape(-1, 64), c[units * 256 : units * 320].reshape(-1, 64), c[units * 320 :].reshape(-1, 64)
    out = [_HEAD, b"\xff\xfe" + struct.pack(">HQ", 10, len(payload)), b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]), _TABLES]
    order = _unit_order(rows, cols)
    dc = [y[order, 0].reshape(units, 4), cb[:, :1], cr[:, :1]]
    top = [64 + (x >> 2).astype(np.int16) for x in dc]
    diff = np.concatenate([np.diff(x.reshape(-1), prepend=np.int16(0)).reshape(x.shape) for x in top], axis=1).reshape(-1)
    out += [_sos([(1, 0, 0), (2, 0, 0), (3, 0, 0)], 0, 0, 0, 2), _stuff(_pad(_DC_WORDS[diff + 127].reshape(-1)))]
    low = np.concatenate(dc, axis=1).reshape(-1)
    for al in (1, 0):
        out += [_sos([(1, 0, 0), (2, 0, 0), (3, 0, 0)], 0, 0, al + 1, al), _stuff(_pad(low >> al & 1))]
    for i, x in enumerate((y, cb, cr), 1):
        first = x >> 2 | 64
        for ss, se in ((1, 31), (32, 63)):
            out += [_sos([(i, 0, 0)], ss, se, 0, 2), first[:, ss : se + 1].tobytes()]
        for al in (1, 0):
            out += [_sos([(i, 0, 1)], 1, 63, al + 1, al), _stuff(_refinement(x[:, 1:] >> al & 1))]
    return b"".join([*out, b"\xff\xd9"])


@lru_cache(256)
def _unit_order(rows: int, cols: int) -> np.ndarray:
    """Blocks of a 2 x 2 component (row after row) in the order of the interleaved units."""
    return np.arange(rows * cols * 4).reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(-1)


def _refinement(bits: np.ndarray) -> bytes:
    """A refinement scan over blocks whose coefficients are all nonzero: end-of-band runs, each followed by one bit for each coefficient."""
    codes, parts, at = _codes(tuple(_AC_REFINE.items())), [], 0
    while at < len(bits):
        run = min(32767, len(bits) - at)
        n = run.bit_length() - 1
        code, length = codes[n << 4]
        word = code << n | (run - (1 << n))
        parts += [np.array([word >> i & 1 for i in range(length + n - 1, -1, -1)], np.uint8), bits[at : at + run].reshape(-1)]
        at += run
    return _pad(np.concatenate(parts))


class _Table:
    """A Huffman table: code lookup by (length, code), and what all codes have in common if they are of one length with their extra bits."""

    def __init__(self, lengths: dict[int, int], ac: bool):
        codes = _codes(tuple(sorted(lengths.items(), key=lambda x: x[1])))
        self.symbol = {(n, code): s for s, (code, n) in codes.items()}
        self.longest = max((n for _, n in codes.values()), default=0)
        totals = {n + (s & 15) for s, (_, n) in codes.items()}
        self.stride = totals.pop() if len(totals) == 1 and (not ac or all(s >> 4 == 0 and s & 15 for s in codes)) else 0
        if 0 < self.stride <= 12:
            self.value = np.full(1 << self.stride, 1 << 20, np.int32)
            for s, (code, n) in codes.items():
                k = s & 15
                extra = np.arange(1 << k)
                self.value[(code << k) + extra] = np.where(extra >= (1 << k >> 1), extra, extra - (1 << k) + 1) if k else 0
        else:
            self.stride = 0


class _Bits:
    def __init__(self, data: bytes):
        self.raw = np.frombuffer(data, np.uint8)
        self.bits: np.ndarray | None = None
        self.at = 0

    def all(self) -> np.ndarray:
        if self.bits is None:
            self.bits = np.unpackbits(self.raw)
        return self.bits

    def take(self, n: int) -> int:
        b, v = self.all(), 0
        for x in b[self.at : self.at + n].tolist():
            v = v << 1 | x
        self.at += n
        return v

    def many(self, n: int) -> np.ndarray:
        self.at += n
        return self.all()[self.at - n : self.at]

    def code(self, table: _Table) -> int:
        b, v, at = self.all(), 0, self.at
        for n in range(1, table.longest + 1):
            v = v << 1 | int(b[at + n - 1])
            if (s := table.symbol.get((n, v))) is not None:
                self.at = at + n
                return s
        raise ValueError("bad code")

    def strided(self, table: _Table, count: int) -> np.ndarray | None:
        """count values of a table whose codes have one length, or None."""
        if not table.stride or self.at:
            return None
        if table.stride == 8:
            words = self.raw[:count]
        else:
            b = self.all()[: count * table.stride].reshape(count, table.stride)
            words = b @ (1 << np.arange(table.stride - 1, -1, -1)).astype(np.int32)
        v = table.value[words]
        if len(v) < count or (len(v) and v.max() == 1 << 20):
            return None
        self.at = count * table.stride
        return v


def _signed(v: int, n: int) -> int:
    return v if not n or v >> (n - 1) else v - (1 << n) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, h, v, quant
        self.rows = self.cols = self.used_rows = self.used_cols = 0
        self.coef = np.zeros((0, 64), np.int16)


def _dc_scan(bits: _Bits, comps: list[Component], tables: list[_Table], ah: int, al: int, units: tuple[int, int]) -> None:
    single = len(comps) == 1
    if single:
        c = comps[0]
        orders = [(np.arange(c.used_rows)[:, None] * c.cols + np.arange(c.used_cols)).reshape(-1, 1)]
    else:
        orders = [(np.arange(units[0] * c.v * units[1] * c.h).reshape(units[0], c.v, units[1], c.h).transpose(0, 2, 1, 3)).reshape(units[0] * units[1], -1) for c in comps]
    width = sum(o.shape[1] for o in orders)
    count = len(orders[0]) * width
    if ah:
        got = bits.many(count).astype(np.int16).reshape(-1, width) << al
        at = 0
        for c, o in zip(comps, orders, strict=True):
            c.coef[o, 0] |= got[:, at : at + o.shape[1]]
            at += o.shape[1]
        return
    diff = bits.strided(tables[0], count) if all(t is tables[0] for t in tables) else None
    if diff is None:
        which = [t for t, o in zip(tables, orders, strict=True) for _ in range(o.shape[1])]
        diff = np.zeros(count, np.int32)
        for i in range(count):
            n = bits.code(which[i % width])
            diff[i] = _signed(bits.take(n), n)
    diff, at = diff.reshape(-1, width), 0
    for c, o in zip(comps, orders, strict=True):
        c.coef[o.reshape(-1), 0] = (np.cumsum(diff[:, at : at + o.shape[1]].reshape(-1)) << al).astype(np.int16)
        at += o.shape[1]


def _ac_scan(bits: _Bits, c: Component, table: _Table, ss: int, se: int, ah: int, al: int) -> None:
    blocks = (np.arange(c.used_rows)[:, None] * c.cols + np.arange(c.used_cols)).reshape(-1)
    width = se - ss + 1
    if not ah and (v := bits.strided(table, len(blocks) * width)) is not None:
        c.coef[blocks, ss : se + 1] = (v.reshape(-1, width) << al).astype(np.int16)
        return
    i, k, one = 0, ss, 1 << al
    while i < len(blocks):
        s = bits.code(table)
        run, size = s >> 4, s & 15
        if not size and run < 15:  # the rest of this block and of `left - 1` more
            left = (1 << run) + (bits.take(run) if run else 0)
            if ah:
                _correct(bits, c, blocks[i : i + 1], k, se, one)
                _correct(bits, c, blocks[i + 1 : i + left], ss, se, one)
            i, k = i + left, ss
            continue
        b = blocks[i]
        if not ah:
            k += run
            if size:
                c.coef[b, k] = _signed(bits.take(size), size) << al
            k += 1
        else:
            new = (one if bits.take(1) else -one) if size else 0
            while k <= se:
                x = int(c.coef[b, k])
                if x:
                    if bits.take(1):
                        c.coef[b, k] = x + (one if x > 0 else -one)
                elif run == 0:
                    c.coef[b, k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if k > se:
            i, k = i + 1, ss


def _correct(bits: _Bits, c: Component, blocks: np.ndarray, ss: int, se: int, one: int) -> None:
    if not len(blocks) or ss > se:
        return
    x = c.coef[blocks, ss : se + 1]
    old = x != 0
    got = bits.many(int(old.sum())).astype(np.int16) * one
    x[old] += np.where(x[old] > 0, got, -got)
    c.coef[blocks, ss : se + 1] = x


class Image:
    """A decoded file: coefficients by component (blocks in zigzag order), size, comments."""

    def __init__(self) -> None:
        self.height = self.width = self.end = 0
        self.comps: list[Component] = []
        self.quant: dict[int, np.ndarray] = {}
        self.comments: list[bytes] = []

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor: uint8 (height, width, 3)."""
        planes = []
        most_h, most_v = max(c.h for c in self.comps), max(c.v for c in self.comps)
        for c in self.comps:
            x = (c.coef * self.quant[c.quant]).astype(np.float32) @ IDCT
            x = x.reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.cols * 8)
            x = np.clip(np.rint(x) + 128, 0, 255)
            if most_v // c.v > 1:
                x = np.repeat(x, most_v // c.v, axis=0)
            if most_h // c.h > 1:
                x = np.repeat(x, most_h // c.h, axis=1)
            planes.append(x[: self.height, : self.width])
        out = np.empty((self.height, self.width, 3), np.float32)
        if len(planes) == 1:
            out[:] = planes[0][..., None]
            return out.astype(np.uint8)
        y, cb, cr = planes
        cb, cr = cb - 128, cr - 128
        out[..., 0] = y + 1.402 * cr
        out[..., 1] = y - 0.344136 * cb - 0.714136 * cr
        out[..., 2] = y + 1.772 * cb
        np.rint(out, out=out)
        return np.clip(out, 0, 255, out=out).astype(np.uint8)


def decode(data: bytes, at: int = 0) -> Image:
    """The image of the progressive JPEG that begins there; ValueError for anything else."""
    try:
        return _decode(data, at)
    except (ArithmeticError, AttributeError, LookupError, StopIteration, TypeError, struct.error) as e:
        raise ValueError("broken JPEG") from e


def decode_all(data: bytes) -> Iterator[Image]:
    """The images that stand one after another, at least one; ValueError if there is anything else."""
    at = 0
    while at < len(data) or not at:
        img = decode(data, at)
        at = img.end
        yield img


def _decode(data: bytes, at: int) -> Image:
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    img, at, tables, units = Image(), at + 2, {}, (0, 0)
    while True:
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        kind = data[at + 1]
        if kind == 0xD9:
            if not img.comps or any(len(img.quant.get(c.quant, ())) != 64 for c in img.comps):
                raise ValueError("no image, or no quantisation table for it")
            img.end = at + 2
            return img
        (n,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                img.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                total = sum(body[1:17])
                lengths, symbols = [i for i in range(1, 17) for _ in range(body[i])], body[17 : 17 + total]
                tables[body[0]] = _table(tuple(zip(symbols, lengths, strict=True)), body[0] >> 4 == 1)
                body = body[17 + total :]
        elif kind == 0xC2:
            bits, img.height, img.width, parts = struct.unpack(">BHHB", body[:6])
            if bits != 8 or parts not in (1, 3) or not 0 < img.height * img.width <= PIXELS:
                raise ValueError("8-bit images of one or three components and a bounded size only")
            img.comps = [Component(c, hv >> 4, hv & 15, q) for c, hv, q in zip(*[iter(body[6:])] * 3, strict=True)]
            if any(c.h not in (1, 2) or c.v not in (1, 2) for c in img.comps):
                raise ValueError("sampling factors 1 and 2 only")
            most_h, most_v = max(c.h for c in img.comps), max(c.v for c in img.comps)
            units = -(-img.height // (8 * most_v)), -(-img.width // (8 * most_h))
            for c in img.comps:
                c.rows, c.cols = units[0] * c.v, units[1] * c.h
                c.used_rows, c.used_cols = -(-(-(-img.height * c.v // most_v)) // 8), -(-(-(-img.width * c.h // most_h)) // 8)
                c.coef = np.zeros((c.rows * c.cols, 64), np.int16)
        elif kind == 0xFE:
            img.comments.append(body)
        elif kind == 0xDD:
            if struct.unpack(">H", body)[0]:
                raise ValueError("restart intervals are not supported")
        elif kind == 0xDA:
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1]:
                    break
                end += 2
            bits, at = _Bits(data[at:end].replace(b"\xff\x00", b"\xff")), end
            parts = [(next(c for c in img.comps if c.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            ss, se, a = body[-3:]
            if ss == 0:
                _dc_scan(bits, [c for c, _ in parts], [tables.get(t >> 4) for _, t in parts], a >> 4, a & 15, units)
            else:
                _ac_scan(bits, parts[0][0], tables[0x10 | parts[0][1] & 15], ss, se, a >> 4, a & 15)
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("not a progressive Huffman JPEG")


@lru_cache(64)
def _table(lengths: tuple[tuple[int, int], ...], ac: bool) -> _Table:
    return _Table(dict(lengths), ac)


def stored_bytes(img: Image) -> bytes:
    """What encode_bytes stored, from the decoded coefficients; ValueError if the image wasn't made by it."""
    if not img.comments or len(img.comments[0]) != 8:
        raise ValueError("no payload")
    (n,) = struct.unpack(">Q", img.comments[0])
    return np.concatenate([c.coef.reshape(-1) for c in img.comps]).astype(np.uint8).tobytes()[:n]
