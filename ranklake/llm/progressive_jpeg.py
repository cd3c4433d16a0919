"""Media columns of progressive JPEG: coefficients from all scans, RGB tensors at full resolution, and lossless payloads.

``decode`` reads a progressive JPEG file (8 bits, Huffman coded, one or three components, any sampling factors): each scan
adds its spectral band and approximation bits to the coefficient arrays. Codes are looked up by the next 16 bits. In a first
scan a symbol's length doesn't depend on the coefficients, so the length at every bit is looked up at once, a short loop
follows the chain of symbols, and their values are cut out with numpy. Refinement scans depend on the coefficients and go
symbol by symbol, but for the correction bits of end-of-band runs. ``planes`` applies the inverse transform with whole
numbers held in doubles, so results don't depend on batching, and ``rgb`` upsamples chroma by repetition.

``encode`` stores a payload of bytes without loss: the format's unit is the quantised coefficient, so each byte is one
coefficient of a 4:2:0 image with quantisers of one. A DC coefficient is the byte; an AC coefficient is the byte and two,
bytes from 128 on the other way below zero, so none is zero even without its lowest bit. Both are sent as differences or
magnitudes without their lowest bit, with a table of Huffman codes made from the file's own sizes, and then refined by one
scan. A comment segment holds the number of payload bytes; blocks after them are padding.

Defined results: a null text counts as empty; texts are padded with spaces to a positive multiple of 192 bytes; a very long
text makes one large image; equal texts give equal values; repeated rows give repeated results; a null doc_id stays null and
ids of any size keep their value; an empty table gives an empty result; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ranklake.llm.common import hold, ship, text_or_empty, unused

UNIT = 192


def _zigzag() -> np.ndarray:
    """Natural position of each zigzag position: anti-diagonals, read in alternating directions."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
#: Basis of the inverse transform, in 2**-12.
BASIS = np.array([[round((np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) * 4096) for x in range(8)] for u in range(8)], dtype=np.float64)


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    rows: int = 0  # of blocks, whole MCUs
    cols: int = 0
    used_rows: int = 0  # of blocks that a scan of this component alone holds
    used_cols: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))  # by block, in zigzag order
    dc_table: int = 0
    ac_table: int = 0


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quantisers: dict[int, np.ndarray]
    comment: bytes


class Huffman:
    """Codes of one table, with lookups by the next 16 bits: length (0: no code), symbol, and how far the next symbol of a
    first scan is (the code and the bits that follow it; FAR: no code)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[int, tuple[int, int]] = {}  # symbol: (code, length)
        self.length, self.symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        self.step_ac, self.step_dc = np.full(1 << 16, FAR, np.uint8), np.full(1 << 16, FAR, np.uint8)
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for x in symbols[at : at + n]:
                self.codes.setdefault(x, (code, length))
                these = slice(code << (16 - length), (code + 1) << (16 - length))
                self.length[these], self.symbol[these] = length, x
                self.step_ac[these] = length + (x >> 4 if x & 15 == 0 and x < 0xF0 else x & 15)
                self.step_dc[these] = length + min(x, 16)
                code += 1
            code, at = code << 1, at + n

    def read(self, bits: Bits) -> int:
        ahead = bits.ahead()
        length = int(self.length[ahead])
        if not length:
            raise ValueError("no such code")
        bits.at += length
        return int(self.symbol[ahead])


FAR = 255


@lru_cache(64)
def _huffman(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


class Bits:
    """The bits of one entropy-coded segment; past its end there are ones, as decoders assume."""

    def __init__(self, data: bytes):
        self.size = 8 * len(data)
        self.data = data + b"\xff" * 8
        self.at = 0

    def ahead(self) -> int:
        """The next 16 bits."""
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 3].ljust(3, b"\xff"), "big") >> (8 - (self.at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        """The next n bits, 16 at most."""
        out = self.ahead() >> (16 - n) if n else 0
        self.at += n
        return out

    def some(self, n: int) -> np.ndarray:
        """The next n bits as an array."""
        i = self.at >> 3
        raw = np.frombuffer(self.data, np.uint8)[i : i + n // 8 + 2]
        out = np.unpackbits(raw)[self.at & 7 : (self.at & 7) + n]
        self.at += n
        return out if len(out) == n else np.concatenate([out, np.ones(n - len(out), np.uint8)])

    def symbols(self, table: Huffman, step: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """All symbols from here to the end, ``most`` at most, and the value of the bits after each; ``step`` is by 16 bits."""
        d = np.frombuffer(self.data, np.uint8).astype(np.uint32)
        n = self.size // 8
        four = d[:n] << 24 | d[1 : n + 1] << 16 | d[2 : n + 2] << 8 | d[3 : n + 3]
        window = (four[:, None] >> SHIFTS).astype(np.uint16).ravel()
        all_steps = step[window]
        steps, mark, at = all_steps.tobytes(), bytearray(self.size), self.at
        try:
            while True:
                mark[at] = 1
                at += steps[at]
        except IndexError:
            pass
        at = np.flatnonzero(np.frombuffer(mark, np.uint8))[:most]
        if len(at) and all_steps[at[-1]] == FAR:  # padding at the end has no code
            at = at[:-1]
        if (all_steps[at] == FAR).any():
            raise ValueError("no such code")
        w = window[at]
        symbol, length = table.symbol[w], table.length[w]
        extra = (all_steps[at] - length).astype(np.uint32)
        begin = at + length
        i = np.minimum(begin >> 3, n - 1)  # values past the end have no bits
        value = four[i] >> (32 - extra - (begin & 7).astype(np.uint32)) & MASKS[extra]
        return symbol, value.astype(np.int32)


SHIFTS = np.arange(16, 8, -1, dtype=np.uint32)
MASKS = (1 << np.arange(32, dtype=np.uint32)) - 1


def _extend(value: int, size: int) -> int:
    return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1


def _extended(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``_extend`` of each."""
    size = size.astype(np.int32)
    return value - np.where((size > 0) & (value >> np.maximum(size - 1, 0) == 0), (1 << size) - 1, 0)


@lru_cache(512)
def _alone(cols: int, used_rows: int, used_cols: int) -> np.ndarray:
    """(0, block) of a scan of one component."""
    blocks = (np.arange(used_rows)[:, None] * cols + np.arange(used_cols)).ravel()
    return np.stack([np.zeros_like(blocks), blocks], axis=1)


@lru_cache(256)
def _interleaved(shapes: tuple[tuple[int, int, int, int], ...], mcu_rows: int, mcu_cols: int) -> np.ndarray:
    """(component number, block) of a scan of several components, in the order of MCUs."""
    parts = []
    for k, (h, v, _, cols) in enumerate(shapes):
        block = (np.arange(mcu_rows)[:, None, None, None] * v + np.arange(v)[:, None]) * cols + np.arange(mcu_cols)[None, :, None, None] * h + np.arange(h)
        parts.append(np.stack([np.full(mcu_rows * mcu_cols * h * v, k), block.reshape(-1)], axis=1).reshape(mcu_rows * mcu_cols, h * v, 2))
    return np.concatenate(parts, axis=1).reshape(-1, 2)


def decode(data: bytes) -> Image:
    """The coefficient arrays of a progressive JPEG file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, quantisers, huffman, image, interval, comment = 2, {}, {}, None, 0, b""
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if marker == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                quantisers[n] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                huffman[body[0]] = _huffman(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xC2:
            image = _frame(body, quantisers)
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a progressive JPEG file with Huffman codes")
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            comment = body
            if image is not None:
                image.comment = comment
        elif marker == 0xDA:
            end = at
            segments = []
            while True:
                nxt = data.index(b"\xff", end)
                if data[nxt + 1] == 0:
                    end = nxt + 2
                elif 0xD0 <= data[nxt + 1] <= 0xD7:
                    segments.append(data[at:nxt].replace(b"\xff\x00", b"\xff"))
                    at = end = nxt + 2
                else:
                    segments.append(data[at:nxt].replace(b"\xff\x00", b"\xff"))
                    at = nxt
                    break
            if image is None:
                raise ValueError("a scan comes before the frame")
            _scan(image, body, segments, huffman, interval)
    if image is None:
        raise ValueError("there is no frame")
    image.comment = image.comment or comment
    return image


def _frame(body: bytes, quantisers: dict[int, np.ndarray]) -> Image:
    bits, height, width, n = struct.unpack(">BHHB", body[:6])
    if bits != 8:
        raise ValueError("samples must have 8 bits")
    parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
    hm, vm = max(c.h for c in parts), max(c.v for c in parts)
    for c in parts:
        c.rows, c.cols = -(-height // (8 * vm)) * c.v, -(-width // (8 * hm)) * c.h
        c.used_rows, c.used_cols = -(-(-(-height * c.v // vm)) // 8), -(-(-(-width * c.h // hm)) // 8)
        c.coefficients = np.zeros((c.rows * c.cols, 64), np.int32)
    return Image(width, height, parts, quantisers, b"")


def _scan(image: Image, body: bytes, segments: list[bytes], huffman: dict[int, Huffman], interval: int) -> None:
    n = body[0]
    chosen = []
    for k in range(n):
        c = next(c for c in image.components if c.id == body[1 + 2 * k])
        c.dc_table, c.ac_table = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
        chosen.append(c)
    first, last, approx = body[1 + 2 * n : 4 + 2 * n]
    high, low = approx >> 4, approx & 15
    if n == 1:
        c = chosen[0]
        order, per = _alone(c.cols, c.used_rows, c.used_cols), 1
    else:
        shapes = tuple((c.h, c.v, c.rows, c.cols) for c in chosen)
        order = _interleaved(shapes, chosen[0].rows // chosen[0].v, chosen[0].cols // chosen[0].h)
        per = sum(c.h * c.v for c in chosen)
    step = interval * per or len(order)
    for k, segment in enumerate(segments):
        part, bits = order[k * step : (k + 1) * step], Bits(segment)
        if first == 0:
            if high:
                _refine_dc(chosen, part, bits, low)
            else:
                _first_dc(chosen, part, bits, low, [huffman[c.dc_table] for c in chosen])
        else:
            table = huffman[0x10 | chosen[0].ac_table]
            (_refine_ac if high else _first_ac)(chosen[0].coefficients, part[:, 1], bits, first, last, low, table)


def _by_component(chosen: list[Component], part: np.ndarray) -> Iterator[tuple[Component, np.ndarray, np.ndarray | slice]]:
    if len(chosen) == 1:
        yield chosen[0], part[:, 1], slice(None)
    else:
        for k, c in enumerate(chosen):
            at = np.flatnonzero(part[:, 0] == k)
            yield c, part[at, 1], at


def _refine_dc(chosen: list[Component], part: np.ndarray, bits: Bits, low: int) -> None:
    raw = bits.some(len(part)).astype(np.int32) << low
    for c, blocks, at in _by_component(chosen, part):
        c.coefficients[blocks, 0] |= raw[at]


def _first_dc(chosen: list[Component], part: np.ndarray, bits: Bits, low: int, tables: list[Huffman]) -> None:
    if all(t is tables[0] for t in tables):
        size, value = bits.symbols(tables[0], tables[0].step_dc, len(part))
        if len(size) < len(part):
            raise ValueError("a scan is too short")
        moves = _extended(value, size)
        for c, blocks, at in _by_component(chosen, part):
            c.coefficients[blocks, 0] = np.cumsum(moves[at]) << low
        return
    before = [0] * len(chosen)
    for k, block in part.tolist():
        size = tables[k].read(bits)
        before[k] += _extend(bits.take(size), size)
        chosen[k].coefficients[block, 0] = before[k] << low


def _first_ac(co: np.ndarray, blocks: np.ndarray, bits: Bits, first: int, last: int, low: int, table: Huffman) -> None:
    width = last - first + 1
    symbol, value = bits.symbols(table, table.step_ac, len(blocks) * width)
    size = symbol & 15
    if len(symbol) == len(blocks) * width and (symbol == size).all() and size.all():  # no zeros
        co[blocks, first : last + 1] = (_extended(value, size) << low).reshape(-1, width)
        return
    values = (_extended(value, size) * (1 << low)).tolist()
    raw, symbols, at, run = value.tolist(), symbol.tolist(), 0, 0
    for block in blocks.tolist():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            if at == len(symbols):
                raise ValueError("a scan is too short")
            r, s = symbols[at] >> 4, symbols[at] & 15
            if s:
                k += r
                co[block, k] = values[at]
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + raw[at] - 1
                at += 1
                break
            at += 1


def _refine_ac(co: np.ndarray, blocks: np.ndarray, bits: Bits, first: int, last: int, low: int, table: Huffman) -> None:
    one, at = 1 << low, 0

    def correct(flat_blocks: np.ndarray, begin: int) -> None:
        """A bit for each coefficient that isn't zero: ``begin`` holds for the first block."""
        band = co[flat_blocks, first : last + 1]
        band_live = band != 0
        band_live[0, : begin - first] = False
        n = int(band_live.sum())
        raw = bits.some(n).astype(np.int32)
        values = band[band_live]
        band[band_live] = values + np.sign(values) * raw * one
        co[flat_blocks, first : last + 1] = band

    while at < len(blocks):
        block, k = int(blocks[at]), first
        row = co[block]
        run = 0
        while k <= last:
            symbol = table.read(bits)
            r, s = symbol >> 4, symbol & 15
            new = 0
            if s:
                new = one if bits.take(1) else -one
            elif r < 15:
                run = (1 << r) + bits.take(r)
                break
            while k <= last:  # corrections up to the place of the new coefficient, or past sixteen zeros
                if row[k]:
                    if bits.take(1):
                        row[k] += one if row[k] > 0 else -one
                elif r == 0:
                    break
                else:
                    r -= 1
                k += 1
            if new and k <= last:
                row[k] = new
            k += 1
        if run:
            run = min(run, len(blocks) - at)
            correct(blocks[at : at + run], min(k, last + 1))
            at += run
        else:
            at += 1


def planes(image: Image) -> list[np.ndarray]:
    """Samples of each component, 0 to 255, whole MCUs."""
    out = []
    for c in image.components:
        natural = np.zeros((len(c.coefficients), 64))
        natural[:, ZIGZAG] = c.coefficients * image.quantisers[c.table]
        rows = natural.reshape(-1, 8) @ BASIS  # along x: exact, for all terms are whole numbers under 2**53
        columns = np.ascontiguousarray(rows.reshape(-1, 8, 8).transpose(0, 2, 1)).reshape(-1, 8) @ BASIS
        samples = np.clip(np.floor(columns * 2.0**-24 + 128.5), 0, 255).astype(np.uint8).reshape(c.rows, c.cols, 8, 8)
        out.append(np.ascontiguousarray(samples.transpose(0, 3, 1, 2)).reshape(c.rows * 8, c.cols * 8))
    return out


def rgb(image: Image) -> np.ndarray:
    """The tensor (height, width, 3) of 8-bit samples; chroma is upsampled by repetition."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    full = []
    for c, p in zip(image.components, planes(image), strict=True):
        p = np.repeat(np.repeat(p, vm // c.v, axis=0), hm // c.h, axis=1) if (c.h, c.v) != (hm, vm) else p
        full.append(p[: image.height, : image.width])
    if len(full) == 1:
        return np.stack([full[0]] * 3, axis=2)
    y, cb, cr = full[0].astype(np.int32) << 16, full[1].astype(np.int32) - 128, full[2].astype(np.int32) - 128
    out = np.empty((*full[0].shape, 3), np.uint8)
    y += 1 << 15
    out[..., 0] = np.clip((y + 91881 * cr) >> 16, 0, 255)
    out[..., 1] = np.clip((y - 22554 * cb - 46802 * cr) >> 16, 0, 255)
    out[..., 2] = np.clip((y + 116130 * cb) >> 16, 0, 255)
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def _entropy(bits: np.ndarray) -> bytes:
    """Bits padded with ones, with zero bytes after 255."""
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)]) if pad else bits).tobytes().replace(b"\xff", b"\xff\x00")


def _codes(counts: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A Huffman table made from the counts of symbols, and (code, length) of each; the code of ones alone isn't used."""
    heap = [(n, [x]) for x, n in sorted(counts.items())]
    length = dict.fromkeys([*counts, -1], 0)
    heap = sorted([*((n, x[0], x) for n, x in heap), (0, -1, [-1])])
    while len(heap) > 1:
        (n, a, x), (m, b, y) = heappop(heap), heappop(heap)
        for z in x + y:
            length[z] += 1
        heappush(heap, (n + m, min(a, b), x + y))
    deepest = max(length.values())
    order = sorted(counts, key=lambda x: (length[x], x))  # the unused code is one of the deepest, so it may come last
    if deepest > 16:
        raise ValueError("too many symbols")
    sizes = [sum(length[x] == k for x in order) for k in range(1, 17)]
    codes, code, at = {}, 0, 0
    for k, n in enumerate(sizes, 1):
        for x in order[at : at + n]:
            codes[x] = (code, k)
            code += 1
        code, at = code << 1, at + n
    return bytes([*sizes, *order]), codes


def _packed(values: np.ndarray, lengths: np.ndarray, parts: list[int]) -> list[bytes]:
    """Values of ``lengths`` bits (16 at most) as the entropy-coded segments of parts of so many values, padded with ones."""
    ends = np.cumsum(lengths)
    bounds = np.cumsum(parts)
    filled = ends[bounds - 1]
    filled[1:] -= filled[:-1].copy()
    pads = -filled % 8
    moved = np.repeat(np.cumsum(pads) - pads, parts)
    start = ends - lengths + moved
    shifted = values.astype(np.uint64) << (64 - (start & 31) - lengths).astype(np.uint64)
    word = start >> 5
    size = int(word[-1]) + 3
    total = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), size)
    total[1:] += np.bincount(word, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), size)[:-1]
    raw = bytearray(total.astype(np.uint32).astype(">u4").tobytes())
    out, at = [], 0
    for n, pad in zip(filled.tolist(), pads.tolist(), strict=True):
        to = at + (n + pad) // 8
        if pad:
            raw[to - 1] |= (1 << pad) - 1
        out.append(bytes(raw[at:to]).replace(b"\xff", b"\xff\x00"))
        at = to
    return out


def _signed_bytes() -> np.ndarray:
    """The AC coefficient of each byte."""
    b = np.arange(256)
    return np.where(b < 128, b + 2, 126 - b).astype(np.int32)


SIGNED = _signed_bytes()
#: The byte of each AC coefficient from -129 on, 0 where there is none.
BYTES = np.zeros(512, np.uint8)
BYTES[SIGNED + 129] = np.arange(256)
HALVES = np.sign(SIGNED) * (np.abs(SIGNED) >> 1)


def _sizes(x: np.ndarray) -> np.ndarray:
    """Bits of each magnitude."""
    return np.frexp(np.abs(x).astype(np.float64))[1]


HALF_SIZES, LOWEST = _sizes(HALVES), (np.abs(SIGNED) & 1).astype(np.uint8)


def _tokens(codes: dict[int, tuple[int, int]], values: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number of each value: the code of its size, then its magnitude as JPEG extends it."""
    code, length = np.zeros(17, np.int64), np.zeros(17, np.int64)
    for x, (c, n) in codes.items():
        code[x], length[x] = c, n
    low = np.where(values < 0, values + (1 << size) - 1, values)
    return code[size] << size | low, length[size] + size


#: AC bands of luma and chroma; luma of images under SMALL MCUs has one, for a scan has a fixed cost.
LUMA_BANDS, CHROMA_BANDS, SMALL = ((1, 5), (6, 63)), ((1, 63),), 32


def shape(payload_bytes: int) -> tuple[int, int]:
    """Rows and columns of MCUs (384 coefficients each) for so many bytes."""
    mcus = -(-payload_bytes // 384)
    cols = max(min(mcus, 64), -(-mcus // 4095))
    return -(-mcus // cols), cols


def encode(payload: bytes) -> bytes:
    """A progressive JPEG file whose coefficients hold the payload."""
    rows, cols = shape(len(payload))
    data = np.full(rows * cols * 384, 32, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(-1, 64)
    n = rows * cols
    parts = (data[: 4 * n], data[4 * n : 5 * n], data[5 * n :])
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xDB, bytes([0, *[1] * 64]))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    all_dc = bytes([3, 1, 0, 2, 0, 3, 0])
    order = _interleaved(((2, 2, rows * 2, cols * 2), (1, 1, rows, cols), (1, 1, rows, cols)), rows, cols)
    dc = data[:, 0][np.array([0, 4 * n, 5 * n])[order[:, 0]] + order[:, 1]].astype(np.int32)
    moves = np.empty(len(dc), np.int32)
    for k in range(3):
        at = np.flatnonzero(order[:, 0] == k)
        moves[at] = np.diff(dc[at] >> 1, prepend=0)
    sizes = _sizes(moves)
    table, codes = _codes({x: c for x, c in enumerate(np.bincount(sizes).tolist()) if c})
    out += [_segment(0xC4, b"\x00" + table), _segment(0xDA, all_dc + bytes([0, 0, 0x01])), *_packed(*_tokens(codes, moves, sizes), [len(moves)])]
    out += [_segment(0xDA, all_dc + bytes([0, 0, 0x10])), _entropy((dc & 1).astype(np.uint8))]

    scans = [(k + 1, part, band) for k, part in enumerate(parts) for band in (LUMA_BANDS if k == 0 and n >= SMALL else CHROMA_BANDS)]
    seen = np.bincount(data[:, 1:].ravel(), minlength=256)
    table, codes = _codes({x: c for x, c in enumerate(np.bincount(HALF_SIZES, seen, 8).astype(int).tolist()) if c})
    bits, length = _tokens(codes, HALVES, HALF_SIZES)  # of each byte
    flat = np.concatenate([part[:, a : b + 1].ravel() for _, part, (a, b) in scans])
    coded = _packed(bits[flat], length[flat], [part.shape[0] * (b - a + 1) for _, part, (a, b) in scans])
    out.append(_segment(0xC4, b"\x10" + table))
    for (k, _, (a, b)), segment in zip(scans, coded, strict=True):
        out += [_segment(0xDA, bytes([1, k, 0, a, b, 0x01])), segment]
    runs = [[min(16384, len(part) - at) for at in range(0, len(part), 16384)] for _, part, _ in scans]  # each 2**r blocks and a rest
    symbols = [run.bit_length() - 1 for of in runs for run in of]
    table, codes = _codes({r << 4: symbols.count(r) for r in sorted(set(symbols))})
    out.append(_segment(0xC4, b"\x10" + table))
    for (k, part, (a, b)), of in zip(scans, runs, strict=True):
        raw, stream, at = LOWEST[part[:, a : b + 1]], [], 0
        for run in of:
            r = run.bit_length() - 1
            code, size = codes[r << 4]
            head = [*(code >> (size - 1 - i) & 1 for i in range(size)), *((run - (1 << r)) >> (r - 1 - i) & 1 for i in range(r))]
            stream += [np.array(head, np.uint8), raw[at : at + run].ravel()]
            at += run
        out += [_segment(0xDA, bytes([1, k, 0, a, b, 0x10])), _entropy(np.concatenate(stream))]
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload_of(image: Image) -> bytes:
    """The bytes that ``encode`` stored, from the coefficients."""
    co = np.concatenate([c.coefficients for c in image.components])
    data = BYTES[co + 129]
    data[:, 0] = co[:, 0]
    return data.tobytes()[: struct.unpack(">Q", image.comment)[0]]


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * ((-len(raw)) % UNIT if raw else UNIT)


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded bytes stored as a progressive JPEG file."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("media")
        for b in batches:
            rows = [(n, encode(p)) for n, p in map(padded, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([m for _, m in rows], pa.binary())], names=["doc_id", "n_bytes", "media"])

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, T.StructType([docs.schema["doc_id"], *fields]))


def tensors(files: DataFrame, column: str = "media") -> DataFrame:
    """files with height, width and ``rgb``, the samples of the tensor (height, width, 3), row by row.

    A null file has a null tensor. Where files has such a column, underscores follow the new one's name.
    """
    ship(files.sparkSession)
    names = unused(files, "height", "width", "rgb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("tensors")
        for b in batches:
            t = [None if m is None else rgb(decode(m)) for m in b.column(column).to_pylist()]
            new = [pa.array([None if x is None else x.shape[k] for x in t], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new, pa.array([None if x is None else x.tobytes() for x in t], pa.binary())], names=[*b.schema.names, *names])

    fields = [T.StructField(n, t) for n, t in zip(names, (T.IntegerType(), T.IntegerType(), T.BinaryType()), strict=True)]
    return files.mapInArrow(run, T.StructType([*files.schema, *fields]))


def digests(files: DataFrame) -> DataFrame:
    """What is read back from ``media``: digests of the payload and the file, features of the RGB tensor, and the tensor.

    The file is decoded once for the payload and the tensor; height, width and rgb are as in ``tensors``.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("digests")
        for b in batches:
            rows = []
            for m in b.column("media").to_pylist():
                image = decode(m)
                p, t = payload_of(image), rgb(image)
                sums = t.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
                feature = f"{image.width}x{image.height}:{sums[0]}:{sums[1]}:{sums[2]}:{zlib.crc32(t)}"
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, image.height, image.width, t.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, (_, _, t) in zip(columns, fields, strict=True))], names=["doc_id", "n_bytes", *(n for n, _, _ in fields)])

    fields = [
        ("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()),
        ("media_sha256", T.StringType(), pa.string()), ("feature", T.StringType(), pa.string()), ("height", T.IntegerType(), pa.int32()), ("width", T.IntegerType(), pa.int32()), ("rgb", T.BinaryType(), pa.binary()),
    ]
    schema = T.StructType([files.schema["doc_id"], files.schema["n_bytes"], *(T.StructField(n, t) for n, t, _ in fields)])
    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
