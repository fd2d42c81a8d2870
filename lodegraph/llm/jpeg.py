"""Media columns: progressive JPEG, decoded in numpy to full-resolution RGB tensors.

The decoder keeps one coefficient array a component and lets every scan add to it what it brings: a band of frequencies
(spectral selection), or one more bit of them (successive approximation). At the end the blocks are dequantised, inverse
transformed by one product with the 64 x 64 basis - in whole numbers, so equal files give equal tensors on any machine -
chroma is upsampled to the luma grid, and the colours are turned to RGB.

Bits are read one code at a time only where codes differ in length. Three kinds of runs are read at once: refinement bits
of DC, correction bits inside end-of-band runs, and bands whose Huffman table has a single code, where every coefficient
takes the same number of bits.

:func:`encode_payload` stores bytes losslessly. JPEG's samples don't survive its transform, its coefficients do: each
byte b is one coefficient b + 256, a block holds 64 of them, and blocks go to 4:2:0 macroblocks (four Y, Cb, Cr) in turn.
Scans: DC without its last bit, DC's last bit; AC without its last bit, of Y in two bands; AC's last bit. All AC first
values lie in 128 to 255 and so share one size class, the single code that makes decoding fast.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import utf8_texts

BLOCK = 64
BIAS = 256
#: Blocks that are read or written at once; a multiple of 8, so that these end at whole bytes.
AT_ONCE = 1 << 14
#: Macroblocks in a row of an encoded image at most.
ROW = 512

ZIGZAG = sorted(range(BLOCK), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
SCALE_BITS = 13


@lru_cache(1)
def basis() -> np.ndarray:
    """Row k: what a coefficient of 1 at zigzag place k adds to the 64 samples, times 2**13, as whole numbers."""
    x = np.arange(8)
    waves = np.array([[math.cos((2 * i + 1) * u * math.pi / 16) for i in x] for u in range(8)])
    waves[0] /= math.sqrt(2)
    planes = np.einsum("ui,vj->uvij", waves, waves).reshape(BLOCK, BLOCK) / 4
    return np.rint(planes[ZIGZAG] * (1 << SCALE_BITS))


@dataclass
class Table:
    """A Huffman table: ``look`` gives for the next 16 bits the code's length and symbol, ``codes`` the reverse."""

    look: list[int]
    codes: dict[int, tuple[int, int]]


@lru_cache(64)
def table(lengths: bytes, symbols: bytes) -> Table:
    look, codes, code, at = np.zeros(65536, np.int64), {}, 0, 0
    for length, count in enumerate(lengths, 1):
        for symbol in symbols[at : at + count]:
            codes[symbol] = (code, length)
            look[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            code += 1
        at += count
        code <<= 1
    return Table(look.tolist(), codes)


class Bits:
    """Entropy-coded bytes without stuffing, read from the front."""

    def __init__(self, data: bytes):
        self.data = data + b"\xff" * 8
        self.at = 0

    def symbol(self, look: list[int]) -> int:
        at = self.at
        byte = at >> 3
        found = look[int.from_bytes(self.data[byte : byte + 3], "big") >> (8 - (at & 7)) & 0xFFFF]
        if not found:
            raise ValueError("a code that the table doesn't have")
        self.at = at + (found >> 8)
        return found & 0xFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        at = self.at
        byte = at >> 3
        self.at = at + n
        return int.from_bytes(self.data[byte : byte + 4], "big") >> (32 - (at & 7) - n) & ((1 << n) - 1)

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1

    def many(self, n: int) -> np.ndarray:
        at, self.at = self.at, self.at + n
        first = at >> 3
        return np.unpackbits(np.frombuffer(self.data, np.uint8, (self.at + 7) // 8 - first, first))[at & 7 : (at & 7) + n]


@dataclass
class Component:
    name: int
    across: int  # sampling factors
    down: int
    quant: int
    blocks_across: int = 0  # of the padded grid
    blocks_down: int = 0
    real_across: int = 0  # of a scan by itself
    real_down: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, BLOCK), np.int32))


@dataclass
class Frame:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comment: bytes = b""

    def samples(self, c: Component) -> np.ndarray:
        """The component's plane, 8 bits a sample."""
        scaled = c.coefficients * self.quants[c.quant]
        plane = np.empty((len(scaled), BLOCK), np.uint8)
        for i in range(0, len(scaled), AT_ONCE):
            made = (scaled[i : i + AT_ONCE] @ basis()).astype(np.int64)
            plane[i : i + AT_ONCE] = np.clip(((made + (1 << (SCALE_BITS - 1))) >> SCALE_BITS) + 128, 0, 255)
        grid = plane.reshape(c.blocks_down, c.blocks_across, 8, 8).transpose(0, 2, 1, 3)
        return grid.reshape(c.blocks_down * 8, c.blocks_across * 8)

    def rgb(self) -> np.ndarray:
        """Height x width x 3, 8 bits each. One component is grey; of three, Y, Cb, Cr, the coarser ones are repeated."""
        most_across, most_down = max(c.across for c in self.components), max(c.down for c in self.components)
        planes = []
        for c in self.components:
            plane = self.samples(c)
            if most_down != c.down:
                plane = np.repeat(plane, most_down // c.down, axis=0)
            if most_across != c.across:
                plane = np.repeat(plane, most_across // c.across, axis=1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2)
        y, cb, cr = (p.astype(np.int32) for p in planes)
        y <<= 16
        y += 1 << 15
        cb -= 128
        cr -= 128
        out = np.empty((self.height, self.width, 3), np.uint8)
        for i, value in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):  # BT.601, times 2**16
            out[:, :, i] = np.clip(value >> 16, 0, 255)
        return out


def decode(data: bytes) -> Frame:
    """A progressive (or baseline-marked but scan-wise progressive) JPEG's coefficients."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    quants: dict[int, np.ndarray] = {}
    tables: dict[int, Table] = {}
    frame: Frame | None = None
    comment, interval, at = b"", 0, 2
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            break
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                quants[name] = np.frombuffer(body, ">u2" if wide else np.uint8, BLOCK, 1).astype(np.int32)
                body = body[1 + BLOCK * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            frame = _frame(body, quants)
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan before its frame")
            end = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]").search(data, at)
            if end is None:
                raise ValueError("a scan without end")
            raw, at = data[at : end.start()], end.start()
            _scan(frame, body, tables, interval, raw)
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("only progressive Huffman-coded JPEG is read")
    if frame is None:
        raise ValueError("no frame")
    frame.comment = comment
    return frame


def _frame(body: bytes, quants: dict[int, np.ndarray]) -> Frame:
    precision, height, width, n = struct.unpack(">BHHB", body[:6])
    if precision != 8:
        raise ValueError("8-bit samples only")
    parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
    most_across, most_down = max(c.across for c in parts), max(c.down for c in parts)
    for c in parts:
        c.blocks_across = -(-width // (8 * most_across)) * c.across
        c.blocks_down = -(-height // (8 * most_down)) * c.down
        c.real_across = -(-(-(-width * c.across // most_across)) // 8)
        c.real_down = -(-(-(-height * c.down // most_down)) // 8)
        c.coefficients = np.zeros((c.blocks_across * c.blocks_down, BLOCK), np.int32)
    return Frame(width, height, parts, quants)


def _order(parts: list[Component]) -> list[np.ndarray]:
    """For each component the blocks that the scan visits: a row a macroblock."""
    if len(parts) == 1:
        c = parts[0]
        return [(np.arange(c.real_down)[:, None] * c.blocks_across + np.arange(c.real_across)).reshape(-1, 1)]
    out = []
    for c in parts:
        grid = np.arange(c.blocks_down * c.blocks_across).reshape(c.blocks_down // c.down, c.down, c.blocks_across // c.across, c.across)
        out.append(grid.transpose(0, 2, 1, 3).reshape(-1, c.down * c.across))
    return out


def _scan(frame: Frame, head: bytes, tables: dict[int, Table], interval: int, raw: bytes) -> None:
    names = {c.name: c for c in frame.components}
    n = head[0]
    parts = [names[head[1 + 2 * i]] for i in range(n)]
    chosen = [head[2 + 2 * i] for i in range(n)]
    first, last, approximation = head[1 + 2 * n : 4 + 2 * n]
    high, low = approximation >> 4, approximation & 15
    visits = _order(parts)
    units = len(visits[0])
    pieces = re.split(rb"\xff+[\xd0-\xd7]", raw) if interval else [raw]
    for i, piece in enumerate(pieces):
        lo, hi = (i * interval, min(units, (i + 1) * interval)) if interval else (0, units)
        bits = Bits(piece.replace(b"\xff\x00", b"\xff"))
        mine = [v[lo:hi] for v in visits]
        if first == 0 and not high:
            _dc_first(parts, mine, [tables[c >> 4].look for c in chosen], low, bits)
        elif first == 0:
            _dc_more(parts, mine, low, bits)
        elif not high:
            _ac_first(parts[0].coefficients, mine[0][:, 0], tables[16 | chosen[0] & 15], first, last, low, bits)
        else:
            _ac_more(parts[0].coefficients, mine[0][:, 0], tables[16 | chosen[0] & 15], first, last, low, bits)


def _dc_first(parts: list[Component], visits: list[np.ndarray], looks: list[list[int]], low: int, bits: Bits) -> None:
    made: list[list[int]] = [[] for _ in parts]
    told = [0] * len(parts)
    turns = [(i, looks[i], made[i].append) for i, v in enumerate(visits) for _ in range(v.shape[1])]
    symbol, signed = bits.symbol, bits.signed
    for _ in range(len(visits[0])):
        for i, look, add in turns:
            told[i] += signed(symbol(look))
            add(told[i])
    for c, v, values in zip(parts, visits, made):
        c.coefficients[v.reshape(-1), 0] = np.array(values, np.int32) << low


def _dc_more(parts: list[Component], visits: list[np.ndarray], low: int, bits: Bits) -> None:
    widths = [v.shape[1] for v in visits]
    found = bits.many(len(visits[0]) * sum(widths)).reshape(-1, sum(widths)).astype(np.int32)
    at = 0
    for c, v, width in zip(parts, visits, widths):
        c.coefficients[v.reshape(-1), 0] |= (found[:, at : at + width] << low).reshape(-1)
        at += width


def _ac_first(out: np.ndarray, blocks: np.ndarray, codes: Table, first: int, last: int, low: int, bits: Bits) -> None:
    if len(codes.codes) == 1:
        ((only, (_, length)),) = codes.codes.items()
        if 0 < only < 16:  # no run before it: every coefficient is there, in as many bits as any other
            width, band = length + only, last - first + 1
            for i in range(0, len(blocks), AT_ONCE):
                some = blocks[i : i + AT_ONCE]
                found = bits.many(len(some) * band * width).reshape(-1, width)[:, length:]
                if only == 8:
                    value = np.packbits(found, axis=1)[:, 0].astype(np.int32)
                else:
                    value = found @ (1 << np.arange(only - 1, -1, -1))
                value = np.where(value >> (only - 1), value, value - (1 << only) + 1) << low
                out[some, first : last + 1] = value.reshape(-1, band)
            return
    look, run = codes.look, 0
    for block in blocks.tolist():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            symbol = bits.symbol(look)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                out[block, k] = bits.signed(size) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def _correct(out: np.ndarray, rows: np.ndarray, first: int, last: int, low: int, bits: Bits) -> None:
    """One more bit for each coefficient of the band that is not 0."""
    for i in range(0, len(rows), AT_ONCE):
        some = rows[i : i + AT_ONCE]
        band = out[some, first : last + 1]
        there = band != 0
        if there.all():
            found = bits.many(band.size).reshape(band.shape).astype(np.int32)
            out[some, first : last + 1] = band + np.where(band < 0, -found, found) * (1 << low)
        else:
            found = bits.many(int(there.sum())).astype(np.int32) << low
            band[there] += np.where(band[there] < 0, -found, found)
            out[some, first : last + 1] = band


def _ac_more(out: np.ndarray, blocks: np.ndarray, codes: Table, first: int, last: int, low: int, bits: Bits) -> None:
    look, at, one = codes.look, 0, 1 << low
    while at < len(blocks):
        block, k = int(blocks[at]), first
        while k <= last:
            symbol = bits.symbol(look)
            zeros, size = symbol >> 4, symbol & 15
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                if k > first:
                    _correct(out, blocks[at : at + 1], k, last, low, bits)
                    at, run = at + 1, run - 1
                _correct(out, blocks[at : at + run], first, last, low, bits)
                at += run
                break
            new = (one if bits.take(1) else -one) if size else 0
            while k <= last:
                value = int(out[block, k])
                if value:
                    if bits.take(1):
                        out[block, k] = value + (one if value > 0 else -one)
                elif zeros:
                    zeros -= 1
                else:
                    out[block, k] = new
                    k += 1
                    break
                k += 1
        else:
            at += 1


# --- storing bytes ---------------------------------------------------------------------------------------------------

#: The standard's code lengths for DC size classes 0 to 11.
DC_LENGTHS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
#: One code, 0: a coefficient of size class 8 with none skipped. And fifteen codes of four bits, for end-of-band runs.
AC_LENGTHS, AC_SYMBOLS = bytes([1, *[0] * 15]), bytes([8])
RUN_LENGTHS, RUN_SYMBOLS = bytes([0, 0, 0, 15, *[0] * 12]), bytes(r << 4 for r in range(15))
SIZE_CLASS = np.array([0, *(int(i).bit_length() for i in range(1, 2048))])
MACROBLOCK = 6


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _coded(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes, the last filled up with ones."""
    fill = -len(bits) % 8
    if fill:
        bits = np.concatenate([bits, np.ones(fill, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _codes(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The lowest ``lengths`` bits of each value, one after the other."""
    place = np.arange(int(lengths.max()))
    down = lengths[:, None] - 1 - place
    return ((values[:, None] >> np.maximum(down, 0)) & 1)[down >= 0].astype(np.uint8)


def _dc_codes(values: np.ndarray, lane: np.ndarray) -> bytes:
    """DC values in scan order as coded differences; ``lane`` names each one's component."""
    difference = np.empty(len(values), np.int64)
    for i in range(3):
        mine = np.flatnonzero(lane == i)
        difference[mine] = np.diff(values[mine], prepend=0)
    size = SIZE_CLASS[np.abs(difference)]
    known = table(DC_LENGTHS, DC_SYMBOLS).codes
    code, length = (np.array([known[s][i] for s in range(12)]) for i in (0, 1))
    extra = np.where(difference < 0, difference + (1 << size) - 1, difference)
    return _coded(_codes(code[size] << size | extra, length[size] + size))


def _ac_codes(values: np.ndarray) -> bytes:
    """Blocks' bands of values 128 to 255: a zero bit and eight more each."""
    out = []
    for i in range(0, len(values), AT_ONCE):
        flat = values[i : i + AT_ONCE].reshape(-1, 1)
        bits = np.zeros((len(flat), 9), np.uint8)
        bits[:, 1:] = np.unpackbits(flat, axis=1)
        out.append(bits.reshape(-1))
    return b"".join(map(_coded, out[:-1])) + _coded(out[-1])


def _correction_codes(last_bits: np.ndarray) -> bytes:
    """Blocks' bands of last bits inside end-of-band runs, for which all coefficients are there already."""
    known = table(RUN_LENGTHS, RUN_SYMBOLS).codes
    out = []
    for i in range(0, len(last_bits), 32767):
        some = last_bits[i : i + 32767]
        r = len(some).bit_length() - 1
        head = _codes(np.array([known[r << 4][0] << r | len(some) - (1 << r)]), np.array([4 + r]))
        out += [head, some.reshape(-1)]
    return _coded(np.concatenate(out))


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload's bytes; a multiple of 64 of them, at least 64."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("a positive multiple of 64 bytes")
    blocks = len(payload) // BLOCK
    units = -(-blocks // MACROBLOCK)
    rows = -(-units // ROW)
    across = -(-units // rows)
    data = np.frombuffer(payload.ljust(rows * across * MACROBLOCK * BLOCK, b"\0"), np.uint8).reshape(-1, MACROBLOCK, BLOCK)
    half = (data >> 1) | 128  # (b + 256) >> 1
    bit = data & 1
    # luma blocks in the plane's order: two rows of two of a macroblock lie apart
    plane = np.arange(4 * rows * across).reshape(rows, across, 2, 2).transpose(0, 2, 1, 3).reshape(-1)
    luma_half, luma_bit = half[:, :4].reshape(-1, BLOCK)[plane], bit[:, :4].reshape(-1, BLOCK)[plane]
    lane = np.tile(np.array([0, 0, 0, 0, 1, 2]), rows * across)
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload)))]
    out.append(_segment(0xDB, b"\0" + bytes([1] * BLOCK)))
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, rows * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_segment(0xC4, b"\x00" + DC_LENGTHS + DC_SYMBOLS + b"\x10" + AC_LENGTHS + AC_SYMBOLS + b"\x11" + RUN_LENGTHS + RUN_SYMBOLS))
    scan = lambda names, ac, first, last, steps: _segment(0xDA, bytes([len(names), *(x for n in names for x in (n, ac)), first, last, steps]))
    out += [scan([1, 2, 3], 0, 0, 0, 0x01), _dc_codes(half[:, :, 0].reshape(-1).astype(np.int64), lane)]
    out += [scan([1], 0, 1, 5, 0x01), _ac_codes(luma_half[:, 1:6])]
    out += [scan([2], 0, 1, 63, 0x01), _ac_codes(half[:, 4, 1:]), scan([3], 0, 1, 63, 0x01), _ac_codes(half[:, 5, 1:])]
    out += [scan([1], 0, 6, 63, 0x01), _ac_codes(luma_half[:, 6:])]
    out += [scan([1, 2, 3], 0, 0, 0, 0x10), _coded(bit[:, :, 0].reshape(-1))]
    for name, bits in ((1, luma_bit), (2, bit[:, 4]), (3, bit[:, 5])):
        out += [scan([name], 1, 1, 63, 0x10), _correction_codes(bits[:, 1:])]
    return b"".join(out) + b"\xff\xd9"


def payload_of(frame: Frame) -> bytes:
    """The bytes that :func:`encode_payload` stored."""
    (size,) = struct.unpack(">Q", frame.comment)
    y, cb, cr = frame.components
    rows, across = y.blocks_down // 2, y.blocks_across // 2
    data = np.empty((rows * across, MACROBLOCK, BLOCK), np.uint8)
    luma = y.coefficients.reshape(rows, 2, across, 2, BLOCK).transpose(0, 2, 1, 3, 4)
    data[:, :4] = luma.reshape(rows * across, 4, BLOCK)  # minus 256, modulo 256
    data[:, 4], data[:, 5] = cb.coefficients, cr.coefficients
    return data.tobytes()[:size]


def padded(text: bytes) -> bytes:
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b"\0")


def feature(rgb: np.ndarray) -> str:
    """A tensor in short: size, channel means times 1000 (rounded down), crc32 of its bytes."""
    n = rgb.shape[0] * rgb.shape[1]
    means = ",".join(str(int(t) * 1000 // n) for t in rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64))
    return f"{rgb.shape[1]}x{rgb.shape[0]};{means};{zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def store_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``, a JPEG that holds the text's UTF-8 bytes, filled with zero bytes to a
    positive multiple of 64 (a null text is empty). Rows are independent; nothing is shuffled."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = list(utf8_texts(part.column(1)))
                media = [encode_payload(padded(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.large_binary()).cast(pa.binary())], ["doc_id", "n_bytes", "media"])

    return df.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def decode_media(df: DataFrame, media_column: str = "media") -> DataFrame:
    """``df`` without the media but with ``width``, ``height`` and ``rgb`` (height x width x 3 bytes), its full-resolution
    tensor. A null or unreadable file gives nulls."""
    kept = [f for f in df.schema if f.name != media_column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", width int, height int, rgb binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                out: list[tuple] = []
                for value in part.column(len(kept)):
                    try:
                        rgb = decode(value.as_py()).rgb()
                        out.append((rgb.shape[1], rgb.shape[0], rgb.tobytes()))
                    except (TypeError, ValueError, KeyError, IndexError, struct.error):
                        out.append((None, None, None))
                width, height, data = zip(*out)
                arrays = [*(part.column(i) for i in range(len(kept))), pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in kept), "width", "height", "rgb"])

    return df.select(*[f"`{f.name}`" for f in kept], media_column).mapInArrow(run, schema)


def round_trip(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text stored and read back: ``doc_id``, ``n_bytes`` (without filling), ``payload_bytes``, ``payload_sha256`` and
    ``tail_crc32`` (of the last 64) of what the file gave back, ``media_bytes``, ``media_sha256`` and ``feature`` of the
    RGB tensor. The file is a value in the worker: at a quarter more than the text, it is not sent around to be read.

    A null text is empty, and stored as 64 zero bytes. Rows are independent: equal texts give equal values, null ids,
    repeated rows and further columns change nothing; an empty table gives no rows.
    """
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def row(text: bytes) -> tuple:
        media = encode_payload(padded(text))
        frame = decode(media)
        payload = payload_of(frame)
        return (
            len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]),
            len(media), hashlib.sha256(media).hexdigest(), feature(frame.rgb()),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(row, utf8_texts(batch.column(1))))) or [()] * len(types)
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return df.select(id_column, text_column).mapInArrow(run, schema)
