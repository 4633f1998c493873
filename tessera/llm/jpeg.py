"""Progressive JPEG in numpy: reading any progressive file, and writing bytes as coefficients.

``read`` accumulates the scans (spectral selection and successive approximation) into one coefficient array a component,
``strips`` transforms them back, upsamples chroma and gives full-resolution RGB. Scans whose code table has one symbol have
a fixed stride in bits and are read as arrays; all others are read code by code.

``write`` stores a payload of whole 64-byte blocks: byte v is the coefficient 256 + v, so that nothing is lost and every
coefficient has the same size; blocks fill luma, then both chroma components (4:2:0); a comment holds the payload's length.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

_CHUNK = 4096  # blocks at a time; a multiple of 8, so that chunks end at whole bytes
_MARKER = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]", re.DOTALL)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]", re.DOTALL)
_LENGTH = b"payload "


def _zigzag() -> np.ndarray:
    """Place in an 8 x 8 block, row by row, of each coefficient in the order of storage."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


@lru_cache(maxsize=8)
def _inverse_transform(quantisation: bytes) -> np.ndarray:
    """Matrix from 64 stored coefficients to 64 samples, dequantisation included."""
    basis = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8)[None, :] * np.pi / 16) / 2
    basis[:, 0] /= np.sqrt(2)
    full = np.kron(basis, basis)  # samples x frequencies
    return (full[:, ZIGZAG] * np.frombuffer(quantisation, ">u2")).T.astype(np.float32).copy()


@dataclass
class Component:
    number: int
    across: int
    down: int
    table: int
    blocks_down: int = 0
    blocks_across: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int16))
    own_down: int = 0
    own_across: int = 0


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    quantisation: dict[int, bytes]
    comments: list[bytes]

    @property
    def most_across(self) -> int:
        return max(c.across for c in self.components)

    @property
    def most_down(self) -> int:
        return max(c.down for c in self.components)


class _Codes:
    """A Huffman table: for the next 16 bits the length of the code and its symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length = np.zeros(1 << 16, np.uint8)
        self.symbol = np.zeros(1 << 16, np.uint8)
        code = k = 0
        for size, n in enumerate(counts, 1):
            for _ in range(n):
                lo, hi = code << (16 - size), (code + 1) << (16 - size)
                self.length[lo:hi], self.symbol[lo:hi] = size, symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.only = symbols[0] if sum(counts) == 1 else None
        self.only_length = next((i for i, n in enumerate(counts, 1) if n), 0)


_codes = lru_cache(maxsize=64)(_Codes)


class _Reader:
    """Bits of one restart interval, and the 16 bits that follow each place."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
        self._look = None

    @property
    def look(self) -> np.ndarray:
        if self._look is None:
            d = np.concatenate((self.data, np.full(4, 0xFF, np.uint8))).astype(np.uint32)
            three = (d[:-2] << 16) | (d[1:-1] << 8) | d[2:]
            self._look = ((three[:, None] >> (8 - np.arange(8, dtype=np.uint32))) & 0xFFFF).ravel()
        return self._look

    def bits(self, at: int, n: int) -> int:
        return int(self.look[at]) >> (16 - n) if n else 0

    def columns(self, rows: int, stride: int, chunk: int):
        """The bits as rows of ``stride``, ``chunk`` rows (a multiple of 8) at a time."""
        for k in range(0, rows, chunk):
            m = min(chunk, rows - k)
            part = self.data[k * stride // 8 : (k * stride + m * stride + 7) // 8]
            yield k, np.unpackbits(part, count=m * stride).reshape(m, stride)


def _extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)


def _run(blocks: np.ndarray):
    """A slice where the blocks follow one another."""
    if len(blocks) and blocks[-1] - blocks[0] == len(blocks) - 1:
        return slice(int(blocks[0]), int(blocks[-1]) + 1)
    return blocks


def _dc_first(reader: _Reader, units: list, tables: list[_Codes], low: int) -> None:
    """units: for each code in its order the component's place in the scan and the block's place in its array."""
    which, of, flats = units
    look = reader.look
    lengths, symbols = [t.length for t in tables], [t.symbol for t in tables]
    at, size = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
    p = 0
    if len(set(map(id, tables))) == 1:
        step = (lengths[0][look].astype(np.int64)).tolist()
        sym = symbols[0][look].tolist()
        for k in range(len(which)):
            s = sym[p]
            at[k], size[k] = p + step[p], s
            p += step[p] + s
    else:
        for k, c in enumerate(which):
            x = look[p]
            s = int(symbols[c][x])
            at[k], size[k] = p + int(lengths[c][x]), s
            p += int(lengths[c][x]) + s
    value = _extend(look[np.minimum(at, len(look) - 1)].astype(np.int64) >> (16 - size), size)
    for c, flat in enumerate(flats):
        mine = which == c
        flat[of[mine], 0] = np.cumsum(value[mine]) << low


def _ac_first(reader: _Reader, blocks: np.ndarray, flat: np.ndarray, codes: _Codes, first: int, last: int, low: int) -> None:
    size = codes.only & 15 if codes.only is not None else 0
    if size and codes.only >> 4 == 0:
        band, head = last - first + 1, codes.only_length
        for k, bits in reader.columns(len(blocks), band * (head + size), _CHUNK):
            bits = bits.reshape(-1, head + size)
            value = np.zeros(len(bits), np.int16)
            for at in range(head, head + size, 8):
                n = min(8, head + size - at)
                value <<= n
                value |= np.packbits(bits[:, at : at + n], axis=1)[:, 0] >> (8 - n)
            lead = bits[:, head]
            if not lead.all():
                value -= ((1 << size) - 1) * (1 - lead.astype(np.int16))
            flat[_run(blocks[k : k + _CHUNK]), first : last + 1] = (value << low).reshape(-1, band)
        return
    look, length, symbol, p, skip = reader.look, codes.length, codes.symbol, 0, 0
    for b in blocks:
        if skip:
            skip -= 1
            continue
        k, row = first, flat[b]
        while k <= last:
            x = look[p]
            s = int(symbol[x])
            p += int(length[x])
            run, n = s >> 4, s & 15
            if n:
                k += run
                v = reader.bits(p, n)
                p += n
                row[k] = (v if v >= 1 << (n - 1) else v - (1 << n) + 1) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) + reader.bits(p, run) - 1
                p += run
                break


def _ac_refine(reader: _Reader, blocks: np.ndarray, flat: np.ndarray, codes: _Codes, first: int, last: int, low: int) -> None:
    bit = 1 << low
    if codes.only == 0 and all(flat[blocks[k : k + _CHUNK], first : last + 1].all() for k in range(0, len(blocks), _CHUNK)):
        band = last - first + 1
        for k, bits in reader.columns(len(blocks), codes.only_length + band, _CHUNK):
            rows = _run(blocks[k : k + len(bits)])
            have = flat[rows, first : last + 1]
            more = bits[:, codes.only_length :].astype(np.int16) << low
            flat[rows, first : last + 1] = have + (more if (have > 0).all() else np.sign(have) * more)
        return
    look, p, skip = reader.look, 0, 0

    def correct(row, k) -> None:
        nonlocal p
        if reader.bits(p, 1) and not abs(int(row[k])) & bit:
            row[k] += bit if row[k] > 0 else -bit
        p += 1

    for b in blocks:
        k, row = first, flat[b]
        if not skip:
            while k <= last:
                x = look[p]
                s = int(codes.symbol[x])
                p += int(codes.length[x])
                run, n, new = s >> 4, s & 15, 0
                if n:
                    new = bit if reader.bits(p, 1) else -bit
                    p += 1
                elif run < 15:
                    skip = (1 << run) + reader.bits(p, run)
                    p += run
                    break
                while k <= last:
                    if row[k]:
                        correct(row, k)
                    elif run == 0:
                        if new:
                            row[k] = new
                        k += 1
                        break
                    else:
                        run -= 1
                    k += 1
        if skip:
            for k in range(k, last + 1):
                if row[k]:
                    correct(row, k)
            skip -= 1


def _interleaved(parts: list[Component], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """For the units lo..hi-1 of an interleaved scan, block by block: place of the component and of the block."""
    shape = tuple((c.across, c.down, c.blocks_across) for c in parts)
    return (_small_order if hi - lo <= 256 else _order)(shape, lo, hi)


def _order(shape: tuple, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    units = shape[0][2] // shape[0][0]
    unit = np.arange(lo, hi)
    which, of = [], []
    for c, (across, down, blocks_across) in enumerate(shape):
        for dy in range(down):
            for dx in range(across):
                which.append(np.full(len(unit), c))
                of.append((unit // units * down + dy) * blocks_across + unit % units * across + dx)
    return np.stack(which, 1).ravel(), np.stack(of, 1).ravel()


_small_order = lru_cache(maxsize=512)(_order)


def _scan(picture: Picture, header: bytes, data: bytes, tables: dict, restart: int) -> None:
    n = header[0]
    parts = [next(c for c in picture.components if c.number == header[1 + 2 * i]) for i in range(n)]
    chosen = [header[2 + 2 * i] for i in range(n)]
    first, last, shift = header[1 + 2 * n], header[2 + 2 * n], header[3 + 2 * n]
    high, low = shift >> 4, shift & 15
    flats = [c.coefficients.reshape(-1, 64) for c in parts]
    if n == 1:
        total = parts[0].own_down * parts[0].own_across
    else:
        total = (parts[0].blocks_across // parts[0].across) * (parts[0].blocks_down // parts[0].down)
    step = restart or max(total, 1)
    pieces = _RESTART.split(data) if restart else [data]
    for k, piece in zip(range(0, total, step), pieces, strict=False):
        reader, end = _Reader(piece), min(total, k + step)
        if n == 1:
            unit = np.arange(k, end)
            own = unit // parts[0].own_across * parts[0].blocks_across + unit % parts[0].own_across
            which, of = np.zeros(len(own), np.int64), own
        else:
            which, of = _interleaved(parts, k, end)
        if first == 0 and high == 0:
            _dc_first(reader, (which, of, flats), [tables[0, x >> 4] for x in chosen], low)
        elif first == 0:
            bits = np.unpackbits(reader.data, count=len(of)).astype(np.int16)
            for c, flat in enumerate(flats):
                flat[of[which == c], 0] |= bits[which == c] << low
        elif high == 0:
            _ac_first(reader, of, flats[0], tables[1, chosen[0] & 15], first, last, low)
        else:
            _ac_refine(reader, of, flats[0], tables[1, chosen[0] & 15], first, last, low)


def read(data: bytes) -> Picture:
    """Coefficients of all scans. Raises ValueError for anything but a progressive JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, restart = 2, {}, 0
    picture: Picture | None = None
    quantisation: dict[int, bytes] = {}
    comments: list[bytes] = []
    while at < len(data):
        while data[at] == 0xFF:
            at += 1
        marker = data[at]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 1)[0]
        body = data[at + 3 : at + 1 + size]
        at += 1 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                quantisation[body[0] & 15] = values.astype(">u2").tobytes()
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            height, width, n = struct.unpack_from(">HHB", body, 1)
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            picture = Picture(width, height, parts, quantisation, comments)
            units_across, units_down = -(-width // (8 * picture.most_across)), -(-height // (8 * picture.most_down))
            for c in parts:
                c.blocks_across, c.blocks_down = units_across * c.across, units_down * c.down
                c.own_across = -(-(-(-width * c.across // picture.most_across)) // 8)
                c.own_down = -(-(-(-height * c.down // picture.most_down)) // 8)
                c.coefficients = np.zeros((c.blocks_down, c.blocks_across, 64), np.int16)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            comments.append(body)
        elif marker == 0xDA:
            found = _MARKER.search(data, at)
            end = found.start() if found else len(data)
            if picture is None:
                raise ValueError("a scan stands before the frame")
            _scan(picture, body, data[at:end], tables, restart)
            at = end
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive JPEG with Huffman codes")
    if picture is None:
        raise ValueError("no frame")
    return picture


def strips(picture: Picture, units: int = 64):
    """Full-resolution RGB, uint8 (rows, width, 3), from top to bottom, ``units`` rows of coding units at a time."""
    total = picture.components[0].blocks_down // picture.components[0].down
    for k in range(0, total, units):
        m = min(units, total - k)
        planes = []
        for c in picture.components:
            part = c.coefficients[k * c.down : (k + m) * c.down]
            flat = part.reshape(-1, 64).astype(np.float32) @ _inverse_transform(picture.quantisation[c.table])
            plane = flat.reshape(m * c.down, c.blocks_across, 8, 8).transpose(0, 2, 1, 3).reshape(m * c.down * 8, -1)
            plane += 128.5
            np.floor(np.clip(plane, 0, 255, out=plane), out=plane)
            down, across = picture.most_down // c.down, picture.most_across // c.across
            if down > 1 or across > 1:
                plane = plane.repeat(down, 0).repeat(across, 1)
            planes.append(plane[: picture.height - k * 8 * picture.most_down, : picture.width])
        if len(planes) == 1:
            yield np.repeat(planes[0].astype(np.uint8)[..., None], 3, 2)
            continue
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.empty((*y.shape, 3), np.uint8)
        for channel, value in enumerate((np.float32(1.402) * cr, np.float32(-0.344136) * cb - np.float32(0.714136) * cr, np.float32(1.772) * cb)):
            value += y
            value += np.float32(0.5)
            rgb[..., channel] = np.clip(value, 0, 255, out=value)
        yield rgb


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _coded(parts: list[np.ndarray]) -> bytes:
    """Rows of bits, each array a whole number of bytes but for the last; filled up with ones, and stuffed."""
    out = []
    for k, bits in enumerate(parts):
        flat = bits.ravel()
        if k == len(parts) - 1 and len(flat) % 8:
            flat = np.concatenate((flat, np.ones(-len(flat) % 8, np.uint8)))
        out.append(np.packbits(flat).tobytes())
    return b"".join(out).replace(b"\xff", b"\xff\x00")


def _table(kind: int, number: int, counts: dict[int, int], symbols: bytes) -> bytes:
    return bytes([kind << 4 | number]) + bytes(counts.get(k, 0) for k in range(1, 17)) + symbols


#: Code tables of ``write``: four bits for each DC size; one bit for the only AC symbol (sizes 8 and 9, end of block).
_TABLES = (
    _table(0, 0, {4: 12}, bytes(range(12))) + _table(1, 0, {1: 1}, b"\x08") + _table(1, 1, {1: 1}, b"\x09") + _table(1, 2, {1: 1}, b"\x00")
)


def _bands(blocks: np.ndarray, first: int, last: int, drop: int) -> bytes:
    """An AC scan of the bytes ``blocks``: code bit, the leading 1 of 256 + v, and v without its last ``drop`` bits."""
    parts = []
    for k in range(0, len(blocks), _CHUNK):
        v = np.ascontiguousarray(blocks[k : k + _CHUNK, first : last + 1]).reshape(-1, 1)
        bits = np.zeros((len(v), 10 - drop), np.uint8)
        bits[:, 1] = 1
        bits[:, 2:] = np.unpackbits(v, axis=1)[:, : 8 - drop]
        parts.append(bits)
    return _coded(parts)


def _dc_bits(values: np.ndarray, which: np.ndarray) -> bytes:
    """Differences to the component's last value: four bits of size, then the bits."""
    diff = np.zeros(len(values), np.int64)
    for c in range(3):
        mine = values[which == c]
        diff[which == c] = np.diff(mine, prepend=0)
    size = np.frexp(np.abs(diff).astype(np.float64))[1]
    code = (size << size) | np.where(diff < 0, diff + (1 << size) - 1, diff)
    length = size + 4
    of = np.repeat(np.arange(len(code)), length)
    place = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
    return _coded([((code[of] >> (length[of] - 1 - place)) & 1).astype(np.uint8)])


def _layout(blocks: int) -> tuple[int, int]:
    """Coding units across and down for so many blocks (six a unit)."""
    units = max(1, -(-blocks // 6))
    across = min(units, max(64, -(-units // 4095)))
    return across, -(-units // across)


def write(payload: bytes) -> bytes:
    """A progressive JPEG that holds the payload, whose length is a positive multiple of 64."""
    if not payload or len(payload) % 64:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    across, down = _layout(len(payload) // 64)
    units = across * down
    blocks = np.zeros((units * 6, 64), np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    luma, cb, cr = blocks[: units * 4], blocks[units * 4 : units * 5], blocks[units * 5 :]
    frame = [Component(1, 2, 2, 0, 2 * down, 2 * across), Component(2, 1, 1, 0, down, across), Component(3, 1, 1, 0, down, across)]
    which, of = _interleaved(frame, 0, units)
    dc = blocks[:, 0].astype(np.int64)[of + np.array([0, units * 4, units * 5])[which]] + 256
    scan = lambda parts, first, last, shift, data: _segment(0xDA, bytes([len(parts) // 2, *parts, first, last, shift])) + data
    refine = []
    for k in range(0, len(luma), _CHUNK):
        part = luma[k : k + _CHUNK]
        bits = np.zeros((len(part), 64), np.uint8)
        bits[:, 1:] = part[:, 1:] & 1
        refine.append(bits)
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xFE, _LENGTH + struct.pack(">Q", len(payload))),
            _segment(0xDB, b"\x00" + b"\x01" * 64),
            _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
            _segment(0xC4, _TABLES),
            scan([1, 0, 2, 0, 3, 0], 0, 0, 0x01, _dc_bits(dc >> 1, which)),
            scan([1, 0], 1, 5, 0x01, _bands(luma, 1, 5, 1)),
            scan([2, 1], 1, 63, 0x00, _bands(cb, 1, 63, 0)),
            scan([3, 1], 1, 63, 0x00, _bands(cr, 1, 63, 0)),
            scan([1, 0], 6, 63, 0x01, _bands(luma, 6, 63, 1)),
            scan([1, 0, 2, 0, 3, 0], 0, 0, 0x10, _coded([(dc & 1).astype(np.uint8)])),
            scan([1, 2], 1, 63, 0x10, _coded(refine)),
            b"\xff\xd9",
        )
    )


def payload(picture: Picture) -> bytes:
    """What ``write`` stored."""
    length = next((c for c in picture.comments if c.startswith(_LENGTH)), None)
    if length is None:
        raise ValueError("the picture holds no payload")
    flat = np.concatenate([c.coefficients.reshape(-1) for c in picture.components])
    return (flat[: struct.unpack(">Q", length[len(_LENGTH) :])[0]] - 256).astype(np.uint8).tobytes()
