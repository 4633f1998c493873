"""Secrets in texts and in what is encoded inside them.

A text is the first layer of a worklist. Each layer is scanned; then whatever it encodes is unwrapped and becomes a further
layer: percent escapes, Unicode escapes (``\\uXXXX``, ``\\UXXXXXXXX``, ``\\xXX``, ``&#N;``, ``&#xX;``), base64 of both alphabets,
and gzip, zlib, bzip2 or LZMA data inside base64. This goes on until no layer gives a new one. A layer is known by its digest
and its place in the text, so data that unwrap to themselves, or two spellings of one layer, are gone through once.

Every layer knows where each of its characters came from, piece by piece: a span of a deep layer is mapped through all layers to
code points of the text. Escapes are mapped character by character, base64 by groups of four, and compressed data as a whole.
A span of a deeper layer counts only if it touches something decoded; the rest of that layer is the layer before.

Defined cases: a null or empty text has no span; ids play no part, so null and repeated ones are rows of their own; equal spans
from several layers are one; a very long text is scanned whole in one row; data that decompress to more than ``MOST`` bytes are
not unwrapped, since one row must not fill a worker, and their place is a span of the kind ``packed``; an empty table has no
row; extra columns, also of clashing names, play no part.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "packed")
MOST = 1 << 26  # bytes of one unwrapped layer

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run shorter than 16 fails as a whole
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")

Span = tuple[int, str, int]  # start, kind, end


def scan(text: str) -> list[Span]:
    """The spans of one layer, leftmost and not overlapping within a kind."""
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return found


class Layer:
    """A text and, piece by piece, where it came from.

    A piece is (start in this layer, start and end in the first text, decoded). Characters of a piece that is not decoded are
    as many as in the first text and map one to one; those of a decoded piece map to the piece as a whole.
    """

    def __init__(self, text: str, pieces: list[tuple[int, int, int, bool]]):
        self.text, self.pieces = text, pieces
        self.starts = [p[0] for p in pieces]

    def place(self, at: int) -> tuple[int, int]:
        """Start and end in the first text of the character at ``at``."""
        start, lo, hi, decoded = self.pieces[bisect_right(self.starts, at) - 1]
        return (lo, hi) if decoded else (lo + at - start, lo + at - start + 1)

    def range(self, start: int, end: int) -> tuple[int, int]:
        return self.place(start)[0], self.place(end - 1)[1]

    def touches(self, start: int, end: int) -> bool:
        """Whether a character from ``start`` to ``end`` is decoded."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1)
        return any(p[3] for p in self.pieces[first:last])

    def cut(self, start: int, end: int, shift: int) -> list[tuple[int, int, int, bool]]:
        """The pieces of a part of this layer, as pieces of another one in which the part begins at ``shift``."""
        out = []
        for k in range(bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1)):
            begun, lo, hi, decoded = self.pieces[k]
            at = max(begun, start)
            out.append((at - start + shift, lo if decoded else lo + at - begun, hi, decoded))
        return out

    def replaced(self, found: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
        """This layer with parts decoded: (start, end, [(characters, start and end of what they were)])."""
        texts, pieces, at, size = [], [], 0, 0
        for start, end, parts in found:
            if start > at:
                pieces += self.cut(at, start, size)
                texts.append(self.text[at:start])
                size += start - at
            for characters, lo, hi in parts:
                pieces.append((size, *self.range(lo, hi), True))
                texts.append(characters)
                size += len(characters)
            at = end
        if at < len(self.text):
            pieces += self.cut(at, len(self.text), size)
            texts.append(self.text[at:])
        return Layer("".join(texts), pieces)


def _characters(raw: bytes) -> list[tuple[str, int, int]] | None:
    """The characters of UTF-8 bytes with the places of their bytes; None if there are others."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        out.append((c, at, at + n))
        at += n
    return out


def _percent(layer: Layer) -> Layer | None:
    found = []
    for m in _URL.finditer(layer.text):
        own = _characters(bytes.fromhex(m[0].replace("%", "")))
        if own is not None:
            found.append((m.start(), m.end(), [(c, m.start() + 3 * lo, m.start() + 3 * hi) for c, lo, hi in own]))
    return layer.replaced(found) if found else None


def _escapes(layer: Layer) -> Layer | None:
    found, high = [], None
    for m in _UNICODE.finditer(layer.text):
        digits = m[0][2:].rstrip(";")
        value = int(digits) if m[0].startswith("&#") and digits[0] not in "xX" else int(digits.lstrip("xX"), 16)
        if 0xDC00 <= value < 0xE000 and high and high[1] == m.start():  # the second half of a pair
            value, start = 0x10000 + ((high[2] - 0xD800) << 10) + value - 0xDC00, high[0]
        else:
            start = m.start()
        high = (m.start(), m.end(), value) if 0xD800 <= value < 0xDC00 else None
        if value < 0x110000 and not 0xD800 <= value < 0xE000:
            found.append((start, m.end(), [(chr(value), start, m.end())]))
    return layer.replaced(found) if found else None


def _bounded(feed, raw: bytes) -> bytes | None:
    """The decompressed bytes; None if they are broken. Raises OverflowError beyond MOST."""
    try:
        out = feed(raw, MOST + 1)
    except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
        return None
    if len(out) > MOST:
        raise OverflowError
    return out


def _gzip(raw: bytes, most: int) -> bytes:
    """All members, one behind another."""
    out = b""
    while raw.startswith(b"\x1f\x8b") and len(out) < most:
        member = zlib.decompressobj(31)
        out += member.decompress(raw, most - len(out))
        raw = member.unused_data
    return out


_PACKED = (
    (b"\x1f\x8b", _gzip),
    (b"\x78", lambda raw, most: zlib.decompressobj().decompress(raw, most)),
    (b"BZh", lambda raw, most: bz2.BZ2Decompressor().decompress(raw, most)),
    (b"\xfd7zXZ", lambda raw, most: lzma.LZMADecompressor().decompress(raw, most)),
)


def _unpacked(raw: bytes) -> tuple[bytes, bool]:
    """What is left when all layers of compression are gone, and whether there was one. Data that hold themselves are left as they are."""
    seen, packed = set(), False
    while (digest := hashlib.sha256(raw).digest()) not in seen:
        seen.add(digest)
        for magic, feed in _PACKED:
            if raw.startswith(magic) and (out := _bounded(feed, raw)):
                raw, packed = out, True
                break
    return raw, packed


def _encoded(layer: Layer) -> tuple[list[Layer], list[tuple[int, int]]]:
    """The layers inside base64, and the places of those that are too large to unwrap."""
    out, large = [], []
    for m in _BASE64.finditer(layer.text):
        own = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        if len(own) % 4 == 1:
            continue
        try:
            raw, packed = _unpacked(base64.b64decode(own + "=" * (-len(own) % 4)))
        except binascii.Error:
            continue
        except OverflowError:
            large.append(layer.range(m.start(), m.end()))
            continue
        text = raw.decode(errors="replace") if packed else None
        if packed:
            out.append(Layer(text, [(0, *layer.range(m.start(), m.end()), True)]))
        elif (own := _characters(raw)) and not _CONTROL.search(text := raw.decode()):
            quads = lambda lo, hi: (m.start() + lo // 3 * 4, min(m.start() + -(-hi // 3) * 4, m.end()))
            out.append(Layer(text, [(k, *layer.range(*quads(lo, hi)), True) for k, (_, lo, hi) in enumerate(own)]))
    return out, large


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """The spans of the text itself, and those of all layers with these, each in order of start and kind."""
    order = lambda found: sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
    if not text:
        return [], []
    base = order(scan(text))
    every, seen = set(base), set()
    work = [Layer(text, [(0, 0, len(text), False)])]
    while work:
        layer = work.pop()
        if not layer.text:
            continue
        known = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.range(0, len(layer.text)))
        if known in seen:
            continue
        seen.add(known)
        if len(seen) > 1:
            for start, kind, end in scan(layer.text):
                if layer.touches(start, end):
                    lo, hi = layer.range(start, end)
                    every.add((lo, kind, hi))
        work += [x for x in (_percent(layer), _escapes(layer)) if x]
        inner, large = _encoded(layer)
        work += inner
        every |= {(lo, "packed", hi) for lo, hi in large}
    return base, order(every)


def written(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in found)


_FOUND = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]], T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])


@F.arrow_udf(_FOUND)
def _scanned(text: pa.Array) -> pa.Array:
    out = []
    for t in text:
        base, every = spans(t.as_py() or "")
        counts = [sum(s[1] == k for s in base) for k in KINDS[:3]]
        out.append(dict(zip(("n_assign", "n_access", "n_hex", "base", "spans"), (*counts, written(base), written(every)), strict=True)))
    return pa.array(out, pa.struct([*[(f"n_{k}", pa.int64()) for k in KINDS[:3]], ("base", pa.string()), ("spans", pa.string())]))


def scanned(text: str) -> Column:
    """n_assign, n_access and n_hex (spans of the text itself), base and spans (``kind:start:end`` joined by commas) of a column of texts."""
    return _scanned(text)
