"""64-bit fingerprints: hexadecimal text at rest, signed longs for bit operations."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_long(hexadecimal: str) -> Column:
    """The long with the bits of up to 16 hexadecimal digits; null for an empty text."""
    return F.expr(f"if({hexadecimal} = '', NULL, cast(conv({hexadecimal}, 16, -10) AS bigint))")


def to_hex(value: str) -> Column:
    return F.expr(f"lower(lpad(hex({value}), 16, '0'))")


def hamming(a: str, b: str) -> Column:
    return F.expr(f"bit_count({a} ^ {b})")


def block_masks(n: int) -> list[int]:
    """Masks of n blocks that divide the 64 bits from the lowest on, as evenly as may be."""
    cuts = [64 * k // n for k in range(n + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def simhash_of(words: list[bytes]) -> str:
    """Bit i is set if more than half of the words' MD5 sums (first 8 bytes, big end first) have it set; '' without words."""
    if not words:
        return ""
    places: dict[bytes, int] = {}
    order = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words))
    sums = np.frombuffer(b"".join(hashlib.md5(w).digest()[:8] for w in places), np.uint8).reshape(-1, 8)
    times = np.bincount(order)
    have = times @ np.unpackbits(sums, axis=1).astype(np.int64)
    return np.packbits(have * 2 > len(words)).tobytes().hex()


@F.arrow_udf(T.StringType())
def simhash(text: pa.Array) -> pa.Array:
    """The fingerprint of a text's words (runs outside ASCII white space), folded inside its row: nothing is shuffled."""
    return pa.array([simhash_of((t or "").encode().split()) for t in text.to_pylist()], pa.string())
