"""Media columns: texts as progressive JPEGs, and progressive JPEGs as RGB tensors and features.

A picture is read by accumulating its scans into coefficient arrays, transforming them back and bringing the chroma planes to
full resolution; ``rgb`` holds all samples, row by row, and features are computed from these samples alone, before they leave
the worker. Pictures and tensors leave it in pieces of a few megabytes, however many rows Spark puts into a batch.

Defined cases: a null text counts as empty, and an empty text is 64 zero bytes; equal texts give equal pictures; a very long
text is one picture, whose tensor takes twice its bytes and is one cell; a null or broken picture has null results and its
reason in ``error``; a repeated row, also of a null id, is done again; an empty table gives no rows; extra columns are kept,
and where their names clash with a result they are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import jpeg
from tessera.llm.storage import free_name

_DECODED = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("rgb", T.BinaryType()),
        T.StructField("feature", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
_KINDS = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
_ARROW = pa.struct([pa.field(f.name, _KINDS[f.dataType]) for f in _DECODED.fields])
_STRIP = 1 << 20  # samples that are looked at together
_PIECE = 1 << 22  # bytes of results that leave a worker together


def padded(text: bytes) -> bytes:
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def _pieces(results: Iterable, size: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """The results as arrays of ``_PIECE`` bytes, but for their last results, so that nobody holds more of them at once."""
    held, total = [], 0
    for x in results:
        held.append(x)
        total += size(x)
        if total >= _PIECE:
            yield pa.array(held, kind)
            held, total = [], 0
    if held:
        yield pa.array(held, kind)


@F.arrow_udf(T.BinaryType())
def encoded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    pictures = (jpeg.write(padded((x.as_py() or "").encode())) for batch in texts for x in batch)
    yield from _pieces(pictures, len, pa.binary())


def _features(width: int, height: int, rgb: np.ndarray) -> str:
    """Size, and for each channel the mean and the shares of black and of full samples."""
    n, sums, black, full = rgb.size // 3, np.zeros(3, np.int64), np.zeros(3, np.int64), np.zeros(3, np.int64)
    for k in range(0, rgb.size, 3 * _STRIP):
        for c in range(3):
            plane = np.ascontiguousarray(rgb[k + c : k + 3 * _STRIP : 3])
            sums[c] += plane.sum(dtype=np.int64)
            black[c] += plane.size - np.count_nonzero(plane)
            full[c] += np.count_nonzero(plane == 255)
    line = lambda x: ",".join(f"{v:.4f}" for v in x / max(n, 1))
    return f"{width}x{height};mean={line(sums)};black={line(black)};full={line(full)}"


def _decode(data: bytes | None) -> dict:
    if data is None:
        return dict.fromkeys(f.name for f in _ARROW) | {"error": "no picture"}
    try:
        picture = jpeg.read(data)
        rgb = b"".join(x.tobytes() for x in jpeg.strips(picture))
        out = {"width": picture.width, "height": picture.height, "rgb": rgb, "feature": _features(picture.width, picture.height, np.frombuffer(rgb, np.uint8))}
        if any(c.startswith(b"payload ") for c in picture.comments):
            held = jpeg.payload(picture)
            out |= {"payload_bytes": len(held), "payload_sha256": hashlib.sha256(held).hexdigest(), "tail_crc32": zlib.crc32(held[-64:])}
        return out
    except (ValueError, IndexError, KeyError, StopIteration) as broken:
        return {"error": f"{type(broken).__name__}: {broken}"}


@F.arrow_udf(_DECODED)
def decoded(media: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _pieces((_decode(x.as_py()) for batch in media for x in batch), lambda x: len(x.get("rgb") or b""), _ARROW)


def store_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``media``, its text as a progressive JPEG."""
    return docs.withColumn("media", encoded("text"))


def read_media(media: DataFrame) -> DataFrame:
    """``media`` with what its pictures hold, their tensors (width, height and rgb) and how these look (feature)."""
    columns = [c for c in media.columns if c not in _DECODED.names]
    name = free_name(media, "m_decoded")
    out = media.select(*(F.col(f"`{c}`") for c in columns), decoded("media").alias(name))
    return out.select(*(F.col(f"`{c}`") for c in columns), *(F.col(name)[n].alias(n) for n in _DECODED.names))
