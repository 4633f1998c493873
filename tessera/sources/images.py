"""Image files: decoding by Spark's image source in the JVM, PNG writing, and the per-file scan facts."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.pixels import canonical_hash, is_grayscale, resize

# Fixed value: suffixes of image files, compared in lower case.
SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp")


class ImageError(OSError):
    """A file is missing or no image."""


def pixels_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB from Spark's image struct, which holds gray, BGR or BGRA bytes."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[..., 2::-1].copy()


#: The same for Hadoop's globs, which know case.
SUFFIX_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s[1:]) for s in SUFFIXES) + "}"


def scanned(spark: SparkSession, folders: list[str], decode: bool = True) -> DataFrame:
    """path, folder and name of the image files directly in ``folders`` (of any file system), and image where ``decode`` is set.

    One scan lists, reads and decodes: Spark packs files into tasks by size, so a folder of very many files is many tasks and
    nothing is joined. image is null for what is no image. As everywhere in Spark, files whose names begin with a dot or an
    underscore are not seen.
    """
    if not folders:
        return spark.createDataFrame([], "path string, folder string, name string, " + ("image struct<height:int,width:int,nChannels:int,data:binary>" if decode else "image string"))
    reader = spark.read.format("image" if decode else "binaryFile").option("pathGlobFilter", SUFFIX_GLOB)
    if decode:
        found = reader.option("dropInvalid", False).load(folders).select(_plain_paths("image.origin").alias("path"), _pixels_or_null().alias("image"))
    else:
        found = reader.load(folders).select(_plain_paths("path").alias("path"), F.lit(None).cast("string").alias("image"))  # no content is read
    return found.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "image")


def _pixels_or_null():
    return F.when(F.col("image.height") > 0, F.struct("image.height", "image.width", "image.nChannels", "image.data"))


def subfolders(spark: SparkSession, root: str) -> list[str] | None:
    """Names of the folders in a folder of any file system, in order; None if there is no such folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return None
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())


def loaded(files: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """``files`` (with path) and image: height, width, nChannels and data, or null for what is missing or no image.

    A join on the path brings file contents to their rows; paths are unique, so it has no hot key. paths: the files, where
    the caller knows them one by one, so that nothing else in their folders is read.
    """
    spark = files.sparkSession
    if paths is None:
        folders = [r[0] for r in files.select(F.regexp_replace("path", "/[^/]*$", "")).distinct().collect()]  # as many as classes
        own = [f for f in folders if f and Path(f).is_dir() and any(x.is_file() for x in Path(f).iterdir())]
    else:
        own = [f for f in paths if Path(f).is_file()]
    if not own:
        return files.withColumn("image", F.expr("cast(NULL AS struct<height:int,width:int,nChannels:int,data:binary>)"))
    read = spark.read.format("image").option("dropInvalid", False).load([f"file://{Path(f).resolve()}" for f in own])
    found = read.select(_plain_paths("image.origin").alias("i_path"), _pixels_or_null().alias("image"))
    return files.join(found, files["path"] == found["i_path"], "left").drop("i_path")


def _plain_path(uri: str) -> str:
    from urllib.parse import unquote, urlsplit

    return unquote(urlsplit(uri).path) if uri.startswith("file:") else uri


@F.arrow_udf(T.StringType())
def _plain_paths(uris: pa.Array) -> pa.Array:
    return pa.array([_plain_path(u) if u else u for u in uris.to_pylist()], pa.string())


def judged(files: DataFrame, compute_hash: bool = True) -> DataFrame:
    """``files`` (with image) with phash, gray and error instead of image."""

    def facts(batches):
        for batch in batches:
            phash, gray, error = [], [], []
            for image in batch.column("image").to_pylist():
                if image is None:
                    phash.append(""), gray.append(False), error.append("no image")
                    continue
                pixels = pixels_of(image["height"], image["width"], image["nChannels"], image["data"])
                phash.append(canonical_hash(pixels) if compute_hash else "")
                gray.append(is_grayscale(pixels))
                error.append(None)
            own = [batch.column(c) for c in names]
            yield pa.record_batch([*own, pa.array(phash, pa.string()), pa.array(gray, pa.bool_()), pa.array(error, pa.string())], [*names, "phash", "gray", "error"])

    names = [c for c in files.columns if c != "image"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "image")
    return files.mapInArrow(facts, f"{kept}, phash string, gray boolean, error string")


def load_image(path: str, size: int | None = None) -> np.ndarray:
    """One file as RGB on the driver, through the JVM's decoder. Raises ImageError."""
    from pyspark.sql import SparkSession

    jvm = SparkSession.active().sparkContext._jvm
    image = None
    if Path(path).is_file():
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(path)))
    if image is None:
        raise ImageError(f"{path} is no image that can be read")
    height, width = image.getHeight(), image.getWidth()
    argb = np.array(image.getRGB(0, 0, width, height, None, 0, width), dtype=np.int64).reshape(height, width)
    rgb = np.stack([(argb >> s & 0xFF).astype(np.uint8) for s in (16, 8, 0)], -1)
    return rgb if size is None else resize(rgb, size, size)


def png(pixels: np.ndarray) -> bytes:
    """RGB bytes as a PNG file."""
    height, width, _ = pixels.shape
    lines = np.concatenate((np.zeros((height, 1), np.uint8), np.ascontiguousarray(pixels, np.uint8).reshape(height, -1)), axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def save_image(pixels: np.ndarray, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(png(pixels))


Loader = Callable[[str, int], np.ndarray]
