"""One CSV file in order, written and read by many tasks.

Writing: rows are ranged by their order, and each task writes its range as lines; the parts are joined in order in the folder
of the file, beside it, and the whole replaces what was there in one step. Nothing but file names passes the driver, and a
failure before the last step leaves the old file as it was.

Reading: the file is split by bytes. A line break ends a record only if the quotes before it are even in number, so each
split counts its quotes, and the sums of the splits before it tell whether its first line begins inside a cell. Records are
numbered in the same way. Only records of several lines, and those that may go on in the next split, are brought together.
"""

from __future__ import annotations

import csv
import io
import os
import shutil
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.shared import store


def _line(cells: list) -> str:
    out = io.StringIO()
    csv.writer(out).writerow(cells)
    return out.getvalue().removesuffix("\r\n")


def _lines(batches):
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        yield pa.record_batch([pa.array([_line(row) for row in rows], pa.string())], ["value"])


def is_local(path: str | Path) -> bool:
    return "://" not in str(path) or str(path).startswith("file://")


def local(path: str | Path) -> Path:
    return Path(str(path).removeprefix("file://"))


def uri(path: str | Path) -> str:
    """As Hadoop's paths are written, in which a percent sign stands for itself."""
    return f"file://{local(path).resolve()}" if is_local(path) else str(path)


def _joined_locally(parts: Path, header: bytes, path: Path) -> None:
    whole = parts.with_suffix(".whole")
    try:
        with open(whole, "wb") as out:
            out.write(header)
            for part in sorted(parts.glob("part-*")):
                with open(part, "rb") as own:
                    shutil.copyfileobj(own, out, 1 << 20)
        os.replace(whole, path)
    finally:
        whole.unlink(missing_ok=True)
        shutil.rmtree(parts, ignore_errors=True)


def _joined_in_store(spark: SparkSession, parts: str, header: bytes, path: str) -> None:
    """The same in any file system that Hadoop knows: parts are concatenated where it can, else streamed by the JVM."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    at = lambda p: hadoop.Path(p)
    fs, whole = at(parts).getFileSystem(conf), at(f"{parts}.whole")
    try:
        out = fs.create(whole, True)
        out.write(bytearray(header))
        names = sorted(s.getPath().toString() for s in fs.listStatus(at(parts)) if s.getPath().getName().startswith("part-"))
        for name in names:
            own = fs.open(at(name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, 1 << 20, False)
            own.close()
        out.close()
        overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        overwrite[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(at(path).toUri(), conf).rename(whole, at(path), overwrite)
    finally:
        fs.delete(whole, False)
        fs.delete(at(parts), True)


def write_ordered(rows: DataFrame, columns: tuple[str, ...], order: str, path: str | Path) -> None:
    """``columns`` of ``rows`` by ``order``, below a header. The file is complete or as it was before."""
    parts = f"{uri(path).rsplit('/', 1)[0]}/.csv-{uuid.uuid4().hex}"
    if is_local(path):
        local(path).resolve().parent.mkdir(parents=True, exist_ok=True)
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).select(*columns)
    header = (_line(list(columns)) + "\r\n").encode()
    try:
        ranged.mapInArrow(_lines, "value string").write.option("lineSep", "\r\n").text(parts)
    except BaseException:
        if is_local(path):
            shutil.rmtree(local(parts), ignore_errors=True)
        raise
    if is_local(path):
        _joined_locally(local(parts), header, local(path).resolve())
    else:
        _joined_in_store(rows.sparkSession, parts, header, str(path))


def _cells(names: list[str]):
    def parse(batches):
        for batch in batches:
            rows = [next(csv.reader(io.StringIO(r.removesuffix("\r"), newline=""), strict=False), []) for r in batch.column("record").to_pylist()]
            columns = [pa.array([row[k] if k < len(row) else None for row in rows], pa.string()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("number"), *columns], ["number", *names])

    return parse


def records(spark: SparkSession, path: str | Path) -> DataFrame:
    """number and record (its text, which may have line breaks in quotes) of every record of a file, from 0; blank lines are none."""
    read = spark.read.option("lineSep", "\n").text(uri(path)).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    quoted = read.withColumn("quotes", F.expr("length(value) - length(replace(value, '\"', ''))"))
    # quotes of the splits before: as many rows as splits
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = quoted.groupBy("block").agg(F.sum("quotes").alias("q")).withColumn("open", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2)
    inside = Window.partitionBy("block").orderBy("id")
    lines = quoted.join(F.broadcast(splits.select("block", "open")), "block")
    lines = lines.withColumn("before", F.col("open") + F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lines = lines.withColumn("blank", F.expr("before % 2 = 0 AND trim(BOTH '\\r' FROM value) = ''")).withColumn("begins", F.expr("before % 2 = 0 AND NOT blank"))
    lines = lines.filter("NOT blank")
    begun = lines.groupBy("block").agg(F.count_if("begins").alias("n")).withColumn("records", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("block", "records")
    numbered = lines.join(F.broadcast(begun), "block").withColumn("number", F.expr("records - 1") + F.sum(F.expr("if(begins, 1L, 0L)")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = numbered.withColumn("alone", F.expr("begins AND (before + quotes) % 2 = 0"))
    whole = numbered.filter("alone").select("number", F.col("value").alias("record"))
    parts = numbered.filter("NOT alone").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("parts"))
    return whole.unionByName(parts.select("number", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record")))


def read_numbered(spark: SparkSession, path: str | Path) -> tuple[list[str], DataFrame]:
    """The names in the header, and number (from 0) and cells of all rows below it; missing cells are null."""
    found = store(records(spark, path), "records").df
    first = found.filter("number = 0").first()
    names = next(csv.reader(io.StringIO((first["record"] if first else "").removesuffix("\r"), newline="")), [])
    inner = [f"c{k}" for k in range(len(names))]
    schema = T.StructType([T.StructField("number", T.LongType()), *(T.StructField(n, T.StringType()) for n in inner)])
    rows = found.filter("number > 0").withColumn("number", F.col("number") - 1).mapInArrow(_cells(inner), schema)
    return names, rows
