"""Image manifests: a scan of ``root/<class>/<image>``, validation, and CSV at the edges.

Inside Spark a manifest is a table with path, label, source, group_id, phash ('' if not computed) and row_idx, the place in
the scan (class folder, then file name). CSV files are replaced in one step.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.labels import compact_key, group_of_name, label_table, spellings, with_canonical
from tessera.operators.groups import with_first
from tessera.sources.csvfile import is_local, local, read_numbered, uri, write_ordered
from tessera.sources.images import judged, scanned, subfolders
from tessera.sources.shared import store

COLUMNS = ("path", "label", "source", "group_id", "phash")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)
# The rules of validation, in the order in which a row's problems are told.
RULES = ("empty path", "duplicate path", "label is not canonical", "unknown label", "empty group_id", "bad phash", "file not found")


SHOWN = 5


class ManifestError(ValueError):
    """``problems`` are the first faults that were told; ``total`` counts all of them. The message has five."""

    def __init__(self, problems, total: int | None = None):
        self.problems = list(problems)
        self.total = len(self.problems) if total is None else total
        more = self.total - len(self.problems[:SHOWN])
        super().__init__(f"{self.total} manifest problem(s): " + "; ".join(self.problems[:SHOWN]) + (f" (+{more} more)" if more > 0 else ""))


TOLD = 10_000


@dataclass
class ScanReport:
    """corrupt: paths of the first TOLD files that are no image; n_corrupt counts all of them."""

    rows: DataFrame
    unknown_folders: list[str]
    corrupt: list[str]
    grayscale: int
    n_corrupt: int = 0

    def class_counts(self) -> dict[str, int]:
        return {r["label"]: r["n"] for r in self.rows.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()}

    def imbalance_ratio(self) -> float:
        counts = self.class_counts().values()
        return max(counts) / min(counts) if counts else 0.0


def scan_folder(spark: SparkSession, root: str | Path, source: str, compute_hash: bool = True, check_images: bool = True) -> ScanReport:
    """Rows of all images below known class folders. Folders of unknown name and files that are no image are reported."""
    folders = subfolders(spark, uri(root))  # as many as classes
    if folders is None:
        raise ManifestError([f"there is no folder {root}"])
    known = spellings()
    key = lambda name: "".join(c for c in name.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    unknown = [name for name in folders if key(name) not in known]
    decode = compute_hash or check_images
    found = scanned(spark, [f"{uri(root)}/{name}" for name in folders if key(name) in known], decode)
    found = judged(found, compute_hash) if decode else found.selectExpr("path", "folder", "name", "'' AS phash", "false AS gray", "CAST(NULL AS string) AS error")
    listed = numbered(found, "folder", "name")
    listed = listed.persist()
    gray = listed.filter("error IS NULL AND gray").count()
    bad = listed.filter("error IS NOT NULL")
    told = [r["path"] for r in bad.orderBy("row_idx").limit(TOLD).select("path").collect()]
    broken = len(told) if len(told) < TOLD else bad.count()
    rows = with_canonical(listed.filter("error IS NULL"), "folder")
    rows = rows.select("path", "label", F.lit(source).alias("source"), F.concat(F.lit(f"{source}:"), group_of_name("name")).alias("group_id"), "phash", "row_idx")
    return ScanReport(rows, unknown, told, gray, broken)


def problems(rows: DataFrame, check_files: bool = True) -> DataFrame:
    """row_idx, rule, rank (place in RULES) and value of every fault of ``rows``."""
    own = rows.withColumn("p_key", compact_key("label"))
    known = label_table(rows.sparkSession).withColumnsRenamed({"key": "p_key", "canonical": "p_label"})
    own = own.join(F.broadcast(known), "p_key", "left")
    # a path that very many rows repeat is no window: its first row comes from a partial aggregation
    own = with_first(own, ["path"], "row_idx", "p_first").withColumn("p_again", F.expr("row_idx > p_first"))
    tests = [
        ("path = ''", "path"),
        ("p_again", "path"),
        ("p_label IS NOT NULL AND p_label <> label", "label"),
        ("p_label IS NULL", "label"),
        ("group_id = ''", "group_id"),
        ("phash <> '' AND NOT phash RLIKE '^[0-9a-f]{16}$'", "phash"),
    ]
    if check_files:
        own = own.withColumn("p_there", _file_exists("path"))
        tests.append(("path <> '' AND NOT p_there", "path"))
    found = [f"if({test}, struct({k} AS rank, '{RULES[k]}' AS rule, {value} AS value), NULL)" for k, (test, value) in enumerate(tests)]
    return own.select("row_idx", F.explode(F.expr(f"array_compact(array({', '.join(found)}))")).alias("p")).select("row_idx", "p.*")


def _file_exists(column: str):
    @F.arrow_udf(T.BooleanType())
    def there(path: pa.Array) -> pa.Array:
        return pa.array([bool(p) and os.path.isfile(p) for p in path.to_pylist()])

    return there(column)


def validate(rows: DataFrame, check_files: bool = True, told: int = 1000) -> None:
    """Raise ManifestError with the first faults (``told`` at most; all are counted), in order of rows and rules."""
    found = problems(rows, check_files).persist()
    total = found.count()
    first = found.orderBy("row_idx", "rank").limit(told).collect() if total else []
    found.unpersist()
    faults = [f"row {r['row_idx'] + 1}: {r['rule']}" + (f" {r['value']!r}" if r["value"] else "") for r in first]
    if rows.isEmpty():
        faults, total = ["manifest is empty", *faults], total + 1
    if total:
        raise ManifestError(faults, total)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with row_idx by ``order``; a manifest is as long as its images are many, so its rows are ranked in ranges.

    The ranged rows are written first: counts and ranks must see the same ranges, whose bounds are sampled anew in each run.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = store(ranged.withColumn("n_part", F.spark_partition_id()).withColumn("n_id", F.monotonically_increasing_id()), "ranged").df
    counts = at.groupBy("n_part").agg(F.count("*").alias("n"), F.min("n_id").alias("n_first"))
    before = counts.withColumn("n_before", F.coalesce(F.sum("n").over(Window.orderBy("n_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return at.join(F.broadcast(before), "n_part").withColumn("row_idx", F.expr("n_before + n_id - n_first")).select(*rows.columns, "row_idx")


def write_manifest(rows: DataFrame, path: str | Path) -> Path:
    """The rows as one CSV file in order of row_idx (or of path). The file is complete or as it was before."""
    write_ordered(rows, COLUMNS, "row_idx" if "row_idx" in rows.columns else "path", path)
    return Path(path) if is_local(path) else path


def read_manifest(spark: SparkSession, path: str | Path, check_files: bool = True) -> DataFrame:
    """A validated manifest. Missing cells are '', further columns go."""
    if is_local(path) and not local(path).is_file():
        raise FileNotFoundError(path)
    names, found = read_numbered(spark, path)
    missing = [c for c in COLUMNS if c not in names]
    if missing:
        raise ManifestError([f"{path}: missing column(s) {missing}"])
    rows = found.select(*(F.coalesce(F.col(f"c{names.index(c)}"), F.lit("")).alias(c) for c in COLUMNS), F.col("number").alias("row_idx"))
    validate(rows, check_files)
    return rows


def write_splits(result, out_dir: str | Path) -> Path:
    """train.csv, val.csv, test.csv and split_report.json."""
    import json

    out = Path(out_dir)
    for name in ("train", "val", "test"):
        write_manifest(result.part(name).drop("row_idx"), out / f"{name}.csv")
    (out / "split_report.json").write_text(json.dumps(result.summary(), indent=2), encoding="utf-8")
    return out


def read_splits(spark: SparkSession, split_dir: str | Path, check_files: bool = True) -> DataFrame:
    """The three manifests as one table with ``split``; row_idx counts through all of them. An empty one raises ManifestError."""
    out, begun = None, 0
    for name in ("train", "val", "test"):
        part = read_manifest(spark, Path(split_dir) / f"{name}.csv", check_files)
        own = part.withColumn("row_idx", F.col("row_idx") + F.lit(begun)).withColumn("split", F.lit(name))
        out, begun = own if out is None else out.unionByName(own), begun + part.count()
    return out
