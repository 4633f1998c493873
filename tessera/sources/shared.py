"""Tables in the folder that the driver and all executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one where the setting is missing on a local master."""
    base = spark.conf.get(_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set(_SETTING, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


class Stored:
    """A written table: ``df`` reads it, ``drop()`` deletes it once nothing needs it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.df: DataFrame = spark.read.parquet(path)

    def drop(self) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def store(df: DataFrame, name: str) -> Stored:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    kept = Stored(df.sparkSession, path)
    if Scratch._open:
        Scratch._open[-1].held.append(kept)
    return kept



class Scratch:
    """The tables that a computation writes on its way: all of them go when it leaves the block, but for its results.

    ``with Scratch() as scratch: ...``; whatever calls ``store`` inside belongs to the innermost block.
    """

    _open: list[Scratch] = []

    def __init__(self):
        self.held: list[Stored] = []

    def __enter__(self) -> Scratch:
        self._open.append(self)
        return self

    def store(self, df: DataFrame, name: str) -> DataFrame:
        return store(df, name).df

    def result(self, df: DataFrame, name: str) -> Stored:
        """A table that outlives this block and belongs to the one around it, if there is one."""
        kept = store(df, name)
        self.held.remove(kept)
        if len(self._open) > 1:
            self._open[-2].held.append(kept)
        return kept

    def __exit__(self, *failure) -> None:
        self._open.remove(self)
        for table in self.held:
            table.drop()


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores if their scan has fewer partitions than that, as a table of one row group has; else as they are.

    It stands before costly work row by row. A large table has more partitions than cores and is never shuffled here.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
