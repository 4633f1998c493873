"""Tables in the shared folder, as the whole library keeps them, and the release of finished shuffles."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.shared import Scratch, Stored, new_path, shared_folder, spread, store

__all__ = ["Scratch", "Stored", "free_name", "new_path", "release_shuffles", "shared_folder", "spread", "store"]


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner delete the shuffle files of finished jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, or with as many underscores behind it as it takes to be none of the columns of ``rows``."""
    have = {c.lower() for c in rows.columns}
    while name.lower() in have:
        name += "_"
    return name
