"""Places of rows inside their groups, whatever the size of a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import Scratch


def _local(batches):
    """Each row with the number of its partition and its place among the partition's rows of its group (the first column)."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0)
        codes = np.asarray(group.dictionary_encode(null_encoding="encode").indices)
        heads = np.flatnonzero(np.diff(codes, prepend=-1))
        if last is None or group[0] != last:
            n = 0
        place = np.arange(len(codes)) - np.repeat(heads, np.diff(np.append(heads, len(codes))))
        place[: heads[1] if len(heads) > 1 else len(codes)] += n
        last, n = group[len(codes) - 1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), part, np.int32)), pa.array(place.astype(np.int64))], [*batch.schema.names, "r_part", "pos"])


def ranked(rows: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` (of a stored table) with ``pos``: the place, from 0, by ``order`` among the rows of equal ``group`` (never null).

    Rows are dealt by ranges of group, order and a number of their own, so that a group of a third of all rows, or of equal
    rows, lies in many partitions; the ranked rows are written, since ranges are sampled anew in each run. Only the first
    group of a partition can have begun in an earlier one: so many counts, one a partition at most, are broadcast.
    """
    names = [group, *(c for c in rows.columns if c != group)]
    keys = [group, *order, "r_tie"]
    ranged = rows.select(*names).withColumn("r_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([*ranged.schema.fields, T.StructField("r_part", T.IntegerType()), T.StructField("pos", T.LongType())])
    at = scratch.store(ranged.mapInArrow(_local, schema), "ranked")
    pieces = at.groupBy(group, "r_part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(group).orderBy("r_part").rowsBetween(Window.unboundedPreceding, -1))
    before = pieces.withColumn("r_before", earlier).filter("r_before > 0").select(F.col(group).alias("r_group"), F.col("r_part").alias("r_in"), "r_before")
    met = at.join(F.broadcast(before), F.expr(f"r_part = r_in AND {group} = r_group"), "left")
    return met.withColumn("pos", F.expr("pos + coalesce(r_before, 0L)")).select(*names, "pos")
