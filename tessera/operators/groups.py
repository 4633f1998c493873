"""Connected components of an edge table, and the first member of each group without a hot task for a hot group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import store

CONTRACTED = 1 << 20  # edges that a task contracts at a time
LAST = 1 << 20  # edges that one task finishes
SALTS = 16


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """node and root of every node but the roots, in order of nodes: a union-find with path halving, whose roots are the smallest."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    # parents are smaller than their children, so each looks one step up once those before it are done
    for k, up in enumerate(parent):
        parent[k] = parent[up]
    root = np.array(parent, np.int64)
    moved = root != np.arange(len(root))
    return nodes[moved], nodes[root[moved]]


def _contract(batches):
    """The edges of a partition as stars of their components, a bounded number of edges at a time."""
    held, size = [], 0

    def stars():
        a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        return pa.record_batch([pa.array(x) for x in forest(a, b)], ["a", "b"])

    for batch in batches:
        held.append([np.asarray(batch.column(k), dtype=np.int64) for k in (0, 1)])
        size += batch.num_rows
        if size >= CONTRACTED:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: each partition's are a forest of stars (node, smallest node), before anything is shuffled."""
    return edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).mapInArrow(_contract, "a bigint, b bigint")


def _round(current: DataFrame) -> DataFrame:
    """One large star and one small star."""
    both = current.union(current.selectExpr("b AS a", "a AS b"))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(lowest, "a").filter("b > a AND b <> m").selectExpr("b AS a", "m AS b").distinct()
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    return large.join(lowest, "a").filter("b <> m").selectExpr("b AS a", "m AS b").union(lowest.selectExpr("a", "m AS b")).distinct()


def components(edges: DataFrame, rounds: int = 100, last: int = LAST, told: list | None = None) -> DataFrame:
    """node and root (the smallest node of its component) of every node of ``edges`` (a, b).

    Every partition first contracts its edges by union-find, so only forests are shuffled. While more than ``last`` edges are
    left, alternating large and small stars join the stars of different partitions, and their results are contracted again;
    so few edges or less are finished by one task. Each round is written to the shared folder, so its lineage is one read.
    told: takes the number of edges of each round. Raises RuntimeError beyond ``rounds``.
    """
    current, before = store(contracted(edges.filter("a <> b")).distinct(), "edges"), None
    for _ in range(rounds):
        state = current.df.selectExpr("count(*)", "sum(xxhash64(a, b) % 1000000007)").first()
        if told is not None:
            told.append(state[0])
        ended = state == before
        if not ended:
            before, few = state, state[0] <= min(last, CONTRACTED)
            after = store(contracted(current.df.coalesce(1)) if few else contracted(_round(current.df)).distinct(), "edges")
            current.drop()
            current, ended = after, few
        if ended:
            return current.df.selectExpr("a AS node", "b AS root").union(current.df.selectExpr("b AS node", "b AS root").distinct())
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def with_first(rows: DataFrame, keys: list[str], member: str, name: str) -> DataFrame:
    """``rows`` with the smallest ``member`` of the rows with equal ``keys``, as ``name``.

    The smallest members come from a partial aggregation; only those of groups with several members are joined back, each
    once a salt, so that the rows of a hot group are spread over SALTS tasks. ``rows`` is read twice. Keys are not null.
    """
    firsts = rows.groupBy(*keys).agg(F.min(member).alias(name), F.max(member).alias("g_last")).filter(f"{name} <> g_last").drop("g_last")
    firsts = firsts.withColumn("g_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("g_salt", F.expr(f"cast(pmod(xxhash64({member}), {SALTS}) AS int)"))
    return salted.join(firsts, [*keys, "g_salt"], "left").drop("g_salt").withColumn(name, F.coalesce(F.col(name), F.col(member)))
