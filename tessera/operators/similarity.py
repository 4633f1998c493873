"""Near-duplicates by Hamming distance, and the groups that they join.

Rows have path, label, source, group_id, phash ('' if there is none) and row_idx, their place in the manifest, which decides
ties and which group id a merged group keeps. Within one manifest row_idx and path are both unique; across manifests only
path is, so whatever compares two of them goes by path.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bits import block_masks, hamming, to_long
from tessera.operators.groups import components

MOST_KEYS = 4096  # of one hash


def shuffled(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of tables that grow with the rows, never by a broadcast.

    Spark guesses a table's size from compressed files and does not count what an explode adds, so that it would gather such
    a table on the driver as if it were small.
    """
    return left.hint("merge").join(right, on, how)


def hashed(rows: DataFrame, *keep: str) -> DataFrame:
    """row_idx (or the columns to keep) and hash of the rows that have one."""
    return rows.filter("phash <> ''").select(*(keep or ("row_idx",)), to_long("phash").alias("hash"))


def blocks_for(values: DataFrame, distance: int, sample: int = 1 << 16) -> int:
    """Into how many blocks the 64 bits are cut: with the least work a hash, its keys and the others that share one together.

    Of b blocks, values within ``distance`` agree in b - distance at least. One key for each choice of so many blocks makes
    C(b, distance) keys of about 64 (b - distance) / b bits: more blocks are more keys, but longer ones, so buckets stay
    small as hashes become many. How many share a key is counted, since fingerprints are far from even, on about ``sample``
    of the hashes; their number alone scales what is counted. The choice decides about speed and never about the result.
    """
    several = [b for b in range(distance + 1, min(distance + 4, 64) + 1) if b == distance + 1 or comb(b, distance) <= MOST_KEYS]
    n = values.count()
    if len(several) == 1 or n < 2:
        return several[0]
    part = max(1, n // sample)
    some = values.filter(F.expr(f"pmod(xxhash64(hash), {part}) = 0"))
    met = some.select(F.explode(F.array(*(F.struct(F.lit(b).alias("blocks"), _keys(distance, b).alias("own")) for b in several))).alias("k"))
    met = met.select("k.blocks", F.explode("k.own").alias("key"))
    counts = met.groupBy("blocks", "key").count().groupBy("blocks").agg(F.expr("sum(count * (count - 1) / 2)").alias("pairs"), F.expr("sum(count)").alias("rows"))
    found = {r["blocks"]: r["pairs"] * comb(r["blocks"], distance) / r["rows"] * part for r in counts.collect()}
    return min(several, key=lambda b: comb(b, distance) + found.get(b, 0))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def index_keys(distance: int, blocks: int) -> list[tuple[int, list[int]]]:
    """For each choice of blocks: their mask, and the masks of blocks before its last one that are not chosen.

    The choices of a pair are those inside its equal blocks. The first one holds the first equal blocks, so a pair belongs to
    the one choice in which all blocks that are passed over differ.
    """
    masks, out = block_masks(blocks), []
    for chosen in combinations(range(blocks), blocks - distance):
        passed = [masks[k] for k in range(chosen[-1]) if k not in chosen]
        out.append((_signed(sum(masks[k] for k in chosen)), [_signed(m) for m in passed]))
    return out


def _keys(distance: int, blocks: int) -> Column:
    """The keys of a column ``hash``, as structs of choice and bits."""
    own = [F.struct(F.lit(k).alias("choice"), F.col("hash").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")) for k, (mask, _) in enumerate(index_keys(distance, blocks))]
    return F.array(*own)


def near_hashes(left: DataFrame, right: DataFrame, distance: int, blocks: int | None = None) -> DataFrame:
    """l_hash, r_hash and distance of the pairs of different values within ``distance``, by a block-permutation index.

    Values are compared if they agree in all blocks of a choice (``index_keys``), and a pair is taken in its first choice
    only, so no distinct is needed. blocks: counted from the values (``blocks_for``) unless given. Raises ValueError for
    distances over 63, at which there is nothing to compare: every pair would be near.
    """
    if distance > 63:
        raise ValueError("64-bit values are compared up to a distance of 63")
    if blocks is None:
        blocks = blocks_for(left.select("hash") if left is right else left.select("hash").union(right.select("hash")), distance)
    cut = lambda df, side: df.select(F.col("hash").alias(f"{side}_hash"), F.explode(_keys(distance, blocks)).alias("b")).select(f"{side}_hash", "b.*")
    passed = [F.array(*(F.lit(m).cast("bigint") for m in others)) if others else F.array().cast("array<bigint>") for _, others in index_keys(distance, blocks)]
    met = shuffled(cut(left, "l"), cut(right, "r"), ["choice", "bits"])
    met = met.withColumn("distance", hamming("l_hash", "r_hash")).filter(F.col("distance") <= distance)
    first = ~F.exists(F.element_at(F.array(*passed), F.col("choice") + 1), lambda m: F.col("l_hash").bitwiseXOR(F.col("r_hash")).bitwiseAND(m) == 0)
    return met.filter(first).select("l_hash", "r_hash", "distance")


def near_duplicate_pairs(rows: DataFrame, distance: int) -> DataFrame:
    """a < b (row_idx) and distance of all pairs within ``distance``. Equal hashes are joined as one value and expanded after that."""
    own = hashed(rows)
    values = own.select("hash").distinct()
    near = near_hashes(values, values, distance).filter("l_hash < r_hash") if distance >= 0 else None
    if near is None:
        return own.sparkSession.createDataFrame([], "a bigint, b bigint, distance int")
    left, right = own.selectExpr("row_idx AS i", "hash AS l_hash"), own.selectExpr("row_idx AS j", "hash AS r_hash")
    same = shuffled(left, right.withColumnRenamed("r_hash", "l_hash"), "l_hash").filter("i < j").selectExpr("i AS a", "j AS b", "0 AS distance")
    other = shuffled(shuffled(near, left, "l_hash"), right, "r_hash").selectExpr("least(i, j) AS a", "greatest(i, j) AS b", "distance")
    return same.unionByName(other)


def _stars(rows: DataFrame, keys: str) -> DataFrame:
    """Each row with the first row of its key: as many edges as rows, also in a large group."""
    first = rows.groupBy(keys).agg(F.min("row_idx").alias("b"))
    return shuffled(rows, first, keys).filter("row_idx <> b").selectExpr("row_idx AS a", "b")


def group_edges(rows: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) between rows of one group and between first rows of near hashes; a group of equal hashes is a star."""
    edges = _stars(rows.select("row_idx", "group_id"), "group_id")
    if distance < 0:
        return edges
    own = hashed(rows)
    firsts = own.groupBy("hash").agg(F.min("row_idx").alias("first"))
    near = near_hashes(firsts, firsts, distance).filter("l_hash < r_hash")
    near = shuffled(near, firsts.selectExpr("hash AS l_hash", "first AS a"), "l_hash")
    near = shuffled(near, firsts.selectExpr("hash AS r_hash", "first AS b"), "r_hash")
    return edges.unionByName(_stars(own, "hash")).unionByName(near.select("a", "b"))


def merge_groups(rows: DataFrame, distance: int = 4) -> DataFrame:
    """``rows`` whose group_id also joins near-duplicates: a merged group keeps the id of its first row."""
    roots = components(group_edges(rows, distance)).withColumnRenamed("node", "row_idx")
    ids = rows.selectExpr("row_idx AS root", "group_id AS m_group")
    moved = shuffled(roots.filter("row_idx <> root"), ids, "root").select("row_idx", "m_group")
    out = shuffled(rows, moved, "row_idx", "left").withColumn("group_id", F.coalesce("m_group", "group_id")).drop("m_group")
    return out.select(rows.columns)
