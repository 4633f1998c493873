"""A Merkle manifest of a dataset: leaf, subtree, root and proof digests, and the proof that a changed row breaks.

Documents are placed in their source by ranges (``ranks``) and cut into aligned blocks of ``ARITY ** levels`` leaves. One task
traverses a block in postorder: it returns the digest of each subtree and, while it unwinds, appends the siblings to the leaves
that the subtree contains. The roots of aligned blocks are the leaves of another distributed traversal, until every source has
one block; the roots of the sources, in order, are traversed in the same way. A source of a third of all documents is so many
blocks as it has documents; nothing but a block is ever held by a task, and its siblings are packed into one row, to which the
siblings above it are joined.

Digests are SHA-256 and travel as 32 bytes; they are concatenated as hexadecimal text. With each sibling list goes one byte a
level: the node's own place in its run and the number of its siblings.

Defined cases: a null column counts as ``-`` in its leaf, and a null source is a source of its own, before all others; rows of
a source are in order of id, null first, and rows of one id in order of their leaf; repeated rows are leaves of their own; an
empty text is no null; a very long text is one digest; an empty table has no row; extra columns, also of clashing names, play
no part. A row with a null id is never tampered with.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ranks import ranked
from tessera.llm.storage import Scratch

ARITY = 3
LEVELS = 7  # of a block: 2187 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(columns: dict[str, str]) -> str:
    """SQL of a row's leaf, as 32 bytes; ``columns`` gives the expressions of FIELDS."""
    part = lambda x: f"if(({x}) IS NULL, '-', concat(octet_length(cast({x} AS string)), ':', cast({x} AS string)))"
    return f"unhex(sha2(concat({', '.join(part(columns[c]) for c in FIELDS)}), 256))"


def combined(digests: list[bytes]) -> bytes:
    """The digest of a node with the digests of its children."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def levels_of(n: int) -> int:
    """How often n nodes are combined until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def traverse(leaves: list[bytes], level: int, first: int, paths: list[bytearray], marks: list[bytearray]) -> bytes:
    """The digest of the subtree of ``ARITY ** level`` leaves from ``first`` on (fewer at the end).

    On the way back the siblings of each child are appended to the paths of the leaves below it, and its place to their marks.
    """
    if level == 0:
        return leaves[first]
    span = ARITY ** (level - 1)
    starts = range(first, min(first + ARITY * span, len(leaves)), span)
    children = [traverse(leaves, level - 1, k, paths, marks) for k in starts]
    for own, start in enumerate(starts):
        siblings = b"".join(children[:own] + children[own + 1 :])
        mark = own * ARITY + len(children) - 1
        for leaf in range(start, min(start + span, len(leaves))):
            paths[leaf] += siblings
            marks[leaf].append(mark)
    return combined(children)


def folded(digest: bytes, path: bytes, marks: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    at = 0
    for mark in marks:
        own, n = divmod(mark, ARITY)
        siblings = [path[at + 32 * k : at + 32 * (k + 1)] for k in range(n)]
        at += 32 * n
        digest = combined([*siblings[:own], digest, *siblings[own:]])
    return digest


_BLOCK = "grp string, block bigint, root binary, ids array<bigint>, digests array<binary>, others array<binary>, paths array<binary>, marks array<binary>"
_BLOCK_TYPES = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 4]


def _traversed(levels: int):
    """Rows (grp, pos, id, digest, other) in order of grp and pos, to a row a block; other: a digest that goes with the row."""

    def blocks(batches):
        size = ARITY**levels
        key, held = None, []

        def done():
            leaves = [r[1] for r in held]
            paths, marks = [bytearray() for _ in leaves], [bytearray() for _ in leaves]
            # the only block of a group is as high as it must be, all others are of full height
            height = levels_of(len(leaves)) if key[1] == 0 and len(leaves) < size else levels
            root = traverse(leaves, height, 0, paths, marks)
            columns = [[key[0]], [key[1]], [root], [[r[0] for r in held]], [leaves], [[r[2] for r in held]], [list(map(bytes, paths))], [list(map(bytes, marks))]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _BLOCK_TYPES, strict=True)], [x.split(" ")[0] for x in _BLOCK.split(", ")])

        for batch in batches:
            for grp, pos, own, digest, other in zip(*(batch.column(c).to_pylist() for c in ("grp", "pos", "id", "digest", "other")), strict=True):
                if held and (grp, pos // size) != key:
                    yield done()
                    held = []
                key = (grp, pos // size)
                held.append((own, digest, other))
        if held:
            yield done()

    return blocks


def _blocks(nodes: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """The traversed blocks of nodes (grp, pos, id, digest, other), as a table."""
    dealt = nodes.withColumn("block", F.expr(f"pos div {ARITY**levels}")).repartition("grp", "block").sortWithinPartitions("grp", "pos")
    return scratch.store(dealt.select("grp", "pos", "id", "digest", "other").mapInArrow(_traversed(levels), _BLOCK), "blocks")


_ABOVE = "grp string, pos bigint, path binary, marks binary, root binary"


def _upward(batches):
    """Each node of a block with its siblings up to the root: those in the block, then those above the block."""
    for batch in batches:
        for row in batch.to_pylist():
            n = len(row["ids"])
            path = [p + (row["a_path"] or b"") for p in row["paths"]]
            marks = [m + (row["a_marks"] or b"") for m in row["marks"]]
            root = row["a_root"] or row["root"]
            yield pa.record_batch([pa.array([row["grp"]] * n), pa.array(row["ids"], pa.int64()), pa.array(path, pa.binary()), pa.array(marks, pa.binary()), pa.array([root] * n, pa.binary())], [x.split(" ")[0] for x in _ABOVE.split(", ")])


def climbed(nodes: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """grp, pos, path, marks and root of every node (grp, pos, digest): its siblings up to the root of its group."""
    packed = _blocks(nodes.selectExpr("grp", "pos", "pos AS id", "digest", "cast(NULL AS binary) AS other"), levels, scratch)
    return _with_above(packed, levels, scratch).mapInArrow(_upward, _ABOVE)


def _with_above(packed: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """Blocks with a_path, a_marks and a_root: what is above them, from a traversal of the blocks' roots."""
    if packed.filter("block > 0").isEmpty():
        return packed.selectExpr("*", "cast(NULL AS binary) AS a_path", "cast(NULL AS binary) AS a_marks", "cast(NULL AS binary) AS a_root")
    above = climbed(packed.selectExpr("grp", "block AS pos", "root AS digest"), levels, scratch)
    return packed.join(above.selectExpr("grp", "pos AS block", "path AS a_path", "marks AS a_marks", "root AS a_root"), ["grp", "block"])


_OUT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_OUT_TYPES = [pa.int64(), *[pa.string()] * 5, pa.bool_()]


def _proved(batches):
    """A row a document, from blocks with the siblings above them in their source and in the tree of sources."""
    for batch in batches:
        for row in batch.to_pylist():
            out = []
            above, more = (row["a_path"] or b"") + row["s_path"], (row["a_marks"] or b"") + row["s_marks"]
            subroot, root = (row["a_root"] or row["root"]).hex(), row["s_root"]
            for own, leaf, other, path, marks in zip(row["ids"], row["digests"], row["others"], row["paths"], row["marks"], strict=True):
                path += above
                found = folded(other or leaf, path, marks + more)
                out.append((own, leaf.hex(), subroot, root.hex(), hashlib.sha256(path.hex().encode()).hexdigest(), found.hex(), found == root))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT_TYPES, strict=True)], [x.split(" ")[0] for x in _OUT.split(", ")])


def manifest(documents: DataFrame, tampered: str, now: str, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``documents``.

    tampered: a condition on rows; where it holds, the leaf that is folded is that of the text ``now``, an expression.
    levels: height of a block, which a task holds: ``ARITY ** levels`` leaves.
    """
    own = {c: c for c in FIELDS}
    rows = documents.selectExpr(
        "cast(doc_id AS bigint) AS id", "if(source IS NULL, '', concat('s', source)) AS grp", f"{leaf_of(own)} AS digest",
        f"if(coalesce({tampered}, false), {leaf_of(own | {'text': now})}, NULL) AS other",
    )
    with Scratch() as scratch:
        placed = ranked(scratch.store(rows, "leaves"), "grp", ["id", "digest"], scratch)
        packed = _blocks(placed, levels, scratch)
        light = packed.select("grp", "block", "root")
        above = scratch.store(_with_above(light.withColumns({"ids": F.array("block"), "paths": F.array(F.lit(b"")), "marks": F.array(F.lit(b""))}), levels, scratch).select("grp", "block", "a_path", "a_marks", "a_root", "root"), "above")
        # the tree of sources, whose subroots are in order of their names
        subroots = above.filter("block = 0").selectExpr("grp AS name", "coalesce(a_root, root) AS digest", "'' AS grp")
        ordered = scratch.store(ranked(scratch.store(subroots, "subroots"), "grp", ["name"], scratch), "sources")
        sources = climbed(ordered, levels, scratch).drop("grp").join(ordered.select("name", "pos"), "pos")
        # a source of very many blocks is spread over as many salts as it has blocks, 16 at most
        counts = above.groupBy(F.col("grp").alias("name")).agg(F.max("block").alias("most"))
        sources = sources.join(counts, "name").selectExpr("name AS grp", "path AS s_path", "marks AS s_marks", "root AS s_root", "explode(sequence(0L, least(most, 15L))) AS salt")
        ways = above.withColumn("salt", F.expr("block % 16")).join(sources, ["grp", "salt"]).drop("salt", "root")
        return scratch.result(packed.join(ways, ["grp", "block"]).mapInArrow(_proved, _OUT), "merkle").df
