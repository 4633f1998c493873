"""A prefix trie of conversations, family first.

Conversations share beginnings with the base of their family (the id without its remainder by 5). A family's rows are brought
together by cogroup, the conversations rebuilt, and the family's small trie built; only its nodes, each once a family however
many conversations pass it, are shuffled to merge equal nodes of all families. Sums over subtrees need no walk over the merged
trie. A node belongs to its smallest member, and a conversation owns its nodes from some depth on: so in a second cogroup each
family adds, to every node that a conversation passes but does not own, what this conversation saves there and the leaf that it
brings; these sums are merged as the nodes are.

A node is known by the sum of digests of (depth, turn) on its path, modulo 2^128. Sums can be continued: a conversation of more
than ``CHUNK`` turns is cut, its parts are rebuilt in different tasks, and the sums of the parts before are added after that.
Turns are placed by ranges (``ranks``), so one conversation may hold a third of all rows, and one first turn begin a third of
all conversations. Texts are read once; a digest and a length stand for them.

Defined cases: a null role or text is empty; a null turn comes first; equal turn numbers are ordered by the MD5 digest of role
and text, and repeated rows are turns of their own; rows without a conversation id belong to no conversation and are left out;
the remainder has the sign of the id, as in SQL; a very long text is a length and a digest; an empty table gives no node;
extra columns, also of clashing names, play no part.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.ranks import ranked
from tessera.llm.storage import Scratch

FAMILY = 5  # ids of a family
HEAD = 9  # a conversation takes fewer turns than this from its base
CHUNK = 1024  # turns of a conversation in one group
FAMILIES = 32  # in one group, so that groups of a few turns do not cost more than their work
_SALTS = 16
_ROOT = bytes(16)


def head_of(conv: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv).encode()) % HEAD


def base_of(conv: int) -> int:
    return conv - (abs(conv) % FAMILY) * (1 if conv >= 0 else -1)


def _added(key: int, depth: int, digest: bytes) -> int:
    """The key of a child from that of its parent."""
    return (key + int.from_bytes(hashlib.md5(digest + depth.to_bytes(8, "big")).digest(), "big")) % (1 << 128)


def _bytes(key: int) -> bytes:
    return key.to_bytes(16, "big")


_FOUND = "part bigint, chunk bigint, key binary, parent binary, depth bigint, bytes bigint, members array<bigint>, ends array<bigint>, goes_on array<bigint>"
_FOUND_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]


def _family_tries(chunk_size: int):
    """From a group's facts (conv_id, n, n_base) and turns (conv_id, pos, digest, bytes): the nodes of its families' tries."""

    def build(key, facts: pa.Table, turns: pa.Table) -> pa.Table:
        part, chunk = (k.as_py() for k in key)
        known = {c: (n, n_base) for c, n, n_base in zip(*(facts.column(k).to_pylist() for k in ("conv_id", "n", "n_base")), strict=True)}
        own: dict[int, list] = {c: [] for c in sorted(known)}
        for conv, pos, digest, size in sorted(zip(*(turns.column(k).to_pylist() for k in ("conv_id", "pos", "digest", "bytes")), strict=True)):
            own[conv].append((pos, digest, size))
        nodes: dict[tuple, list] = {}

        def visit(family, key, parent, depth, size, conv):
            # the nodes of different families meet only in the merge, and parts behind the first are not yet comparable
            found = nodes.setdefault((family, key), [_bytes(key), _bytes(parent), depth, size, [], [], []])
            found[4].append(conv)
            return found

        for conv, rows in own.items():
            n, n_base = known[conv]
            base, h = base_of(conv), head_of(conv)
            shift = h - min(h, n_base)
            if chunk == 0:
                taken = [*[(k, *r[1:]) for k, r in enumerate(own.get(base, [])[:h])], *[(r[0] - shift, *r[1:]) for r in rows[h:]]]
                node, at = visit(base, 0, 0, 0, 0, conv), 0
            else:
                taken, at = [(r[0] - shift, *r[1:]) for r in rows], 0
            for pos, digest, size in taken:
                parent, at = at, _added(at, pos + 1, digest)
                node = visit(base if chunk == 0 else conv, at, parent, pos + 1, size, conv)
            node[6 if n > (chunk + 1) * chunk_size else 5].append(conv)
        columns = list(zip(*nodes.values(), strict=True)) or [[]] * 7
        return pa.table([pa.array(c, t) for c, t in zip([[part] * len(nodes), [chunk] * len(nodes), *columns], _FOUND_TYPES, strict=True)], [x.split(" ")[0] for x in _FOUND.split(", ")])

    return build


def _running(batches):
    """conv_id, chunk and the sum of the keys of the chunks before, from rows in order of both."""
    last, total = None, 0
    for batch in batches:
        convs, chunks, keys = (batch.column(c).to_pylist() for c in ("conv_id", "chunk", "key"))
        before = []
        for conv, key in zip(convs, keys, strict=True):
            total = total if conv == last else 0
            last = conv
            before.append(_bytes(total))
            total = (total + int.from_bytes(key, "big")) % (1 << 128)
        yield pa.record_batch([pa.array(convs, pa.int64()), pa.array(chunks, pa.int64()), pa.array(before, pa.binary())], ["conv_id", "chunk", "before"])


@F.arrow_udf(T.BinaryType())
def _sum(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_bytes((int.from_bytes(x, "big") + int.from_bytes(y, "big")) % (1 << 128)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.binary())


def _group(conv: str) -> str:
    """The group of a conversation's family: FAMILIES families of neighbouring ids."""
    return f"cast(floor(({conv} - {conv} % {FAMILY}) / {FAMILY * FAMILIES}D) AS bigint)"


def _family_nodes(turns: DataFrame, chunk: int, scratch: Scratch) -> DataFrame:
    """part, chunk, key, parent, depth, bytes, members and ends of the nodes of every family, and of the parts of long conversations."""
    facts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    bases = facts.filter(f"conv_id % {FAMILY} = 0").selectExpr("conv_id AS base", "n AS n_base")
    facts = facts.withColumn("base", F.expr(f"conv_id - conv_id % {FAMILY}")).join(bases, "base", "left").selectExpr("conv_id", "n", "coalesce(n_base, 0L) AS n_base", f"{_group('conv_id')} AS part")
    facts = scratch.store(facts.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {chunk})"))), "facts")
    rows = turns.withColumns({"part": F.expr(_group("conv_id")), "chunk": F.expr(f"pos div {chunk}")})
    found = scratch.store(facts.groupBy("part", "chunk").cogroup(rows.groupBy("part", "chunk")).applyInArrow(_family_tries(chunk), _FOUND), "families")
    # parts behind a conversation's first start from the sum of all before them
    ended = found.filter("chunk > 0").groupBy(F.col("members")[0].alias("conv_id"), "chunk").agg(F.max_by("key", "depth").alias("key"))
    ended = ended.union(found.select(F.explode("goes_on").alias("conv_id"), "chunk", "key").filter("chunk = 0"))
    before = ended.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_running, "conv_id bigint, chunk bigint, before binary").filter("chunk > 0")
    columns = ["part", "chunk", "key", "parent", "depth", "bytes", "members", "ends"]
    later = found.filter("chunk > 0").withColumn("conv_id", F.col("members")[0]).join(before, ["conv_id", "chunk"])
    later = later.withColumns({"key": _sum("key", "before"), "parent": _sum("parent", "before")})
    return scratch.store(found.filter("chunk = 0").select(*columns).union(later.select(*columns)), "nodes")


def _merged(found: DataFrame, scratch: Scratch) -> DataFrame:
    """key, parent, depth, bytes, conv_id, n_convs, n_ends and n_children of every node of the global trie."""
    one = found.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"), F.min(F.col("members")[0]).alias("conv_id"),
        F.sum(F.size("members")).alias("n_convs"), F.sum(F.size("ends")).alias("n_ends"),
    )
    one = scratch.store(one, "merged")
    children = one.filter("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    return scratch.store(one.join(children, "key", "left").withColumn("n_children", F.expr("coalesce(n_children, 0L)")), "trie")


def _owners(nodes: DataFrame) -> DataFrame:
    """conv_id, first and last (depths of the nodes that it owns), chain (bytes of these), leaf (whether the last one is childless), and key and parent of the first."""
    first = lambda c: F.min_by(c, "depth").alias(f"first_{c}")
    leaf = F.max(F.expr("if(n_children = 0, 1L, 0L)")).alias("leaf")
    return nodes.groupBy("conv_id").agg(F.min("depth").alias("first"), F.max("depth").alias("last"), F.sum("bytes").alias("chain"), leaf, first("key"), first("parent"))


def _brought(key, facts: pa.Table, nodes: pa.Table) -> pa.Table:
    """key, saved and leaves: what conversations add to the nodes that they pass and do not own."""
    names = ("conv_id", "first", "chain", "leaf", "after")
    known = {c: list(rest) for c, *rest in zip(*(facts.column(k).to_pylist() for k in names), strict=True)}
    out = []
    rows = zip(*(nodes.column(k).to_pylist() for k in ("depth", "key", "bytes", "members")), strict=True)
    for depth, node, size, members in sorted(rows, key=lambda r: -r[0]):
        saved = leaves = 0
        passed = False
        for conv in members:
            fact = known[conv]
            fact[3] += size  # bytes from this node on
            if fact[0] is None or depth < fact[0]:
                passed, saved, leaves = True, saved + fact[3] - fact[1], leaves + fact[2]
        if passed:
            out.append((node, saved, leaves))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, [pa.binary(), pa.int64(), pa.int64()], strict=True)], ["key", "saved", "leaves"])


def _subtrees(found: DataFrame, owners: DataFrame, scratch: Scratch) -> DataFrame:
    """key, saved and leaves: sums over all conversations that pass a node without owning it."""
    within = found.select("part", "chunk", "bytes", F.explode("members").alias("conv_id")).groupBy("part", "chunk", "conv_id").agg(F.sum("bytes").alias("own"))
    later = F.sum("own").over(Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1))
    facts = within.withColumn("after", F.coalesce(later, F.lit(0))).join(owners.select("conv_id", "first", "chain", "leaf"), "conv_id", "left")
    facts = scratch.store(facts.selectExpr("part", "chunk", "conv_id", "first", "coalesce(chain, 0L) AS chain", "coalesce(leaf, 0L) AS leaf", "after"), "owned")
    rows = found.select("part", "chunk", "key", "depth", "bytes", "members")
    brought = facts.groupBy("part", "chunk").cogroup(rows.groupBy("part", "chunk")).applyInArrow(_brought, "key binary, saved bigint, leaves bigint")
    return brought.groupBy("key").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def _texts(batches, most: int = 1 << 16):
    """key, first and the decimal ids of a run of a node's ends, joined by commas, ``most`` characters long or a little longer."""
    out, run, size = [], [], 0
    last = None

    def flush():
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, [pa.binary(), pa.int64(), pa.string()], strict=True)], ["key", "first", "ids"])

    for batch in batches:
        for key, conv in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id")), strict=True):
            if run and (key != last or size > most):
                out.append((last, int(run[0]), ",".join(run)))
                run, size = [], 0
            last = key
            run.append(str(conv))
            size += len(run[-1]) + 1
        if len(out) >= 2048 or size + sum(len(r[2]) for r in out[-64:]) > 1 << 22:
            yield flush()
            out = []
    if run:
        out.append((last, int(run[0]), ",".join(run)))
    yield flush()


def _hashes(batches):
    """key and ends_sha256 from the runs of ids of each key in order."""
    last, state, out = None, None, []
    for batch in batches:
        for key, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "ids")), strict=True):
            if key != last:
                if state:
                    out.append((last, state.hexdigest()))
                last, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 2, [pa.binary(), pa.string()], strict=True)], ["key", "ends_sha256"])
        out = []
    if state:
        yield pa.record_batch([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])


def _end_digests(found: DataFrame, scratch: Scratch) -> DataFrame:
    """key and ends_sha256. Ids are sorted and joined in ranges of many tasks, so that the task of a node goes through few long runs."""
    ends = scratch.store(found.filter("size(ends) > 0").select("key", F.explode("ends").alias("conv_id")), "ends")
    runs = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_texts, "key binary, first bigint, ids string")
    return runs.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_hashes, "key binary, ends_sha256 string")


def trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    ``conversations`` has conv_id, turn, role and text. chunk: turns of a conversation that one task rebuilds, at least HEAD.
    """
    if chunk < HEAD:
        raise ValueError(f"a part of a conversation has {HEAD} turns at least")
    own = conversations.filter("conv_id IS NOT NULL").selectExpr("cast(conv_id AS bigint) AS conv_id", "turn", "coalesce(role, '') AS role", "coalesce(text, '') AS text")
    own = own.selectExpr("conv_id", "turn", "unhex(md5(concat(octet_length(role), ':', role, text))) AS digest", "cast(octet_length(text) AS bigint) AS bytes")
    with Scratch() as scratch:
        turns = ranked(scratch.store(own, "turns"), "conv_id", ["turn", "digest"], scratch)
        found = _family_nodes(turns, chunk, scratch)
        nodes = _merged(found, scratch)
        owners = scratch.store(_owners(nodes), "owners")
        # the parent of a node is its owner's, but for the first that the owner has; a parent may have very many of those
        salted = nodes.filter("n_children > 1 OR (n_children = 1 AND n_ends > 0)").selectExpr("key AS first_parent", "conv_id AS parent_conv_id", f"explode(sequence(0, {_SALTS - 1})) AS salt")
        heads = owners.filter("first > 0").selectExpr("first_key", "first_parent", f"cast(pmod(xxhash64(first_key), {_SALTS}) AS int) AS salt").join(salted, ["first_parent", "salt"])
        heads = heads.selectExpr("first_key AS key", "parent_conv_id")
        # the leaf of a node's owner, sought in parts of the owner's depths
        leaves = owners.filter("leaf = 1").select("conv_id", F.explode(F.expr(f"sequence(first div {chunk}, last div {chunk})")).alias("deep"), F.lit(1).cast("bigint").alias("owned"))
        shared = nodes.filter("n_convs > 1").selectExpr("key", "conv_id", f"depth div {chunk} AS deep").join(leaves, ["conv_id", "deep"]).select("key", "owned")
        out = nodes.join(heads, "key", "left").join(_subtrees(found, owners, scratch), "key", "left").join(shared, "key", "left").join(_end_digests(found, scratch), "key", "left")
        out = out.selectExpr(
            "conv_id", "depth", "if(depth = 0, NULL, coalesce(parent_conv_id, conv_id)) AS parent_conv_id", "n_convs", "n_children",
            "if(n_convs = 1, 1L, coalesce(leaves, 0L) + coalesce(owned, 0L)) AS n_leaves", "coalesce(saved, 0L) AS saved_tokens", "coalesce(ends_sha256, sha2('', 256)) AS ends_sha256",
        )
        return scratch.result(out, "conversation-trie").df
