"""N-gram Jaccard join: near-duplicate documents by the similarity of their sets of word n-grams.

1. Every n-gram's document frequency orders them from rare to frequent. N-grams of one document alone can't be shared; they
   come first in its order and are left out after that, so most documents drop out here.
2. Documents with equal sets are one class, joined through its smallest member.
3. Prefix filter: of two sets that reach the threshold t, the first |x| - ceil(t |x|) + 1 n-grams share one. Prefix n-grams
   are the join keys. Length filter: the smaller set has t of the larger's size at least. Positional filter: what may still
   follow the shared n-gram must reach the overlap needed. Suffix filter: both sets are divided at the same values, and the
   sizes of their parts bound the overlap: 128 parts while pairs are searched, halves of halves before whole sets are met.
4. Each pair of classes is verified once, on whole sets. Members of a key first meet its hub, and only pairs whose ends are
   still in different components after that are enumerated, in parts of bounded size; a group of m near copies costs about m
   pairs and not their square, and no link between components is lost.
5. Components of the links.

Sets are sets of 64-bit hashes of n-grams (48 bits beside the hash's range).

Defined cases: a null text, and one without words, has an empty set and no link; fewer words than n are one n-gram; a very
long text is one set, made of slices of a megabyte of rows; a null id has no link; rows of equal ids count as one document
with the union of their sets; of equal texts the smallest id stays; an empty table gives no rows; extra columns, also of
clashing names, stay in ``keep_one`` and play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import repeats
from tessera.llm.groups import with_first
from tessera.llm.storage import Stored, store
from tessera.llm.wordhash import mix, runs_inside, slices, utf8, window_hashes, words
from tessera.operators.groups import components


def needed(n, t: int):
    """Of a set of n, so many elements at least are in any set that reaches t percent: ceil(n t / 100)."""
    return -(-n * t // 100)


def shingles(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Number of different n-grams of each text, and their hashes, text by text."""
    w = words(*utf8(column), lower=True)
    hashes = w.hashes()
    at = runs_inside(w, size)
    row, found = w.row[at], window_hashes(hashes, size)[at]
    many = np.diff(w.begin)
    short = np.flatnonzero((many > 0) & (many < size))
    if len(short):
        whole = [mix(hashes[w.begin[k] : w.begin[k + 1]] * np.uint64(2 * many[k] + 1) + np.arange(many[k], dtype=np.uint64)).sum(dtype=np.uint64) for k in short]
        row, found = np.concatenate((row, short)), np.concatenate((found, mix(np.array(whole, np.uint64))))
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return np.bincount(row[new], minlength=len(column)), found[new]


def sizes(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id and n_shingles of every row."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, 1):
                many, _ = shingles(part.column(1), size)
                yield pa.record_batch([part.column(0), pa.array(many, pa.int64())], ["doc_id", "n_shingles"])

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(count, "doc_id bigint, n_shingles bigint")


_PAIR = np.dtype([("times", "<u4"), ("low", "<u4"), ("high", "<u2")])
CHUNKS = 2  # chunks of documents for each bucket


def _shared_part(chunks: int):
    """Of a bucket: the (times, n-gram) that occur again, packed for each chunk of documents with ids, sizes and counts."""

    def shared(batches):
        held, size = [], 0

        def flush():
            ids, totals, many, pairs = (np.concatenate([h[k] for h in held]) for k in range(4))
            chunk = (mix(ids.view(np.uint64)) % np.uint64(chunks)).astype(np.int32)
            order = np.argsort(chunk, kind="stable")
            starts = np.cumsum(many) - many
            out = []
            cuts = np.append(np.flatnonzero(np.diff(chunk[order], prepend=-1)), len(order))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[lo:hi]
                packed = b"".join(pairs[starts[k] : starts[k] + many[k]].tobytes() for k in own)
                out.append((int(chunk[own[0]]), ids[own].tobytes(), totals[own].tobytes(), many[own].tobytes(), packed))
            return pa.record_batch([pa.array(c, x) for c, x in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["chunk", "ids", "totals", "many", "pairs"])

        for ids, many, totals, hashes, times in repeats.repeated(batches):
            hit = times > 1
            own = np.bincount(np.repeat(np.arange(len(ids)), many)[hit], minlength=len(ids))
            if not hit.any():
                continue
            pairs = np.empty(int(hit.sum()), dtype=_PAIR)
            pairs["times"] = np.minimum(times[hit], 0xFFFFFFFF)
            pairs["low"], pairs["high"] = hashes[hit] & np.uint64(0xFFFFFFFF), hashes[hit] >> np.uint64(32)
            some = own > 0
            held.append((ids[some].astype("<i8"), totals[some].astype("<u4"), own[some].astype("<i8"), pairs))
            size += len(pairs)
            if size > 1 << 22:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return shared


def _ordered(t: int):
    """Chunks to (doc_id, n, k, grams): all shared n-grams of a document from rare to frequent; the first k are its prefix."""

    def order(batches):
        for parts in repeats.of_chunks(batches, ["ids", "totals", "many", "pairs"]):
            read = lambda name, kind: np.concatenate([np.frombuffer(p[name], kind) for p in parts])  # noqa: B023, E731
            ids, totals, many, pairs = read("ids", "<i8"), read("totals", "<u4"), read("many", "<i8"), read("pairs", _PAIR)
            doc, place = np.unique(ids, return_inverse=True)
            n_of = np.zeros(len(doc), np.int64)
            np.maximum.at(n_of, place, totals)
            # equal low bits in different buckets would differ in the bucket, which is left out here: once in 2**48
            gram = pairs["low"].astype(np.uint64) | pairs["high"].astype(np.uint64) << np.uint64(32)
            of = np.repeat(place, many)
            by = np.lexsort((gram, pairs["times"], of))
            of, gram = of[by], gram[by]
            new = np.ones(len(of), dtype=bool)
            new[1:] = (of[1:] != of[:-1]) | (gram[1:] != gram[:-1])
            of, gram = of[new], gram[new]
            cuts = np.searchsorted(of, np.arange(len(doc) + 1))
            shared = np.diff(cuts)
            k_of = n_of - needed(n_of, t) + 1 - (n_of - shared)
            rows = [(int(doc[d]), int(n_of[d]), int(k_of[d]), gram[cuts[d] : cuts[d + 1]].astype("<u8").tobytes()) for d in np.flatnonzero(k_of > 0)]
            yield pa.record_batch([pa.array(c, x) for c, x in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "n", "k", "grams"])

    return order


def candidate_sets(docs: DataFrame, size: int, t: int) -> Stored:
    """Documents that may have a partner: doc_id, n, k, grams."""
    buckets = repeats.buckets_for(docs)
    rows = docs.filter("doc_id IS NOT NULL").selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    parts = repeats.dealt(rows, lambda c: shingles(c, size), buckets).mapInArrow(_shared_part(buckets * CHUNKS), "chunk int, ids binary, totals binary, many binary, pairs binary")
    # a chunk holds half as much as a bucket at any size of the corpus, since there are more chunks with more buckets
    chunks = repeats.by_chunk(parts, buckets * CHUNKS)
    return store(chunks.mapInArrow(_ordered(t), "doc_id bigint, n int, k int, grams binary"), "sets")


def _postings(batches):
    """Each prefix n-gram: gram, doc_id, n, m (shared n-grams in all), pos."""
    for batch in batches:
        for doc_id, n, k, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            g = np.frombuffer(grams, "<u8")
            same = lambda v, kind: pa.array(np.full(k, v), kind)  # noqa: B023, E731
            yield pa.record_batch([pa.array(g[:k].view(np.int64)), same(doc_id, pa.int64()), same(n, pa.int32()), same(len(g), pa.int32()), pa.array(np.arange(k), pa.int32())], ["gram", "doc_id", "n", "m", "pos"])


def _bound(x: np.ndarray, y: np.ndarray, needed_overlap: int, depth: int = 3) -> bool:
    """Suffix filter: whether sorted sets may share so many elements, judged by the sizes of their parts."""
    if min(len(x), len(y)) < needed_overlap:
        return False
    if depth == 0 or len(x) < 2:
        return True
    p = x[len(x) // 2]
    i, j = len(x) // 2, int(np.searchsorted(y, p))
    left, right = min(i, j), min(len(x) - i, len(y) - j)
    if left + right < needed_overlap:
        return False
    return _bound(x[:i], y[:j], needed_overlap - right, depth - 1) and _bound(x[i:], y[j:], needed_overlap - left, depth - 1)


def _verified(t: int):
    def verify(batches):
        for batch in batches:
            out = []
            for a, b, na, nb, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                need = -(-(na + nb) * t // (100 + t))
                x, y = np.sort(np.frombuffer(x, "<u8")), np.sort(np.frombuffer(y, "<u8"))
                if _bound(x, y, need) and len(np.intersect1d(x, y, assume_unique=True)) >= need:
                    out.append((a, b))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], []))], ["a", "b"])

    return verify


def _links(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold, each verified once."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("grams").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(_verified(t), "a bigint, b bigint")


BLOCK = 1024  # members of a key that are compared with as many in one task
PARTS = 128


def blocked(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """``postings`` (with gram and doc_id) with row, column and role: who meets whom in which part of a gram's square.

    Up to ``block`` members meet in one part, as both sides. More are dealt to blocks by a hash of their ids, and each block
    meets each other one in a part of its own, so a gram of any number of members is compared in parts of bounded size.
    """
    counts = postings.groupBy("gram").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = postings.join(counts, "gram", "left").withColumn("own", F.expr("if(blocks IS NULL, 0, cast(pmod(xxhash64(doc_id, gram), blocks) AS int))"))
    index = "transform(sequence(0, blocks - 1), k -> struct(own AS row, k AS column, 1 AS role))"
    probe = "transform(sequence(0, blocks - 1), k -> struct(k AS row, own AS column, 2 AS role))"
    places = f"if(blocks IS NULL, array(struct(0 AS row, 0 AS column, 3 AS role)), concat({index}, {probe}))"
    return dealt.withColumn("place", F.explode(F.expr(places))).selectExpr("* EXCEPT (blocks, own, place)", "place.row", "place.column", "place.role")


def _part_sizes(batches):
    """doc_id and how many of its shared n-grams are in each of PARTS ranges of their hashes."""
    for batch in batches:
        sizes = [np.bincount((mix(np.frombuffer(g.as_py(), "<u8")) % np.uint64(PARTS)).astype(np.int64), minlength=PARTS).astype("<u4").tobytes() for g in batch.column("grams")]
        yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.binary())], ["doc_id", "sizes"])


def _across(t: int):
    """Postings in order of gram and part to pairs of different components that pass the length and positional filters here.

    Of a pair, the smaller set is met in its index prefix: |x| - ceil(2 t / (1 + t) |x|) + 1.
    """

    def pairs_of(g: np.ndarray, sizes: np.ndarray):
        n, m, pos, root, doc, role = (g[:, k] for k in range(3, 9))
        index = np.flatnonzero((role != 2) & (pos < n - -(-2 * t * n // (100 + t)) + 1 - (n - m)))
        i, j = index[:, None], np.flatnonzero(role != 1)[None]
        ok = (root[i] != root[j]) & ((n[i] < n[j]) | (n[i] == n[j]) & (doc[i] < doc[j])) & (100 * n[i] >= t * n[j])
        need = -(-(n[i] + n[j]) * t // (100 + t))
        ok &= np.minimum(pos[i], pos[j]) + 1 + np.minimum(m[i] - pos[i], m[j] - pos[j]) - 1 >= need
        x, y = np.nonzero(ok)
        x, y = i[x, 0], j[0, y]
        for k in range(0, len(x), 1 << 16):  # suffix filter
            part = slice(k, k + (1 << 16))
            both = np.minimum(sizes[x[part]], sizes[y[part]]).sum(1)
            near = both >= need_of(n[x[part]], n[y[part]])
            yield from emit(doc, n, m, pos, x[part][near], y[part][near])

    def emit(doc, n, m, pos, x, y):
        if len(x):
            yield pa.record_batch([pa.array(c) for c in (doc[x], doc[y], m[x] - pos[x] - 1, m[y] - pos[y] - 1, need_of(n[x], n[y]))], ["a", "b", "rest_a", "rest_b", "need"])

    need_of = lambda x, y: -(-(x + y) * t // (100 + t))

    def across(batches):
        columns = ("gram", "row", "column", "n", "m", "pos", "root", "doc_id", "role")
        held, sizes = np.zeros((0, 9), np.int64), np.zeros((0, PARTS), np.uint32)
        for batch in batches:
            held = np.concatenate((held, np.column_stack([np.asarray(batch.column(c), dtype=np.int64) for c in columns])))
            sizes = np.concatenate((sizes, np.frombuffer(b"".join(batch.column("sizes").to_pylist()), "<u4").reshape(-1, PARTS)))
            cuts = np.flatnonzero((np.diff(held[:, :3], axis=0) != 0).any(1)) + 1
            for lo, hi in zip(np.append(0, cuts[:-1]), cuts, strict=False):
                yield from pairs_of(held[lo:hi], sizes[lo:hi])
            if len(cuts):
                held, sizes = held[cuts[-1] :], sizes[cuts[-1] :]
        if len(held):
            yield from pairs_of(held, sizes)

    return across


def link_components(docs: DataFrame, size: int = 5, t: int = 75) -> DataFrame:
    """doc_id and component_id (the smallest linked id) of every document that is linked with another one."""
    found = candidate_sets(docs, size, t)
    # classes of equal sets; a set with n-grams of its own equals no other
    key = F.when(F.length("grams") == 8 * F.col("n"), F.concat(F.md5("grams"), F.crc32("grams"))).otherwise(F.concat(F.lit("own "), "doc_id"))
    members = store(with_first(found.df.select("doc_id", key.alias("key")), ["key"], "doc_id", "rep").select("doc_id", "rep"), "members")
    sets = store(found.df.join(members.df.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi"), "class-sets")
    found.drop()
    postings = store(sets.df.mapInArrow(_postings, "gram bigint, doc_id bigint, n int, m int, pos int"), "postings")
    shared = postings.df.groupBy("gram").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).filter("hub <> last").drop("last")
    # one candidate a class first: the hub with which it shares most prefix n-grams
    stars = postings.df.join(shared, "gram").filter("doc_id <> hub").groupBy("doc_id", "hub").count()
    best = stars.groupBy("doc_id").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub"))
    tried = store(best.selectExpr("hub AS a", "doc_id AS b"), "tried")  # a hub is the smallest id of its gram, so a < b
    first = store(_links(tried.df, sets.df, t), "links")
    roots = components(first.df)
    # then what may link two components
    placed = postings.df.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    placed = store(placed, "placed")
    postings.drop()
    several = placed.df.groupBy("gram").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("gram")
    parts = sets.df.mapInArrow(_part_sizes, "doc_id bigint, sizes binary")
    dealt = blocked(placed.df.join(several, "gram", "left_semi")).join(parts, "doc_id")
    dealt = dealt.repartition("gram", "row", "column").sortWithinPartitions("gram", "row", "column", "doc_id")
    pairs = dealt.select("gram", "row", "column", "n", "m", "pos", "root", "doc_id", "role", "sizes").mapInArrow(_across(t), "a bigint, b bigint, rest_a bigint, rest_b bigint, need bigint")
    # positional filter over all shared prefix n-grams: what is shared so far, and what can still follow
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("rest_a").alias("ra"), F.min("rest_b").alias("rb"), F.max("need").alias("need"))
    pairs = pairs.filter("c + least(ra, rb) >= need").selectExpr("least(a, b) AS a", "greatest(a, b) AS b")
    second = store(_links(pairs.join(tried.df, ["a", "b"], "left_anti"), sets.df, t), "links")  # whole sets are met once a pair
    placed.drop()
    more = second.df.union(roots.selectExpr("root AS a", "node AS b").filter("a <> b"))
    final = components(more)
    sets.drop()
    out = members.df.join(final.withColumnRenamed("node", "rep"), "rep", "left").selectExpr("doc_id", "coalesce(root, rep) AS component_id")
    return out.filter("doc_id <> component_id").unionByName(out.filter("doc_id <> component_id").selectExpr("component_id AS doc_id", "component_id").distinct())


def near_duplicates(docs: DataFrame, size: int = 5, t: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    linked = link_components(docs, size, t).filter("doc_id <> component_id").distinct()
    return sizes(docs, size).join(linked, "doc_id", "left").selectExpr("doc_id", "n_shingles", "coalesce(component_id, doc_id) AS component_id")


def keep_one(docs: DataFrame, size: int = 5, t: int = 75) -> DataFrame:
    """One document of each component, the one with the smallest id; the columns stay. Rows without an id stay."""
    away = link_components(docs, size, t).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(away, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
