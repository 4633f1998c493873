"""Substring deduplication with difference-cover anchors.

A word is removed if a window of ``size`` words covers it whose words also start earlier (in a document of smaller id, or
before in the same one). Windows are judged on the input.

1. Anchors: runs of size - period + 1 words that start at cover positions modulo the period. For any two places there is a
   shift below the period that brings both to cover positions, so equal windows share an aligned anchor that lies in both.
   Only |cover| / period of all places are hashed and shuffled.
2. Windows around an anchor that occurs again are candidates; their whole hashes tell which of them start earlier elsewhere.
3. The later ones cover the words to remove; matches of any length are unions of their windows.

Two shuffles of packed hashes, and two of the texts (to bring the answers of 1 and 2 back to them).

Defined cases: a null or empty text has no words; a null id is neither judged nor counts as earlier; rows with equal ids do
not see one another, but a repetition inside each; a text of fewer words than a window keeps all; a very long text is one
row, hashed a megabyte at a time; an empty table gives no rows; extra columns, also of clashing names, are kept by
``cleaned`` and play no part.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import repeats
from tessera.llm.storage import free_name, release_shuffles, store
from tessera.llm.wordhash import Words, mix, slices, utf8, window_hashes, words

PERIOD = 13
COVER = (0, 1, 3, 9)  # each difference modulo 13 occurs


def _anchors(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words at which anchors start, and their hashes."""
    length = size - PERIOD + 1
    hashes = window_hashes(w.hashes(), length)
    inside = w.row[: len(hashes)] == w.row[length - 1 :][: len(hashes)]
    place = np.arange(len(hashes)) - w.begin[w.row[: len(hashes)]]
    at = np.flatnonzero(inside & np.isin(place % PERIOD, COVER))
    return at, hashes[at]


def _anchor_hashes(size: int):
    def hasher(column):
        w = words(*utf8(column))
        at, hashes = _anchors(w, size)
        return np.bincount(w.row[at], minlength=len(column)), hashes

    return hasher


_ANSWER = "chunk int, bucket int, ids binary, many binary, bits binary"
CHUNKS = 2  # chunks of documents for each bucket


def _answers(marks, bucket: int, chunks: int):
    """Marked hashes of the documents that have any, packed for each chunk of documents: ids, counts and bits."""
    names, kinds = ["chunk", "bucket", "ids", "many", "bits"], (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    held, size = [], 0

    def flush():
        ids, many, mark = (np.concatenate([h[k] for h in held]) for k in range(3))
        chunk = (mix(ids.view(np.uint64)) % np.uint64(chunks)).astype(np.int32)
        order = np.argsort(chunk, kind="stable")
        starts = np.cumsum(many) - many
        cuts = np.append(np.flatnonzero(np.diff(chunk[order], prepend=-1)), len(order))
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[lo:hi]
            bits = np.packbits(np.concatenate([mark[starts[k] : starts[k] + many[k]] for k in own]))
            out.append((int(chunk[own[0]]), bucket, ids[own].tobytes(), many[own].astype("<u4").tobytes(), bits.tobytes()))
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for ids, many, mark in marks:
        of = np.repeat(np.arange(len(ids)), many)
        some = np.bincount(of, mark, minlength=len(ids)) > 0
        if some.any():
            held.append((ids[some].astype("<i8"), many[some], mark[some[of]]))
            size += len(held[-1][2])
            if size > 1 << 23:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _by_document(answers: DataFrame, name: str, chunks: int) -> DataFrame:
    """s_id and ``name``: for each document with a mark its (bucket, many, bits)."""

    def split(batches):
        for parts in repeats.of_chunks(batches, ["bucket", "ids", "many", "bits"]):
            found: dict[int, list] = {}
            for p in parts:
                ids, many = np.frombuffer(p["ids"], "<i8"), np.frombuffer(p["many"], "<u4").astype(np.int64)
                mark = np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=int(many.sum()))
                ends = np.cumsum(many)
                for k, doc_id in enumerate(ids.tolist()):
                    bits = np.packbits(mark[ends[k] - many[k] : ends[k]]).tobytes()
                    found.setdefault(doc_id, []).append({"bucket": p["bucket"], "many": int(many[k]), "bits": bits})
            yield pa.record_batch([pa.array(found.keys(), pa.int64()), pa.array(found.values(), kind)], ["s_id", name])

    kind = pa.list_(pa.struct([("bucket", pa.int32()), ("many", pa.int32()), ("bits", pa.binary())]))
    return repeats.by_chunk(answers, chunks).mapInArrow(split, f"s_id bigint, {name} array<struct<bucket:int,many:int,bits:binary>>")


def _split(batches):
    """The first row's bucket, and all batches: a partition holds one bucket."""
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return None, iter(())

    def again():
        yield first
        yield from batches

    return first.column("bucket")[0].as_py(), again()


def _repeated_anchors(chunks: int):
    def run(batches):
        bucket, own = _split(batches)
        yield from _answers(((ids, many, times > 1) for ids, many, _, _, times in repeats.repeated(own)), bucket, chunks)

    return run


def _later_windows(chunks: int):
    def run(batches):
        bucket, own = _split(batches)
        yield from _answers(repeats.not_first(own), bucket, chunks)

    return run


def _unpacked(answers, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Marks of one document's hashes from its answers (bucket, bits, many)."""
    mark = np.zeros(len(hashes), dtype=bool)
    if answers:
        bucket = repeats.bucket_of(hashes, buckets)
        for a in answers:
            own = np.flatnonzero(bucket == a["bucket"])
            # another row with this id may have other words: then every window is looked at
            mark[own] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["many"]).astype(bool) if len(own) == a["many"] else True
    return mark


def _candidates(w: Words, answers: list, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words at which windows around a repeated anchor start, and the windows' hashes."""
    at, hashes = _anchors(w, size)
    cuts = np.searchsorted(w.row[at], np.arange(len(w.begin)))
    near = np.zeros(len(w.row) + 1, np.int64)
    for k, own in enumerate(answers):
        if own:
            found = at[cuts[k] : cuts[k + 1]][_unpacked(own, hashes[cuts[k] : cuts[k + 1]], buckets)]
            np.add.at(near, np.maximum(found - PERIOD + 1, 0), 1)
            np.add.at(near, found + 1, -1)
    n = len(w.row) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = window_hashes(w.hashes(), size)
    start = np.flatnonzero((np.cumsum(near)[:n] > 0) & (w.row[:n] == w.row[size - 1 :]))
    return start, whole[start]


def _window_hashes(size: int, buckets: int):
    def hasher(column, answers):
        w = words(*utf8(column))
        start, hashes = _candidates(w, answers.to_pylist(), size, buckets)
        return np.bincount(w.row[start], minlength=len(column)), hashes

    return hasher


def _removed(w: Words, first: list, second: list, size: int, buckets: int) -> np.ndarray:
    """Which words of a batch go."""
    start, hashes = _candidates(w, first, size, buckets)
    cuts = np.searchsorted(w.row[start], np.arange(len(w.begin)))
    cover = np.zeros(len(w.row) + 1, np.int64)
    for k, own in enumerate(second):
        if own:
            found = start[cuts[k] : cuts[k + 1]][_unpacked(own, hashes[cuts[k] : cuts[k + 1]], buckets)]
            np.add.at(cover, found, 1)
            np.add.at(cover, found + size, -1)
    return np.cumsum(cover)[:-1] > 0


def _judged(docs: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``docs`` with two more columns, the answers about its anchors and about its windows; the number of buckets."""
    spark = docs.sparkSession
    buckets = max(4, repeats.buckets_for(docs) // 2)
    rows = docs.filter("doc_id IS NOT NULL").selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    found = repeats.dealt(rows, _anchor_hashes(size), buckets).mapInArrow(_repeated_anchors(buckets * CHUNKS), _ANSWER)
    first = store(_by_document(found, "s_first", buckets * CHUNKS), "anchors")
    release_shuffles(spark)
    again = rows.join(first.df, rows["doc_id"] == first.df["s_id"]).select("doc_id", "text", "s_first")
    found = repeats.dealt(again, _window_hashes(size, buckets), buckets, width=8).mapInArrow(_later_windows(buckets * CHUNKS), _ANSWER)
    second = store(_by_document(found, "s_second", buckets * CHUNKS), "windows")
    release_shuffles(spark)
    names = [free_name(docs, n) for n in ("s_id", "s_first", "s_second")]
    both = first.df.join(second.df, "s_id").toDF(*names)  # only documents with a later window lose words
    return docs.join(both, docs["doc_id"] == both[names[0]], "left").drop(names[0]), buckets


def _answers_of(batch) -> list[list]:
    """The last two columns, with lists for nulls."""
    return [[x or [] for x in column.to_pylist()] for column in batch.columns[-2:]]


def removal_digest(docs: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space) of every row."""
    judged, buckets = _judged(docs.select("doc_id", "text"), size)

    def digest(batches):
        for batch in batches:
            for part in slices(batch, 1):
                w = words(*utf8(part.column(1)))
                gone = _removed(w, *_answers_of(part), size, buckets)
                n_words = np.diff(w.begin)
                n_gone = np.diff(np.concatenate(([0], np.cumsum(gone)))[w.begin])
                kept = []
                for k, text in enumerate(part.column(1).to_pylist()):
                    parts = (text or "").encode().split()
                    if n_gone[k]:
                        parts = compress(parts, (~gone[w.begin[k] : w.begin[k + 1]]).tolist())
                    kept.append(hashlib.sha256(b" ".join(parts)).hexdigest())
                yield pa.record_batch([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    own = judged.selectExpr("cast(doc_id AS bigint) AS doc_id", "text", "s_first", "s_second")
    return own.mapInArrow(digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def cleaned(docs: DataFrame, size: int = 20) -> DataFrame:
    """``docs`` whose texts have lost the words to remove and the white space behind them; other texts stay as they are.

    Rows of which no word is left are dropped.
    """
    judged, buckets = _judged(docs, size)
    at = judged.columns.index("text")

    def clean(batches):
        for batch in batches:
            for part in slices(batch, at):
                w = words(*utf8(part.column(at)))
                gone = _removed(w, *_answers_of(part), size, buckets)
                n_gone = np.diff(np.concatenate(([0], np.cumsum(gone)))[w.begin])
                texts, keep = part.column(at).to_pylist(), np.ones(part.num_rows, dtype=bool)
                data, begin = utf8(part.column(at))
                for k in np.flatnonzero(n_gone):
                    lo, hi = w.begin[k], w.begin[k + 1]
                    stay = ~gone[lo:hi]
                    keep[k] = stay.any()
                    ends = np.append(w.first[lo + 1 : hi], begin[k + 1])
                    texts[k] = b"".join(data[a:b].tobytes() for a, b in zip(w.first[lo:hi][stay], ends[stay], strict=True)).decode()
                columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(part.columns[:-2])]
                yield pa.record_batch(columns, names).filter(pa.array(keep))

    names = docs.columns
    return judged.mapInArrow(clean, docs.schema)
