"""Which hashes of a corpus's documents occur more than once, asked in bulk.

Documents give packed arrays of hashes, dealt by hash range to buckets: a row holds one bucket's hashes of a batch of
documents, so the shuffle carries a few bytes a hash. Each batch gives a bucket two rows: what is needed to count, and the
documents. Spark's sort brings the first kind to the front of its bucket (and spills where it must), so a task first counts,
in arrays as long as the bucket's different hashes, and then goes through the documents row by row and answers. A hash that a
third of all documents share is one entry of the count, and its documents pass by as a stream. Only hashes that occur again go
back to their documents.

Six bytes of a hash travel beside its bucket, and four of them are counted. Two hashes that agree in these count as equal,
which makes about one hash in a thousand of a bucket of four million look repeated that is not; that costs work, and whoever
uses the answer compares whole hashes afterwards. First occurrences are found by all eight bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MERGED = 1 << 21  # entries read before they are merged into the count, or as many as it holds: each is merged a few times only
PER_BUCKET = 1 << 27  # bytes of the scanned table that a bucket stands for at most

#: From an Arrow array of texts: for each document its number of hashes, and all hashes in order.
Hasher = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def buckets_for(rows: DataFrame) -> int:
    """Buckets for a table: as many as there are shuffle partitions, and more where a bucket would stand for too much of its files."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    known = sum(n for n in sizes if n < 1 << 60)  # the others are no files and do not know their size
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // PER_BUCKET + 1)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def pack(hashes: np.ndarray, width: int = 6) -> bytes:
    """The low bytes of each."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes, width: int = 6) -> np.ndarray:
    low = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :width] = low
    return out.view("<u8").ravel().astype(np.uint64)


_ROWS = "bucket int, kind int, ids binary, counts binary, totals binary, hashes binary"
COUNT, DOCUMENTS = 0, 1


def dealt(rows: DataFrame, hasher: Hasher, buckets: int, width: int = 6, text: int = 1) -> DataFrame:
    """bucket, kind, and packed: ids, counts (hashes of each id in this bucket), totals (of each id in all), hashes.

    ``rows`` begins with doc_id; ``text`` is the place of its text, and ``hasher`` gets the columns from there on (the text
    alone if it is the last). width: bytes of a hash that travel. Rows of the kind COUNT come first in their bucket: the low
    four bytes of all hashes, or with a width of eight all different hashes with the smallest id of each.
    """
    from tessera.llm.wordhash import slices

    def counted(ids: np.ndarray, hashes: np.ndarray) -> tuple[bytes, bytes]:
        if width < 8:
            return b"", (hashes & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
        order = np.lexsort((ids, hashes))
        keys, least = hashes[order], ids[order]
        head = np.ones(len(keys), dtype=bool)
        head[1:] = keys[1:] != keys[:-1]
        return least[head].astype("<i8").tobytes(), keys[head].astype("<u8").tobytes()

    def deal(batches):
        names, kinds = [c.split(" ")[0] for c in _ROWS.split(", ")], [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        for batch in batches:
            for part in slices(batch, text):
                many, hashes = hasher(*part.columns[text:])
                ids = np.asarray(part.column(0), dtype=np.int64)
                of = np.repeat(np.arange(len(ids)), many)
                bucket = bucket_of(hashes, buckets).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, of, hashes = bucket[order], of[order], hashes[order]
                cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                out = []
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    heads = np.flatnonzero(np.diff(of[lo:hi], prepend=-1))
                    docs = of[lo:hi][heads]
                    counts = np.diff(np.append(heads, hi - lo)).astype("<u4")
                    least, keys = counted(ids[of[lo:hi]], hashes[lo:hi])
                    out.append((int(bucket[lo]), COUNT, least, b"", b"", keys))
                    out.append((int(bucket[lo]), DOCUMENTS, ids[docs].astype("<i8").tobytes(), counts.tobytes(), many[docs].astype("<u4").tobytes(), pack(hashes[lo:hi], width)))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)

    packed = rows.mapInArrow(deal, _ROWS)
    return packed.repartitionById(buckets, packed["bucket"]).sortWithinPartitions("bucket", "kind")


def _rows(batches: Iterator[pa.RecordBatch]):
    """kind, ids, counts, totals and hashes of each row, packed."""
    for batch in batches:
        columns = [batch.column(c) for c in ("ids", "counts", "totals", "hashes")]
        for k, kind in enumerate(batch.column("kind").to_pylist()):
            yield kind, *(c[k].as_buffer().to_pybytes() for c in columns)


def _documents(ids: bytes, counts: bytes, totals: bytes, hashes: bytes, width: int):
    return np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<u4").astype(np.int64), np.frombuffer(totals, "<u4"), unpack(hashes, width)


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal ones begin in sorted keys."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _joined(keys: np.ndarray, values: np.ndarray, more: np.ndarray, others: np.ndarray, how: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted tables of different keys as one; ``how`` puts the values of a key of both together."""
    both, values = np.concatenate((keys, more)), np.concatenate((values, others))
    order = np.argsort(both, kind="stable")  # two sorted runs, which are merged
    both = both[order]
    heads = _heads(both)
    return both[heads], how.reduceat(values[order], heads) if len(heads) else values


def repeated(batches: Iterator[pa.RecordBatch], width: int = 6):
    """Of one bucket: (ids, counts, totals, hashes, times), where times is how often each hash occurs in the corpus."""
    keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    waiting, size, again = [], 0, None

    def merge():
        nonlocal keys, counts, waiting, size
        if waiting:
            new = np.sort(np.concatenate(waiting))
            heads = _heads(new)
            keys, counts = _joined(keys, counts, new[heads], np.diff(np.append(heads, len(new))), np.add)
        waiting, size = [], 0

    for kind, *row in _rows(batches):
        if kind == COUNT:
            waiting.append(np.frombuffer(row[3], "<u4"))
            size += len(waiting[-1])
            if size > max(MERGED, len(keys)):
                merge()
            continue
        if again is None:
            merge()
            again = counts > 1
            keys, counts = keys[again], counts[again]
        ids, many, totals, hashes = _documents(*row, width)
        low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = np.minimum(np.searchsorted(keys, low), max(len(keys) - 1, 0))
        times = np.where(keys[at] == low, counts[at], 1) if len(keys) else np.ones(len(hashes), np.int64)
        yield ids, many, totals, hashes, times


def not_first(batches: Iterator[pa.RecordBatch], width: int = 8):
    """Of one bucket: (ids, counts, later), where later marks hashes that a smaller id has too, or the same document before."""
    keys, least, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def merge():
        nonlocal keys, least, waiting, size
        k, i = (np.concatenate([x[side] for x in waiting]) for side in (0, 1))
        order = np.argsort(k)
        k, i = k[order], i[order]
        heads = _heads(k)
        keys, least = _joined(keys, least, k[heads], np.minimum.reduceat(i, heads) if len(k) else i, np.minimum)
        waiting, size = [], 0

    for kind, *row in _rows(batches):
        if kind == COUNT:
            waiting.append((np.frombuffer(row[3], "<u8"), np.frombuffer(row[0], "<i8")))
            size += len(waiting[-1][0])
            if size > max(MERGED, len(keys)):
                merge()
            continue
        if waiting:
            merge()
        ids, many, _, hashes = _documents(*row, width)
        of = np.repeat(np.arange(len(ids)), many)
        later = ids[of] > least[np.searchsorted(keys, hashes)] if len(hashes) else np.zeros(0, dtype=bool)
        order = np.lexsort((np.arange(len(of)), hashes, of))
        again = np.zeros(len(of), dtype=bool)
        again[order[1:]] = (of[order[1:]] == of[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
        yield ids, many, later | again


def by_chunk(rows: DataFrame, chunks: int) -> DataFrame:
    """``rows`` with those of each chunk behind one another."""
    return rows.repartition(max(1, chunks // 2), "chunk").sortWithinPartitions("chunk")


def of_chunks(batches: Iterator[pa.RecordBatch], columns: list[str]):
    """The rows of each chunk, as dictionaries of packed ``columns``."""
    chunk, held = None, []
    for batch in batches:
        packed = [batch.column(c) for c in columns]
        for k, own in enumerate(batch.column("chunk").to_pylist()):
            if own != chunk and held:
                yield held
                held = []
            chunk = own
            held.append({name: c[k].as_py() for name, c in zip(columns, packed, strict=True)})
    if held:
        yield held
