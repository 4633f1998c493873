"""Byte-level BPE: encoding by ranked merges over distinct words, decoding by concatenating binary pieces.

A text is cut into the matches of a pattern; each match ("word") is encoded for itself: its bytes are folded by merging,
again and again, the neighbours whose union has the lowest rank. Two forms of that fold are here.

``encode_words`` is Spark's higher-order functions over the words of a table, with the ranks as one literal. ``encode``
does the same in an Arrow UDF with a table of words already seen; see the README for why the query uses it. Decoding is
higher-order functions in either case: pieces are looked up in a literal array by id and concatenated.

Defined cases: a null or empty text has no tokens; a word of any length is folded with a heap, and a very long text is one
row, whose ids are held together; special tokens' strings are ordinary text; an id outside the vocabulary decodes to null; ids
of documents play no part, so null and repeated ones are rows of their own; of pairs of equal rank, which are the same pair,
the leftmost is merged first; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORDS_HELD = 500_000  # words that a worker remembers; then it begins anew


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: merge the pair of lowest rank, the leftmost first, until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 100:
        return _fold_long(word, ranks)
    parts = [word[k : k + 1] for k in range(len(word))]
    rank_of, none = ranks.get, 1 << 40
    pairs = [rank_of(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (best := min(pairs)) < none:
        k = pairs.index(best)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del pairs[k]
        if k < len(pairs):
            pairs[k] = rank_of(parts[k] + parts[k + 1], none)
        if k:
            pairs[k - 1] = rank_of(parts[k - 1] + parts[k], none)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs and linked parts."""
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(k: int) -> None:
        if k >= 0 and after[k] < n and (r := ranks.get(word[k : end[after[k]]])) is not None:
            heapq.heappush(heap, (r, k, end[after[k]]))

    for k in range(n):
        push(k)
    while heap:
        _, k, stop = heapq.heappop(heap)
        if not alive[k] or after[k] >= n or end[after[k]] != stop:
            continue
        gone = after[k]
        alive[gone] = False
        end[k], after[k] = stop, after[gone]
        if after[gone] < n:
            before[after[gone]] = k
        push(before[k])
        push(k)
    out, k = [], 0
    while k < n:
        out.append(ranks[word[k : end[k]]])
        k = after[k]
    return out


class _Words(dict):
    """Number of each word seen; where its ids stand in one flat array."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(_WORDS_HELD + 1, np.int64), np.zeros(_WORDS_HELD + 1, np.int64)

    def __missing__(self, word: str) -> int:
        ids = fold(word.encode(), self.ranks)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)))
        k = len(self)
        if k >= len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros(len(x), np.int64))) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k], self.length[k] = self.used, len(ids)
        self.used += len(ids)
        self[word] = k
        return k

    def encode(self, text: str) -> np.ndarray:
        if len(self) > _WORDS_HELD:
            self.clear()
        at = np.array(list(map(self.__getitem__, self.find(text))), np.int64)
        many = self.length[at]
        ends = np.cumsum(many)
        return self.flat[np.repeat(self.start[at] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)]


_held: dict[str, _Words] = {}
_ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_sha256", T.StringType())])


def encoder(ranks: Broadcast, pattern: str):
    """A scalar UDF from text to ids and the digest of the ids as little-endian unsigned 32-bit integers."""
    key = f"{ranks.id if hasattr(ranks, 'id') else id(ranks)}/{pattern}"

    @F.arrow_udf(_ENCODED)
    def encode_texts(text: pa.Array) -> pa.Array:
        if key not in _held:
            _held.clear()
            _held[key] = _Words(ranks.value, pattern)
        words = _held[key]
        found = [words.encode(x.as_py() or "") for x in text]
        ends = np.cumsum([0, *map(len, found)])
        flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
        digests = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(digests, pa.string())], ["ids", "ids_sha256"])

    return encode_texts


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ids and ids_sha256 of its text. path: ranks, a base64 piece and its rank a line. The driver reads them."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))  # one vocabulary: a megabyte or so
    keep = [f"`{c}`" for c in docs.columns if c not in ("ids", "ids_sha256")]
    return docs.select(*keep, encoder(ranks, pattern)("text").alias("b_encoded")).select(*keep, "b_encoded.*")


def decoded(ids: str, path: str) -> Column:
    """The bytes of an array of ids: pieces from a literal array, joined as hexadecimal digits."""
    pieces = [""] * (max((ranks := load_ranks(path)).values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    literal = f"split('{','.join(pieces)}', ',')"
    known = f"forall({ids}, i -> i >= 0 AND i < {len(pieces)})"
    return F.expr(f"CASE WHEN {known} THEN unhex(array_join(transform({ids}, i -> element_at({literal}, i + 1)), '')) END")


def encode_words(words: DataFrame, path: str, slots: int = 16384) -> DataFrame:
    """``words`` (word, distinct) with ids, in higher-order functions.

    The ranks are one literal: an array of small maps, by the CRC of the piece, since a lookup in a map is linear.
    """
    maps: list[dict[str, int]] = [{} for _ in range(slots)]
    for piece, rank in load_ranks(path).items():
        text = piece.hex().upper()
        maps[zlib.crc32(text.encode()) % slots][text] = rank
    literal = f"from_json('{json.dumps(maps, separators=(',', ':'))}', 'array<map<string,int>>')"
    rank = lambda x: f"try_element_at(element_at({literal}, cast(crc32({x}) % {slots} AS int) + 1), {x})"
    bytes_of = "transform(sequence(1, greatest(1, octet_length(word))), i -> substr(w_hex, 2 * i - 1, 2))"
    best = f"transform(sequence(1, size(p) - 1), i -> {rank('concat(p[i - 1], p[i])')})"
    merged = "concat(slice(p, 1, k - 1), array(concat(p[k - 1], p[k])), slice(p, k + 2, greatest(size(p) - k - 1, 0)))"
    step = f"aggregate(array(cast(array_position(b, array_min(b)) AS int)), p, (p, k) -> if(k IS NULL OR k = 0, p, {merged}))"
    step = f"aggregate(array({best}), p, (p, b) -> {step})"
    pieces = f"aggregate(sequence(1, greatest(1, octet_length(word))), {bytes_of}, (p, n) -> if(size(p) < 2, p, {step}))"
    out = words.selectExpr("*", "hex(cast(word AS binary)) AS w_hex").selectExpr("*", f"{pieces} AS w_pieces")
    ids = f"if(word = '', cast(array() AS array<int>), transform(w_pieces, x -> {rank('x')}))"
    return out.selectExpr(*(f"`{c}`" for c in words.columns), f"{ids} AS ids")


def distinct_words(docs: DataFrame, pattern: str) -> DataFrame:
    """word: the different matches of the pattern in all texts, by a partial aggregation. Java's regular expressions do the cutting."""
    unicode = "(?U)" + pattern
    found = F.expr(f"explode(regexp_extract_all(coalesce(text, ''), {json.dumps(unicode)}, 0))")
    return docs.select(found.alias("word")).distinct()
