"""WARC archives: writing pages as segmented, chunked records, and reassembling them.

Writing: a page is one HTTP response in chunked transfer coding. Blocks over ``segment`` bytes continue in further records,
which name the first one as their origin, carry a segment number, and in the last one the total length. Pages whose payload
equals an earlier one of at least ``least`` bytes become revisit records without a body. Archives are written by Spark's
text writer, whose "line" separator is the two line breaks that end a record, so the files have its commit protocol, any
Hadoop file system and a bounded number of records each. That writer compresses a file as one member; ``members`` gives the
bytes of an archive with one member a record instead.

Reading: a compressed archive may be one gzip member or, as is usual, one for each record; all members are read, a bounded
piece at a time. Records are framed by Content-Length alone, so payloads may hold anything. Continuation records are grouped by
their origin's identifier (a group is one page), ordered by segment number, checked against the total length, and their
chunked framing is decoded; whole records never shuffle.

Defined cases: every row has a record. A null page is an empty payload; empty payloads of different pages are equal payloads.
Among rows of equal payload the smallest id is the response, also of repeated rows, of which one is; rows without an id come
last, and are responses only where no row has an id. A very long page is many segments, put together in one task. Of an empty
table the archive is empty; extra columns, also of clashing names, play no part. A record that is cut off, lacks a segment or
a length, has a wrong length or broken framing comes back with the reason in ``error`` and no payload, as far as its header can
be read with its page; reading goes on at the next line that begins a record, or ends with the archive. Bytes between records
that belong to none are an error row of their own. Records of other types (warcinfo, request, metadata, resource, conversion)
are no pages and are passed over, with their continuations. A header line without a blank behind its colon, or one that goes
on in the next line, is read as the format allows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.storage import store

_SALTS = 16


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), sha (hexadecimal SHA-1 of the payload), bytes, and w_key: a number of the row's own."""
    have = [c if c in pages.columns else f"cast(NULL AS string) AS {c}" for c in ("url", "html")]
    own = pages.selectExpr("cast(page_id AS bigint) AS page_id", *have).withColumn("html", F.expr("coalesce(html, '')"))
    own = own.withColumns({"sha": F.expr("sha1(cast(html AS binary))"), "bytes": F.expr("cast(octet_length(html) AS bigint)")})
    return own.withColumn("w_key", F.monotonically_increasing_id())


def revisits(rows: DataFrame, least: int = 0) -> DataFrame:
    """w_key and refers_to (page_id and w_key) of the rows that repeat the payload of an earlier one, by page_id and then by w_key.

    ``rows`` has page_id, sha, bytes and w_key. Digests and ids alone are shuffled. The first row of each repeated payload is
    spread over salts, so that one payload of a third of all pages is joined in many tasks.
    """
    light = rows.filter(f"bytes >= {least}").select("sha", "w_key", F.struct(F.col("page_id").isNull().alias("none"), "page_id", "w_key").alias("place"))
    firsts = light.groupBy("sha").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = firsts.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salted = light.select("w_key", "sha", F.expr(f"cast(pmod(xxhash64(w_key), {_SALTS}) AS int)").alias("salt"))
    return salted.join(firsts, ["sha", "salt"]).filter("w_key <> first.w_key").selectExpr("w_key", "first.page_id AS refers_to", "first.w_key AS refers_key")


def _base32(sha: str) -> str:
    return base64.b32encode(bytes.fromhex(sha)).decode()


def _pieces(text: bytes, most: int) -> list[bytes]:
    """Parts of at most ``most`` bytes that do not cut a character."""
    out, k = [], 0
    while k < len(text):
        end = min(len(text), k + most)
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        out.append(text[k:end])
        k = end
    return out


def _record(fields: list[tuple[str, str]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n{block.decode()}"


def _identifier(key: int, sha: str, part: int) -> str:
    h = hashlib.md5(f"{key}/{sha}/{part}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _records(key: int, page_id: int | None, url: str, html: str, refers_to: int | None, refers_key: int | None, segment: int, chunk: int):
    payload = html.encode()
    sha = hashlib.sha1(payload).hexdigest()
    own = [
        ("WARC-Target-URI", re.sub(r"\s", "%20", url or "about:blank")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{_base32(sha)}"),
        *([] if page_id is None else [("X-Page-Id", str(page_id))]),
        ("X-Payload-Bytes", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_key is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", _identifier(key, sha, 1)), *own]
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        fields += [("WARC-Refers-To", _identifier(refers_key, sha, 1)), *([] if refers_to is None else [("X-Refers-To-Page-Id", str(refers_to))])]
        yield _record(fields, b"HTTP/1.1 200 OK\r\n\r\n")
        return
    parts = [b"%x\r\n%s\r\n" % (len(x), x) for x in _pieces(payload, chunk)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + b"".join(parts) + b"0\r\n\r\n"
    cuts = _pieces(block, segment)
    for k, piece in enumerate(cuts, 1):
        fields = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", _identifier(key, sha, k)), *own]
        if len(cuts) > 1:
            fields.append(("WARC-Segment-Number", str(k)))
        if k > 1:
            fields.append(("WARC-Segment-Origin-ID", _identifier(key, sha, 1)))
        if 1 < k == len(cuts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(fields, piece)


def write(pages: DataFrame, path: str, least: int = 0, segment: int = 16384, chunk: int = 4096, records: int = 4096) -> None:
    """Write the archive of ``pages`` (page_id, url, html) to the new folder ``path``.

    least: payloads from so many bytes on can be revisited. segment, chunk: most bytes of a record's block and of an HTTP
    chunk. records: most records in a file, which bounds it to about ``records * segment`` bytes before compression.
    """
    # numbered and written once, since the digests and the records must see the same numbers
    rows = store(keyed(pages), "pages").df
    seen = store(revisits(rows, least), "revisits").df
    rows = rows.join(seen, "w_key", "left").select("w_key", "page_id", "url", "html", "refers_to", "refers_key")

    def render(batches):
        for batch in batches:
            lines = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.extend(_records(*row, segment, chunk))
                if len(lines) >= 2048:
                    yield pa.record_batch([pa.array(lines, pa.string())], ["value"])
                    lines = []
            yield pa.record_batch([pa.array(lines, pa.string())], ["value"])

    out = rows.mapInArrow(render, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    out.option("maxRecordsPerFile", records).text(path)


def members(records: list[str]) -> bytes:
    """An archive of ``records`` (without their last two line breaks) as one gzip member each."""
    return b"".join(gzip.compress(f"{x}\r\n\r\n".encode(), mtime=0) for x in records)


def _plain(raw: bytes, most: int = 1 << 20):
    """The bytes of an archive in pieces of at most ``most``: of all its gzip members, or as they are."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    view, at = memoryview(raw), 0
    while at < len(raw):
        member, fed = zlib.decompressobj(31), at
        while not member.eof:
            data = member.unconsumed_tail or view[fed : fed + most]
            if not member.unconsumed_tail:
                fed += len(data)
                if not len(data):
                    raise ValueError("the archive ends inside a gzip member")
            yield member.decompress(data, most)
        at = fed - len(member.unused_data)


class _Pieces:
    """Pieces as one stream of which exact lengths are read."""

    def __init__(self, pieces):
        self.pieces, self.held = pieces, bytearray()

    def fill(self, size: int) -> bool:
        while len(self.held) < size:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            self.held += piece
        return True

    def take(self, size: int) -> bytes:
        if not self.fill(size):
            raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


_BEGIN = re.compile(rb"WARC/\d\.\d+\r?\n")
_NUMBER = re.compile(r"[0-9]{1,18}")


def _header(raw: bytes) -> dict[str, str]:
    """Fields of a header by lower-case name; a line that begins with white space goes on with the field before."""
    head, last = {}, None
    for line in raw.decode(errors="replace").splitlines()[1:]:
        if line[:1] in (" ", "\t") and last:
            head[last] = f"{head[last]} {line.strip()}".strip()
        else:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            head[last] = value.strip()
    return head


def _number(head: dict[str, str], name: str, signed: bool = False) -> int | None:
    value = head.get(name, "")
    found = _NUMBER.fullmatch(value.removeprefix("-") if signed else value)
    return int(value) if found else None


class _Records:
    """Header, block and what is wrong, of each record of an archive; iterating never raises for what the archive holds."""

    STEP = 1 << 16

    def __init__(self, pieces):
        self.stream, self.broken = _Pieces(self._safe(pieces)), None

    def _safe(self, pieces):
        """The pieces up to where the compression breaks."""
        try:
            yield from pieces
        except (ValueError, zlib.error) as broken:
            self.broken = str(broken)

    def _skip(self, begun: int) -> int:
        """Drop what is held up to the next record's beginning, from ``begun`` on; how many bytes went."""
        gone = 0
        while True:
            found = _BEGIN.search(self.stream.held, begun)
            if found:
                break
            size = len(self.stream.held)
            if not self.stream.fill(size + self.STEP) and len(self.stream.held) == size:
                return gone + len(self.stream.take(size))
            # the line may be cut by the end of what is held
            begun = max(begun, size - 16)
            if begun > self.STEP:
                gone += len(self.stream.take(begun))
                begun = 0
        return gone + len(self.stream.take(found.start()))

    def __iter__(self):
        while self.stream.fill(1):
            self.stream.fill(16)
            if not _BEGIN.match(self.stream.held):
                blank = bytes(self.stream.held[:4]).strip() == b""
                gone = self._skip(0)
                if not blank or gone > 4:
                    yield {}, b"", self.broken or f"{gone} bytes that belong to no record"
                continue
            found = self._head()
            if found is None:
                yield _header(self.stream.take(len(self.stream.held))), b"", self.broken or "the archive ends inside a header"
                return
            head, size = found
            length = _number(head, "content-length")
            if length is None:
                self._skip(size)
                yield head, b"", f"no length: {head.get('content-length')!r}"
            elif not self.stream.fill(size + length):
                self._skip(size)
                yield head, b"", self.broken or f"the archive ends inside a record of {length} bytes"
            else:
                self.stream.fill(size + length + 4)
                end = bytes(self.stream.held[size + length : size + length + 4])
                if end != b"\r\n\r\n" and (len(end) == 4 or end.strip()):
                    self._skip(size)
                    yield head, b"", f"the record {head.get('warc-record-id')} does not end where its length says"
                    continue
                self.stream.take(size)
                block = self.stream.take(length)
                wrong = None if end == b"\r\n\r\n" else self.broken or "the archive ends before the end of the record"
                self.stream.take(len(end))
                yield head, block, wrong
        if self.broken:
            yield {}, b"", self.broken

    def _head(self) -> tuple[dict[str, str], int] | None:
        """The fields and the length of the header that is held from its beginning."""
        begun = 0
        while (end := self.stream.held.find(b"\r\n\r\n", begun)) < 0:
            size = len(self.stream.held)
            begun = max(0, size - 3)
            if not self.stream.fill(size + 1):
                return None
        return _header(bytes(self.stream.held[:end])), end + 4


def dechunk(block: bytes) -> bytes:
    """The payload of an HTTP message in chunked transfer coding."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a message without the end of its header")
    if b"transfer-encoding: chunked" not in block[:end].lower():
        return block[end + 4 :]
    at, parts = end + 4, []
    while True:
        line = block.index(b"\r\n", at)
        size = int(block[at:line].split(b";")[0], 16)
        if size < 0:
            raise ValueError("broken chunk")
        if size == 0:
            return b"".join(parts)
        part = block[line + 2 : line + 2 + size]
        if len(part) < size or block[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        parts.append(part)
        at = line + 4 + size


_PARTS = "origin string, number int, total bigint, kind string, page_id bigint, refers_to bigint, claimed string, n_claimed bigint, block binary, wrong string"
PAGES = ("response", "revisit", "continuation")  # types of records that hold pages


def _parse(batches):
    names = [x.split(" ")[0] for x in _PARTS.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    batch_of = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    for batch in batches:
        for data in batch.column(0):
            rows, size = [], 0
            for h, block, wrong in _Records(_plain(data.as_buffer().to_pybytes())):
                kind = h.get("warc-type", "").lower() or None
                segment, origin = _number(h, "warc-segment-number"), h.get("warc-segment-origin-id", h.get("warc-record-id"))
                # a record of another type that is not divided can be passed over here, a divided one when its parts are known
                if kind not in (*PAGES, None) and segment is None:
                    continue
                if kind == "continuation" and (segment is None or origin is None):
                    wrong = wrong or "a continuation without its origin or number"
                if wrong:  # it stands for itself and is no part of another one
                    segment, block = None, None
                digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                segment = segment if segment is None or segment < 1 << 31 else -1
                rows.append((origin, segment, _number(h, "warc-segment-total-length"), kind, _number(h, "x-page-id", True), _number(h, "x-refers-to-page-id", True), digest, _number(h, "x-payload-bytes"), block, wrong))
                size += len(block or b"")
                if size > 1 << 22:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)


def _reassembled(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of one origin from (number, total, block)."""
    segments = sorted(segments, key=lambda x: x[0])
    if [x[0] for x in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("a segment is missing or repeated")
    block = b"".join(x[2] for x in segments)
    if len(segments) > 1 and segments[-1][1] != len(block):
        raise ValueError(f"{len(block)} bytes instead of {segments[-1][1]}")
    return block


_OUT = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, error string"
_OUT_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]


def _finish(batches):
    names = [x.split(" ")[0] for x in _OUT.split(", ")]
    for batch in batches:
        rows = []
        for kind, page_id, refers_to, claimed, n_claimed, segments, wrong in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if wrong:
                rows.append((page_id, kind if kind != "continuation" else "response", refers_to, None, None, None, wrong))
                continue
            if kind == "revisit":
                rows.append((page_id, kind, refers_to, n_claimed, claimed, None, None))
                continue
            try:
                payload = dechunk(_reassembled([(s["number"] or 1, s["total"], s["block"]) for s in segments]))
                digest = _base32(hashlib.sha1(payload).hexdigest())
                if claimed and digest != claimed:
                    raise ValueError(f"digest {digest} instead of {claimed}")
                rows.append((page_id, kind, None, len(payload), digest, payload, None))
            except ValueError as broken:
                rows.append((page_id, kind, None, None, None, None, str(broken)))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, _OUT_TYPES, strict=True)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a page: page_id, record_type, refers_to, payload_bytes, payload_digest (base32), payload (null for revisits), error."""
    parts = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, _PARTS)
    columns = ["kind", "page_id", "refers_to", "claimed", "n_claimed", "segments", "wrong"]
    one = F.struct("number", "total", "block")
    whole = parts.filter("number IS NULL").withColumn("segments", F.array(one)).select(*columns)
    first = lambda c: F.first(c).alias(c)
    # the type of a divided record is that of its first part
    kind = F.expr("coalesce(max(kind) FILTER (WHERE kind <> 'continuation'), 'response')").alias("kind")
    joined = parts.filter("number IS NOT NULL").groupBy("origin").agg(kind, first("page_id"), first("refers_to"), first("claimed"), first("n_claimed"), F.collect_list(one).alias("segments"), first("wrong"))
    joined = joined.filter(F.col("kind").isin(*PAGES))
    # both sides share one schema, so that single records pass without a shuffle
    return whole.mapInArrow(_finish, _OUT).unionByName(joined.select(*columns).mapInArrow(_finish, _OUT))
