"""Pages, archives, pictures and conversations: round trips and small fixtures."""

import base64
import gzip
import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat, html, jpeg, media, warc

PAGES = "page_id bigint, url string, html string"


def page(k, body, extra=""):
    return f"<html><head><title>t{k}</title><script>var a='<p>no</p>';</script></head><body><nav><a href=/>Home</a></nav>{extra}{body}<footer>&copy; 2024</footer></body></html>"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_marked_articles(spark):
    body = "<main><article><header><h1>A&nbsp;title</h1><div class=byline>by</div></header><p>One <b>bo</b>ld\n\n  &lt;x&gt;<p>Two<br>three<ul><li>a<li>b</ul><form>f</form><div class='comments'>c</div><aside>s</aside></article><article class=comment>n</article></main>"
    rows = [(1, "http://h/1", page(1, body)), (2, "http://h/2", None), (3, None, ""), (4, "http://h/4", "just text &amp; more"), (5, "x", "<p>cut <b>off")]
    assert texts(spark, rows) == {1: "A title One bold <x> Two three a b", 2: "", 3: "", 4: "just text & more", 5: "cut off"}


def test_template_slots_of_a_host(spark):
    """Without marks, what all pages of a host share is template, also if it looks like content."""
    rows = [(k, f"http://h/{k}", f"<html><body><div><p>Welcome to our pages</p><div><p>Story {k} of its own</p><p>More words {k * k}</p></div><p>Call us</p></div></body></html>") for k in range(6)]
    assert texts(spark, rows) == {k: f"Story {k} of its own More words {k * k}" for k in range(6)}
    copies = [(k, f"http://g/{k}", rows[0][2]) for k in range(6)]  # copies do not make their text a template
    assert set(texts(spark, copies).values()) == {"Welcome to our pages Story 0 of its own More words 0 Call us"}


def test_alignment_is_a_largest_matching():
    def best(a, b):
        """Simple tree matching, as its recursion says."""
        if a.tag != b.tag:
            return 0
        p, q = getattr(a, "children", []), getattr(b, "children", [])
        m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, x in enumerate(p):
            for j, y in enumerate(q):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + best(x, y))
        return m[-1][-1] + 1

    def pairs(a, b):
        return {(x.text, y.text) for x, y in html.align(a, b)}

    one = html.parse("<div><p>a</p><p><b>b</b>c</p><ul><li>d<li>e</ul><p>f</p></div>")
    two = html.parse("<div><h2>x</h2><p><b>B</b>C</p><ul><li>D<li>E<li>G</ul><p>F</p></div>")
    assert pairs(one, two) == {("b", "B"), ("c", "C"), ("d", "D"), ("e", "E"), ("f", "F")}
    assert best(one, two) == 1 + 1 + 4 + 5 + 2


def archive(spark, path, rows, **options):
    warc.write(spark.createDataFrame(rows, PAGES + ", sha string, w_key string"), path, **options)
    return warc.read(spark, path).collect()


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_warc_round_trip(spark, tmp_path):
    long = "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 900
    bodies = [(1, "same"), (2, "same"), (3, None), (4, ""), (5, long), (6, "x"), (7, "same"), (8, "0\r\n\r\n"), (9, "é" * 100_000), (6, "x"), (6, "y"), (None, "gone!"), (None, "gone!"), (None, "same")]
    rows = [(k, f"http://h/{k}\n" if k != 4 else None, b, "s", "w") for k, b in bodies]
    got = archive(spark, f"file://{tmp_path}/a", rows, segment=512, chunk=100, records=7)
    place, expected = {}, []
    for k, b in sorted(bodies, key=lambda x: (x[0] is None, x[0] or 0)):
        own = (sha(b or ""), len((b or "").encode()))
        expected.append((k, *own, *(("revisit", place[own]) if own in place else ("response", None))))
        place.setdefault(own, k)
    order = lambda x: sorted(x, key=str)
    assert order((r["page_id"], r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == order(expected)
    assert all(r["error"] is None for r in got)
    assert order((sha(bytes(r["payload"]).decode()), r["payload_bytes"]) for r in got if r["record_type"] == "response") == order(place)
    few = archive(spark, f"file://{tmp_path}/b", rows, least=5)
    assert len(few) == len(rows) and {(r["page_id"], r["refers_to"]) for r in few if r["record_type"] == "revisit"} == {(None, None)}
    warc.write(spark.createDataFrame([], PAGES), f"file://{tmp_path}/c")
    assert warc.read(spark, f"file://{tmp_path}/c").count() == 0


def test_warc_members(spark, tmp_path):
    """An archive with a gzip member for each record, one whole member, and a plain one hold the same records; a cut one is told."""
    records = [x for k, b in enumerate(["a", "b" * 5000, "", "é" * 3_000_000, "e"]) for x in warc._records(k, k, "u", b, None, None, 1 << 20, 4096)]
    plain = "".join(f"{x}\r\n\r\n" for x in records).encode()
    kinds = {"members": warc.members(records), "one": gzip.compress(plain), "plain": plain}
    for name, data in kinds.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x.warc").write_bytes(data)
        got = {r["page_id"]: (r["payload_bytes"], r["error"]) for r in warc.read(spark, f"file://{folder}").collect()}
        assert got == {0: (1, None), 1: (5000, None), 2: (0, None), 3: (6_000_000, None), 4: (1, None)}
    for k, data in enumerate((kinds["members"][:-9], plain[:-7], plain[: len(plain) // 2], kinds["one"][:-100])):
        folder = tmp_path / f"cut{k}"
        folder.mkdir()
        (folder / "x.warc").write_bytes(data)
        got = warc.read(spark, f"file://{folder}").collect()
        assert [r for r in got if r["error"]] and {r["page_id"] for r in got if not r["error"]} <= {0, 1, 2, 3, 4}
        assert {(r["page_id"], r["payload_bytes"]) for r in got if not r["error"]} <= {(0, 1), (1, 5000), (2, 0), (3, 6_000_000), (4, 1)}


def _faulty(spark, folder, data):
    """page_id to (payload, whether there is an error) of what ``read`` gives for an archive, and the rows without a page."""
    folder.mkdir(exist_ok=True)
    (folder / "x.warc").write_bytes(data)
    got = warc.read(spark, f"file://{folder}").collect()
    assert all((r["payload"] is None) == (r["error"] is not None or r["record_type"] == "revisit") for r in got)
    return {r["page_id"]: (r["payload"], r["error"] is not None) for r in got if r["page_id"] is not None}, [r for r in got if r["page_id"] is None]


def test_faulty_archives_give_error_rows(spark, tmp_path):
    """Wrong, missing and oddly written lengths, cut records, bytes between records and missing parts: the other pages are all read."""
    record = lambda k, body, **options: [f"{x}\r\n\r\n".encode() for x in warc._records(k, k, "u", body, None, None, options.get("segment", 1 << 20), 4096)]
    a, b, c = (record(k, t)[0] for k, t in enumerate(("first page", "WARC/1.1\r\nno record\r\n\r\n", "third")))
    whole = {0: (b"first page", False), 1: (b"WARC/1.1\r\nno record\r\n\r\n", False), 2: (b"third", False)}
    assert _faulty(spark, tmp_path / "0", a + b + c) == (whole, [])
    length = re.compile(rb"Content-Length: (\d+)")
    for k, change in enumerate((lambda m: b"Content-Length:" + m[1], lambda m: b"content-length :\t" + m[1], lambda m: b"Content-Length:\r\n " + m[1])):
        assert _faulty(spark, tmp_path / f"ok{k}", a + length.sub(change, b) + c) == (whole, [])
    wrong = (lambda m: b"Content-Length: %d" % (int(m[1]) - 1), lambda m: b"Content-Length: %d" % (int(m[1]) + 7), lambda m: b"Content-Length: 99999999999", lambda m: b"Content-Length: four", lambda m: b"X-None: 1", lambda m: b"Content-Length: -4")
    for k, change in enumerate(wrong):
        found, rest = _faulty(spark, tmp_path / f"no{k}", b + length.sub(change, a) + c)
        assert found == {0: (None, True), 1: whole[1], 2: whole[2]} and rest == []
    found, rest = _faulty(spark, tmp_path / "between", a + b"rubbish between\r\n\r\n" + c + b"\r\n\r\n")
    assert found == {0: whole[0], 2: whole[2]} and len(rest) == 1 and "belong to no record" in rest[0]["error"]
    found, rest = _faulty(spark, tmp_path / "cut", a + c[:-6])
    assert found == {0: whole[0], 2: (None, True)} and rest == []
    found, rest = _faulty(spark, tmp_path / "header", a + c[:40])
    assert found == {0: whole[0]} and len(rest) == 1 and rest[0]["error"]
    assert _faulty(spark, tmp_path / "rubbish", b"x" * 300_000)[1][0]["error"] == "300000 bytes that belong to no record"
    assert _faulty(spark, tmp_path / "empty", b"") == ({}, [])
    parts = record(5, "long " * 300, segment=400)
    for k, some in enumerate((parts[1:], parts[:-1], [*parts, parts[1]], parts[:1] + parts[2:])):
        found, _ = _faulty(spark, tmp_path / f"parts{k}", b"".join(some) + a)
        assert found == {5: (None, True), 0: whole[0]}


def test_foreign_records_are_passed_over(spark, tmp_path):
    """Archives begin with a warcinfo record and hold requests and metadata, also divided ones; they are no pages."""
    page = b"".join(f"{x}\r\n\r\n".encode() for x in warc._records(7, 7, "u", "page", None, None, 1 << 20, 4096))
    foreign = b""
    for k, kind in enumerate(("warcinfo", "request", "metadata", "resource", "conversion")):
        foreign += f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{k}>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n".encode()
    foreign += b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:8>\r\nWARC-Segment-Number: 1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    foreign += b"WARC/1.0\r\nWARC-Type: continuation\r\nWARC-Record-ID: <urn:x:9>\r\nWARC-Segment-Origin-ID: <urn:x:8>\r\nWARC-Segment-Number: 2\r\nWARC-Segment-Total-Length: 4\r\nContent-Length: 2\r\n\r\ncd\r\n\r\n"
    assert _faulty(spark, tmp_path / "a", foreign + page + foreign) == ({7: (b"page", False)}, [])


def test_long_runs_of_backslashes():
    """Neither escaping nor reading goes through a run of backslashes again and again."""
    for text in ("\\" * 1_000_000, "\\" * 1_000_000 + "</turn>", ("\\" * 1000 + "x") * 1000):
        began = time.perf_counter()
        rendered, start, size = chat.render("assistant", text)
        assert chat.parse(rendered) == [("assistant", text)] and chat.unescape(rendered[start : start + size]) == text
        assert time.perf_counter() - began < 1


def test_warc_faults():
    with pytest.raises(ValueError):
        warc._reassembled([(1, None, b"ab"), (3, 4, b"cd")])
    with pytest.raises(ValueError):
        warc._reassembled([(1, None, b"ab"), (2, 5, b"cd")])
    assert warc._reassembled([(2, 4, b"cd"), (1, None, b"ab")]) == b"abcd"
    with pytest.raises(ValueError):
        warc.dechunk(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab\r\n0\r\n\r\n")


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=0, max_size=3000))
def test_payloads_come_back(data):
    held = media.padded(data)
    assert len(held) % 64 == 0 and held.startswith(data)
    assert jpeg.payload(jpeg.read(jpeg.write(held))) == held


def _bits(codes):
    flat = "".join(codes)
    flat += "1" * (-len(flat) % 8)
    return bytes(int(flat[k : k + 8], 2) for k in range(0, len(flat), 8)).replace(b"\xff", b"\xff\x00")


def _value(v):
    n = abs(v).bit_length()
    return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def progressive(coefficients):
    """A gray progressive JPEG of one row of blocks: sparse scans with runs, ends of blocks and refinement, code by code."""
    blocks = len(coefficients)
    seg = lambda m, b: bytes([255, m]) + (len(b) + 2).to_bytes(2, "big") + b
    every = lambda symbols: bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    ac = sorted({(r << 4) | s for r in range(16) for s in range(11)} - {0xF0 | 15})
    code = {s: format(k, "08b") for k, s in enumerate(ac)}
    dc_code = {s: format(s, "08b") for s in range(12)}
    half = lambda v: int(v / 2)
    out = [b"\xff\xd8", seg(0xDB, b"\0" + b"\1" * 64), seg(0xC2, b"\x08" + (8).to_bytes(2, "big") + (8 * blocks).to_bytes(2, "big") + b"\1\1\x11\0"), seg(0xC4, b"\0" + every(range(12)) + b"\x10" + every(ac))]
    last, codes = 0, []
    for b in coefficients:
        n, v = _value((b[0] >> 1) - last)
        codes += [dc_code[n], v]
        last = b[0] >> 1
    out += [seg(0xDA, b"\1\1\0\0\0\x01"), _bits(codes)]
    for first, end in ((1, 5), (6, 63)):
        codes = []
        for b in coefficients:
            run = 0
            for v in map(half, b[first : end + 1]):
                if not v:
                    run += 1
                    continue
                while run > 15:
                    codes.append(code[0xF0])
                    run -= 16
                n, bits = _value(v)
                codes += [code[run << 4 | n], bits]
                run = 0
            if run:
                codes.append(code[0])
        out += [seg(0xDA, bytes([1, 1, 0, first, end, 0x01])), _bits(codes)]
    out += [seg(0xDA, b"\1\1\0\0\0\x10"), _bits([str(b[0] & 1) for b in coefficients])]
    codes = []
    for b in coefficients:
        run, waiting = 0, ""
        tail = max((k for k in range(1, 64) if abs(b[k]) == 1), default=0)
        for k in range(1, 64):
            v = b[k]
            if half(v):
                waiting += str(abs(v) & 1)
            elif abs(v) == 1:
                codes += [code[run << 4 | 1], "1" if v > 0 else "0", waiting]
                run, waiting = 0, ""
            else:
                run += 1
                if run == 16 and k < tail:
                    codes += [code[0xF0], waiting]
                    run, waiting = 0, ""
        if run or waiting:
            codes += [code[0], waiting]
    out += [seg(0xDA, b"\1\1\0\x01\x3f\x10"), _bits(codes), b"\xff\xd9"]
    return b"".join(out)


def test_sparse_progressive_scans():
    rng = np.random.default_rng(3)
    blocks = rng.integers(-40, 40, (9, 64)) * (rng.random((9, 64)) < 0.15)
    blocks[:, 0] = rng.integers(-300, 300, 9)
    blocks[4, 1:] = 0
    blocks[5, 1:63] = 0
    blocks[5, 63] = 1
    picture = jpeg.read(progressive(blocks.tolist()))
    assert (picture.components[0].coefficients.reshape(-1, 64) == blocks).all()
    rgb = np.concatenate(list(jpeg.strips(picture)))
    u = (np.arange(8)[:, None] * 2 + 1) * np.arange(8)[None] * np.pi / 16
    basis = np.cos(u) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)
    for k, b in enumerate(blocks):
        square = np.zeros(64)
        square[jpeg.ZIGZAG] = b
        expected = np.clip(np.floor(basis @ square.reshape(8, 8) @ basis.T + 128.5), 0, 255)
        assert np.abs(rgb[:, 8 * k : 8 * k + 8, 0] - expected).max() <= 1
    with pytest.raises(ValueError):
        jpeg.read(b"no picture")


def test_media_columns(spark):
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "é" * 500), (5, "a" * 64)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'z' AS width")
    got = {r["doc_id"]: r for r in media.read_media(media.store_texts(docs)).collect()}
    for i, t in rows:
        held = media.padded((t or "").encode())
        r = got[i]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["error"]) == (len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:]), None)
    assert got[1]["media"] == got[2]["media"] and got[3]["feature"] == got[5]["feature"]
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"\xff\xd8\xff")), (3, bytearray(b"x"))], "doc_id bigint, media binary")
    assert all(r["payload_sha256"] is None and r["error"] for r in media.read_media(broken).collect())
    assert all(len(r["rgb"]) == 3 * r["width"] * r["height"] for r in got.values())
    picture = jpeg.read(bytes(got[4]["media"]))
    rgb = np.concatenate(list(jpeg.strips(picture)))
    mean = ",".join(f"{v:.4f}" for v in rgb.reshape(-1, 3).mean(0))
    assert bytes(got[4]["rgb"]) == rgb.tobytes() and f"mean={mean};" in got[4]["feature"]
    assert media.read_media(media.store_texts(docs.limit(0))).count() == 0
    long = spark.createDataFrame([(None, "word é " * 150_000), (None, "word é " * 150_000)], "doc_id bigint, text string")
    held = media.padded(("word é " * 150_000).encode())
    assert {(r["payload_bytes"], r["payload_sha256"]) for r in media.read_media(media.store_texts(long)).collect()} == {(len(held), hashlib.sha256(held).hexdigest())}


def test_pictures_and_tensors_leave_in_pieces():
    """A batch of long texts in one array of tensors takes a worker's memory, and Spark's."""
    texts = [f"{k} " + "word " * 40_000 for k in range(20)]
    pictures = list(media.encoded.func(iter([pa.array(texts[:15]), pa.array(texts[15:])])))
    tensors = list(media.decoded.func(iter([pa.concat_arrays(pictures)])))
    one = max(len(x["rgb"]) for piece in tensors for x in piece.to_pylist())
    assert one < media._PIECE and all(piece.nbytes < media._PIECE + one + 65_536 for piece in pictures + tensors)
    assert len(tensors) > 1 and [x["payload_bytes"] for piece in tensors for x in piece.to_pylist()] == [len(media.padded(t.encode())) for t in texts]
    assert list(media.decoded.func(iter([]))) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\\", "### ", "</turn>", "\n", "Assistant:", "é", "x"]), max_size=9), st.sampled_from(["user", "assistant", "", "odd\n### User:\n"]))
def test_turns_come_back(pieces, role):
    text = "".join(pieces)
    rendered, start, length = chat.render(role, text)
    assert chat.parse(rendered * 2) == [(role, text)] * 2
    assert not length or chat.unescape(rendered[start : start + length]) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "odd:\n"]), st.lists(st.sampled_from(["\\", "### ", "</turn>", "\n", "é" * 40]), max_size=6)), max_size=8), st.integers(1, 50), st.integers(1, 9))
def test_conversations_are_read_in_any_pieces(turns, step, least):
    turns = [(role, "".join(pieces)) for role, pieces in turns]
    text, reader, found = "".join(chat.render(role, t)[0] for role, t in turns), chat.Reader(), []
    reader.PIECE = reader.due = least
    for k in range(0, len(text), step):
        found += reader.feed(text[k : k + step])
    assert found + reader.read() == turns == chat.parse(text)
    if turns:
        cut = chat.Reader()
        cut.feed(text[:-3])
        with pytest.raises(chat.GrammarError):
            cut.read()


def test_a_long_conversation_and_null_turns(spark):
    turns = [(1, None, "user", "first"), (1, None, "assistant", "again"), *[(1, k, "assistant" if k % 2 else "user", f"t{k} </turn>\n" * 400) for k in range(300)], (1, 300, "assistant", "x" * 3_000_000)]
    own = spark.createDataFrame([(*t, "r") for t in turns], "conv_id bigint, turn bigint, role string, text string, r string")
    got = chat.read_back(chat.format_turns(own)).collect()
    first = sorted(turns[:2], key=lambda t: chat.render(t[2], t[3])[0])
    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in first + turns[2:]).encode()).hexdigest()
    assert [(r["n_turns"], r["turns_sha256"]) for r in got] == [(303, digest)]
    assert got[0]["loss_chars"] == sum(len(t) for _, _, r, t in turns if r == "assistant")


def test_broken_grammar():
    for text in ("x", "### Nobody:\na\n</turn>\n", "### User:\nno end", "### =1", "### User:\n</turn>\n"):
        with pytest.raises(chat.GrammarError):
            chat.parse(text)


def test_conversations(spark):
    turns = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (1, 2, "assistant", "\\### x"), (None, 0, "user", "n"), (3, 0, "user", "t"), (3, 0, "user", "t")]
    own = spark.createDataFrame([(*t, "x") for t in turns], "conv_id bigint, turn bigint, role string, text string, segment string")
    segments = chat.format_turns(own)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(segments).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1] == (3, digest("user\na\nassistant\nb\nassistant\n\\### x\n"), 7, digest("b\\### x"))
    assert got[2][:2] == (1, digest("\n\n")) and got[None][0] == 1 and got[3][0] == 2
    whole = {r["conv_id"]: r for r in chat.conversations(segments).collect()}[1]
    masked = "".join(chat.unescape(whole["formatted"][s["start"] : s["start"] + s["length"]]) for s in whole["loss_spans"])
    assert masked == "b\\### x" and chat.read_back(segments.limit(0)).count() == 0


def test_articles_marked_by_class(spark):
    """All outermost marks are read; a mark that holds little of the page does not hide the rest."""
    words = " ".join(f"word{k}" for k in range(40))
    bodies = {
        1: (f"<div class=container><div class=post-meta>By X</div><div class=post-body><p>{words}</p></div></div>", f"By X {words}"),
        2: ("".join(f"<div class=story><p>part {k} {words}</p></div>" for k in range(3)), " ".join(f"part {k} {words}" for k in range(3))),
        3: (f"<div class=post-meta>By X</div><div class=text><p>{words}</p></div><div class=sidebar>s</div>", f"By X {words}"),
        4: (f"<div class=entry><p>{words}</p></div><div>Call us</div>", words),
    }
    assert texts(spark, [(k, f"http://h{k}/", page(k, b)) for k, (b, _) in bodies.items()]) == {k: t for k, (_, t) in bodies.items()}


def test_template_with_an_odd_first_page_and_in_long_boilerplate():
    def story(k, notice):
        return f"<html><body><div><p>{notice}</p><div><p>{' '.join(f'own{k}x{j}' for j in range(40))}</p></div><p>Call us</p></div></body></html>"

    odd = ["", "<html><body><table><tr><td>Moved</table>", "<html><body><div><p>Wel"]
    for first, notice in [(o, "Welcome to our pages") for o in odd] + [(None, "long notice " * 100)]:
        pages = [html.Page(x) for x in ([] if first is None else [first]) + [story(k, notice) for k in range(6)]]
        html.induce(pages)
        assert [p.text() for p in pages[-6:]] == [" ".join(f"own{k}x{j}" for j in range(40)) for k in range(6)]


def tree_matching(a, b):
    """Simple tree matching, as its recursion says."""
    if a.tag != b.tag:
        return 0
    p, q = a.kids, b.kids
    m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i, x in enumerate(p):
        for j, y in enumerate(q):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + tree_matching(x, y))
    return m[-1][-1] + 1


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([4, 1 << 22]))
def test_matchings_are_as_large_as_by_brute_force(seed, cells):
    rng = np.random.default_rng(seed)

    def tree(depth):
        inner = "".join(tree(depth - 1) for _ in range(rng.integers(0, 5))) if depth else "x"
        tag = rng.choice(["div", "section", "h2"])
        return f"<{tag}>{inner}</{tag}>"

    one, two = (html.parse("<div>" + "".join(tree(2) for _ in range(4)) + "</div>") for _ in range(2))
    matching, before, html._CELLS = html.Matching(), html._CELLS, cells
    try:
        assert matching.size(one, two) == tree_matching(one, two)
        todo, nodes, places = [(one, two)], 0, set()
        while todo:
            x, y = todo.pop()
            assert x.tag == y.tag and id(y) not in places
            places.add(id(y))
            nodes += 1
            todo += matching.children(x, y)
        assert nodes == tree_matching(one, two)
    finally:
        html._CELLS = before


def test_induction_alone_finds_the_content():
    """Menus, adverts and footers that differ from page to page, without a name: where the varying text stands decides."""
    def story(k):
        menu = "".join(f"<li><a href=/{k}{j}>go {k} {j}</a></li>" for j in range(5))
        own = "".join(f"<p>{' '.join(f'w{k}x{j}y{i}' for i in range(40))}</p>" for j in range(2 + k % 3))
        return f"<html><body><div><ul>{menu}</ul></div><div>offer {k}</div><h1>Title {k}</h1><div><section>{own}</section></div><div>copy right {k * 7}</div></body></html>"

    pages = [html.Page(story(k)) for k in range(9)]
    html.induce(pages)
    expected = [f"Title {k} " + " ".join(f"w{k}x{j}y{i}" for j in range(2 + k % 3) for i in range(40)) for k in range(9)]
    assert [p.induced() for p in pages] == expected == [p.text() for p in pages]
    few = [html.Page(story(k)) for k in range(2)]
    html.induce(few)
    assert all("offer" in p.text() for p in few)  # two pages say nothing about their host


@pytest.mark.parametrize("body", ["<p " * 300_000, "<a href='x " * 90_000, "<div>" * 60_000 + "x", "<b>" * 90_000 + "<p>x</p>" * 2000, "&amp; " * 170_000, "< " * 500_000, "<i>" * 60_000 + "</b></div>" * 60_000, "<!-- " * 200_000, "<li>a" * 200_000])
def test_long_and_deep_pages(body):
    import time

    began = time.process_time()
    html.Page(body).text()
    assert time.process_time() - began < 60


def test_long_pages_of_one_host():
    pages = [html.Page("<body><div>" + "<h2>t</h2><p>some words</p>" * (9000 + k) + f"<h3>{k}</h3></div><p>call us</p>") for k in range(3)] + [html.Page("<div>" * 3000 + f"x{k}") for k in range(3)]
    html.induce(pages)
    assert all("call us" not in p.text() for p in pages) and [p.text() for p in pages[3:]] == ["x0", "x1", "x2"]


def test_odd_pages(spark):
    body = page(1, "<article><p>one story</p></article>")
    rows = [(1, "http://h/", body), (1, "http://h/", body), (None, "http://h/", body), (None, None, None), (2, None, body), (3, "", ""), (4, "http://h/", "é " * 400_000)]
    own = spark.createDataFrame([(*r, "x", 7) for r in rows], PAGES + ", host string, bucket int")
    got = sorted((tuple(r) for r in html.extract(own).collect()), key=str)
    expected = sorted(((k, u, t := "" if not h else "one story" if h is body else "é " * 399_999 + "é", len(t)) for k, u, h in rows), key=str)
    assert got == expected and html.extract(own.limit(0)).count() == 0


def _in_article(fragment, pages=12):
    """Texts of pages of one host whose marked articles hold a fragment beside text that varies."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    own = [html.Page(f"<body><nav><a href=/>Home</a><a href=/a>About</a></nav><article><h1>{line(4)}</h1><p>{line(40)}</p>{fragment(line, k)}<p>{line(30)}</p></article><div class=footer>Imprint {k}</div></body>") for k in range(pages)]
    html.induce(own)
    return [p.text() for p in own]


@pytest.mark.parametrize("open_, close", [('<p class="alert">', "</p>"), ('<p class="ad-free">', "</p>"), ('<div class="header">', "</div>"), ('<div class="footer-note">', "</div>"), ("<article>", "</article>")])
def test_names_inside_an_article_decide_only_without_a_template(open_, close):
    """What varies stays, whatever it is called; what is constant goes."""
    kept = _in_article(lambda line, k: f"{open_}KEPT{k} {line(8)}{close}")
    assert all(f"KEPT{k} " in text for k, text in enumerate(kept)) and not any("Home" in t or "Imprint" in t for t in kept)
    gone = _in_article(lambda line, k: f"{open_}Read our GONE terms{close}")
    assert not any("GONE" in text for text in gone)


@pytest.mark.parametrize("open_, close", [('<div class="ad">', "</div>"), ('<section id="comments-list">', "</section>"), ('<div class="related posts">', "</div>"), ("<aside>", "</aside>"), ('<ul class="share-buttons">', "</ul>"), ("<form>", "</form>")])
def test_what_is_never_text_goes_though_it_varies(open_, close):
    assert not any("GONE" in text for text in _in_article(lambda line, k: f"{open_}GONE{k} {line(8)}{close}"))


def test_long_lists_of_unlike_children():
    """Children of many shapes are aligned exactly, and small lists without arrays give the same total as large ones."""
    page = lambda n, s: html.parse("<div>" + "".join(f"<div>{'<p>b</p>' * (1 + (k * 13 + s) % 9)}<x{k % 29}>y</x{k % 29}></div>" for k in range(n)) + "</div>")
    a, b = page(150, 1), page(150, 5)
    began = time.perf_counter()
    pairs = html.align(a, b)
    assert time.perf_counter() - began < 5 and len(pairs) > 300
    p, q = a.kids[0].kids[:14], b.kids[0].kids[:14]
    matching = html.Matching()
    for u in p:
        for v in q:
            matching.size(u, v)
    assert matching._best(p, q) == int(html._last_row(*matching._classes(p, q))[-1])
