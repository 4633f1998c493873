"""Chat formatting with a grammar round trip.

A turn is rendered as ``### Role:``, a line break, the text, a line break and ``</turn>``. A deterministic parser reads
rendered text back; a turn whose role or text does not come back identical is escaped and rendered again until it does. The
escape is one more backslash before every control string (and before the backslashes already there), which the parser
removes; a role outside the usual ones is written as a JSON string.

Turns are rendered row by row, before the shuffle; then each conversation's whole text is parsed as a stream, whose pieces
know nothing of the rows they came from: where turns begin and end, and how many there are, is what the grammar says. Its
length does not matter for memory. The digest of a conversation is sequential by definition: one task reads one conversation.

Defined cases: null role or text counts as empty; rows with a null id form one conversation; rows with equal turn numbers
are ordered by their rendered text, and a null turn comes first; repeated rows are turns of their own; a very long text is
one turn, held while it is read; an empty table gives no conversation; extra columns, also of clashing names, play no part.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
_NAMED = {v: k for k, v in ROLES.items()}
_CONTROL = re.compile(r"(?<!\\)\\*(?=### |</turn>)")
_RUN = re.compile(r"(?<!\\)\\(\\*)(?=### |</turn>)")  # from the first of a run, so that a long one is gone through once
_END = re.compile(r"(?<!\\)</turn>\n")
LOSS_ROLE = "assistant"


class GrammarError(ValueError):
    """Text that is not a sequence of turns."""


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _RUN.sub(lambda m: m[1], text)


def _header(role: str) -> str:
    return f"### {ROLES[role]}:\n" if role in ROLES else f"### ={json.dumps(role)}:\n"


def turns_of(text: str, final: bool = True) -> tuple[list[tuple[str, str]], int]:
    """Role and text of each turn, and how many characters they take. Without ``final``, a last turn may still go on."""
    out, at = [], 0
    while at < len(text):
        found = _turn(text, at)
        if isinstance(found, str):
            if final or not found.startswith("no end"):
                raise GrammarError(found)
            break
        role, content, at = found
        out.append((role, unescape(content)))
    return out, at


def _turn(text: str, at: int) -> tuple[str, str, int] | str:
    """Role, content and end of the turn at a place, or what is wrong with it."""
    if not text.startswith("### ", at):
        return f"no turn at character {at}" if not "### ".startswith(text[at:]) else f"no end of the turn from character {at}"
    begun, at = at, at + 4
    if text.startswith("=", at):
        try:
            role, at = json.JSONDecoder().raw_decode(text, at + 1)
        except json.JSONDecodeError as broken:
            return f"no end of the role at character {at}: {broken}"
        if not text.startswith(":\n", at):
            return f"no end of the role at character {at}"
    else:
        end = text.find(":\n", at)
        if end < 0:
            return f"no end of the role at character {at}"
        if text[at:end] not in _NAMED:
            return f"unknown role at character {at}"
        role, at = _NAMED[text[at:end]], end
    end = _END.search(text, at + 2)
    if not end:
        return f"no end of the turn from character {begun}"
    if text[end.start() - 1] != "\n" or end.start() - 1 < at + 2:
        return f"a turn from character {begun} that ends within a line"
    return role, text[at + 2 : end.start() - 1], end.end()


def parse(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a whole conversation."""
    return turns_of(text)[0]


class Reader:
    """A conversation's text, fed in pieces that need not end where turns end, and read turn by turn."""

    PIECE = 1 << 16

    def __init__(self):
        self.held, self.size, self.due = [], 0, self.PIECE

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.held.append(piece)
        self.size += len(piece)
        return self.read(False) if self.size >= self.due else []

    def read(self, final: bool = True) -> list[tuple[str, str]]:
        text = "".join(self.held)
        found, end = turns_of(text, final)
        self.held, self.size = [text[end:]], len(text) - end
        self.due = max(self.PIECE, 2 * self.size)  # a long turn is not gone through again for each piece
        return found


def _comes_back(rendered: str, role: str, text: str) -> bool:
    try:
        return parse(rendered) == [(role, text)]
    except GrammarError:
        return False


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as text, and where the loss mask begins in it and how long it is (in code points)."""
    content = text
    while not _comes_back(rendered := f"{_header(role)}{content}\n</turn>\n", role, text):
        escaped = escape(content)
        if escaped == content or len(escaped) > 4 * len(text) + 64:
            raise GrammarError(f"no escape makes this turn come back: {text[:80]!r}")
        content = escaped
    return rendered, len(_header(role)), len(content) if role == LOSS_ROLE else 0


_TURN = T.StructType([T.StructField("segment", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_length", T.LongType())])


@F.arrow_udf(_TURN)
def _rendered(role: pa.Array, text: pa.Array) -> pa.Array:
    rows = [render(r or "", t or "") for r, t in zip(role.to_pylist(), text.to_pylist(), strict=True)]
    return pa.array([dict(zip(("segment", "loss_start", "loss_length"), x, strict=True)) for x in rows], pa.struct([("segment", pa.string()), ("loss_start", pa.int64()), ("loss_length", pa.int64())]))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, segment (the rendered turn), loss_start and loss_length in it. The segments of a conversation, in order, are its text."""
    return turns.select("conv_id", "turn", _rendered("role", "text").alias("r")).select("conv_id", "turn", "r.*")


def in_order(segments: DataFrame) -> DataFrame:
    """Each conversation in one partition, its segments in order."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")


def conversations(segments: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start and length in code points of formatted), for conversations that fit a row."""
    return in_order(segments).mapInArrow(_joined, "conv_id bigint, formatted string, loss_spans array<struct<start:bigint,length:bigint>>")


def _groups(batches, columns):
    """(whether a conversation begins, row) in order, then (True, None)."""
    begun, last = False, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            new = not begun or row[0] != last
            begun, last = True, row[0]
            yield new, row
    yield True, None


def _joined(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    key, parts, spans, size = None, None, [], 0
    for new, row in _groups(batches, ["conv_id", "segment", "loss_start", "loss_length"]):
        if new and parts is not None:
            yield pa.record_batch([pa.array([key], pa.int64()), pa.array(["".join(parts)]), pa.array([spans], kind)], ["conv_id", "formatted", "loss_spans"])
        if row is None:
            return
        if new:
            key, parts, spans, size = row[0], [], [], 0
        parts.append(row[1])
        if row[3]:
            spans.append({"start": size + row[2], "length": row[3]})
        size += len(row[1])


_READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, parsed from the rendered text: turns, digests of the turns and of the text under the loss mask, lengths."""
    return in_order(segments).mapInArrow(_digests, _READ)


def _digests(batches):
    names = [x.split(" ")[0] for x in _READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    out, state, reader = [], None, Reader()

    def flush():
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names)

    def hashed(found):
        for role, text in found:
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())

    for new, row in _groups(batches, ["conv_id", "segment", "loss_start", "loss_length"]):
        if new and state:
            hashed(reader.read())
            key, n, turns, chars, loss, size = state
            out.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            if len(out) == 2048:
                yield flush()
                out = []
        if row is None:
            break
        if new:
            state, reader = [row[0], 0, hashlib.sha256(), 0, hashlib.sha256(), 0], Reader()
        hashed(reader.feed(row[1]))
        if row[3]:
            masked = unescape(row[1][row[2] : row[2] + row[3]])
            state[3] += len(masked)
            state[4].update(masked.encode())
        state[5] += len(row[1])
    yield flush()
