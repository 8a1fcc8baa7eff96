"""Chat formatting by columnar byte assembly.

Rows sorted by conversation and turn are formatted a batch at a time. Texts get an escape byte
in every control string they hold; with its header and footer a text makes the segments of a
turn. Their lengths and cumulative offsets say where each byte of the output comes from, and
numpy scatters headers and contents into one preallocated Arrow buffer. Turns fill pieces of
bounded size; each piece carries the spans that the loss is taken over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalcount.session import materialize

#: A piece ends with the turn that takes it to so many bytes; bytes copied at a time.
PIECE_BYTES, WINDOW = 1 << 20, 1 << 20

#: The byte that is put after the first character of a control string inside a text.
ESCAPE = b"\\"

CONTROL = re.compile(r"\[[^][<>\\ ]+\]|<[^][<>\\ ]+>")


@dataclass(frozen=True)
class Template:
    """What stands before and after the text of each role.

    Other roles, null and empty ones too, are written between the first two strings of ``other``,
    escaped like a text. Control strings are what brackets enclose; they begin with < or [, and
    a blank parts them from texts. ``learned`` are the roles whose texts the loss is taken over.
    """

    roles: tuple[tuple[str, str, str], ...] = (
        ("system", "[SYS] ", " [/SYS]"),
        ("user", "<s>[INST] ", " [/INST]"),
        ("assistant", "[OUT] ", " [/OUT]</s>"),
    )
    other: tuple[str, str, str] = ("[ROLE] ", " [SAYS] ", " [/ROLE]")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for before, after in ((x, y) for _, x, y in (*self.roles, ("", *self.other[:2]), ("", *self.other[1:]))):
            if not (before.endswith(" ") and after.startswith(" ") and CONTROL.search(before) and CONTROL.search(after)):
                raise ValueError("a control string and a blank must stand on both sides of a text")

    def controls(self) -> list[bytes]:
        frames = [f for _, *two in self.roles for f in two] + list(self.other)
        return sorted({c.encode() for f in frames for c in CONTROL.findall(f)})


# --- escaping -----------------------------------------------------------------------------


def control_starts(data: np.ndarray, ends: np.ndarray, controls: list[bytes], stuffed: bool = False) -> np.ndarray:
    """Where control strings begin in texts laid end to end, after any number of escape bytes.

    ``ends`` are the ends of the texts; no match crosses one. With ``stuffed`` only matches with
    at least one escape byte count, as in escaped texts.
    """
    openings = np.unique(np.frombuffer(b"".join(c[:1] for c in controls), np.uint8))
    at = np.flatnonzero(np.isin(data, openings))
    if not len(at):
        return at
    stop = ends[np.searchsorted(ends, at, "right")]
    slash = data == ESCAPE[0]
    run_ends = np.flatnonzero(slash & ~np.append(slash[1:], False)) + 1
    rest = at + 1
    inside = rest < len(data)
    inside[inside] = slash[rest[inside]]
    rest[inside] = run_ends[np.searchsorted(run_ends, rest[inside], "right")]
    hit = np.zeros(len(at), bool)
    for c in controls:
        fits = np.flatnonzero((data[at] == c[0]) & (rest + len(c) - 1 <= stop))
        for k, byte in enumerate(c[1:]):
            fits = fits[data[rest[fits] + k] == byte]
        hit[fits] = True
    return at[hit & (rest > at + 1)] if stuffed else at[hit]


def scatter(out: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """out[to : to + length] = source[start : start + length] for every segment, a bounded window at a time."""
    begins = np.concatenate([[0], np.cumsum(length)])
    for lo in range(0, int(begins[-1]), WINDOW):
        hi = min(lo + WINDOW, int(begins[-1]))
        a, b = np.searchsorted(begins, lo, "right") - 1, np.searchsorted(begins, hi, "left")
        skipped = np.maximum(lo - begins[a:b], 0)
        n = np.minimum(begins[a + 1 : b + 1], hi) - np.maximum(begins[a:b], lo)
        within = np.arange(hi - lo) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to[a:b] + skipped, n) + within] = source[np.repeat(start[a:b] + skipped, n) + within]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts laid end to end, and the n + 1 offsets between them."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _shifted(offsets: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    return offsets + step * np.searchsorted(at, offsets, "left")


def escaped(data: np.ndarray, offsets: np.ndarray, controls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One more escape byte in every control string, whether or not it holds some already."""
    at = control_starts(data, offsets[1:], controls)
    if not len(at):
        return data, offsets
    cuts = np.concatenate([[0], at + 1, [len(data)]])
    out = np.empty(len(data) + len(at), np.uint8)
    scatter(out, cuts[:-1] + np.arange(len(cuts) - 1), data, cuts[:-1], np.diff(cuts))
    out[at + 1 + np.arange(len(at))] = ESCAPE[0]
    return out, _shifted(offsets, at, 1)


def unescaped(data: np.ndarray, offsets: np.ndarray, controls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of :func:`escaped`."""
    at = control_starts(data, offsets[1:], controls, stuffed=True)
    if not len(at):
        return data, offsets
    return np.delete(data, at + 1), _shifted(offsets, at, -1)


# --- formatting ---------------------------------------------------------------------------

PIECES = "conv_id bigint, piece bigint, whole boolean, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"


def _borders(ids: pa.Array) -> np.ndarray:
    """Whether each row begins another conversation than the row before."""
    null, value = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    return np.concatenate([[True], (value[1:] != value[:-1]) | (null[1:] != null[:-1])])


def assembled(b: pa.RecordBatch, template: Template, piece_bytes: int = PIECE_BYTES) -> pa.RecordBatch:
    """Turns in order as pieces: conv_id, n_turns, formatted, loss (byte spans within the piece)."""
    controls = template.controls()
    names = [r for r, *_ in template.roles]
    kind = pc.index_in(b.column("role"), value_set=pa.array(names, pa.string())).fill_null(len(names)).to_numpy()
    data, offsets = escaped(*_texts(b.column("text")), controls)
    roles, role_offsets = escaped(*_texts(b.column("role")), controls)

    # five segments a turn: header, role, separator, text, footer; known roles have only three
    frames = [(x.encode(), b"", y.encode()) for _, x, y in template.roles] + [tuple(x.encode() for x in template.other)]
    pool = np.frombuffer(b"".join(b"".join(f) for f in frames), np.uint8)
    frame_length = np.array([[len(x) for x in f] for f in frames], np.int64)
    frame_start = (np.cumsum(frame_length) - frame_length.ravel()).reshape(frame_length.shape)
    length = np.zeros((b.num_rows, 5), np.int64)
    length[:, 0::2] = frame_length[kind]
    length[:, 1] = np.where(kind == len(names), np.diff(role_offsets), 0)
    length[:, 3] = np.diff(offsets)
    ends = np.cumsum(length).reshape(length.shape)
    begin = ends - length

    buffer = pa.allocate_buffer(int(ends[-1, -1]))
    out = np.frombuffer(buffer, np.uint8)
    for k in range(3):
        scatter(out, begin[:, 2 * k], pool, frame_start[kind, k], length[:, 2 * k])
    scatter(out, begin[:, 1], roles, role_offsets[:-1], length[:, 1])
    scatter(out, begin[:, 3], data, offsets[:-1], length[:, 3])

    border = _borders(b.column("conv_id"))
    conv = np.flatnonzero(border)[np.cumsum(border) - 1]
    filled = (begin[:, 0] - begin[conv, 0]) // piece_bytes
    first = np.flatnonzero(border | np.append(True, filled[1:] != filled[:-1]))
    cuts = np.append(begin[first, 0], ends[-1, -1]).astype(np.int32)
    piece = np.searchsorted(first, np.arange(b.num_rows), "right") - 1
    learned = np.flatnonzero(pc.is_in(b.column("role"), value_set=pa.array(template.learned, pa.string())).to_numpy(zero_copy_only=False))
    spans = pa.StructArray.from_arrays([pa.array(x[learned, 3] - cuts[piece[learned]], pa.int64()) for x in (begin, ends)], names=["start", "end"])
    held = np.concatenate([[0], np.cumsum(np.bincount(piece[learned], minlength=len(first)))])
    return pa.RecordBatch.from_arrays(
        [
            b.column("conv_id").take(pa.array(first)), pa.array(np.diff(np.append(first, b.num_rows)), pa.int64()),
            pa.StringArray.from_buffers(len(first), pa.py_buffer(cuts), buffer), pa.ListArray.from_arrays(pa.array(held, pa.int32()), spans),
        ],
        names=["conv_id", "n_turns", "formatted", "loss"],
    )


def _formatter(template: Template, piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, opening, held = TaskContext.get().partitionId() << 40, True, None

        def pieces(b: pa.RecordBatch, closing: bool) -> pa.RecordBatch:
            """``closing``: more of the last conversation may follow here or in the next partition."""
            nonlocal number, opening
            done = assembled(b, template, piece_bytes)
            border = _borders(done.column("conv_id"))
            alone = border & np.append(border[1:], not closing)
            alone[0] &= not opening
            opening = closing and len(border) == 1
            at = np.arange(number, number + done.num_rows)
            number += done.num_rows
            ids, n, formatted, loss = done.columns
            return pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(alone), n, formatted, loss], names=["conv_id", "piece", "whole", "n_turns", "formatted", "loss"])

        for b in batches:
            if not b.num_rows:
                continue
            b = b if held is None else pa.concat_batches([held, b])
            last = int(np.flatnonzero(_borders(b.column("conv_id")))[-1])
            if last:
                yield pieces(b.slice(0, last), False)
            held = b.slice(last)
            if held.nbytes > piece_bytes:
                yield pieces(held, True)
                held, opening = None, True
        if held is not None:
            yield pieces(held, True)

    return run


def format_conversations(turns: DataFrame, template: Template = Template(), piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Conversations as formatted text: conv_id, piece, whole, n_turns, formatted, loss.

    ``turns`` has conv_id, turn, role and text. Turns go by turn (null first), ties by role and
    text; null text is empty, and so is a null role, which counts as one without an entry in the
    template. Null is a conv_id like any other; repeated rows are turns of their own. Other
    columns are ignored.

    ``formatted`` of a conversation's pieces, in order of ``piece``, laid end to end is the
    conversation. Most have one piece; one of more than ``piece_bytes`` has several, and so may one
    that lies on the border of two partitions: rows are dealt by ranges of (conv_id, turn), so
    that a conversation of any size is spread over tasks. ``whole`` marks pieces known to be
    all of their conversation. ``loss`` are the byte spans (end exclusive) of ``formatted`` that
    hold learned texts, still escaped.
    """
    rows = turns.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"))])
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_formatter(template, piece_bytes), PIECES)


# --- reading back -------------------------------------------------------------------------


def _plain(parts: list[bytes], controls: list[bytes]) -> list[bytes]:
    data = np.frombuffer(b"".join(parts), np.uint8)
    out, ends = unescaped(data, np.cumsum([0, *map(len, parts)]), controls)
    raw = out.tobytes()
    return [raw[a:e] for a, e in zip(ends.tolist(), ends[1:].tolist())]


def turns_of(formatted: bytes, template: Template) -> list[tuple[bytes, bytes]]:
    """Role and text of every turn of a piece."""
    known = [(role.encode(), before.encode(), after.encode()) for role, before, after in template.roles]
    opening, between, closing = (x.encode() for x in template.other)
    parts: list[bytes] = []
    at = 0
    while at < len(formatted):
        for role, before, after in known:
            if formatted.startswith(before, at):
                break
        else:
            begin = at + len(opening)
            at = formatted.index(between, begin)
            role, before, after = formatted[begin:at], between, closing
        begin = at + len(before)
        end = formatted.index(after, begin)
        parts += [role, formatted[begin:end]]
        at = end + len(after)
    plain = _plain(parts, template.controls())
    return list(zip(plain[::2], plain[1::2]))


def _characters(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def _reader(template: Template):
    """Digests of conversations whose pieces come one after another; nothing of them is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        controls, kinds = template.controls(), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        conv = None  # conv_id, turns, their digest, learned characters, their digest, characters
        rows: list[tuple] = []

        def closed() -> None:
            if conv:
                rows.append((conv[0], conv[1], conv[2].hexdigest(), conv[3], conv[4].hexdigest(), conv[5]))

        for b in batches:
            for i, text, loss in zip(b.column("conv_id").to_pylist(), b.column("formatted"), b.column("loss").to_pylist()):
                if conv is None or conv[0] != i:
                    closed()
                    conv = [i, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = text.as_buffer().to_pybytes()
                turns = turns_of(raw, template)
                conv[1] += len(turns)
                for turn in turns:
                    for part in turn:
                        conv[2].update(part)
                        conv[2].update(b"\n")
                for part in _plain([raw[s["start"] : s["end"]] for s in loss], controls):
                    conv[3] += _characters(part)
                    conv[4].update(part)
                conv[5] += _characters(raw)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
                rows.clear()
        closed()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def read_back(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from stored pieces: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Pieces that are whole conversations are read where they lie; only the others are dealt by
    conversation. A digest is sequential by definition, so those of one conversation pass
    through one task, piece by piece.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    columns = ("conv_id", "piece", "formatted", "loss")
    parted = pieces.where(~F.col("whole")).select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return pieces.where("whole").select(*columns).mapInArrow(_reader(template), schema).unionByName(parted.mapInArrow(_reader(template), schema))


def digests(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """:func:`format_conversations`, stored, and :func:`read_back`."""
    return read_back(materialize(format_conversations(turns, template)), template)
