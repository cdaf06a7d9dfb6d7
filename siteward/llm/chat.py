"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>`` role newline text ``<|im_end|>`` newline.  Control strings inside
roles and texts are escaped reversibly: ``<|`` after ``<`` and any backslashes gets one backslash
more.  Segments (headers, texts, ends) are laid out for a whole batch at once: their lengths and
cumulative offsets are computed in numpy and their bytes are scattered into one preallocated
Arrow buffer.  The loss mask covers exactly the escaped text of the turns of ``assistant``.

Turns are dealt by ranges of (conversation, turn), so that a conversation with a third of all rows
is formatted by many tasks; its parts are rows of their own, in order of ``part``.  ``digest``
reads the parts back one after another in constant memory.

Defined results: null texts and roles are empty; turns with equal numbers go by role, then text;
a null turn comes first; a null conversation id is a conversation; repeated rows are turns of
their own; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteward.llm.words import text_bytes

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
_TURN = re.compile(re.escape(START) + "([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)
_SEGMENTS = 5


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, pattern=r"<(\\*)\|", replacement=r"<\\\1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(column: pa.Array) -> pa.Array:
    """Roles are lines: backslashes are doubled and newlines written as backslash n."""
    return escape(pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _code_points(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points before each offset."""
    return np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]


def assemble(role: pa.Array, text: pa.Array, cuts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Turns of a batch, those from cuts[i] to cuts[i + 1] in one string; and their loss spans in
    code points of that string."""
    n = len(role)
    trained = pc.equal(role, TRAINED).to_numpy(zero_copy_only=False).astype(bool)
    fixed = [np.frombuffer(x.encode(), np.uint8) for x in (START, "\n", END + "\n")]
    columns = [text_bytes(escape_role(role)), text_bytes(escape(text))]
    # Segments of a turn: start, role, newline, text, end.
    lengths = np.empty((n, _SEGMENTS), np.int64)
    for k, size in zip((0, 2, 4), map(len, fixed), strict=True):
        lengths[:, k] = size
    for k, (_, offsets) in zip((1, 3), columns, strict=True):
        lengths[:, k] = np.diff(offsets)
    ends = np.cumsum(lengths).reshape(n, _SEGMENTS)
    starts = ends - lengths
    total = int(ends[-1, -1]) if n else 0
    out = np.empty(total, np.uint8)
    for k, piece in zip((0, 2, 4), fixed, strict=True):
        out[(starts[:, k, None] + np.arange(len(piece))).ravel()] = np.tile(piece, n)
    for k, (raw, offsets) in zip((1, 3), columns, strict=True):
        if len(raw):
            out[np.arange(len(raw)) + np.repeat(starts[:, k] - offsets[:-1], lengths[:, k])] = raw
    bounds = np.concatenate((starts[:, 0], [total]))[cuts]
    strings = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out))
    # Loss spans in code points, from the start of their string.
    points = _code_points(out, np.concatenate((starts[:, 3], ends[:, 3], bounds)))
    first, last, zero = points[:n], points[n : 2 * n], points[2 * n :]
    of = np.searchsorted(cuts, np.arange(n), "right") - 1
    kept = np.flatnonzero(trained)
    spans = pa.StructArray.from_arrays([pa.array(first[kept] - zero[of[kept]]), pa.array(last[kept] - zero[of[kept]])], names=["start", "end"])
    return strings, pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, cuts), pa.int32()), spans)


def format_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) as rows conv_id, first_turn, part, formatted, loss.

    The parts of a conversation, in order of (first_turn, nulls first, then part), make it up."""
    kind, number = turns.schema["conv_id"].dataType.simpleString(), turns.schema["turn"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        part = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0)
            changed = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, n - 1)), False).to_numpy(zero_copy_only=False).astype(bool)
            nulls = pc.is_null(ids).to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.flatnonzero(changed | (nulls[1:] != nulls[:-1])) + 1, [n]))
            strings, loss = assemble(batch.column(2), batch.column(3), cuts)
            first = pa.array(cuts[:-1])
            parts = pa.array(np.arange(part, part + len(cuts) - 1), pa.int64())
            part += len(cuts) - 1
            yield pa.RecordBatch.from_arrays([ids.take(first), batch.column(1).take(first), parts, strings.cast(pa.string()), loss], names=["conv_id", "first_turn", "part", "formatted", "loss"])

    return rows.mapInArrow(run, f"conv_id {kind}, first_turn {number}, part long, formatted string, loss array<struct<start:bigint,end:bigint>>")


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn, unescaped."""
    at = 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("formatted text is damaged")
        at = m.end()
        yield unescape_role(m[1]), unescape(m[2])
    if at != len(formatted):
        raise ValueError("formatted text is damaged")


def digest(turns: DataFrame) -> DataFrame:
    kind = turns.schema["conv_id"].dataType.simpleString()
    parts = format_turns(turns)
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "part")

    def run(batches):
        now, held = None, None
        for batch in batches:
            out = []
            for key, text, loss in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if now is None or now[0] != key:
                    if now is not None:
                        out.append(held)
                    now, held = (key,), [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    held[1] += 1
                    held[2].update(f"{role}\n{said}\n".encode())
                for s in loss:
                    said = unescape(text[s["start"] : s["end"]])
                    held[3] += len(said)
                    held[4].update(said.encode())
                held[5] += len(text)
            yield table(out)
        if now is not None:
            yield table([held])

    def table(rows):
        columns = list(zip(*rows)) if rows else [()] * 6
        return pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], pa_kind), pa.array(columns[1], pa.int64()), pa.array([h.hexdigest() for h in columns[2]], pa.string()),
                pa.array(columns[3], pa.int64()), pa.array([h.hexdigest() for h in columns[4]], pa.string()), pa.array(columns[5], pa.int64()),
            ],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind = to_arrow_type(turns.schema["conv_id"].dataType)
    return parts.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
