"""Conversations as training text with a loss mask, assembled column by column.

A user's turn is `[INST]text[/INST]`, an assistant's `text</s>`, any other role's `[ROLE]role[/ROLE]text</s>`, and the
first turn of a conversation opens with `<s>`. Control strings inside texts and roles get a backslash after their first
character, or one more where there are some already, which `unescape` takes back. The pieces of a batch (headers,
texts, closings) are lengths first, then offsets, then one scatter of bytes into one buffer that becomes an Arrow
column without a copy. The loss mask is the range of code points that an assistant's escaped text has in its turn.

A null text or role is empty; turns of one conversation are in order of turn (null first), role, text, and repeated rows
stay; rows without conv_id are one conversation, whose id is null. Empty tables give no rows.
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

from quietlog.llm.common import byte_view, pieces

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_REST})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_REST})")
_TURN = re.compile(r"(<s>)?(?:\[INST\](?P<user>.*?)\[/INST\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)</s>|(?P<assistant>.*?)</s>)", re.S)

FORMATTED = "conv_id long, formatted binary, loss_start long, loss_end long, opens boolean"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError(f"no turn: {formatted[:80]!r}")
    if m["user"] is not None:
        return "user", unescape(m["user"])
    if m["role"] is not None:
        return unescape(m["role"]), unescape(m["other"])
    return "assistant", unescape(m["assistant"])


def _escaped(column: pa.Array) -> pa.Array:
    """Only values that may hold a control string go through Python."""
    some = pc.match_substring_regex(column, r"[<\[]\\*/?(s>|INST\]|ROLE\])")
    if not pc.any(some).as_py():
        return column
    return pa.array([escape(v) if s else v for v, s in zip(column.to_pylist(), some.to_pylist(), strict=True)], column.type)


def assemble(parts: list[pa.Array]) -> pa.Array:
    """Row by row the concatenation of the columns: one buffer, filled by scatter indices."""
    views = [byte_view(p) for p in parts]
    size = np.stack([np.diff(offsets) for _, offsets in views], axis=1)  # rows x parts
    ends = np.cumsum(size.ravel())
    begin = (ends - size.ravel()).reshape(size.shape)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k, (data, offsets) in enumerate(views):
        at = np.repeat(begin[:, k] - offsets[:-1], size[:, k])
        out[at + np.arange(len(data))] = data
    row_ends = np.concatenate([[0], np.cumsum(size.sum(1))])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(row_ends.astype(np.int64)), pa.py_buffer(out)])


def format_turns(role: pa.Array, text: pa.Array, opens: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns; first and last code point (exclusive) of the loss in each, equal where there is none."""
    user, assistant = pc.equal(role, "user"), pc.equal(role, "assistant")
    text = _escaped(text)
    other = pc.binary_join_element_wise("[ROLE]", _escaped(role), "[/ROLE]", "")
    head = pc.if_else(user, "[INST]", pc.if_else(assistant, "", other))
    close = pc.if_else(user, "[/INST]", "</s>")
    start = pc.if_else(pa.array(opens), "<s>", "")
    before = pc.add(pc.utf8_length(start), pc.utf8_length(head)).to_numpy(zero_copy_only=False).astype(np.int64)
    long = pc.utf8_length(text).to_numpy(zero_copy_only=False) * assistant.to_numpy(zero_copy_only=False)
    return assemble([start, head, text, close]), before, before + long


def formatted(conversations: DataFrame) -> DataFrame:
    """A row per turn, in order within each partition; a conversation's turns are in one partition and stand together.

    Turns stream through: a conversation is never held as a whole, however long it is.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in pieces(batches, "text"):
            ids = batch.column("conv_id").to_pylist()
            opens = np.array([last != (c,) if k == 0 else c != ids[k - 1] for k, c in enumerate(ids)])
            last = (ids[-1],)
            out, start, end = format_turns(batch.column("role"), batch.column("text"), opens)
            yield pa.record_batch([batch.column("conv_id"), out.cast(pa.binary()), pa.array(start), pa.array(end), pa.array(opens)], ["conv_id", "formatted", "loss_start", "loss_end", "opens"])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


def digests(turns: DataFrame) -> DataFrame:
    """What is read back from formatted turns, by conversation; reads them as `formatted` leaves them, in a stream."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in schema.split(", ")]
        now: list | None = None
        for batch in batches:
            done = []
            for conv, data, start, end, opens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if opens:
                    if now:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turn = data.decode()
                role, text = read_turn(turn)
                loss = unescape(turn[start:end])
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(turn)
            if done:
                yield pack(done, kinds, names)
        if now:
            yield pack([now], kinds, names)

    def pack(rows: list[list], kinds: list, names: list[str]) -> pa.RecordBatch:
        values = [[a, b, c.hexdigest(), d, e.hexdigest(), f] for a, b, c, d, e, f in rows]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*values, strict=True), kinds, strict=True)], names)

    return turns.mapInArrow(run, schema)
