"""Chat formatting by columnar byte assembly.

A turn is ``### role: text</turn>\\n``. Inside roles and texts a backslash is doubled, and ``### `` and ``</turn>`` get a backslash before
them, as does ``:`` in a role; so a marker is real where an even number of backslashes stands before it, and reading back
is exact. The loss mask covers the escaped texts of assistant turns.

For each Arrow batch numpy computes the lengths of all segments (header, text, end), their cumulative offsets and the
scatter indices, and copies headers and texts into one preallocated buffer. Rows are dealt by ranges of (conv_id, turn), so
that a conversation of a third of all rows spreads over many tasks: the output has one row for each run of a
conversation in a batch, with its byte-exact piece of the formatted text and the spans under the mask; a
conversation is its pieces in order of ``piece``.

Defined results: null text or role is empty; rows of equal turn are ordered by role, then text, and repeated rows stay; a
null conv_id is a conversation of its own and null turns come first; an empty table gives no rows; other columns are ignored.
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

from sparkvec.llm.common import table

BEGIN = "### "
END = "</turn>\n"
END_MARK = "</turn>"
LOSS_ROLE = "assistant"
#: Turns formatted into one piece, at most, and about how many bytes of them, unless one turn has more.
PIECE_TURNS = 4096
PIECE_BYTES = 1 << 28
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_END = re.compile(r"(?<!\\)(?:\\\\)*</turn>\n")
_ROLE_END = re.compile(r"(?<!\\)(?:\\\\)*: ")


def _escape(column: pa.Array, role: bool = False) -> pa.Array:
    for mark in ("\\", BEGIN, END_MARK) + ((":",) if role else ()):
        column = pc.replace_substring(column, mark, "\\" + mark)
    return column


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _scatter(out: np.ndarray, at: np.ndarray, column: pa.Array) -> None:
    """Copy each string of ``column`` to ``out`` at its offset."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    out[np.repeat(at - (offsets[:-1] - offsets[0]), lengths) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all turns, byte offset of each turn and the end, code point offset of each turn and the end, code points of headers)."""
    roles, texts = pc.fill_null(roles, ""), pc.fill_null(texts, "")
    kinds = pc.dictionary_encode(roles)
    shown = _escape(kinds.dictionary.cast(pa.string()), role=True)
    headers = pc.take(pc.binary_join_element_wise(pa.scalar(BEGIN), shown, pa.scalar(": "), pa.scalar("")), kinds.indices)
    body = _escape(texts)
    lengths = np.stack([pc.binary_length(headers).to_numpy(zero_copy_only=False), pc.binary_length(body).to_numpy(zero_copy_only=False), np.full(len(texts), len(END))], axis=1).astype(np.int64)
    ends = np.cumsum(lengths.reshape(-1)).reshape(-1, 3)
    starts = ends - lengths
    total = int(ends[-1, 2]) if len(texts) else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, dtype=np.uint8)
    _scatter(out, starts[:, 0], headers)
    _scatter(out, starts[:, 1], body)
    if len(texts):
        out[starts[:, 2, None] + np.arange(len(END))] = np.frombuffer(END.encode(), dtype=np.uint8)
    chars = np.stack([pc.utf8_length(headers).to_numpy(zero_copy_only=False), pc.utf8_length(body).to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)
    turns = np.concatenate([[0], np.cumsum(chars.sum(axis=1) + len(END))])
    return buffer, np.append(starts[:, 0], total), turns, chars[:, 0]


_SHAPE = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.list_(pa.int64())))])


def _runs(sizes: np.ndarray, most_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, number) of the turns of each piece: as many as fit, and one at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, side="right")) - at
        turns = min(PIECE_TURNS, max(1, fit))
        yield at, min(turns, len(sizes) - at)
        at += turns


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piece = 0
    for batch in batches:
        conv, roles, texts = batch.column("conv_id"), batch.column("role"), batch.column("text")
        sizes = pc.add(pc.fill_null(pc.binary_length(roles), 0), pc.fill_null(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, turns in _runs(sizes):
            c, r, t = conv.slice(at, turns), roles.slice(at, turns), texts.slice(at, turns)
            buffer, offsets, chars, header = assemble(r, t)
            ids, valid = pc.fill_null(c, 0).to_numpy(zero_copy_only=False), pc.is_valid(c).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])])
            last = np.append(first[1:], len(ids))
            cut = np.append(offsets[first], offsets[-1])
            if cut[-1] >= 2**31:
                raise ValueError("a turn has 2 GiB or more when it is formatted, which no text column holds")
            whole = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), buffer])
            own = pc.fill_null(pc.equal(r, LOSS_ROLE), False).to_numpy(zero_copy_only=False)
            loss = []
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                k = a + np.flatnonzero(own[a:b])
                loss.append(np.stack([chars[k] + header[k] - chars[a], chars[k + 1] - len(END) - chars[a]], axis=1).tolist())
            yield pa.record_batch([c.take(pa.array(first)), pa.array(piece + np.arange(len(first))), pa.array(last - first), whole, pa.array(loss, _SHAPE.field("loss").type)], schema=_SHAPE)
            piece += len(first)


def format_conversations(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """(conv_id, part, piece, n_turns, text, loss): formatted pieces, in order of (part, piece) within a conversation; loss
    holds [start, end) code points of the piece under the mask."""
    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(partitions, *order[:2]) if partitions else rows.repartitionByRange(*order[:2])
    shape = "conv_id long, piece long, n_turns long, text string, loss array<array<long>>"
    return dealt.sortWithinPartitions(*order).mapInArrow(_format, shape).withColumn("part", F.spark_partition_id())


def read_turns(text: str, n_turns: int) -> list[tuple[str, str]]:
    """Roles and texts of a formatted piece."""
    out, at = [], 0
    for _ in range(n_turns):
        if not text.startswith(BEGIN, at):
            raise ValueError("a turn must begin here")
        head = _ROLE_END.search(text, at + len(BEGIN))
        role_end, body = head.end() - 2, head.end()
        tail = _END.search(text, body)
        body_end = tail.end() - len(END)
        out.append((unescape(text[at + len(BEGIN) : role_end]), unescape(text[body:body_end])))
        at = tail.end()
    if at != len(text):
        raise ValueError("turns and text differ")
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running digests over pieces in order; holds one piece at a time."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state: list | None = None

    def closed() -> list:
        return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]

    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if state is None or state[0] != row["conv_id"]:
                if state is not None:
                    rows.append(closed())
                state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += row["n_turns"]
            for role, text in read_turns(row["text"], row["n_turns"]):
                state[2].update(f"{role}\n{text}\n".encode())
            for a, b in row["loss"]:
                text = unescape(row["text"][a:b])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(row["text"])
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    if state is not None:
        yield pa.record_batch([pa.array([v], t) for v, t in zip(closed(), types, strict=True)], names=names)


def chat_report(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from the pieces. SHA-256 takes its input in order, so a conversation's
    pieces pass through one task, one at a time."""
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return dealt.select("conv_id", "n_turns", "text", "loss").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


CHECK_TEXT = "\\### Assistant: </turn> ok"


def op7_chat(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CHECK_TEXT), (-7, 1, "assistant", CHECK_TEXT)], "conv_id long, turn long, role string, text string")
    return chat_report(format_conversations(given.unionByName(more)))


def _sql_escape(column: str, role: bool = False) -> str:
    for mark in ("\\", BEGIN, END_MARK) + ((":",) if role else ()):
        column = f"replace({column}, '{mark}', '\\{mark}')"
    return column


OP7_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CHECK_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CHECK_TEXT}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       CAST(sum({len(BEGIN)} + length({_sql_escape("role", True)}) + 2 + length({_sql_escape("text")}) + {len(END)}) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
