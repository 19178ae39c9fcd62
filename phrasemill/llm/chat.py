"""Chat formatting by columnar byte assembly.

A batch of turns becomes bytes without a loop over turns: segment lengths,
their running sums and scatter indices are numpy arrays, and headers, texts
and footers are copied into one preallocated buffer. Turns are dealt out by
ranges of (conversation, turn), so a conversation of any length is formatted
by as many tasks as it needs; its pieces carry their order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import list_of, parts_for, whole

#: Fixed values of the template; (opening, closing) of a turn. Assistant turns end a sequence, others are instructions.
ASSISTANT = ("<s>", "</s>")
OTHER = ("[INST]", "[/INST]")
#: Strings that have a meaning to the template; inside texts and roles they are broken up by an escape sign.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
ESCAPE = "\\"
#: Up to the first line end that no escape sign stands before: the role.
LINE_END = re.compile(r"(?s)(?:[^\\\n]|\\.)*\n")
#: Rows that are assembled together.
TOGETHER = 2000


def escaped(column: pa.Array) -> pa.Array:
    """Texts in which no control string is left; ``unescaped`` undoes it.

    The escape sign is doubled, and one is put after the first character of a control string.
    """
    column = pc.replace_substring(column, ESCAPE, ESCAPE * 2)
    for c in CONTROL:
        column = pc.replace_substring(column, c, c[0] + ESCAPE + c[1:])
    return column


def unescaped(text: str) -> str:
    parts = text.split(ESCAPE * 2)
    return ESCAPE.join(p.replace(ESCAPE, "") for p in parts)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start of each value and all bytes of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def assemble(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of string columns, end to end: one byte buffer and the start of each (row, column) in it.

    The second result has ``rows * columns + 1`` entries, row by row.
    """
    parts = [_bytes_of(c) for c in columns]
    lengths = np.stack([np.diff(o) for o, _ in parts], axis=1)
    starts = np.zeros(lengths.size + 1, dtype=np.int64)
    np.cumsum(lengths.ravel(), out=starts[1:])
    out = np.empty(int(starts[-1]), dtype=np.uint8)
    for k, (offsets, data) in enumerate(parts):
        size = lengths[:, k]
        total = int(size.sum())
        if total:
            # A column's bytes lie end to end, so a run of positions is shifted for each row.
            shift = np.repeat(starts[:-1][k::len(parts)] - (offsets[:-1] - offsets[0]), size)
            out[shift + np.arange(total)] = data[offsets[0]:offsets[0] + total]
    return out, starts


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """Pieces of formatted conversations: (conv_id, piece, n_turns, formatted binary, loss_start, loss_length).

    ``piece`` orders the pieces of a conversation. The loss spans, in bytes of
    the piece, cover the texts of assistant turns and nothing else. Null texts
    and roles count as empty; turns with equal numbers are ordered by role and
    text, null numbers come first, and null conversation ids are one
    conversation. An empty table gives no pieces; further columns are not read.
    """
    source = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                          whole(role).alias("role"), whole(text).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = source.repartitionByRange(parts_for(turns.sparkSession), "conv_id", "turn", "role").sortWithinPartitions(*order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 33
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, TOGETHER):
                batch = whole_batch.slice(at, TOGETHER)
                n = batch.num_rows
                answers = pc.equal(batch.column("role"), "assistant").to_numpy(zero_copy_only=False)
                pick = lambda pair: pa.array(np.where(answers, pair[0], pair[1]))  # noqa: E731, B023
                buffer, starts = assemble([
                    pick((ASSISTANT[0], OTHER[0])),
                    pc.replace_substring(escaped(batch.column("role")), "\n", ESCAPE + "\n"), pa.array(["\n"] * n),
                    escaped(batch.column("text")), pick((ASSISTANT[1], OTHER[1]))])
                # A piece is a run of turns of one conversation.
                ids = batch.column("conv_id")
                key, null = pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])]))
                ends = np.concatenate([first[1:], [n]])
                of = np.repeat(np.arange(len(first)), ends - first)
                begin = starts[:-1].reshape(n, 5)[:, 0][first]
                text_at, text_end = starts[:-1].reshape(n, 5)[:, 3], starts[:-1].reshape(n, 5)[:, 4]
                spans = np.bincount(of[answers], minlength=len(first))
                bounds = np.concatenate([begin, starts[-1:]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(first)), pa.array(piece + np.arange(len(first))), pa.array((ends - first).astype(np.int64)),
                    pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(buffer)]),
                    list_of(spans, (text_at - begin[of])[answers].astype(np.int32), pa.int32()),
                    list_of(spans, (text_end - text_at)[answers].astype(np.int32), pa.int32())],
                    ["conv_id", "piece", "n_turns", "formatted", "loss_start", "loss_length"])
                piece += len(first)

    return dealt.mapInArrow(run, "conv_id long, piece long, n_turns long, formatted binary, loss_start array<int>, "
                                 "loss_length array<int>")


def parse_turns(formatted: bytes) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted piece, control strings restored."""
    data, at = formatted.decode(), 0
    while at < len(data):
        opening, closing = next(p for p in (ASSISTANT, OTHER) if data.startswith(p[0], at))
        end = data.index(closing, at)
        cut = LINE_END.match(data, at + len(opening)).end()
        yield unescaped(data[at + len(opening):cut - 1]), unescaped(data[cut:end])
        at = end + len(closing)


def read_chats(pieces: DataFrame) -> DataFrame:
    """One row for each conversation, from its formatted pieces alone.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end of every
    turn), loss_chars and loss_sha256 (all text under the mask), formatted_chars.
    A hash has to see a conversation in order, so its pieces meet in one task,
    as a stream: nothing of a conversation is held but the state of two hashes.
    """
    dealt = pieces.repartition(parts_for(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "piece")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, turns_hash, loss_hash = [], None, None, None

        def close() -> None:
            if now is not None:
                done.append((now[0], now[1], turns_hash.hexdigest(), now[2], loss_hash.hexdigest(), now[3]))

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if now is None or row["conv_id"] != now[0]:
                    close()
                    now, turns_hash, loss_hash = [row["conv_id"], 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                formatted = row["formatted"]
                for role, text in parse_turns(formatted):
                    now[1] += 1
                    turns_hash.update(f"{role}\n{text}\n".encode())
                for start, length in zip(row["loss_start"], row["loss_length"], strict=True):
                    text = unescaped(formatted[start:start + length].decode())
                    now[2] += len(text)
                    loss_hash.update(text.encode())
                now[3] += len(formatted.decode())
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                 "formatted_chars long")


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '{ESCAPE}', '{ESCAPE * 2}')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0] + ESCAPE + c[1:]}')"
    return out


#: What is read back of all conversations and one more, two turns with ``trap`` as their text, in SQL.
SQL = """
WITH given AS (SELECT conv_id, turn, role, text FROM conversations
               UNION ALL SELECT {conv}, unnest([0, 1]), unnest(['user', 'assistant']), '{trap}'),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM given)
SELECT conv_id, count(*) AS n_turns,
sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
CAST(sum(length(CASE WHEN role = 'assistant' THEN '<s></s>' ELSE '[INST][/INST]' END) + 1
    + length(replace(%s, chr(10), '%s' || chr(10))) + length(%s)) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
""" % (_escaped_sql("role"), ESCAPE, _escaped_sql("text"))
