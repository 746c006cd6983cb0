"""Chat formatting by columnar byte assembly.

``format_conversations`` turns rows of (conversation, turn, role, text) into one
formatted byte string per conversation: segment lengths, cumulative offsets and
scatter indices are computed in numpy, and headers, contents and ends are copied into
one preallocated Arrow buffer, of which the rows are slices. A conversation over ``chunk_bytes`` becomes several chunks,
cut between turns, so that memory stays bounded however long it is.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Texts are escaped reversibly: every
``<`` + n backslashes + ``|`` gets one backslash more, so no text holds a control string.
In roles, backslash, newline and ``|`` are escaped with a backslash.

Nulls: a null role or text is empty; rows of null conversation form one conversation;
a null turn sorts first. Rows with equal turn are ordered by role, then text; repeated
rows are all kept. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm.common import arrow_map, sources, text_bytes

START, END = b"<|im_start|>", b"<|im_end|>\n"
TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
SCHEMA = "conv_id long, chunk long, n_turns long, formatted binary, loss array<struct<start:long,stop:long>>"
CHUNK_BYTES = 4 << 20


def escape_text(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(column, ""), r"<(\\*)\|", r"<\1\\|")


def unescape_text(text: bytes) -> bytes:
    return re.sub(rb"<\\(\\*)\|", rb"<\1|", text) if b"<\\" in text else text


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\|")


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], role, flags=re.S)


def assemble(roles: list[str], contents: pa.Array, trained: str) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """An Arrow buffer with the bytes of all turns after one another; for each turn its start, and start and stop of its loss span."""
    names = sorted(set(roles))
    heads = [np.frombuffer(START + escape_role(r).encode() + b"\n", np.uint8) for r in names]
    of = np.searchsorted(np.array(names, object), np.array(roles, object)) if roles else np.zeros(0, int)
    data = contents.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    body = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.empty((len(roles), 3), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2] = np.array([len(h) for h in heads], np.int64)[of], np.diff(offsets), len(END)
    to = (np.cumsum(lengths) - lengths.ravel()).reshape(-1, 3)
    buffer = pa.allocate_buffer(int(lengths.sum()))
    out = np.frombuffer(buffer, np.uint8)
    # where each byte of the contents goes, and each of the headers and ends
    out[np.arange(len(body)) + np.repeat(to[:, 1] - (offsets[:-1] - offsets[0]), lengths[:, 1])] = body
    for k, head in enumerate(heads):
        out[to[of == k, 0][:, None] + np.arange(len(head))] = head
    out[to[:, 2][:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)
    mask = np.array([r == trained for r in roles], bool)
    return buffer, to[:, 0], to[:, 1], np.where(mask, to[:, 2], to[:, 1])


def _format(trained: str, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_of: list = [None, 0]  # conversation begun before, chunks of it given out

        def emit(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
            """The turns from each cut to the next are a row. Rows are slices of the one buffer."""
            ids = table.column(0).to_pylist()
            buffer, start, a, b = assemble([r or "" for r in table.column(1).to_pylist()], escape_text(table.column(2).combine_chunks()), trained)
            edge, chunks = np.append(start, buffer.size)[cuts], []
            for i in cuts[:-1]:
                chunk_of[1] = chunk_of[1] + 1 if ids[i] == chunk_of[0] and chunk_of[1] else 1
                chunk_of[0] = ids[i]
                chunks.append(chunk_of[1] - 1)
            turns = np.diff(cuts)
            row, some = np.repeat(np.arange(len(turns)), turns), b > a
            spans = pa.StructArray.from_arrays([pa.array((x - edge[row])[some]) for x in (a, b)], ["start", "stop"])
            listed = np.concatenate([[0], np.cumsum(np.bincount(row[some], minlength=len(turns)))]).astype(np.int32)
            formatted = pa.BinaryArray.from_buffers(pa.binary(), len(turns), [None, pa.py_buffer(edge.astype(np.int32)), buffer])
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in cuts[:-1]], pa.int64()), pa.array(chunks, pa.int64()), pa.array(turns), formatted, pa.ListArray.from_arrays(pa.array(listed), spans)], ["conv_id", "chunk", "n_turns", "formatted", "loss"]
            )

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            ids = rest.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
            if rest.slice(cuts[-1]).nbytes >= chunk_bytes:
                cuts.append(len(ids))
            if len(cuts) > 1:
                yield emit(rest.slice(0, cuts[-1]), cuts)
                rest = rest.slice(cuts[-1])
        if rest is not None and len(rest):
            yield emit(rest, [0, len(rest)])

    return run


def format_conversations(df: DataFrame, trained: str = "assistant", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (conv_id, chunk, n_turns, formatted, loss), in order of chunk within each conversation's partition; loss: byte spans of the texts of role ``trained`` in ``formatted``."""
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return arrow_map(rows, _format(trained, chunk_bytes), SCHEMA)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now, has = [None], False

    def row():
        return {"conv_id": now[0], "n_turns": now[1], "turns_sha256": now[2].hexdigest(), "loss_chars": now[3], "loss_sha256": now[4].hexdigest(), "formatted_chars": now[5]}

    for batch in batches:
        done = []
        for conv, chunk, data, loss in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "chunk", "formatted", "loss"))):
            if chunk == 0:
                if has:
                    done.append(row())
                now, has = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
            for role, text in TURN.findall(data):
                now[1] += 1
                now[2].update(unescape_role(role) + b"\n" + unescape_text(text) + b"\n")
            for span in loss:
                text = unescape_text(data[span["start"] : span["stop"]])
                now[3] += len(text.decode("utf-8", "replace"))
                now[4].update(text)
            now[5] += len(data.decode("utf-8", "replace"))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if has:
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


def read_formatted(formatted: DataFrame) -> DataFrame:
    """What ``format_conversations`` wrote, parsed again: digests of turns and of the text under the loss mask. Takes the operator's own output, in its order."""
    return arrow_map(formatted, _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "<|im_end|><|im_start|>assistant ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_formatted(format_conversations(rows.unionByName(probe)))
