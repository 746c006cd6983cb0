"""Token ids in files of Simple-8b words.

A file holds the documents of a run of ascending doc_ids. Their ids, one after another,
are cut into blocks of ``BLOCK`` ids; each block is a sequence of 64-bit words whose top
four bits select how many ids the other 60 bits hold, and how wide each is. Ids over 30
bits are escaped: a word of their own. A table of the first word of each block lets all
blocks be coded and decoded in step, in numpy.

Layout, little-endian: magic ``GLS8``, then u32 version, u64 documents, u64 ids, u64
words of counts, u64 words of ids; i64 doc_ids; u8 null flags of doc_ids; block offsets and
words of the documents' id counts; block offsets and words of the ids.

Files are written under ``spark.checkpoint.dir``, each under a name of its own attempt, and
only those that a finished task has listed in the manifest are read.

Nulls and empty texts: a document of its end id alone; null doc_ids come first; equal
doc_ids are ordered by a hash of their text, and all repeated rows are kept. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridloom.llm.common import arrow_map, shared_dir, sources, stored, strings
from gridloom.llm.tokens import END_ID, default_path, encoder

MAGIC, VERSION, BLOCK = b"GLS8", 1, 1024
#: Ids gathered before a file is closed.
FILE_IDS = 4 << 20
#: Ids in a word and bits of each, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit lengths, at least 1, as far as the widths of words tell them apart."""
    if len(values) > len(_NARROW) and int(values.max()) < len(_NARROW):
        return _NARROW[values]
    out = np.ones(len(values), np.uint8)
    for b in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30):  # only the widths that words have matter
        out[values >= (1 << b)] = b + 1
    return out


_NARROW = np.zeros(0, np.uint8)
_NARROW = _bits(np.arange(1 << 16))


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each block (with the total at the end), and the words."""
    values = values.astype(np.uint64)
    if len(values) and int(values.max()) >> 60:
        raise ValueError("ids must be under 2**60")
    n, blocks = len(values), -(-len(values) // BLOCK)
    if not n:
        return np.zeros(1, np.uint64), np.zeros(0, np.uint64)
    padded = np.zeros((blocks, BLOCK + 60), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:n] = values
    padded[:, :BLOCK] = full.reshape(blocks, BLOCK)
    bits = _bits(padded.ravel()).reshape(padded.shape)
    bits[:, BLOCK:] = 0
    if n % BLOCK:
        bits[-1, n % BLOCK :] = 0
    widest = {1: bits}
    k = 1
    while k < 64:
        nxt = widest[k].copy()
        nxt[:, :-k] = np.maximum(widest[k][:, :-k], widest[k][:, k:])
        widest[2 * k] = nxt
        k *= 2
    select = np.full((blocks, BLOCK), len(COUNTS) - 1, np.uint8)
    for s in range(len(COUNTS) - 2, -1, -1):
        c = int(COUNTS[s])
        k = 1 << (c.bit_length() - 1)
        fits = np.maximum(widest[k][:, :BLOCK], widest[k][:, c - k : c - k + BLOCK]) <= WIDTHS[s]
        select[fits] = s
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - (blocks - 1) * BLOCK
    at, out_words, out_block = np.zeros(blocks, np.int64), [], []
    flat, chosen, row = padded.ravel(), select.ravel(), BLOCK + 60
    reach = [(np.arange(c), (np.arange(c) * w).astype(np.uint64)) for c, w in zip(COUNTS, WIDTHS)]
    active = np.arange(blocks)
    while len(active):
        p = at[active]
        s = chosen[active * BLOCK + p].astype(np.int64)
        words, first = s.astype(np.uint64) << np.uint64(60), active * row + p
        for one in np.flatnonzero(np.bincount(s, minlength=len(COUNTS))):
            rows = np.flatnonzero(s == one)
            step, shift = reach[one]
            words[rows] |= np.bitwise_or.reduce(flat[first[rows][:, None] + step] << shift, axis=1)
        out_words.append(words)
        out_block.append(active)
        at[active] += COUNTS[s]
        active = active[at[active] < lengths[active]]
    block = np.concatenate(out_block)
    order = np.argsort(block, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks))]).astype(np.uint64), np.concatenate(out_words)[order]


def decode(offsets: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    offsets = offsets.astype(np.int64)
    select = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[select]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    to = before - before[offsets[:-1]][block] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n + 60, np.uint64)
    for one in np.unique(select):
        rows = np.flatnonzero(select == one)
        c, w = int(COUNTS[one]), int(WIDTHS[one])
        got = words[rows][:, None] >> (np.arange(c) * w).astype(np.uint64) & np.uint64((1 << w) - 1)
        place = to[rows][:, None] + np.arange(c)
        keep = place < stop[rows][:, None]
        out[place[keep]] = got[keep]
    return out[:n]


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    count_at, count_words = encode(counts)
    id_at, id_words = encode(ids)
    head = MAGIC + struct.pack("<IQQQQ", VERSION, len(doc_ids), len(ids), len(count_words), len(id_words))
    return b"".join([head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), *(np.ascontiguousarray(a, "<u8").tobytes() for a in (count_at, count_words, id_at, id_words))])


def read_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each, and all ids."""
    version, docs, n, count_words, id_words = struct.unpack_from("<IQQQQ", data, 4)
    if data[:4] != MAGIC or version != VERSION:
        raise ValueError("not a file of token ids")
    at, parts = 40, []
    for kind, size in (("<i8", docs), ("u1", docs), ("<u8", 1 - (-docs // BLOCK)), ("<u8", count_words), ("<u8", 1 - (-n // BLOCK)), ("<u8", id_words)):
        parts.append(np.frombuffer(data, kind, size, at))
        at += parts[-1].nbytes
    doc_ids = [None if null else x for x, null in zip(parts[0].tolist(), parts[1].tolist())]
    return doc_ids, decode(parts[2], parts[3], docs).astype(np.int64), decode(parts[4], parts[5], n)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def _write(path: str, kind: str, folder: str, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, part, number = encoder(path, kind), np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        files, root = _file_system(folder)
        doc_ids, docs, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            ids = np.frombuffer(b"".join(docs), "<u4")
            name = f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.s8b"
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(file_bytes(doc_ids, np.array([len(x) // 4 for x in docs], np.int64), ids))
            number += 1
            return pa.RecordBatch.from_pydict({"part": [part], "number": [number - 1], "file": [name], "n_docs": [len(docs)], "n_ids": [len(ids)]})

        for batch in batches:
            more = [x + end for x in enc.encode(strings(batch.column(1)))]
            doc_ids += batch.column(0).to_pylist()
            docs += more
            held += sum(map(len, more)) // 4
            if held >= file_ids:
                yield flush()
                doc_ids, docs, held = [], [], 0
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer: str | None = None, kind: str = "byte", folder: str | None = None, file_ids: int = FILE_IDS) -> tuple[str, DataFrame]:
    """Writes all documents in ascending doc_id order; gives the folder and the manifest (part, number, file, n_docs, n_ids, start), start: ids in the files before."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    files, root = _file_system(folder)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    manifest = stored(arrow_map(rows, _write(tokenizer or default_path("byte_bpe_50k.json"), kind, folder, file_ids), "part long, number long, file string, n_docs long, n_ids long"))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file: few
    return folder, manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_stream(f"{root}/{name}") as f:
                    doc_ids, counts, ids = read_bytes(f.read())
                edge = np.concatenate([[0], np.cumsum(counts)])
                flat = ids.astype("<u4").tobytes()
                for at in range(0, len(doc_ids), 2048):
                    to = min(at + 2048, len(doc_ids))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[at:to], pa.int64()), pa.array(start + edge[at:to]), pa.array(counts[at:to]), pa.array([flat[4 * a : 4 * b] for a, b in zip(edge[at:to].tolist(), edge[at + 1 : to + 1].tolist())], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document: doc_id, start, n_tokens and ids as little-endian unsigned 32-bit bytes."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(manifest.select("file", "start").repartition(n, "file"), _read(folder), "doc_id long, start long, n_tokens long, ids binary")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_token_files(*write_token_files(sources(spark, sf_dir, "documents")))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
