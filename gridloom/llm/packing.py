"""Packing token sequences by best-fit decreasing.

Documents are tokenised where they are read and packed within that partition, so no
text moves. Overlong documents are first cut into full windows; the remaining pieces go,
longest first, to the tightest open window that a segment tree indexed by remaining
capacity finds. A window that stays under ``split_below`` full is cut into sequences of
powers of two, which need no padding.

A partition packs in blocks of at most ``block_tokens`` ids, which bounds memory.
Sequence ids are unique across the table: partition * 2**40 + number within it.

Nulls and empty texts: a document of its end id alone. A null doc_id stays null; repeated
rows are packed as separate documents. Ties in length go by order of reading, ties in
capacity to the window opened last. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm.common import arrow_map, sources, strings
from gridloom.llm.tokens import END_ID, default_path, encoder

WINDOW = 4096
BLOCK_TOKENS = 32 << 20
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class CapacityTree:
    """Open windows by remaining capacity; finds the smallest capacity that is large enough in log(size) steps, and of several windows the latest."""

    def __init__(self, size: int):
        self.leaves = 1 << (size).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.heaps: list[list[int]] = [[] for _ in range(self.leaves)]  # of negated windows

    def add(self, capacity: int, window: int) -> None:
        heappush(self.heaps[capacity], -window)
        i, count = capacity + self.leaves, self.count
        while i:
            count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window of the least capacity >= need, removed, and that capacity."""
        i, count = need + self.leaves, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return -heappop(self.heaps[capacity]), capacity


def best_fit(lengths: np.ndarray, window: int) -> list[list[int]]:
    """Windows as lists of pieces; each piece is at most one window long."""
    tree, windows = CapacityTree(window), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[piece])
        found = tree.take(n)
        if found is None:
            windows.append([piece])
            left, at = window - n, len(windows) - 1
        else:
            at, left = found[0], found[1] - n
            windows[at].append(piece)
        if left:
            tree.add(left, at)
    return windows


def pack_block(lengths: list[int], window: int, split_below: float) -> list[tuple[int, int, int, int, int]]:
    """For documents of these token counts: (document, start, length, sequence, offset) of each piece."""
    doc = np.arange(len(lengths)).repeat([-(-n // window) for n in lengths])
    first = np.concatenate([np.arange(-(-n // window)) for n in lengths]) * window
    size = np.minimum(np.array(lengths)[doc] - first, window)
    out, sequence = [], 0
    for pieces in best_fit(size, window):
        room = window - int(size[pieces].sum())
        sizes = [window] if room <= (1 - split_below) * window else [1 << b for b in range(window.bit_length(), -1, -1) if (window - room) >> b & 1]
        left, offset = sizes.pop(0), 0
        for p in pieces:
            start, n = int(first[p]), int(size[p])
            while n:
                if not left:
                    sequence, left, offset = sequence + 1, sizes.pop(0), 0
                k = min(n, left)
                out.append((int(doc[p]), start, k, sequence, offset))
                start, n, left, offset = start + k, n - k, left - k, offset + k
        sequence += 1
    return out


def _pack(path: str, window: int, split_below: float, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(path, "word"), np.array([END_ID], "<u4").tobytes()
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        base, ids, docs, held = TaskContext.get().partitionId() << 40, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            lengths = [len(x) // 4 for x in docs]
            pieces = pack_block(lengths, window, split_below)
            for at in range(0, len(pieces), 4096):
                part = pieces[at : at + 4096]
                d, start, n, sequence, offset = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in d], pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array([lengths[i] for i in d], pa.int64()), pa.array(np.array(sequence) + base), pa.array(offset, pa.int64()), pa.array([docs[i][4 * s : 4 * (s + k)] for i, s, k in zip(d, start, n)], pa.binary())], names)
            base += 1 + max(p[3] for p in pieces)

        for batch in batches:
            more = [x + end for x in enc.encode(strings(batch.column(1)))]
            ids += batch.column(0).to_pylist()
            docs += more
            held += sum(map(len, more)) // 4
            if held >= block_tokens:
                yield from flush()
                ids, docs, held = [], [], 0
        if docs:
            yield from flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, split_below: float = 0.9, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each piece, with its ids as little-endian unsigned 32-bit bytes."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return arrow_map(rows, _pack(tokenizer or default_path("word_bpe_49k.json"), window, split_below, block_tokens), SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(sources(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
