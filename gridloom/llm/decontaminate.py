"""Benchmark decontamination by winnowing.

Of the hashes of each GRAM consecutive words, the smallest in every window of
WINDOW - GRAM + 1 is kept, on both sides, as the fingerprint of WINDOW words; so any WINDOW shared words share
a fingerprint. Fingerprints of documents are joined with the benchmark's, and hits are extended: the WINDOW words
that a fingerprint stands for are joined too, by a digest of 128 bits. Items of fewer words are windows of their own
length, with a hash of all of them as fingerprint.

Before they are shuffled, fingerprints of documents are looked up in a bitmap of the benchmark's, of 2 ** BITS
bits however large the benchmark is: it lets all through that occur there, and in proportion to the benchmark's size some others,
which the join drops. Windows that stand in very many documents are spread over tasks.

Nulls: a text that is null has no words; an item of no words occurs nowhere; an item of
null item_id makes words hit, but isn't listed. Items repeated under one id count once; repeated
documents each have a row. Very long texts are whole, on both sides. Empty tables give no rows, or clean ones. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm.common import arrow_map, join_spread, sources, stored, text_bytes
from gridloom.llm.hashing import gram_hashes, sliding_min, word_hashes

WINDOW, GRAM = 10, 5
#: Size of the bitmap: 2 MB.
BITS = 24
#: Everything in ASCII but digits and lower-case letters separates words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows_of(words: np.ndarray, k: int) -> np.ndarray:
    """The fingerprint of each k consecutive words, given by their hashes."""
    grams = gram_hashes(words, min(k, GRAM if k == WINDOW else k))
    if k < WINDOW:
        return grams
    w = WINDOW - GRAM + 1
    return sliding_min(grams, w) if len(grams) >= w else grams[:0]


def _digest(words: list[bytes]) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(words))


def _benchmark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            words = words_of(text)
            if words:
                k = min(WINDOW, len(words))
                prints = windows_of(word_hashes(words), k)
                n = len(prints)
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array([_digest(words[i : i + k]) for i in range(n)], pa.binary()), pa.array([k] * n, pa.int32()), pa.array([item] * n, pa.int64())], ["print", "window", "k", "item"])


def positions(prints, bits: int):
    """Two places in a bitmap for each fingerprint: columns, or numpy arrays of unsigned ones."""
    if isinstance(prints, np.ndarray):
        return (prints >> np.uint64(64 - bits)).astype(np.int64), (prints >> np.uint64(64 - 2 * bits) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return F.shiftrightunsigned(prints, 64 - bits), F.shiftrightunsigned(prints, 64 - 2 * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """Of the fingerprints in the column ``print``: the driver gets no more than its 2 ** (bits - 6) words of 64 bits."""
    places = windows.select(F.explode(F.array(*positions(F.col("print"), bits))).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return out.view(np.uint64)


def known(prints: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which fingerprints may be in the bitmap."""
    at = np.arange(len(prints))
    for place in positions(prints, 6 + len(of).bit_length() - 1):
        at = at[(of[place[at] >> 6] >> (place[at] & 63).astype(np.uint64) & np.uint64(1)).astype(bool)]
    return at


def _documents(shared):
    """Rows (rid, text): the number of words, and the windows whose fingerprints the bitmap knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, lengths = shared.value
        for batch in batches:
            docs = [words_of(t) for t in text_bytes(batch.column(1))]
            size = np.array([len(d) for d in docs], np.int64)
            edge = np.concatenate([[0], np.cumsum(size)])
            flat = [w for d in docs for w in d]
            h = word_hashes(flat)
            starts, ks, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
            for k in lengths:
                each = windows_of(h, k)
                at = known(each, of)
                at = at[at + k <= edge[np.searchsorted(edge, at, "right")]]  # those that end in the document
                starts.append(at)
                ks.append(np.full(len(at), k, np.int32))
                prints.append(each[at])
            at, k, found = map(np.concatenate, (starts, ks, prints))
            doc = np.searchsorted(edge, at, "right") - 1
            order = np.argsort(doc, kind="stable")
            at, k, found, doc = at[order], k[order], found[order], doc[order]
            digests = pa.array([_digest(flat[s : s + n]) for s, n in zip(at.tolist(), k.tolist())], pa.binary())
            hits = pa.StructArray.from_arrays([pa.array(found.view(np.int64)), digests, pa.array(at - edge[doc]), pa.array(at - edge[doc] + k)], ["print", "window", "start", "stop"])
            offsets = pa.array(np.searchsorted(doc, np.arange(len(docs) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.ListArray.from_arrays(offsets, hits)], ["rid", "n_words", "hits"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", bits: int | None = None) -> DataFrame:
    """(rid, n_words, n_hit, items, spans) for each row; rid is the column ``key``, which may repeat or be null. spans: runs of hit words."""
    spark, bits = docs.sparkSession, bits or BITS
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text"))
    listed = arrow_map(items, _benchmark, "print long, window binary, k int, item long")
    windows = stored(listed.groupBy("print", "window").agg(F.first("k").alias("k"), F.collect_set("item").alias("items")))
    lengths = [r[0] for r in windows.select("k").distinct().collect()]  # no more than WINDOW
    shared = spark.sparkContext.broadcast((bitmap(windows, bits), sorted(lengths)))
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(key).alias("rid")).alias("rid"), F.col("text").cast("string").alias("text"))
    hit = "struct<print:long,window:binary,start:long,stop:long>"
    every = stored(arrow_map(rows, _documents(shared), f"rid {rows.schema['rid'].dataType.simpleString()}, n_words long, hits array<{hit}>"))
    hits = every.select(F.col("rid.row").alias("row"), F.explode("hits").alias("hit")).select("row", "hit.*")
    met = stored(hits.groupBy("print", "window").agg(F.count("*").alias("rows")).join(windows.drop("k"), ["print", "window"]))
    found = join_spread(hits, met, ["print", "window"], "rows")
    # the windows of a document, which are no more than its words
    found = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    runs = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    last = lambda a: F.element_at(a, -1)
    longer = lambda a, s: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["stop"], s["stop"]).alias("stop"))))
    found = found.withColumn("spans", F.aggregate("spans", runs, lambda a, s: F.when(F.size(a) == 0, F.array(s)).when(last(a)["stop"] >= s["start"], longer(a, s)).otherwise(F.concat(a, F.array(s)))))
    joined = every.select(F.col("rid.row").alias("row"), F.col("rid.rid").alias("rid"), "n_words").join(found, "row", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return joined.select("rid", "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("spans", runs).alias("spans"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(sources(spark, sf_dir, "documents"), sources(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(F.col("rid").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
