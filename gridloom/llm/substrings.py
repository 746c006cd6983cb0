"""Removal of repeated passages by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the smallest hash among its runs of
MINIMISER words, at the leftmost place; consecutive windows with the same
minimiser at the same place form a super-k-mer, and never repeat each other. Equal windows have
equal minimisers, so only super-k-mers of one bucket, the minimiser's hash, can share one.

1. Super-k-mers are listed as (minimiser, content hash, document, place).
2. They are counted by content and by bucket. Buckets with one super-k-mer hold no repeat. Where one content (with the
   minimiser, 128 bits) occurs again, each of its windows repeats.
3. What is left are contents that occur once, in buckets of several. With one of each that occurs again, they travel
   as packed strings to their bucket, where sorting their windows counts them exactly.
   Buckets of more than BUCKET strings are not gathered: their windows are counted by a digest of 128 bits, in part before they are shuffled.
4. Repeated windows become spans of words of their documents, which are removed.

Keys that many rows share are spread over tasks wherever rows are joined by them.

Nulls: a null text has no words; documents of less than WINDOW words are kept; very long ones are whole; a null
doc_id is a document of its own. Equal rows repeat each other. An empty table gives
no rows. All columns are kept; one that has the name of the result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm.common import arrow_map, join_spread, sources, stored, text_bytes
from gridloom.llm.hashing import gram_hashes, range_hashes, sliding_min, word_hashes

WINDOW, MINIMISER = 35, 4
#: Packed strings of a bucket that one task takes at most; beyond it, windows are counted one by one.
BUCKET = 4096


def super_kmers(h: np.ndarray, edges: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer of documents whose word hashes h follow one another; edges: where documents begin, and the end."""
    grams = gram_hashes(h, m)
    w = window - m + 1
    if len(grams) < w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = sliding_min(grams, w)
    n = len(least)
    at = np.arange(n)
    same = np.flatnonzero(grams[:n] == least)  # windows whose first run is the minimum
    # leftmost place of the minimum
    place = np.full(n, -1, np.int64)
    place[same] = same
    open_ = np.flatnonzero(place < 0)
    step = 1
    while len(open_) and step < w:
        hit = grams[open_ + step] == least[open_]
        place[open_[hit]] = open_[hit] + step
        open_ = open_[~hit]
        step += 1
    doc = np.searchsorted(edges, at, "right") - 1
    whole = at + window <= edges[doc + 1]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    new &= whole
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    count = np.bincount(group[whole], minlength=len(begin)) if len(begin) else np.zeros(0, np.int64)
    return least[begin], begin, count


def _list_kmers(window: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [t.split() for t in text_bytes(batch.column(2))]
            edges = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
            h = word_hashes([w for d in docs for w in d])
            least, begin, count = super_kmers(h, edges, window, m)
            doc = np.searchsorted(edges, begin, "right") - 1
            content = range_hashes(h, begin, begin + count + window - 1).view(np.int64) if len(begin) else np.zeros(0, np.int64)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(least.view(np.int64)), pa.array(content), batch.column(0).take(take), batch.column(1).take(take), pa.array((begin - edges[doc]).astype(np.int32)), pa.array(count.astype(np.int32))],
                ["bucket", "content", "id", "hash", "start", "n"],
            )

    return run


def _pack(window: int):
    """Rows (text, id, hash, wanted): the words of each super-k-mer wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, id_, hash_, wanted in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.split()
                out += [(x["bucket"], x["full"], x["times"], id_, hash_, x["start"], b" ".join(words[x["start"] : x["start"] + x["n"] + window - 1])) for x in wanted]
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["bucket", "full", "times", "id", "hash", "start", "packed"])

    return run


def windows_of(packed: bytes, window: int) -> Iterator[bytes]:
    size = np.fromiter(map(len, packed.split(b" ")), np.int64)
    stop = np.cumsum(size + 1) - 1
    return (packed[a:b] for a, b in zip((stop - size).tolist(), stop[window - 1 :].tolist()))


def _count(window: int):
    """Rows (bucket, times, id, hash, start, packed) in order of the bucket: spans (id, hash, first, stop) of repeated windows in what occurs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entries, out = None, [], []

        def close() -> None:
            entries.sort(key=lambda e: e[0])
            places: dict[tuple, list[int]] = {}
            i = 0
            while i < len(entries):
                j = i + 1
                while j < len(entries) and entries[j][0] == entries[i][0]:
                    j += 1
                if j - i > 1 or entries[i][1] > 1:
                    for _, times, id_, hash_, place in entries[i:j]:
                        if times == 1:
                            places.setdefault((id_, hash_), []).append(place)
                i = j
            for (id_, hash_), at in places.items():
                at.sort()
                cut = [k for k in range(1, len(at)) if at[k] > at[k - 1] + window]
                out.extend((id_, hash_, at[a], at[b - 1] + window) for a, b in zip([0, *cut], [*cut, len(at)]))
            entries.clear()

        def batch_of() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["id", "hash", "first", "stop"])
            out.clear()
            return rows

        for batch in batches:
            for bucket, times, id_, hash_, start, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    close()
                    now = bucket
                entries += [(text, times, id_, hash_, start + i) for i, text in enumerate(windows_of(packed, window))]
            if len(out) > 4096:
                yield batch_of()
        close()
        yield batch_of()

    return run


def _digests(window: int):
    """Rows (times, id, hash, start, packed): each window's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            windows = [[xxh3_128_digest(w) for w in windows_of(p, window)] for p in batch.column(4).to_pylist()]
            size = [len(w) for w in windows]
            times, id_, hash_, start = (np.repeat(batch.column(k).to_numpy(), size) for k in range(4))
            place = start + np.arange(sum(size)) - np.repeat(np.cumsum([0, *size])[:-1], size)
            yield pa.RecordBatch.from_arrays([pa.array([x for w in windows for x in w], pa.binary()), pa.array(times), pa.array(id_), pa.array(hash_), pa.array(place.astype(np.int32))], ["window", "times", "id", "hash", "first"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """docs (id, hash, text): (id, hash, spans) of those with words to remove."""
    kmers = stored(arrow_map(docs.select("id", "hash", "text"), _list_kmers(window, m), "bucket long, content long, id long, hash long, start int, n int"))
    buckets = stored(kmers.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1"))
    some = stored(join_spread(kmers, buckets, ["bucket"], "rows"))
    contents = some.groupBy("bucket", "content").agg(F.count("*").alias("times"))
    kinds = stored(contents.groupBy("bucket").agg(F.count("*").alias("kinds")).withColumn("rows", F.col("kinds")))
    # each content, times: how often it occurs, kinds: contents of its bucket
    each = stored(join_spread(contents, kinds, ["bucket"], "rows").withColumn("rows", F.col("times")))
    met = stored(join_spread(some, each, ["bucket", "content"], "rows"))
    whole = met.where("times > 1").select("id", "hash", F.col("start").alias("first"), (F.col("start") + F.col("n") + window - 1).alias("stop"))
    once = met.where("times = 1").select("bucket", "kinds", "times", "id", "hash", "start", "n")
    again = met.where("times > 1 and kinds > 1").groupBy("bucket", "content").agg(F.first("kinds").alias("kinds"), F.first("times").alias("times"), F.min(F.struct("id", "hash", "start", "n")).alias("at")).select("bucket", "kinds", "times", "at.*")
    # equal rows (id, hash) of a document occur again, so that each of what occurs once has one place
    wanted = once.union(again).groupBy("id", "hash").agg(F.collect_list(F.struct("bucket", (F.col("kinds") > BUCKET).alias("full"), "times", "start", "n")).alias("wanted"))
    first = docs.join(wanted, ["id", "hash"]).groupBy("id", "hash").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    packed = stored(arrow_map(first.select("text", "id", "hash", "wanted"), _pack(window), "bucket long, full boolean, times long, id long, hash long, start int, packed binary"))
    gathered = packed.where("not full").select("bucket", "times", "id", "hash", "start", "packed").repartition("bucket").sortWithinPartitions("bucket")
    partly = arrow_map(gathered, _count(window), "id long, hash long, first int, stop int")
    digests = stored(arrow_map(packed.where("full").select("times", "id", "hash", "start", "packed"), _digests(window), "window binary, times long, id long, hash long, first int"))
    counted = stored(digests.groupBy("window").agg(F.sum("times").alias("times"), F.count("*").alias("rows")).where("times > 1").drop("times"))
    dealt = join_spread(digests.where("times = 1").drop("times"), counted, ["window"], "rows").select("id", "hash", "first", (F.col("first") + window).alias("stop"))
    return whole.union(partly).union(dealt).groupBy("id", "hash").agg(F.sort_array(F.collect_set(F.struct("first", "stop"))).alias("spans"))


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, spans in zip(text_bytes(batch.column(batch.num_columns - 2)), batch.column(batch.num_columns - 1).to_pylist()):
                words = text.split()
                n = len(words)
                if spans:
                    left, at = [], 0
                    for s in spans:
                        left += words[at : s["first"]] if s["first"] > at else []
                        at = max(at, s["stop"])
                    words = left + words[at:]
                counts.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words))
            into = pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept"])
            passed = batch.columns[:-1] if with_text else batch.columns[:-2]
            yield pa.RecordBatch.from_arrays([*passed, into], ["row", "text", "__into"] if with_text else ["row", "__into"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER, into: str = "repeats", with_text: bool = True) -> DataFrame:
    """docs with a column ``into``: struct(n_words, n_removed, kept), kept: the words left, joined by one space; the text itself goes along unless with_text is false."""
    names = [c for c in docs.columns if c.lower() not in (into.lower(), "text")]
    keyed = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), F.col("text").cast("string").alias("text")).select(
        "row", "text", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("hash")
    )
    spans = repeated_spans(keyed, window, m)
    joined = keyed.join(spans, ["id", "hash"], "left").select("row", "text", "spans")
    row = joined.schema["row"].dataType.simpleString()
    out = arrow_map(joined, _remove(with_text), f"row {row}, {'text string, ' if with_text else ''}__into struct<n_words:long,n_removed:long,kept:string>")
    columns = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c in names or c == "text" and with_text]
    return out.select(*columns, F.col("__into").alias(into))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(sources(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2(F.col("repeats.kept").cast("binary"), 256).alias("kept_sha256"))
