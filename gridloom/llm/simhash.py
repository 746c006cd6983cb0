"""SimHash near-duplicates by Golay-code fuzzy hashing.

``fingerprints``: 64-bit SimHash of word shingles (XXH64, seed 42; a bit is set if set in
over half of the hashes). ``links`` joins fingerprints at up to two differing bits:
the bits fall into segments of 23, 23 and 18. By pigeonhole, for some pair of segments
(X, Y) of (0, 1), (1, 2), (2, 0), X is equal and Y differs in at most one bit, so a key is X with the
index of a nearby codeword of the perfect (23, 12) Golay code: each Y is decoded together
with all its one-bit neighbours, giving one to six codewords, and segments within one
bit share one. Buckets are verified exactly. In a bucket of more than ``BUCKET``
fingerprints no pairs are made: its members are linked exactly through midpoints, since
two fingerprints within two bits have a common neighbour within one bit of both, and at most 65
fingerprints surround a midpoint.

``near_duplicates`` finds the texts that are similar by the Jaccard similarity of their sets of
shingles, directly or through others. Its fingerprints are wider, SEGMENTS segments of 23 bits. Each segment
is decoded to the two codewords nearest to it, a bit counting by the margin of its votes, as bits of small margins are
the ones in error. The errors of a pair at the threshold fall unevenly, so that for some of the TRIPLES of segments
both share a codeword in all three: a key is a triple with three codeword indices, eight for each triple.
Buckets of a key give candidates; the groups that they join are compared on the whole sets of shingles.
Of single pairs (two copies without others between them) RECALL are found; the tests measure it.

Nulls and texts without words have fingerprint zero and are linked like any others in
``link_fingerprints``; ``near_duplicates`` groups them with equal texts only. Null doc_ids are
never a component's id unless it has no other. Repeated rows count once each. Very long texts are whole: their
shingles are counted in slices. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm.common import arrow_map, sources, stored, text_bytes
from gridloom.llm.components import components
from gridloom.llm.hashing import gram_hashes, mix, word_hashes

#: Members up to which a bucket's pairs are compared directly.
BUCKET = 64
SEED = 42
#: Generator polynomial of the binary Golay code.
GOLAY = 0b110001110101

_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each k words joined by a space, A-Z in lower case; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    start = (stop - size)[: len(words) - k + 1].tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start, stop[k - 1 :].tolist())], np.uint64)


def votes(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    each = hashes.view(np.uint8).astype(np.int64) + np.tile(np.arange(8) * 256, len(hashes))
    counts = (np.bincount(each, minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([votes(shingle_hashes(t, k)) for t in text_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _fingerprints(shingle), "doc_id long, fp long")


def _remainder(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.int64).copy()
    for b in range(22, 10, -1):
        x = np.where(x >> b & 1, x ^ GOLAY << (b - 11), x)
    return x


class _Code:
    """Remainders of single bits, and for each remainder the error of at most three bits that has it."""

    def __init__(self):
        self.bit = _remainder(1 << np.arange(23))
        self.error = np.zeros(2048, np.int64)
        for n in (1, 2, 3):
            for bits in itertools.combinations(range(23), n):
                self.error[np.bitwise_xor.reduce(self.bit[list(bits)])] = sum(1 << b for b in bits)
        self.byte = [_remainder(np.arange(256) << s) if s < 16 else _remainder(np.arange(128) << 16) for s in (0, 8, 16)]
        words = np.arange(1 << 12) << 11
        self.signs = (2 * ((words | _remainder(words)) >> np.arange(23)[:, None] & 1) - 1).astype(np.float32)

    def index(self, v: np.ndarray) -> np.ndarray:
        """The 12-bit index of the codeword nearest to each 23-bit word."""
        rest = self.byte[0][v & 255] ^ self.byte[1][v >> 8 & 255] ^ self.byte[2][v >> 16]
        return (v ^ self.error[rest]) >> 11

    def nearest(self, margins: np.ndarray) -> np.ndarray:
        """The indices of the two codewords that agree best with rows of 23 votes, each bit weighed by its margin."""
        out = np.empty((len(margins), 2), np.uint16)
        for at in range(0, len(margins), 512):
            agree = margins[at : at + 512].astype(np.float32) @ self.signs
            out[at : at + 512, 0] = best = agree.argmax(1)
            agree[np.arange(len(agree)), best] = -np.inf
            out[at : at + 512, 1] = agree.argmax(1)
        return out


_CODE: list[_Code] = []


def code() -> _Code:
    if not _CODE:
        _CODE.append(_Code())
    return _CODE[0]


SPANS = ((0, 23), (23, 23), (46, 18))


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the prints and their keys, without repeats."""
    p = prints.view(np.uint64)
    part = [(p >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SPANS]
    rows, keys = [], []
    for kind, (x, y) in enumerate(((0, 1), (1, 2), (2, 0))):
        flips = np.concatenate([[0], 1 << np.arange(SPANS[y][1])])
        near = np.sort(code().index(part[y][:, None] ^ flips), axis=1)
        new = np.concatenate([np.ones((len(p), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        r, c = np.nonzero(new)
        rows.append(r)
        keys.append(kind << 60 | part[x][r] << 12 | near[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy()
        rows, keys = fuzzy_keys(np.ascontiguousarray(fp))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])


def _verified(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for members in batch.column(0).to_pylist():
                m = np.array(members, np.int64)
                a, b = np.nonzero(np.triu(np.bitwise_count((m[:, None] ^ m).view(np.uint64)) <= bits, 1))
                u.append(m[a])
                v.append(m[b])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return run


def links(prints: DataFrame) -> DataFrame:
    """Links (u, v) that connect all of the distinct fingerprints fp that are within two bits, directly or through others within two bits."""
    keyed = arrow_map(prints.select("fp"), _keyed, "key long, fp long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(keyed.join(sizes, "key"))
    direct = arrow_map(met.where(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list("fp").alias("members")).select("members"), _verified(2), "u long, v long")
    around = met.where(F.col("n") > BUCKET).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << b)).cast("long") for b in range(64)))
    mids = around.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("mid")).groupBy("mid").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    through = mids.select(F.array_min("members").alias("u"), F.explode("members").alias("v")).where("u <> v")
    return direct.union(through).distinct()


def link_fingerprints(rows: DataFrame) -> DataFrame:
    """(doc_id, fp) with component_id, the smallest doc_id that links reach."""
    each = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(each)).withColumnRenamed("node", "fp")
    of = each.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of.join(least, "root").select("fp", "component_id"), "fp")


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(fingerprints(sources(spark, sf_dir, "documents")))
    return link_fingerprints(rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- similar texts -----------------------------------------------------------


#: Words of 64 bits of a wide fingerprint, and its segments.
WORDS, SEGMENTS = 12, 33
#: Segments that make keys together; each stands in two triples.
TRIPLES = [(3 * i, 3 * i + 1, 3 * i + 2) for i in range(11)] + [(i, i + 11, i + 22) for i in range(11)]
#: Differing bits of 40 beyond which two of a small bucket are no candidates (five standard deviations at 0.8), if both have STEADY shingles.
LOOSE, STEADY = 18, 16
#: Numbers of shingles from here on are not told apart by their size.
MOST = (1 << 23) - 1
#: Text of a group that is compared at once; more goes in blocks, each with each.
BLOCK_BYTES = 12 << 20
#: Shingles whose votes are counted at once.
SLICE = 1 << 14

_SALTS = mix(np.arange(1, WORDS + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACES = np.arange(8 * WORDS) * 256
_BIT_OF = _BITS.astype(np.float64)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The different hashes of each text's k consecutive words, A-Z in lower case; of all its words if there are fewer."""
    docs = [t.lower().split() for t in texts]
    h = word_hashes([w for d in docs for w in d])
    grams, at, out = gram_hashes(h, k), 0, []
    for d in docs:
        n = len(d)
        out.append(np.unique(grams[at : at + n - k + 1]) if n >= k else gram_hashes(h[at : at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def margins(hashes: np.ndarray) -> np.ndarray:
    """Votes for less votes against each bit of the wide fingerprint."""
    counts = np.zeros(len(_PLACES) * 256)
    for at in range(0, len(hashes), SLICE):
        part = mix(hashes[at : at + SLICE, None] ^ _SALTS)
        counts += np.bincount((part.view(np.uint8).reshape(len(part), -1) + _PLACES).ravel(), minlength=len(counts))
    return 2 * (counts.reshape(-1, 256) @ _BIT_OF).ravel() - len(hashes)


def _described(k: int):
    """Rows (rid, same, text): number of shingles; 40 bits of fingerprint and that number; codewords of the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(2))
            sets = shingle_sets(texts, k)
            votes_of = np.array([margins(s) for s in sets]).reshape(len(sets), -1)
            codes = code().nearest(votes_of[:, : 23 * SEGMENTS].reshape(-1, 23)).reshape(len(sets), -1)
            size = np.array([len(s) for s in sets], np.int64)
            bits = np.packbits(votes_of[:, -40:] > 0, axis=1).astype(np.int64) @ (1 << np.arange(0, 40, 8))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size), pa.array(list(map(len, texts)), pa.int64()), pa.array((bits << 23) + np.minimum(size, (1 << 23) - 1)), pa.array([c.tobytes() for c in codes], pa.binary())],
                ["rid", "same", "n", "size", "fact", "codes"],
            )

    return run


def triple_keys(codes: np.ndarray) -> np.ndarray:
    """Keys (rows, 8 * TRIPLES) of codeword indices (rows, SEGMENTS, 2)."""
    c = codes.astype(np.int64)
    each = [k << 36 | c[:, x, :, None, None] << 24 | c[:, y, None, :, None] << 12 | c[:, z, None, None, :] for k, (x, y, z) in enumerate(TRIPLES)]
    return np.concatenate([e.reshape(len(c), 8) for e in each], axis=1)


def _triple_keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid, fact = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, SEGMENTS, 2)
        for at in range(0, len(rid), 1024):
            keys = triple_keys(codes[at : at + 1024])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(x[at : at + 1024], keys.shape[1])) for x in (rid, fact))], ["key", "rid", "fact"])


def forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Links (least, node) that join what the links u, v join: one fewer than each component has nodes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]
    child = label != np.arange(len(nodes))
    return np.stack([nodes[label[child]], nodes[child]], axis=1)


#: Links that a task holds before it joins them.
HELD = 1 << 20


def _candidates(threshold: float):
    """Rows (key, rid, fact) in order of the key: links that join what may be similar. A bucket of more than BUCKET is linked whole, through its first member."""

    def met(m: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        first, large = np.repeat(start, size), np.repeat(size > BUCKET, size)
        u, v = [m[first[large], 1]], [m[large, 1]]
        rest = m[~large & np.repeat(size > 1, size)]
        for d in range(1, BUCKET):
            a, b = rest[:-d], rest[d:]
            at = np.flatnonzero(a[:, 0] == b[:, 0])
            if not len(at):
                break
            a, b = a[at], b[at]
            less, more = np.minimum(a[:, 2] & MOST, b[:, 2] & MOST), np.maximum(a[:, 2] & MOST, b[:, 2] & MOST)
            near = ((less >= threshold * more - 1e-9) | (more == MOST)) & ((less < STEADY) | (np.bitwise_count((a[:, 2] ^ b[:, 2]).view(np.uint64) >> np.uint64(23)) <= LOOSE))
            u.append(a[near, 1])
            v.append(b[near, 1])
        return forest(np.concatenate(u), np.concatenate(v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, held, n = np.zeros((0, 3), np.int64), [np.zeros((0, 2), np.int64)], 0
        for batch in itertools.chain(batches, [None]):
            m = tail if batch is None else np.concatenate([tail, np.stack([c.to_numpy() for c in batch.columns[:3]], axis=1)])
            if len(m):
                start = np.flatnonzero(np.concatenate([[True], m[1:, 0] != m[:-1, 0]]))
                size = np.diff(np.append(start, len(m)))
                if batch is not None:  # the last bucket may go on; of a large one no more is kept than tells that it is
                    tail = m[start[-1] :][: BUCKET + 1].copy()
                    if size[-1] <= BUCKET:
                        m, start, size = m[: start[-1]], start[:-1], size[:-1]
                held.append(met(m, start, size))
                n += len(held[-1])
            if n > HELD or batch is None:
                pairs = np.concatenate(held)
                pairs, held, n = forest(pairs[:, 0], pairs[:, 1]), held[:1], 0
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

    return run


def similar_links(rids: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[list[int], list[int]]:
    """Links that join all of the sets at the threshold or above, directly or through others: from each one reached, all that are not are counted by their shingles in common."""
    n, size = len(sets), np.array([len(s) for s in sets])
    kinds, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner, at = np.repeat(np.arange(n), size), np.concatenate([[0], np.cumsum(size)])
    left, listed, u, v = np.ones(n, bool), n + 1, [], []
    remain = n
    for root in range(n):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        remain -= 1
        while queue and remain:
            if remain <= listed // 2 or listed > n:  # list those that remain, by shingle
                keep = left[owner]
                order = np.argsort(ids[keep], kind="stable")
                having, edge = owner[keep][order], np.concatenate([[0], np.cumsum(np.bincount(ids[keep], minlength=len(kinds)))])
                listed = remain
            a = queue.pop()
            mine = ids[at[a] : at[a + 1]]
            begin, end = edge[mine], edge[mine + 1]
            some = np.flatnonzero(end > begin)
            if not len(some):
                continue
            common = np.bincount(np.concatenate([having[x:y] for x, y in zip(begin[some].tolist(), end[some].tolist())]), minlength=n)
            near = np.flatnonzero(left & (common * (1 + threshold) >= threshold * (size[a] + size) - 1e-9))
            left[near] = False
            remain -= len(near)
            queue += near.tolist()
            u += [int(rids[root])] * len(near)
            v += rids[near].tolist()
    return u, v


def _compared(shingle: int, threshold: float):
    """Rows (root, i, j, rid, text) in order: links within each (root, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rids, sets = None, [], []
        for batch in itertools.chain(batches, [None]):
            rows = [(None, 0, None)]
            if batch is not None:
                keys = zip(*(c.to_pylist() for c in batch.columns[:3]))
                rows = zip(keys, batch.column(3).to_pylist(), text_bytes(batch.column(4)))
            u, v = [], []
            for k, rid, text in rows:
                if k != key:
                    if len(sets) > 1:
                        more = similar_links(np.array(rids), sets, threshold)
                        u += more[0]
                        v += more[1]
                    key, rids, sets = k, [], []
                rids.append(rid)
                sets += shingle_sets([text or b""], shingle)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def similar_pairs(rows: DataFrame, described: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links (u, v) that join rows (rid, text) whose sets of shingles are at threshold or above, directly or through others.

    Buckets of up to BUCKET rows are candidates pair by pair, larger ones as a whole. Each group that candidates join
    is compared in full, its sets together; groups of more than BLOCK_BYTES in blocks, each with each."""
    keyed = arrow_map(described.select("rid", "fact", "codes"), _triple_keyed, "key long, rid long, fact long")
    met = arrow_map(keyed.repartition("key").sortWithinPartitions("key"), _candidates(threshold), "u long, v long")
    groups = stored(components(met).select(F.col("node").alias("rid"), "root"))
    blocks = stored(described.select("rid", "size").join(groups, "rid").groupBy("root").agg(F.ceil(F.sum("size") / F.lit(BLOCK_BYTES)).alias("blocks")))
    tagged = stored(groups.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks"))))
    own = rows.join(tagged, "rid")
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: (F.col("blocks") == 1) | (k != F.col("own")))
    each = own.select("root", F.explode(F.transform(others, lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))).alias("pair"), "rid", "text")
    each = each.select("root", "pair.i", "pair.j", "rid", "text").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "rid")
    return arrow_map(each, _compared(shingle, threshold), "u long, v long")


def near_duplicates(rows: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """For rows (rid, text), those that are not the first of their group of similar texts: (rid, root). Equal texts are grouped by 128 bits of hash; the first of each goes on."""
    same = F.unhex(F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    described = stored(arrow_map(rows.select("rid", same.alias("same"), "text"), _described(shingle), "rid long, same binary, n long, size long, fact long, codes binary"))
    first = stored(described.groupBy("same").agg(F.min("rid").alias("root"), F.count("*").alias("times")).where("times > 1"))
    joined = described.join(first.drop("times"), "same", "left")
    copies = joined.where("rid <> root").select("rid", "root")
    near = stored(components(similar_pairs(rows, joined.where("n > 0 and (root is null or rid = root)"), shingle, threshold)).where("node <> root").select(F.col("node").alias("rid"), "root"))
    moved = copies.join(near.select(F.col("rid").alias("root"), F.col("root").alias("top")), "root", "left").select("rid", F.coalesce("top", "root").alias("root"))
    return moved.union(near)
