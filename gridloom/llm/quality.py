"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its runs of three byte classes (letters, capitals, digits, marks, ...),
hashed words, and buckets of its length, repeated and different words. Weighted
log(1 + tf) * idf and projected on the leading singular vectors of the labelled sample, they
give a unit vector. The sample's vectors (at most SAMPLE of each label, whatever the corpus)
are broadcast; every document's cosines with all of them are computed exactly, in blocks of a
matrix product, and its NEIGHBOURS nearest vote for their label, weighted by similarity and by
how often the label occurs among all labelled training rows.

Only the fit is bounded: it uses the labelled training rows with the smallest hashes of
doc_id, and of rows that share a doc_id one text. Terms are counted where the texts are read; their counts meet in one
task, which fits the model and sends it to the driver. labels, lang, source and doc_id are no inputs of a score.

Nulls and empty texts have terms of their own (length 0) and are scored like others. Rows of
null label are not used; of a document with several labels, all are. Repeated rows are scored
each. With no labelled rows, all scores are 0.5. An empty table gives no rows. All columns are
kept; one that has the name of the result column is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm.common import arrow_map, holdout, sources, text_bytes
from gridloom.llm.hashing import word_hashes

#: Labelled rows of each label used for the fit, at most.
SAMPLE = 2000
DIMENSIONS, NEIGHBOURS, THRESHOLD = 64, 25, 0.3
WORD_BUCKETS = 4096

_CLASS = np.full(256, 11, np.int64)  # other marks
for _k, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".", b",;:", b"!?", b"|", b"'\"()-", range(128, 256))):
    _CLASS[list(_chars)] = _k
CLASSES = 12
TRIGRAMS = CLASSES**3
BUCKETS = 48
TERMS = TRIGRAMS + WORD_BUCKETS + BUCKETS
#: Bytes whose classes are counted at once.
SLICE = 4 << 20


def term_counts(text: bytes) -> np.ndarray:
    out = np.zeros(TERMS, np.float32)
    for at in range(0, max(len(text) - 2, 0), SLICE):
        c = _CLASS[np.frombuffer(text, np.uint8, min(SLICE + 2, len(text) - at), at)]
        out[:TRIGRAMS] += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=TRIGRAMS)
    h = word_hashes(text.lower().split())
    n = len(h)
    out[TRIGRAMS : TRIGRAMS + WORD_BUCKETS] = np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=WORD_BUCKETS)
    again = int((h[1:] == h[:-1]).sum()) / n if n else 0
    distinct = len(np.unique(h)) / n if n else 0
    base = TRIGRAMS + WORD_BUCKETS
    out[[base + min(15, n.bit_length()), base + 16 + min(15, int(again * 16)), base + 32 + min(15, int(distinct * 16))]] = 1
    return out


@dataclass
class Model:
    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    neighbours: int = NEIGHBOURS

    def embed(self, counts: np.ndarray) -> np.ndarray:
        v = weigh(counts, self.idf) @ self.project
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        cosine = self.embed(counts) @ self.vectors.T
        k = min(self.neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** 8 * self.weights[near]
        return (w * self.labels[near]).sum(1) / w.sum(1)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each kind of terms as a vector of its own length."""
    x = np.log1p(counts) * idf
    for a, b, size in ((0, TRIGRAMS, 1.0), (TRIGRAMS, TRIGRAMS + WORD_BUCKETS, 0.5), (TRIGRAMS + WORD_BUCKETS, TERMS, 0.7)):
        x[:, a:b] *= size / np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-12)
    return x


def fit(counts: np.ndarray, labels: np.ndarray, shares: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Model:
    """shares: of label 0 and 1 among all labelled rows."""
    df = np.count_nonzero(counts, axis=0)
    idf = (np.log((1 + len(counts)) / (1 + df)) + 0.1).astype(np.float32)
    x = weigh(counts, idf)
    # leading right singular vectors by subspace iteration from a fixed start
    q = np.random.default_rng(0).standard_normal((TERMS, min(dimensions + 16, len(x)))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    project = (q @ vt.T)[:, :dimensions].astype(np.float32)
    have = np.array([(labels == 0).mean(), (labels == 1).mean()])
    weights = (shares / np.maximum(have, 1e-12))[labels]
    model = Model(idf, project, np.zeros((0, dimensions), np.float32), labels.astype(np.float64), weights, neighbours)
    v = x @ project
    model.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return model


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [term_counts(t) for t in text_bytes(batch.column(0))]
        at = [np.flatnonzero(x) for x in found]
        terms = pa.StructArray.from_arrays([pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([x[a] for x, a in zip(found, at)], pa.list_(pa.float32()))], ["at", "count"])
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], terms], ["doc_id", "label", "hash", "terms"])


def _fit(shares: np.ndarray):
    """Rows (label, hash, at, count) of one task, no more than 2 * SAMPLE: the model, pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is not None and len(table):
            table = table.sort_by([("hash", "ascending"), ("label", "ascending")]).combine_chunks()
            at, count = (table.column(c).combine_chunks() for c in ("at", "count"))
            counts = np.zeros((len(table), TERMS), np.float32)
            counts[np.repeat(np.arange(len(table)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = count.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(counts, table.column("label").to_numpy(), shares))], pa.binary())], ["model"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, modulus: int = 5) -> Model | None:
    """Fits on rows whose crc32(doc_id as text) mod modulus is not 0."""
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).where(holdout(F.col("doc_id"), modulus) != 0)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shares = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not shares:
        return None
    chosen = [known.where(F.col("label") == k).select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]).distinct())  # at most 2 * sample rows
    picked = rows.join(chosen, "doc_id").select("text", "doc_id", "label", F.xxhash64("text").alias("hash"))
    found = arrow_map(picked, _terms, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, hash long, terms struct<at:array<int>,count:array<float>>")
    # of rows that share an id, one text: no more than 2 * sample rows in all, which one task fits
    found = found.groupBy("doc_id", "label").agg(F.min("hash").alias("hash"), F.min_by("terms", "hash").alias("terms"))
    total = sum(shares.values())
    share = np.array([shares.get(k, 0) / total for k in (0, 1)])
    got = arrow_map(found.select("label", "hash", "terms.at", "terms.count").repartition(1), _fit(share), "model binary").collect()
    return pickle.loads(got[0][0]) if got else None


#: Documents whose terms are held as a dense block.
DOCS = 256


def _score(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.value
        for batch in batches:
            texts = text_bytes(batch.column(batch.num_columns - 1))
            scores = [np.full(len(texts), 0.5)] if model is None else [model.score(np.stack([term_counts(t) for t in texts[at : at + DOCS]])) for at in range(0, len(texts), DOCS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(np.concatenate(scores), 0, 1) if texts else [], pa.float64())], [*batch.schema.names, "__score"])

    return run


def score_quality(docs: DataFrame, model: Model | None, into: str = "score") -> DataFrame:
    """docs with the score of their texts. The model goes to the executors as a broadcast of bounded size."""
    names = [c for c in docs.columns if c.lower() not in (into.lower(), "text")]
    rows = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), F.col("text").cast("string").alias("text"))
    handle = docs.sparkSession.sparkContext.broadcast(model)
    out = arrow_map(rows, _score(handle), f"row {rows.schema['row'].dataType.simpleString()}, text string, __score double")
    columns = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c in names or c == "text"]
    return out.select(*columns, F.col("__score").alias(into))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sources(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train(docs, sources(spark, sf_dir, "labels")))
    return scored.select("doc_id", (holdout(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
