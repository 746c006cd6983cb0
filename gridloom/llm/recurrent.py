"""Language-model scoring by a gated recurrent network in numpy.

Counts of all training words come first (partial counts, one shuffle). The HEAD most
frequent words, with the end of text, form classes of CLASS words by frequency; every other
word, seen or not, belongs to one of TAIL classes by its letters. The network reads one word
after another and predicts the next one's class (softmax), and within a head class the word
(softmax of that class alone); within a tail class words have their share of the class's smoothed
counts over the whole corpus, with one place for unseen words. So the scores of all words sum to one.

Training: truncated backpropagation over STEPS words, with the state carried on from window to
window and set back between documents. Each partition trains on its training documents of the round
from the same start, and the results are averaged, weighted by words, in two levels on the
executors. Each round takes another 1 / rounds of the training documents, by hash of id and text, so
that all of them train the network, each once; words that don't fill a batch's columns go into the next batch.

Scoring: documents of a batch advance in step, longest first, in windows of STEPS
words with the state carried across, so whole texts are scored in bounded memory. Only the
SHORTLIST most frequent words' counts are broadcast; counts of other words are joined by word.

Nulls: a null text is empty, one end; a null doc_id counts as the empty id for the split. Repeated rows are
scored, and learned from, each. With no training documents counts are zero. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm.common import arrow_map, holdout, sources, stored, text_bytes

HIDDEN, STEPS, STREAMS = 16, 24, 256
HEAD, CLASS, TAIL = 1024, 32, 32
SHORTLIST = 100_000
#: Text that advances in step: more makes wider matrix products.
SCORED_BYTES = 12 << 20
ROUNDS, RATE = 2, 0.05
#: Different words whose partial counts a worker holds.
COUNTED = 400_000
#: Stands for the end of a text; no word contains white space.
END = b"\n"


def words_of(text: bytes) -> list[bytes]:
    out = text.lower().split()
    out.append(END)
    return out


def tail_class(word: bytes) -> int:
    """By its first letter beyond ASCII, or else by its last two bytes."""
    if not word.isascii():
        for b in word:
            if b & 0xC0 == 0x80:
                return b % 16
    return 16 + (word[-1] * 5 + word[-2:][0]) % (TAIL - 16)


# --- counts ------------------------------------------------------------------


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
        found.clear()
        return rows

    for batch in batches:
        for text in text_bytes(batch.column(0)):
            found.update(words_of(text))
            if len(found) > COUNTED:
                yield out()
    yield out()


def _tails(head: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = np.zeros(TAIL), np.zeros(TAIL, np.int64)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in head:
                    k = tail_class(word)
                    total[k] += n
                    kinds[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(TAIL), pa.int32()), pa.array(total), pa.array(kinds)], ["k", "total", "kinds"])

    return run


# --- the network -------------------------------------------------------------


def start(head_counts: np.ndarray, tail_mass: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters before training: biases give the words' shares, the rest is small and fixed by a seed."""
    rng, h = np.random.default_rng(0), HIDDEN
    classes = HEAD // CLASS
    w = np.maximum(np.pad(head_counts, (0, HEAD - len(head_counts))), 0.01).reshape(classes, CLASS)
    mass = np.concatenate([w.sum(1), np.maximum(tail_mass, 0.01)])
    f = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    return {
        "E": f(HEAD + TAIL, 3 * h), "U": f(h, 2 * h), "N": f(h, h),
        "C": f(h, classes + TAIL), "c": np.log(mass / mass.sum()).astype(np.float32),
        "W": f(classes, h, CLASS), "w": np.log(w / w.sum(1, keepdims=True)).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def forward(p: dict, ids: np.ndarray, h: np.ndarray, first: np.ndarray | None = None, gates: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
    """ids (steps, streams): states before each word, and the last state; first: where a text begins; gates: arrays to be filled with update, reset and candidate of each step."""
    e, n, (steps, streams) = p["E"][ids], HIDDEN, ids.shape
    states = np.empty((steps, streams, n), np.float32)
    begins = np.zeros(steps, bool) if first is None else first.any(1)
    for t in range(steps):
        if begins[t]:
            h = h * ~first[t][:, None]
        states[t] = h
        zr = h @ p["U"]
        zr += e[t, :, : 2 * n]
        _sigmoid(zr)
        z, r = zr[:, :n], zr[:, n:]
        new = (r * h) @ p["N"]
        new += e[t, :, 2 * n :]
        np.tanh(new, out=new)
        if gates is not None:
            gates[0][t], gates[1][t], gates[2][t] = z, r, new
        new -= h
        new *= z
        new += h
        h = new
    return states, h


def _softmax_at(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of logits x, which is overwritten: the log probability at one place, exponentials, and their sum."""
    rows = np.arange(len(x))
    picked = x[rows, at]
    top = float(x.max()) if x.size else 0.0
    if top > 60:  # states are within -1 and 1, so this is rare
        shift = x.max(1)
        x -= shift[:, None]
        picked = picked - shift
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return picked - np.log(total), x, total


def outputs(p: dict, s: np.ndarray, ids: np.ndarray, grads: dict | None = None):
    """Natural log probability of class, and of word within a head class, for states s and ids; with grads, also the gradient by s."""
    classes = HEAD // CLASS
    cls = np.where(ids < HEAD, ids // CLASS, ids - HEAD + classes).astype(np.uint16)
    order = np.argsort(cls, kind="stable")
    edge = np.searchsorted(cls[order], np.arange(classes + 1))
    head, states = order[: edge[-1]], s[order[: edge[-1]]]
    place = ids[head] % CLASS
    x = s @ p["C"]
    x += p["c"]
    out, e, total = _softmax_at(x, cls)
    ds = None
    if grads is not None:
        e[np.arange(len(ids)), cls] -= total  # gradients by logits, times the sum
        share = (1 / total)[:, None]
        grads["C"], grads["c"], ds = (s * share).T @ e, share[:, 0] @ e, e @ p["C"].T
        ds *= share
        grads["W"], grads["w"] = np.zeros_like(p["W"]), np.zeros_like(p["w"])
        back = np.empty_like(states)
    words = np.empty(len(head), out.dtype)
    for k in range(classes):
        a, b = edge[k], edge[k + 1]
        if a < b:
            x = states[a:b] @ p["W"][k]
            x += p["w"][k]
            words[a:b], e, total = _softmax_at(x, place[a:b])
            if grads is not None:
                e[np.arange(b - a), place[a:b]] -= total
                share = (1 / total)[:, None]
                grads["W"][k], grads["w"][k] = (states[a:b] * share).T @ e, share[:, 0] @ e
                back[a:b] = (e @ p["W"][k].T) * share
    out[head] += words
    if grads is not None:
        ds[head] += back
    return out, ds


def train_window(p: dict, square: dict, ids: np.ndarray, first: np.ndarray, h: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
    """One update from a window; the state goes on to the next. square: sums of squared gradients."""
    n, (steps, streams) = HIDDEN, ids.shape
    z, r, new = (np.empty((steps, streams, n), np.float32) for _ in range(3))
    states, last = forward(p, ids, h, first, (z, r, new))
    g: dict = {}
    lp, ds = outputs(p, states.reshape(-1, n), ids.ravel(), g)
    ds = ds.reshape(steps, streams, n)
    # what doesn't depend on later steps is computed for the whole window at once
    keep, reset = 1 - z, r * states
    by_z, by_r, by_new = (new - states) * z * keep, reset * (1 - r), z * (1 - new * new)
    de, dh = np.empty((steps, streams, 3 * n), np.float32), np.zeros((streams, n), np.float32)
    u, v, begins = np.ascontiguousarray(p["U"].T), np.ascontiguousarray(p["N"].T), first.any(1)
    for t in range(steps - 1, -1, -1):
        d = de[t]
        da = dh * by_new[t]
        drs = da @ v
        np.multiply(dh, by_z[t], out=d[:, :n])
        np.multiply(drs, by_r[t], out=d[:, n : 2 * n])
        d[:, 2 * n :] = da
        dh *= keep[t]
        drs *= r[t]
        dh += drs
        dh += d[:, : 2 * n] @ u
        dh += ds[t]
        if begins[t]:
            dh *= ~first[t][:, None]
    all_steps = de.reshape(-1, 3 * n)
    g["N"] = reset.reshape(-1, n).T @ all_steps[:, 2 * n :]
    g["U"] = states.reshape(-1, n).T @ all_steps[:, : 2 * n]
    flat, wide = ids.ravel(), all_steps
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    begin = np.flatnonzero(np.diff(flat[order], prepend=-1))
    seen, d = flat[order[begin]], np.add.reduceat(wide[order], begin, axis=0) / np.float32(ids.size)
    square["E"][seen] += d * d
    p["E"][seen] -= np.float32(rate) * d / (np.sqrt(square["E"][seen]) + np.float32(1e-6))
    for k, d in g.items():
        d /= np.float32(ids.size)
        square[k] += d * d
        p[k] -= np.float32(rate) * d / (np.sqrt(square[k]) + np.float32(1e-6))
    return last, float(lp.sum())


class Lexicon:
    """Counts and places of the shortlist."""

    def __init__(self, words: list[bytes], counts: list[int], tail_total: np.ndarray, tail_kinds: np.ndarray, tokens: int, kinds: int):
        head = [END] + [w for w in words if w != END][: HEAD - 1]
        self.head = {w: i for i, w in enumerate(head)}
        count = dict(zip(words, counts))
        self.head_counts = np.array([count.get(w, 0) for w in head], float)
        self.tokens, self.kinds = tokens, kinds
        self.tail_mass = tail_total + 0.1 * (tail_kinds + 1)
        listed = words if END in count else [*words, END]
        self.at = {w: i for i, w in enumerate(listed)}
        self.id = np.array([self.head[w] if w in self.head else HEAD + tail_class(w) for w in listed], np.int64)
        self.log = np.log10(np.array([count.get(w, 0) for w in listed], float) + 0.1)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Of each word, in the shortlist; -1 if it isn't there."""
        return np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, words: list[bytes], places: np.ndarray) -> np.ndarray:
        out = self.id[places]
        for i in np.flatnonzero(places < 0).tolist():
            out[i] = HEAD + tail_class(words[i])
        return out


def _stream(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words laid one after another into STREAMS columns, with the starts of documents, and what is left over."""
    rows = len(flat) // STREAMS
    n, starts = rows * STREAMS, first.copy()
    starts[: n : max(rows, 1)] = True
    return flat[:n].reshape(STREAMS, rows).T, starts[:n].reshape(STREAMS, rows).T, flat[n:], first[n:]


def _learn_stream(p: dict, square: dict, ids: np.ndarray, first: np.ndarray, rate: float) -> int:
    h = np.zeros((ids.shape[1], HIDDEN), np.float32)
    for at in range(0, len(ids), STEPS):
        h, _ = train_window(p, square, ids[at : at + STEPS], first[at : at + STEPS], h, rate)
    return ids.size


def _train(lexicon, params, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, p = lexicon.value, {k: v.copy() for k, v in params.value.items()}
        square, seen = {k: np.full_like(v, 1e-4) for k, v in p.items()}, 0
        rest, begins = np.zeros(0, np.int64), np.zeros(0, bool)
        for batch in batches:
            docs = [lex.ids(words, lex.places(words)) for words in map(words_of, text_bytes(batch.column(0)))]
            if not docs:
                continue
            start_of = np.zeros(sum(map(len, docs)), bool)
            start_of[np.cumsum([0, *map(len, docs[:-1])])] = True
            ids, first, rest, begins = _stream(np.concatenate([rest, *docs]), np.concatenate([begins, start_of]))
            seen += _learn_stream(p, square, ids, first, rate)
        seen += _learn_stream(p, square, rest[:, None], begins[:, None], rate)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(p)], pa.binary()), pa.array([float(seen)])], ["params", "seen"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = None, 0.0
    for batch in batches:
        for data, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p = pickle.loads(data)
            total = {k: (0 if total is None else total[k]) + v.astype(float) * n for k, v in p.items()}
            seen += n
    if seen:
        mean = {k: (v / seen).astype(np.float32) for k, v in total.items()}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(mean)], pa.binary()), pa.array([seen])], ["params", "seen"])


def learn(docs: DataFrame, rounds: int = ROUNDS, shortlist: int = SHORTLIST, rate: float = RATE):
    """From rows (doc_id, text): the counts table, the lexicon and the parameters."""
    spark = docs.sparkSession
    counts = stored(arrow_map(docs.select("text"), _counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(shortlist).toArrow()  # bounded
    words, n = top.column("word").to_pylist(), top.column("n").to_pylist()
    head = frozenset([END] + [w for w in words if w != END][: HEAD - 1])
    tails = arrow_map(counts, _tails(head), "k int, total double, kinds long").groupBy("k").agg(F.sum("total"), F.sum("kinds")).collect()
    total, other = np.zeros(TAIL), np.zeros(TAIL)
    for k, a, b in tails:
        total[k], other[k] = a, b
    lex = Lexicon(words, n, total, other, int(tokens), int(kinds))
    lexicon, p = spark.sparkContext.broadcast(lex), start(lex.head_counts, total)
    for r in range(rounds):
        some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r).select("text")
        each = arrow_map(some, _train(lexicon, spark.sparkContext.broadcast(p), rate / (r + 1)), "params binary, seen double")
        groups = max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
        got = arrow_map(arrow_map(each.repartition(groups), _average, "params binary, seen double").repartition(1), _average, "params binary, seen double").collect()
        if got:
            p = pickle.loads(got[0][0])
    return counts, lexicon, p


# --- scoring -----------------------------------------------------------------


#: Documents that advance in step.
ABREAST = 1024


def score_ids(p: dict, docs: list[np.ndarray]) -> np.ndarray:
    """Sum of natural log probabilities of each document's classes and head words."""
    order = np.argsort([-len(d) for d in docs], kind="stable")
    out = np.zeros(len(docs))
    for some in (order[a : a + ABREAST] for a in range(0, len(order), ABREAST)):
        length = np.array([len(docs[i]) for i in some])
        flat, begin = np.concatenate([docs[i] for i in some]), np.cumsum(length) - length
        h = np.zeros((len(some), HIDDEN), np.float32)
        for at in range(0, int(length[0]), STEPS):
            live = int(np.searchsorted(-length, -at, "left"))  # documents longer than at
            step = np.arange(at, min(at + STEPS, int(length[0])))[:, None]
            real = np.flatnonzero(step < length[:live])
            ids = flat[begin[:live] + np.minimum(step, length[:live] - 1)]
            states, h = forward(p, ids, h[:live])
            states, ids = states.reshape(-1, HIDDEN), ids.ravel()
            if len(real) < len(ids):
                states, ids = states[real], ids[real]
            lp, _ = outputs(p, states, ids)
            out[some[:live]] += np.bincount(real % live, lp, minlength=live)
    return out


def _score(lexicon, params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, p = lexicon.value, params.value
        mass = np.log10(lex.tail_mass)
        scale = float(np.log10(lex.tokens + 0.1 * (lex.kinds + 1)))
        for batch in batches:
            docs, base, known, rest, tails, more = [], [], [], [], [], []
            for text in text_bytes(batch.column(2)):
                words = words_of(text)
                places = lex.places(words)
                ids, near = lex.ids(words, places), places >= 0
                logs = np.where(near, lex.log[places], 0)  # what isn't in the shortlist is added after a join
                docs.append(ids)
                base.append(float(logs.sum()) - scale * len(words))
                known.append(int((logs[near] > -1.0).sum()))
                in_tail = ids >= HEAD
                rest.append(float(logs[in_tail].sum() - mass[ids[in_tail] - HEAD].sum()))
                times = Counter([words[i] for i in np.flatnonzero(~near).tolist()])
                tails.append([{"word": w, "times": n} for w, n in times.items()])
                more.append(len(words))
            score = score_ids(p, docs) / np.log(10) + np.array(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(more, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.array(tails, pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())])))],
                ["rid", "doc_id", "n_tokens", "n_known", "base_score", "score", "tail"],
            )

    return run


def score_texts(docs: DataFrame, learned) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row."""
    counts, lexicon, p = learned
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "rid long, doc_id long, n_tokens long, n_known long, base_score double, score double, tail array<struct<word:binary,times:int>>"
    near = stored(arrow_map(rows, _score(lexicon, docs.sparkSession.sparkContext.broadcast(p)), schema, SCORED_BYTES))
    far = near.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.times").join(counts, "word", "left")
    far = far.groupBy("rid").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("log"))
    joined = near.drop("tail").join(far, "rid", "left").fillna({"more": 0, "log": 0.0})
    return joined.select("doc_id", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), (F.col("base_score") + F.col("log")).alias("base_score"), (F.col("score") + F.col("log")).alias("score"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sources(spark, sf_dir, "documents").select("doc_id", "text")
    learned = learn(docs.where(holdout(F.col("doc_id"), 10) != 0))
    out = score_texts(docs, learned)
    return out.select("doc_id", (holdout(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(learned[1].value.tokens).cast("long").alias("train_tokens"), "base_score", "score")
