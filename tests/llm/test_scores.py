import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import licenses, quality, recurrent, sketches

SF = "/root/testdata/sf0.001"


# --- language model


def test_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(float) for k, v in recurrent.start(rng.random(recurrent.HEAD) * 50, rng.random(recurrent.TAIL) * 50).items()}
    ids, first, h = rng.integers(0, recurrent.HEAD + recurrent.TAIL, (6, 5)), np.zeros((6, 5), bool), np.zeros((5, recurrent.HIDDEN))
    first[0], first[3, 2] = True, True

    def loss(p):
        states, _ = recurrent.forward(p, ids, h, first)
        return -recurrent.outputs(p, states.reshape(-1, recurrent.HIDDEN).astype(float), ids.ravel())[0].sum() / ids.size

    square = {k: np.zeros_like(v) for k, v in p.items()}
    recurrent.train_window({k: v.copy() for k, v in p.items()}, square, ids, first, h, 0.0)
    for k in p:
        at = np.unravel_index(np.argmax(square[k]), p[k].shape)
        up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        assert abs(loss(up) - loss(down)) / 2e-3 == pytest.approx(math.sqrt(square[k][at]), rel=0.02, abs=1e-6)


def test_batched_scores_equal_single_ones():
    rng = np.random.default_rng(2)
    p = recurrent.start(rng.random(recurrent.HEAD) * 50, rng.random(recurrent.TAIL) * 50)
    docs = [rng.integers(0, recurrent.HEAD + recurrent.TAIL, n) for n in (1, 70, 24, 25, 3, 200)]
    assert np.allclose(recurrent.score_ids(p, docs), [recurrent.score_ids(p, [d])[0] for d in docs], rtol=1e-4)


def test_lm_query(spark):
    rows = recurrent.op3_lm_scoring(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    counts = Counter(w for d, t in docs.items() if not out(d) for w in recurrent.words_of((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(docs)
    for r in rows:
        words = recurrent.words_of((docs[r["doc_id"]] or "").encode())
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(r["doc_id"]), len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(spark):
    text = "a b c d e f g a b c a b a " * 40
    docs = spark.createDataFrame([(k, text) for k in range(30)] + [(None, None), (31, "")], "doc_id long, text string")
    counts, lexicon, p = recurrent.learn(docs)
    words = [r["word"] for r in counts.collect()]
    lex = lexicon.value
    assert all(bytes(w) in lex.head for w in words)  # so the head classes hold all words, and the tail only unseen ones
    states = np.zeros((1, recurrent.HIDDEN), np.float32)
    head = [math.exp(recurrent.outputs(p, states, np.array([i]))[0][0]) for i in range(recurrent.HEAD)]
    tail = [math.exp(recurrent.outputs(p, states, np.array([recurrent.HEAD + k]))[0][0]) for k in range(recurrent.TAIL)]
    assert sum(head) + sum(tail) == pytest.approx(1, abs=1e-4)
    scored = {r["doc_id"]: r for r in recurrent.score_texts(docs, (counts, lexicon, p)).collect()}
    assert scored[None]["n_tokens"] == scored[31]["n_tokens"] == 1


def test_lm_without_training_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    learned = recurrent.learn(none)
    r = recurrent.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), learned).first()
    assert (r["n_tokens"], r["n_known"], r["base_score"]) == (3, 0, 0.0)
    assert recurrent.score_texts(none, learned).collect() == []


def test_all_training_words_reach_the_network(spark, monkeypatch):
    seen, mapped = [], recurrent.arrow_map

    def counted(df, fn, *args):
        out = mapped(df, fn, *args)
        if fn.__qualname__.startswith("_train"):
            seen.append(out.agg({"seen": "sum"}).first()[0])
        return out

    monkeypatch.setattr(recurrent, "arrow_map", counted)
    docs = spark.createDataFrame([(k % 5 if k % 3 else None, f"w{k} x y " * (k % 11)) for k in range(90)], "doc_id long, text string")
    _, lexicon, _ = recurrent.learn(docs)
    assert len(seen) == recurrent.ROUNDS and sum(seen) == lexicon.value.tokens > 0


def slow_score(text, counts, lex, p):
    """Word by word in plain double precision: class, then word of a head class, or share of a tail class."""
    q, n = {k: v.astype(float) for k, v in p.items()}, recurrent.HIDDEN
    h, total = np.zeros(n), 0.0
    soft = lambda x: x - math.log(sum(math.exp(y) for y in x))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for w in (text or "").lower().encode().split() + [recurrent.END]:
        i = lex.head[w] if w in lex.head else recurrent.HEAD + recurrent.tail_class(w)
        classes = soft(h @ q["C"] + q["c"])
        if i < recurrent.HEAD:
            k = i // recurrent.CLASS
            total += classes[k] + soft(h @ q["W"][k] + q["w"][k])[i % recurrent.CLASS]
        else:
            t = i - recurrent.HEAD
            total += classes[recurrent.HEAD // recurrent.CLASS + t] + math.log((counts[w] + 0.1) / lex.tail_mass[t])
        e = q["E"][i]
        z, r = sigmoid(e[:n] + h @ q["U"][:, :n]), sigmoid(e[n : 2 * n] + h @ q["U"][:, n:])
        h = (1 - z) * h + z * np.tanh(e[2 * n :] + (r * h) @ q["N"])
    return total / math.log(10)


def test_scores_by_brute_force(spark):
    """Long, empty, null and repeated texts, clashing columns, words of head, tail and shortlist, and unseen ones."""
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.2)) % 4000}" for _ in range(6000)]
    texts = [" ".join(words[a : a + rng.randint(1, 90)]) for a in range(0, 5900, 60)]
    texts += [None, "", texts[0], "W1 unseen \u00e9t\u00e9 w2", " ".join(words[:3000]), " ".join(words[:3000])]
    docs = spark.createDataFrame([(k if k % 7 else None, t, "x", 1.0, 2) for k, t in enumerate(texts)], "doc_id long, text string, word string, score double, rid int")
    counts, lexicon, p = recurrent.learn(docs.limit(99), shortlist=1200)
    seen = Counter({bytes(r["word"]): r["n"] for r in counts.collect()})
    assert len(seen) > 1200 > recurrent.HEAD
    rows = recurrent.score_texts(docs, (counts, lexicon, p)).collect()
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in rows)
    want = sorted((k if k % 7 and k else -1, len((t or "").split()) + 1, slow_score(t, seen, lexicon.value, p)) for k, t in enumerate(texts))
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-4)


# --- quality


def test_votes_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = quality.score_quality(docs, model).select("text", "score").collect()
    for r in got[:60]:
        v = model.embed(quality.term_counts((r["text"] or "").encode())[None])[0]
        cosine = [float(sum(x * y for x, y in zip(v, w))) for w in model.vectors]
        near = sorted(range(len(cosine)), key=lambda k: -cosine[k])[: quality.NEIGHBOURS]
        power = [max(cosine[k], 1e-6) ** 8 * model.weights[k] for k in near]
        assert r["score"] == pytest.approx(sum(w * model.labels[k] for w, k in zip(power, near)) / sum(power), abs=1e-3)


def test_ties_of_neighbours():
    """Equal texts of both labels in equal number: any choice among the tied is a score within 0 and 1, and equal texts have equal ones."""
    counts = np.stack([quality.term_counts(b"one two three")] * 60)
    model = quality.fit(counts.copy(), np.arange(60) % 2, np.array([0.5, 0.5]))
    scores = model.score(counts[:3])
    assert np.all((scores >= 0) & (scores <= 1)) and np.allclose(scores, scores[0])


def test_quality_held_out(spark):
    rows = {r["doc_id"]: r for r in quality.op6_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = [(r["quality"], rows[r["doc_id"]]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    held = [(y, r) for y, r in labels if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in rows.items())
    assert sum(r["predicted"] == y for y, r in held) >= 0.9 * len(held)


def test_quality_of_odd_rows(spark):
    schema = "doc_id long, text string, score int, row string"
    docs = spark.createDataFrame([(k, "good text here. " * (k % 7 + 1) if k % 2 else "BAD!! " * (k % 5 + 1), 1, "r") for k in range(60)] + [(None, None, 1, None), (None, "", None, "r"), (3, "x" * 100_000, 0, "")], schema)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, text int")
    out = quality.score_quality(docs, quality.train(docs, labels))
    assert out.columns == ["doc_id", "text", "row", "score"] and out.count() == 63
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert np.mean([got[k] for k in range(1, 60, 2)]) > 0.8 > 0.2 > np.mean([got[k] for k in range(0, 60, 2)])
    assert quality.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.score_quality(docs, None).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), None).collect() == []


# --- fingerprints


def test_fingerprints(spark):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    rows = {r["doc_id"]: r for r in sketches.op8_fingerprints(spark, SF).collect()}
    assert len(rows) == len(docs)
    prints = {}
    for k, (d, t) in enumerate(docs):
        n, after = len(t), docs[(k + 1) % len(docs)][1]
        edited = t[: n - n // 3] + after[: n // 3]
        assert (rows[d]["n_chars"], rows[d]["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        prints.setdefault(t, set()).add(rows[d]["fingerprint"])
        prints.setdefault(edited, set()).add(rows[d]["edited_fingerprint"])
        assert 0 <= rows[d]["near_edited"] <= 1 and 0 <= rows[d]["near_next"] <= 1
    assert all(len(x) == 1 for x in prints.values())
    mean = lambda c: sum(r[c] for r in rows.values()) / len(rows)
    assert mean("near_edited") > 0.6 and mean("near_next") < 0.1


def test_next_with_nulls_and_repeats(spark):
    rows = [(3, "c c"), (3, "c c"), (2, None), (None, "last text"), (5, "first words"), (2, "two")]
    got = sketches.with_next(spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, id int, sketch string")).collect()
    assert len(got) == 6
    after = {(r["id"], r["text"]): r["start"] for r in got}
    assert after[5, "first words"] == "c c"[:3] and after[sketches.LEAST, "last text"] == "fir"
    assert len({(r["text"], str(r["sketch"])) for r in got}) == 5
    one = sketches.with_next(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["start"] == "ab"
    assert sketches.with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def sketch_of(text):
    w, hashes = text.lower().split(), set()
    if not w:
        return True, []
    for i in range(max(1, len(w) - 4)):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        hashes.add(h - (1 << 64) if h >> 63 else h)
    exact = max(1, len(w) - 4) <= sketches.SMALL
    return exact, sorted(h for h in hashes if exact or h < sketches.LEAST + (1 << 61))


def likeness_of(a, b):
    if a == b:
        return 1.0
    x, y = ({h for h in s[1] if a[0] and b[0] or h < sketches.LEAST + (1 << 61)} for s in (a, b))
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def test_sketches_and_likeness_by_brute_force(spark):
    rng = random.Random(9)
    word = lambda: f"W{rng.randrange(10**6)}"
    short = [" ".join(word() for _ in range(n)) for n in (6, 6, 20, 60, 64, 69)]
    texts = [*short, *(f"{t} {' '.join(word() for _ in range(200))}" for t in short), "", None, "one", "a b " * 9000, " \t\n"]
    df = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "i int, j int, a string, b string")
    df = df.select("i", "j", *(sketches.sketch(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in "ab"))
    of = [sketch_of(t or "") for t in texts]
    for r in df.select("i", "j", "a", sketches.likeness(F.col("a"), F.col("b")).alias("like"), sketches.merge(F.col("a"), F.col("b")).alias("both"), sketches.containment(F.col("a"), F.col("b")).alias("part")).collect():
        a, b = of[r["i"]], of[r["j"]]
        assert (r["a"]["exact"], r["a"]["hashes"]) == a and r["like"] == pytest.approx(likeness_of(a, b))
        union = sorted(set(a[1]) | set(b[1]))
        exact = a[0] and b[0] and len(union) <= sketches.SMALL
        assert (r["both"]["exact"], r["both"]["hashes"]) == (exact, [h for h in union if exact or h < sketches.LEAST + (1 << 61)])
        if r["i"] < len(short) and r["j"] == r["i"] + len(short):
            assert r["part"] in (1.0, None)  # a text lies whole in the longer one


# --- licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_rows(docs):
    out = {}
    for d, t in docs:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w, places, extra = WORD.findall(t), [], {}
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        for label, text in licenses.TEMPLATES:
            need, tier = set(text.split()), licenses.tier_of(text)
            for s in range(0, max(1, len(w) - tier), tier):
                share = len(need & set(w[s : s + 2 * tier])) / len(need)
                if share >= 0.8 - 1e-9:
                    extra[label] = max(extra.get(label, 0), share)
        base = {label for _, label in places}
        out[d] = (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted(base)), ",".join(sorted(base | set(extra))), 1.0 if base else max(extra.values(), default=0.0))
    return out


def test_licenses(spark, tmp_path):
    rng = random.Random(4)
    texts = ["", None, "Under the MIT license", "released, under THE mit LICENSE\nunder the mit license under the mit license", "all rights", "All RIGHTS-reserved.", "cc by\nnc", "licensed under cc by nc 4 0", "apache license version 2", " ".join(["filler"] * 70 + licenses.TEMPLATES[1][1].split() + ["tail"] * 90), "Redistribution and use in source and binary forms, with modification, are permitted\n", "é" * 300, "this wor\u212a is licensed under the gnu general public license version 3", "word " * 50_000 + licenses.TEMPLATES[1][1], "\n".join(licenses.TEMPLATES[-1][1].split())]
    for _, t in licenses.TEMPLATES * 6:
        w = t.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "other"
        rng.shuffle(w)
        texts.append(" ".join(w))
    docs = list(enumerate(texts))
    spark.createDataFrame([(d, t, "n", 1) for d, t in docs], "doc_id long, text string, line string, w int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.op10_license_scan(spark, str(tmp_path)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()}
    want = license_rows(docs)
    for d in want:
        assert got[d][:6] == want[d][:6], (d, texts[d])
        assert got[d][6] == pytest.approx(want[d][6])
    assert licenses.scan(spark.createDataFrame([(None, "x"), (None, "x")], "doc_id long, text string"), []).collect() == []
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([], "doc_id long, text string"), [("none", "...")])
    twice = spark.createDataFrame([(1, "all rights reserved"), (1, "all rights reserved"), (1, "nothing"), (None, "All rights reserved")], "doc_id long, text string")
    twice.write.parquet(f"{tmp_path}/again/documents.parquet")
    rows = licenses.op10_license_scan(spark, f"{tmp_path}/again").collect()
    assert sorted((r["doc_id"] or 0, r["labels"]) for r in rows) == [(0, "all-rights-reserved"), (1, ""), (1, "all-rights-reserved"), (1, "all-rights-reserved")]


def test_wrapped_and_long_templates(spark):
    bsd, long = licenses.TEMPLATES[5][1].split(), [f"t{k}" for k in range(70)]
    at = bsd.index("modification")
    texts = [" ".join(bsd[:at]) + "\n" + " ".join(bsd[at:]), "\n".join(["filler"] * 50 + bsd + ["tail"] * 50), " ".join(["filler"] * 65 + long + ["tail"] * 65)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["id"], r["label"]): r["containment"] for r in licenses.scan(docs, [("bsd", " ".join(bsd)), ("long", " ".join(long))]).collect()}
    assert got == {(0, "bsd"): 1.0, (1, "bsd"): 1.0, (2, "long"): 1.0}
