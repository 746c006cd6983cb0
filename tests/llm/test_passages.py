import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common, decontaminate, hashing, substrings

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def key(r):
    return tuple((x is not None, x) for x in r)


# --- decontamination


def contamination(docs, items):
    of = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            of[tuple(w[j : j + k])].add(i)
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = [0] * len(w), set()
        for k in {len(x) for x in of}:
            for j in range(len(w) - k + 1):
                if x := of.get(tuple(w[j : j + k])):
                    found |= x
                    hit[j : j + k] = [1] * k
        out.append((d, len(w), sum(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=key)


ITEMS = [(1, " ".join(f"w{k}" for k in range(25))), (2, "Short ITEM"), (3, ""), (4, None), (None, "nameless item here"), (1, "again under one"), (5, "a " * 40), (6, "é-è ü1"), (7, " ".join(f"w{k}" for k in range(15)))]
TEXTS = [(1, "x " * 5 + " ".join(f"W{k}," for k in range(3, 20)) + " y"), (2, "short"), (3, "a short  item, short item"), (4, None), (5, ""), (6, "a " * 12), (None, "nameless item here"), (7, "é è Ü1 é è ü1"), (8, " ".join(f"w{k}" for k in range(9))), (1, "x"), (9, "short\nitem " * 3000), (10, "clean words only")]


@pytest.mark.parametrize("bits", [24, 7])
def test_contamination(spark, bits):
    docs = spark.createDataFrame([(d, t, 1, "z", k) for k, (d, t) in enumerate(TEXTS)], "doc_id long, text string, n_hit int, items string, rid0 long")
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, rid int")
    got = decontaminate.find_contamination(docs, items, key="rid0", bits=bits).collect()
    assert sorted(((TEXTS[r["rid"]][0], r["n_words"], r["n_hit"], sorted(r["items"])) for r in got), key=key) == contamination(TEXTS, ITEMS)
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)


@pytest.mark.parametrize("bits", [7, 24])
def test_repeated_and_null_ids_keep_their_rows(spark, tmp_path, monkeypatch, bits):
    rows = TEXTS + [(1, "a short item"), (1, "a short item"), (None, "clean"), (None, "short item " * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(decontaminate, "BITS", bits)
    got = decontaminate.op4_decontamination(spark, str(tmp_path)).collect()
    want = contamination(rows, ITEMS)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got), key=key) == sorted(((d, n, h, len(x)) for d, n, h, x in want), key=key)


def test_contamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, items).where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_winnowing_keeps_a_hash_of_every_window():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 40, 500).astype(np.uint64)
    grams = hashing.gram_hashes(h, 5)
    kept = hashing.sliding_min(grams, 6)
    assert len(kept) == 491 and all(kept[i] == grams[i : i + 6].min() for i in range(491))


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)
    rows = spark.createDataFrame([(k % 3 and 7, k) for k in range(300)] + [(None, 1), (9, 2)], "key long, x long")
    counted = spark.createDataFrame([(7, "a", 200), (0, "b", 100), (9, "c", 1), (11, "d", 0)], "key long, y string, n long")
    out = common.join_spread(rows, counted, ["key"], "n", spread=8)
    assert out.columns == ["key", "x", "y"]
    assert sorted(map(tuple, out.collect())) == sorted([(k % 3 and 7, k, "a" if k % 3 else "b") for k in range(300)] + [(9, 2, "c")])


# --- repeats


def repeats(docs):
    words = [(t or "").encode().split() for _, t in docs]
    c = collections.Counter(tuple(w[j : j + 35]) for w in words for j in range(len(w) - 34))
    out = []
    for (d, _), w in zip(docs, words):
        hit = [0] * len(w)
        for j in range(len(w) - 34):
            if c[tuple(w[j : j + 35])] > 1:
                hit[j : j + 35] = [1] * 35
        out.append((d, len(w), sum(hit), hashlib.sha256(b" ".join(x for x, y in zip(w, hit) if not y)).hexdigest()))
    return sorted(out, key=key)


def corpus():
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 12)
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 120)]
    rows = []
    for d in range(60):
        text = [word() for _ in range(rng.randint(0, 90))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(text))
            text[at:at] = p[rng.randint(0, 3) :]
        rows.append((d, "  ".join(text)))
    return rows + [(None, rows[3][1]), (None, rows[3][1]), (5, None), (6, ""), (7, "x " * 300), (8, "a b c " * 90), (9, rows[9][1]), (9, rows[9][1]), (90, " ".join(map(str, range(9000)))), (91, " ".join(map(str, range(4000, 4050))))]


@pytest.mark.parametrize("bucket,m", [(4096, 4), (2, 4), (4096, 1), (4096, 35)])
def test_repeats(spark, monkeypatch, bucket, m):
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    monkeypatch.setattr(common, "HOT", 1000 if bucket > 2 else 5)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "n", "k") for d, t in rows], "doc_id long, text string, repeats int, row string, id string")
    out = substrings.remove_repeats(df, m=m)
    assert out.columns == ["doc_id", "text", "row", "id", "repeats"]
    got = out.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2(F.col("repeats.kept").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got), key=key) == repeats(rows)


def test_repeats_of_nothing(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hashes_depend_on_words_alone():
    words = [b"", b"a", b"abcdefgh", b"abcdefghi", b"x" * 100, "é".encode()] * 2
    h = hashing.word_hashes(words)
    assert (h[:6] == h[6:]).all() and len(set(h.tolist())) == 6
    r = hashing.range_hashes(h, np.array([0, 6, 1]), np.array([5, 11, 6]))
    assert r[0] == r[1] != r[2]


def test_very_long_texts(spark):
    """Passages at the far end of texts of 400,000 words."""
    passage, filler = " ".join(f"p{k}" for k in range(40)), "fill " * 3 + "er "
    long = " ".join(f"x{k % 977}y{k // 977}" for k in range(400_000))
    docs = spark.createDataFrame([(1, f"{long} {passage}"), (2, f"{filler} {passage}"), (3, filler)], "doc_id long, text string")
    items = spark.createDataFrame([(5, passage)], "item_id long, text string")
    hit = {r["doc_id"]: r["n_hit"] for r in decontaminate.find_contamination(docs, items).select(F.col("rid").alias("doc_id"), "n_hit").collect()}
    assert hit == {1: 40, 2: 40, 3: 0}
    got = {r["doc_id"]: (r["repeats"]["n_words"], r["repeats"]["n_removed"]) for r in substrings.remove_repeats(docs).collect()}
    assert got == {1: (400_040, 40), 2: (44, 40), 3: (4, 0)}
