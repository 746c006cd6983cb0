import random
import re

import numpy as np
import xxhash

from gridloom.llm import components, simhash

DOCS = "doc_id long, text string, fp string, component_id int"


def brute(rows):
    prints = []
    for _, text, *_ in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    return prints, linked([r[0] for r in rows], prints)


def linked(ids, prints):
    v = np.array(prints, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v) <= 2
    part = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(near)):
            if part[a] != part[b]:
                part[a] = part[b] = min(part[a], part[b])
                changed = True
    least = {}
    for i, p in zip(ids, part):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    return [least.get(p) for p in part]


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices("The of and Über x yz été to in a".split(), k=rng.randint(0, 40))) for _ in range(40)]
    rows = [(i, t, "", 0) for i, t in enumerate(base)]
    rows += [(100 + i, t + " tail", "", 0) for i, t in enumerate(base[:20])] + [(200, None, "", 0), (201, "", "", 0), (None, base[0], "", 0), (7, base[7], "", 0)]
    prints, parts = brute(rows)
    got = simhash.link_fingerprints(simhash.fingerprints(spark.createDataFrame(rows, DOCS)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((r[0], p - (1 << 64) if p >> 63 else p, c) for r, p, c in zip(rows, prints, parts)), key=key)
    assert sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in got.collect()), key=key) == want


def test_full_buckets_lose_no_link(spark, monkeypatch):
    rng = random.Random(5)
    center, prints = rng.getrandbits(64), []
    for _ in range(150):
        p = center
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
            p ^= 1 << b
        prints.append(p)
    rows = list(enumerate(simhash._signed(p) for p in prints))
    want = dict(zip(range(150), linked(list(range(150)), prints)))
    for size in (64, 2):
        monkeypatch.setattr(simhash, "BUCKET", size)
        got = simhash.link_fingerprints(spark.createDataFrame(rows, "doc_id long, fp long"))
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_golay_keys_meet():
    rng, code = random.Random(7), simhash.code()
    words = np.arange(1 << 12) << 11
    words |= simhash._remainder(words)
    assert (simhash._remainder(words) == 0).all()
    for b in range(23):
        assert (code.index(words ^ 1 << b) == words >> 11).all()
    p = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    for flips in (0, 1, 2):
        q = p.copy()
        for i in range(len(q)):
            for b in rng.sample(range(64), flips):
                q[i] ^= np.uint64(1 << b)
        ka, kb = ({} , {})
        for keys, rows in ((ka, simhash.fuzzy_keys(p.view(np.int64))), (kb, simhash.fuzzy_keys(q.view(np.int64)))):
            for r, k in zip(*rows):
                keys.setdefault(int(r), set()).add(int(k))
        assert all(ka[i] & kb[i] for i in range(len(p)))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in (100, 101, 102)}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_empty(spark):
    assert simhash.link_fingerprints(simhash.fingerprints(spark.createDataFrame([], DOCS))).collect() == []
    assert simhash.near_duplicates(spark.createDataFrame([], "rid long, text string")).collect() == []


def test_similar_texts_are_found_and_others_left(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, pairs = [], []
    for k in range(40):
        words = [word() for _ in range(300)]
        other = list(words)
        for at in rng.sample(range(300), 4):
            other[at] = word()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = ({tuple(w[i : i + 5]) for i in range(296)} for w in (words, other))
        pairs.append(len(a & b) / len(a | b))
    rows += [(1000, None), (1001, None), (1002, rows[0][1])]
    got = {r["rid"]: r["root"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "rid long, text string")).collect()}
    found = [got.get(2 * k + 1) == 2 * k for k, j in enumerate(pairs) if j >= 0.85]
    assert sum(found) >= 0.85 * len(found)
    assert got[1002] == 0 and got[1001] == 1000
    assert all(r // 2 == root // 2 for r, root in got.items() if r < 1000)


def edited(rng, words, at):
    out = list(words)
    for i in at:
        out[i] = f"e{rng.getrandbits(60):x}"
    return out


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_star_of_variants_is_one_group(spark, monkeypatch):
    rng = random.Random(13)
    base = [f"b{rng.getrandbits(60):x}" for _ in range(300)]
    texts = [edited(rng, base, rng.sample(range(10, 290), 6)) for _ in range(400)]
    texts = [t for t in texts if jaccard(base, t) >= 0.8][:300]
    assert len(texts) == 300 and sum(jaccard(a, b) < 0.8 for a, b in zip(texts, texts[1:])) > 250
    order = texts[:150] + [base] + texts[150:]
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(order)], "rid long, text string")
    for block in (simhash.BLOCK_BYTES, 200_000):  # whole, and in blocks
        monkeypatch.setattr(simhash, "BLOCK_BYTES", block)
        got = {r["rid"]: r["root"] for r in simhash.near_duplicates(rows).collect()}
        assert got == {k: 0 for k in range(1, 301)}


def test_pairs_are_judged_by_their_shingles(spark):
    rng, rows, want = random.Random(17), [], {}
    while len(rows) < 240:
        words = [f"{rng.getrandbits(60):x}" for _ in range(300)]
        other = edited(rng, words, rng.sample(range(300), rng.choice([6, 7, 8])))
        if 0.76 <= jaccard(words, other) <= 0.84:
            if jaccard(words, other) >= 0.8:
                want[len(rows) + 1] = len(rows)
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    assert 20 < len(want) < 100
    got = {r["rid"]: r["root"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "rid long, text string")).collect()}
    assert got.items() <= want.items() and len(got) >= 0.9 * len(want)


def keys_of(texts):
    sets = simhash.shingle_sets([" ".join(t).encode() for t in texts], 5)
    votes = np.array([simhash.margins(s)[: 23 * simhash.SEGMENTS] for s in sets])
    return simhash.triple_keys(simhash.code().nearest(votes.reshape(-1, 23)).reshape(len(sets), simhash.SEGMENTS, 2))


def test_recall_of_single_pairs():
    """In each step of 0.02 of similarity from the threshold on, at least 0.9 of pairs that stand alone share a key; of short texts too."""
    rng, found = random.Random(19), {}
    for size in (12, 40, 300):
        for _ in range(1500):
            words = [f"{rng.getrandbits(60):x}" for _ in range(size)]
            other = edited(rng, words, rng.sample(range(size), rng.randint(1, max(1, size // 35))))
            if size < 40:
                other = words + [f"{rng.getrandbits(60):x}" for _ in range(rng.randint(1, 2))]
            if (j := jaccard(words, other)) >= 0.8:
                a, b = keys_of([words, other])
                found.setdefault(int((j - 0.8) / 0.02 + 1e-9), []).append(bool(set(a.tolist()) & set(b.tolist())))
    share = {k: sum(v) / len(v) for k, v in sorted(found.items()) if len(v) > 30}
    print({f"{0.8 + 0.02 * k:.2f}": (round(v, 3), len(found[k])) for k, v in share.items()})
    assert 0 in share and min(share.values()) >= 0.9


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    part = {}
    for a, b in zip(u.tolist(), v.tolist()):
        x, y = part.setdefault(a, {a}), part.setdefault(b, {b})
        if x is not y:
            x |= y
            part |= dict.fromkeys(y, x)
    got = simhash.forest(u, v)
    assert len(got) == len({id(x) for x in part.values()}) * -1 + len(part)
    assert all(min(part[b]) == a for a, b in got.tolist())


def test_long_texts_are_counted_in_slices(monkeypatch):
    h = np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64)
    whole = simhash.margins(h)
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert (simhash.margins(h) == whole).all()
    assert (simhash.margins(h[:1])[:] != 0).all()
