import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gridloom.llm import binary, packing, tokens
from gridloom.llm.common import strings

FILES = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}
ODD = ["", " ", "a  b", " lead", "x\n\n y", "tab\tz", "don't  stop\n", "nb\xa0sp", "é\x1cq", "A\nB c", "\n", "<|endoftext|> x", "ΑΣ Σ İ", "a b \n d", "ﬁ é é", "１２ ½x.,!?", "A.B,!c!!", "👍🏽 ok"]
DOCS = "doc_id long, text string, start string, ids int"


def reference(kind):
    t = Tokenizer.from_file(tokens.default_path(FILES[kind]))
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", FILES)
def test_encoder_on_odd_texts(kind):
    want, e = reference(kind), tokens.Encoder(tokens.default_path(FILES[kind]), kind)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(ODD)] == [want(x) for x in ODD]


@pytest.mark.parametrize("kind", FILES)
def test_encoder_on_random_texts(kind):
    want, e = reference(kind), tokens.Encoder(tokens.default_path(FILES[kind]), kind)

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.one_of(st.sampled_from(" \n.,!'s’éßñA1Σ́"), st.characters(exclude_categories=["Cs"])), max_size=30))
    def same(text):
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == want(text)

    same()


@pytest.mark.parametrize("kind", FILES)
def test_encoder_on_columns(kind):
    want, e = reference(kind), tokens.Encoder(tokens.default_path(FILES[kind]), kind)
    bad = pa.array([b"x", None, b"\xffa b,", "é, ×, A!B".encode(), b"x"])
    assert strings(bad).to_pylist() == ["x", "", "\ufffda b,", "é, ×, A!B", "x"]

    @settings(max_examples=100, deadline=None)
    @given(st.lists(st.text(st.sampled_from(" \n.,#'sAéÿ×÷ßΣ1И٣אḧ\u0331<|\u00a0"), max_size=12), max_size=8), st.integers(0, 3))
    def same(rows, first):
        column = pa.concat_arrays([strings(bad), pa.array([*rows, *ODD], pa.large_string())]).slice(first)
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(column)] == [want(x) for x in column.to_pylist()]

    same()


def test_capitals_with_marks_that_compose_only_with_small_letters():
    want, e = reference("word"), tokens.Encoder(tokens.default_path(FILES["word"]), "word")
    rows = ["H\u0331 x", "J\u030ca", "T\u0308,", "Éa ÉA", "Ǆ"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(rows)] == [want(x) for x in rows]


@pytest.mark.parametrize("kind", FILES)
def test_pieces_in_use_are_learned_once(kind, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    e, learned = tokens.Encoder(tokens.default_path(FILES[kind]), kind), Counter()
    monkeypatch.setattr(e, "_learn", lambda pieces, f=e._learn: (learned.update(pieces), f(pieces)))
    for i in range(50):
        e.encode([f"a cat, a cat {'q' * i}z {'v' * i}z", "a cat,"])
        assert len(e.cache) + len(e.older) < 80
    assert learned[" cat"] == learned[","] == 1 and learned.total() < 120


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**60 - 1)), max_size=2500))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    assert (binary.decode(*binary.encode(v), len(v)) == v).all()


def test_ids_too_wide_are_refused():
    with pytest.raises(ValueError):
        binary.encode(np.array([1 << 60], np.uint64))


ROWS = [(5, "the end", "", 0), (None, "no id", "", 0), (2, None, "", 0), (2, "", "", 0), (9, "word " * 9000, "", 0), (5, "the end", "", 0), (1, "a\nb", "", 0)]


def test_token_files(spark):
    want, ids = reference("byte"), []
    folder, manifest = binary.write_token_files(spark.createDataFrame(ROWS, DOCS), file_ids=50)
    got = sorted(binary.read_token_files(folder, manifest).collect(), key=lambda r: r["start"])
    assert manifest.count() > 1
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids) and ids[-1] == tokens.END_ID
        assert ids[:-1] in [want(t or "") for d, t, *_ in ROWS if d == r["doc_id"]]
        at += len(ids)
    assert binary.read_token_files(*binary.write_token_files(spark.createDataFrame([], DOCS))).collect() == []


def test_packing(spark):
    want = reference("word")
    rows = packing.pack_documents(spark.createDataFrame(ROWS, DOCS).coalesce(1)).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.WINDOW
    texts = {(d, len(want(t or "")) + 1): want(t or "") + [tokens.END_ID] for d, t, *_ in ROWS}
    assert set(documents) == set(texts)
    long = documents[9, len(texts[9, 9001])]
    assert sum((ids for _, ids in sorted(long)), []) == texts[9, 9001]
    assert sum(start == 0 for start, _ in documents[5, 3]) == 2
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=80))
def test_best_fit_finds_the_tightest_window(lengths):
    n, window = np.array([min(x, 64) for x in lengths]), 64
    want, left = [], []
    for p in np.argsort(-n, kind="stable").tolist():
        fits = [(c, i) for i, c in enumerate(left) if c >= n[p]]
        if fits:
            i = min(fits)[0], max(i for c, i in fits if c == min(fits)[0])
            want[i[1]].append(p)
            left[i[1]] -= n[p]
        else:
            want.append([p])
            left.append(window - n[p])
    got = packing.best_fit(n, window)
    assert sorted(map(sorted, (n[w].tolist() for w in got))) == sorted(map(sorted, (n[w].tolist() for w in want)))


def test_of_windows_with_equal_room_the_latest_is_taken():
    n = np.array([1, 8, 15, 43, 50])
    assert [n[w].tolist() for w in packing.best_fit(n, 64)] == [[50, 8], [43, 15, 1]]


def test_padding_is_little():
    lengths = np.random.default_rng(0).integers(1, 6000, 3000).tolist()
    used = defaultdict(int)
    for _, _, n, s, _ in packing.pack_block(lengths, 4096, 0.9):
        used[s] += n
    assert sum(0 if u & (u - 1) == 0 else 4096 - u for u in used.values()) < 0.01 * sum(lengths)


def test_crc_of_the_query(spark):
    row = packing.op2_packing(spark, "/root/testdata/sf0.001").where("length < 4096 and start = 0").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(f"doc_id = {row['doc_id']}").first()["text"]
    ids = np.array(reference("word")(text) + [tokens.END_ID], "<u4")[: row["length"]]
    assert row["ids_crc32"] == zlib.crc32(ids.tobytes())
