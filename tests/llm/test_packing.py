import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from srcatlas.llm import packing
from srcatlas.llm.wordhash import raw_words

PATH = public_tokenizers.path("word_bpe_49k.json")


def encoded(tokenizer, texts):
    ids, first = tokenizer.encode(raw_words(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


@given(st.lists(st.integers(1, 64), max_size=60))
def test_bins_hold_exactly_the_pieces(lengths):
    bins = packing.best_two_fit(np.array(lengths, np.int64), 64)
    assert sorted(n for b in bins for n in b) == sorted(lengths)
    assert all(sum(b) <= 64 for b in bins)
    assert all(sum(a) + sum(b) > 64 for i, a in enumerate(bins) for b in bins[:i])


def test_two_pieces_replace_the_smallest():
    # greedy fills 60 + 30 of 100 and then nothing fits the 10 left; 20 + 20 fill what 30 and the gap make
    assert sorted(map(sorted, packing.best_two_fit(np.array([60, 30, 20, 20]), 100))) == [[20, 20, 60], [30]]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_the_tokenizers(text):
    clean = text.encode("utf-8", "replace").decode()
    tokenizer = packing.shared_tokenizer(PATH)
    assert encoded(tokenizer, [clean]) == [tokenizer.tokenizer.encode(clean, add_special_tokens=False).ids]


def test_hard_words(reference):
    texts = ["it's <|endoftext|> THE'LL 'S", "ΑΣ. ΣΑΣ ς", "İstanbul ǅ á é", "a.b,c 123abc ££  x", "日本語 한국어", ""]
    assert encoded(packing.WordTokenizer(PATH), texts) == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_crowded_table_forgets_nothing_it_needs(reference, monkeypatch):
    monkeypatch.setattr(packing, "SLOTS", 16)
    monkeypatch.setattr(packing, "POOL", 64)
    monkeypatch.setattr(packing, "PARTS", 20)
    tokenizer = packing.WordTokenizer(PATH)
    for turn in range(6):
        texts = [" ".join(f"word{(i * 7 + turn * k) % 60}, x{i}" for i in range(40)) for k in range(5)]
        assert encoded(tokenizer, texts) == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_and_places(docs, reference):
    rows = [(1, "word " * 5000), (2, None), (3, ""), (4, "a b c"), (4, "a b c"), (None, "x"), *((i, "some text here " * (i % 40)) for i in range(10, 200))]
    out = packing.pack(docs(rows), PATH, size=256, bucket_pieces=64).collect()
    long = sorted((r["start"], r["length"], r["ids_crc32"], r["piece"]) for r in out if r["doc_id"] == 1)
    ids = reference.encode("word " * 5000, add_special_tokens=False).ids + [0]
    expected = [(s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes()), s // 256) for s in range(0, len(ids), 256)]
    assert long == expected
    assert [r["length"] for r in out if r["doc_id"] in (2, 3)] == [1, 1]
    assert sum(r["doc_id"] == 4 for r in out) == 2
    held = {}
    for r in out:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 256
    total = sum(r["length"] for r in out)
    assert len(held) <= -(-total // 256) + 12
    assert packing.pack(docs([]), PATH).count() == 0


def test_long_and_repeated_words(reference):
    texts = ["x" * 600 + " " + "y" * 5000 + " " + "x" * 600, "y" * 5000, "ab" * 400 + "! " + "ab" * 400 + "!"]
    tokenizer = packing.WordTokenizer(PATH)
    for _ in range(2):
        assert encoded(tokenizer, texts) == [reference.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("change", [{"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {}])
def test_other_tokenizers_encode_whole_texts(docs, tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        made = json.load(f) | change
    path = str(tmp_path / "t.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(made, f)
    assert packing.by_words(path) == (not change)
    texts = ["The Cat's  hat. É x", "", "A,b 12"]
    plain = Tokenizer.from_file(path)
    out = {r["doc_id"]: r["ids_crc32"] for r in packing.pack(docs(list(enumerate(texts))), path).collect()}
    assert out == {i: zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in enumerate(texts)}


def test_buckets_follow_the_pieces(docs):
    rows = [(i, "word " * 30_000) for i in range(8)]
    out = packing.pack(docs(rows), PATH, size=64, bucket_pieces=256).collect()
    assert len({r["sequence_id"] >> 32 for r in out}) >= 8
    assert len({(r["doc_id"], r["piece"]) for r in out}) == len(out) == 8 * 469


def test_equal_rows_fill_no_bucket(docs):
    frame = docs([(1, "the same words")] * 30_000).repartition(4)
    out = packing.pack(frame, PATH, bucket_pieces=512)
    held = out.groupBy((out["sequence_id"] / (1 << 32)).cast("int")).count().collect()
    assert sum(r["count"] for r in held) == 30_000 and len(held) == 59 and max(r["count"] for r in held) < 700
