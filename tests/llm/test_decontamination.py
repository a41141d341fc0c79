import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from srcatlas.llm import decontamination as d

VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "lmnrstv"]
COMMON = ["the", "of", "and", "to"]


def sentence(rng, n):
    return [rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(VOCABULARY) for _ in range(n)]


def best_distance(item, words):
    """Least edit distance of item to any stretch of words, the textbook way."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=8), st.lists(st.integers(0, 4), max_size=14))
def test_nearest_is_the_textbook_distance(item, words):
    found = d.nearest(np.array(item), np.array(words, np.int64), 8)
    expected = best_distance(item, [w or -1 for w in words])
    assert found[0] == min(expected, 9)
    if found[0] <= 8:
        assert best_distance(item, [w or -1 for w in words[found[1] : found[2]]]) == found[0]


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    items = [(i, " ".join(sentence(rng, rng.randrange(10, 45)))) for i in range(40)] + [(90, "one two three"), (91, None), (92, "...")]
    rows, planted = [], {}
    for doc in range(400):
        words = sentence(rng, rng.randrange(0, 150))
        if doc % 4 == 0:
            item, text = items[rng.randrange(40)]
            part = text.split()
            for _ in range(rng.randrange(0, d.allowed(len(part)) + 1)):
                at, kind = rng.randrange(len(part)), rng.randrange(3)
                if kind == 0:
                    part[at] = "zzz"
                elif kind == 1:
                    part.insert(at, "yyy")
                else:
                    del part[at]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
            planted[doc] = item
        rows.append((doc, ", ".join(words).title()))
    rows += [(1000, None), (1001, ""), (1002, "so one two three go"), (1003, "one two x three"), (1002, "so one two three go")]
    return items, rows, planted


def test_recall_and_exactness(spark, docs, case):
    items, rows, planted = case
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = d.contaminated(docs(rows), benchmark).collect()
    found = {(r["doc_id"], r["item_id"]) for r in out}
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in items}
    texts = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in rows}
    truth = {(i, k) for i, t in texts.items() for k, w in words.items() if w and best_distance(w, t) <= d.allowed(len(w))}
    assert found <= truth
    assert len(found) >= 0.95 * len(truth) and len(truth) >= len(planted) + 1
    exact = {(i, k) for i, k in truth if best_distance(words[k], texts[i]) == 0}
    assert exact <= found
    assert (1002, 90) in found and (1003, 90) not in found
    assert sum(r["doc_id"] == 1002 for r in out) == 2
    for r in out:
        assert best_distance(words[r["item_id"]], texts[r["doc_id"]][r["word"] : r["word"] + r["words"]]) == r["distance"]


def copies_found(lengths, copies, seed):
    """For each length, the share of copies edited at the threshold, between unknown words, that an index finds."""
    rng = np.random.default_rng(seed)
    hashes = rng.integers(1, 1 << 63, 3000).astype(np.uint64)
    share = 1 / np.arange(1, 3001)
    items = [hashes[rng.choice(3000, n, p=share / share.sum())] for n in lengths for _ in range(40)]
    index = d.Index(list(range(len(items))), items)
    found = {}
    for k, n in enumerate(lengths):
        texts, planted = [], []
        for _ in range(copies):
            item = 40 * k + int(rng.integers(0, 40))
            words = items[item].tolist()
            for _ in range(d.allowed(n)):
                at, kind = int(rng.integers(0, len(words))), int(rng.integers(0, 3))
                words[at : at + (kind != 1)] = [1] * (kind < 2)
            texts.append(np.array([1] * 6 + words + [1] * 30, np.uint64))
            planted.append(item)
        first = np.concatenate(([0], np.cumsum([t.size for t in texts])))
        out = {(t, i) for t, i, *_ in index.matches(index.symbols(np.concatenate(texts)), first)}
        found[n] = np.mean([(t, i) in out for t, i in enumerate(planted)])
    return found


def test_long_items_reach_the_recall():
    found = copies_found([100, 200, 400], 60, 3)
    assert min(found.values()) >= d.RECALL, found


def test_short_items_reach_the_recall_between_unknown_words():
    found = copies_found([15, 19, 24, 30, 38], 2000, 7)
    assert min(found.values()) >= d.RECALL, found


def test_recall_in_every_length_band():
    """Items of 5 to 300 words in one index, with known words around the copies too."""
    rng = np.random.default_rng(5)
    hashes = rng.integers(1, 1 << 63, 3000).astype(np.uint64)
    share = 1 / np.arange(1, 3001)
    draw = lambda n: hashes[rng.choice(3000, n, p=share / share.sum())]
    bands = [(5, 9), (10, 19), (20, 39), (40, 79), (80, 149), (150, 300)]
    items = [draw(int(rng.integers(a, b + 1))) for a, b in bands for _ in range(30)]
    index = d.Index(list(range(len(items))), items)
    for k, band in enumerate(bands):
        copies = 400 if band[1] < 80 else 100
        texts, planted = [], []
        for _ in range(copies):
            item = 30 * k + int(rng.integers(0, 30))
            words = items[item].tolist()
            for _ in range(d.allowed(len(words))):
                at, kind = int(rng.integers(0, len(words))), int(rng.integers(0, 3))
                words[at : at + (kind != 1)] = [int(draw(1)[0])] * (kind < 2)
            texts.append(np.concatenate((draw(40), np.array(words, np.uint64), draw(40))))
            planted.append(item)
        first = np.concatenate(([0], np.cumsum([t.size for t in texts])))
        out = {(t, i) for t, i, *_ in index.matches(index.symbols(np.concatenate(texts)), first)}
        found = np.mean([(t, i) in out for t, i in enumerate(planted)])
        assert found >= d.RECALL, (band, found)


def test_walks_find_items_of_any_length():
    """No group of items is left to another filter; a long item is found by a part, wherever it is."""
    rng = np.random.default_rng(8)
    hashes = rng.integers(1, 1 << 63, 20_000).astype(np.uint64)
    items = [rng.choice(hashes, n) for n in (5, 12, 40, 63, 64, 80, 100, 150, 300, 2000) for _ in range(5)]
    index = d.Index(list(range(len(items))), items)
    assert all(plan and all(isinstance(walk, d.Walk) for walk in plan) for plan in index.plans)
    long = items[-1]
    kept = long.copy()
    kept[:400] = rng.integers(1, 1 << 63, 400)  # all edits at the beginning, and an item cut off
    texts = [kept, np.concatenate((long[:1600], rng.integers(1, 1 << 63, 50).astype(np.uint64)))]
    spoilt = kept.copy()
    spoilt[400:402] = 1
    texts.append(spoilt)
    first = np.concatenate(([0], np.cumsum([t.size for t in texts])))
    found = {(t, i): distance for t, i, _, _, distance in index.matches(index.symbols(np.concatenate(texts)), first)}
    assert found == {(0, len(items) - 1): 400, (1, len(items) - 1): 400}


def test_a_very_long_text_and_clashing_columns(spark, docs, case):
    items, _, _ = case
    rng = random.Random(4)
    long = sentence(rng, 120_000)
    long[90_000:90_000] = items[3][1].split()
    frame = docs([(1, " ".join(long)), (2, "clean text")]).selectExpr("*", "1 as hit", "2 as id", "3 as `row`", "4 as __hit")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert (1, 3) in {(r["doc_id"], r["item_id"]) for r in d.contaminated(frame, benchmark).collect()}
    kept = d.clean(frame, benchmark)
    assert kept.columns == frame.columns and [(r["doc_id"], r["__hit"], r["hit"]) for r in kept.collect()] == [(2, 4, 1)]


def test_clean_keeps_the_rest(spark, docs, case):
    items, rows, _ = case
    frame = docs(rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    hit = {r["doc_id"] for r in d.contaminated(frame, benchmark).collect()}
    kept = d.clean(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i not in hit)


def test_blocks_and_empty_tables(spark, docs, case, monkeypatch):
    items, rows, _ = case
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r)[:2] for r in d.contaminated(docs(rows), benchmark).collect()}
    monkeypatch.setattr(d.blocks, "__defaults__", (15, 300))
    parts = {tuple(r)[:2] for r in d.contaminated(docs(rows), benchmark).collect()}
    assert len(whole ^ parts) <= 0.05 * len(whole)
    assert d.contaminated(docs(rows), benchmark.limit(0)).count() == 0
    assert d.contaminated(docs([]), benchmark).count() == 0


def test_rows_are_judged_by_their_own_texts(spark, docs):
    """Rows that share an id with a contaminated one, or have none as it does, stay."""
    item = " ".join(f"w{i}" for i in range(30))
    frame = docs([(None, f"before {item} after"), (None, "quite another text"), (7, item), (7, "a third text"), (8, None)])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = d.clean(frame, benchmark)
    assert left.columns == frame.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(None, "quite another text"), (7, "a third text"), (8, None)], key=repr)
