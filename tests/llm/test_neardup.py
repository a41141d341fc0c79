import collections
import math
import random
import re

import numpy as np

from srcatlas.llm import neardup
from srcatlas.llm.components import components


def tf(count):
    return 1 + math.log(count) if count else 0.0


def brute(rows, threshold=0.8, extra=()):
    """Classes by all pairs, in plain Python; the texts of ``extra`` only count in the frequencies."""
    sets, df = {}, collections.Counter()
    for i, text in rows:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] or ([tuple(words)] if words else [])
        sets[i] = collections.Counter(grams)
        df.update(sets[i].keys())
    for text in extra:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        df.update({tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    n = len(rows) + len(extra)
    idf = {s: 1 + math.log10(1 + n / max(c, neardup.FLOOR * n)) for s, c in df.items()}
    of = {i: i for i in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                low = sum(min(tf(c), tf(sets[b][s])) * idf[s] for s, c in sets[a].items())
                high = sum(max(tf(sets[a][s]), tf(sets[b][s])) * idf[s] for s in sets[a].keys() | sets[b].keys())
                if (low / high if high else 1.0) >= threshold:
                    x, y = find(a), find(b)
                    of[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(rng.choice([1, 2, 3, 8, 25])):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(words)))
        rows.append((len(rows) + 1, rows[-1][1]))
    rows += [(500, ""), (501, None), (502, "one two"), (503, "One, two!"), (504, "one three")]
    return rows


def test_against_all_pairs(docs):
    rows = corpus()
    out = {r["doc_id"]: r for r in neardup.classes(docs(rows)).collect()}
    assert {i: r["class_id"] for i, r in out.items()} == brute(rows)
    assert sorted(i for i, r in out.items() if r["kept"]) == sorted({r["class_id"] for r in out.values()})


def test_frequencies_do_not_depend_on_partitions(spark, monkeypatch):
    """A shingle in one text of every small block is frequent, and so is any in a small table."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    texts = [" ".join([*(["a", "b", "c", "d", "e"] if i % 5 == 0 else []), *(f"w{i}x{k}" for k in range(8))]) for i in range(200)]
    spread = spark.createDataFrame(spark.sparkContext.parallelize([(t,) for t in texts], 40), "text string")
    weights = neardup.frequent(spread, 200, 0.1)
    assert weights.idf.tolist() == [1 + math.log10(1 + 200 / 40)]
    small = neardup.frequent(spark.createDataFrame([("one two three",), ("four five six",)], "text string"), 2)
    assert small.idf.tolist() == [1 + math.log10(1 + 2 / 1)] * 2


def test_frequencies_are_exact(spark):
    """All shares from bursts in one block to even spreads, against plain counts."""
    rng = random.Random(2)
    texts = [[f"u{i}", *[f"s{k} s{k} s{k} s{k} s{k}" for k in range(30) if rng.random() < k / 100 or (k < 5 and 40 * k <= i < 40 * k + 30)]] for i in range(400)]
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(" ".join(t),) for t in texts], 8), "text string")
    df = collections.Counter()
    for t in texts:
        words = " ".join(t).split()
        df.update({tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)})
    expected = sorted(1 + math.log10(1 + 400 / n) for n in df.values() if n >= 0.05 * 400)
    assert np.allclose(sorted(neardup.frequent(rows, 400, 0.05).idf), expected) and len(expected) > 20


def test_pairs_among_pages_of_one_template(docs):
    """Buckets of many components: every pair must meet, not only those with a pivot."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template = fresh(200)
    rows = []
    for _ in range(150):
        own = fresh(15)
        rows += [(len(rows) + k, " ".join([*template, *own, *fresh(10)])) for k in (1, 2)]
    expected = brute(rows)
    assert len(set(expected.values())) == 150
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(rows)).collect()}
    assert found == expected


def test_deduplicate_keeps_columns_and_one_row_a_class(docs):
    rows = corpus()
    frame = docs([*rows, rows[0], (None, None), (None, "alone here are words")])
    kept = neardup.deduplicate(frame)
    assert kept.columns == frame.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(brute(rows, extra=[rows[0][1], None, "alone here are words"]).values()))
    assert neardup.deduplicate(docs([])).count() == 0


def test_very_long_texts_and_clashing_columns(docs):
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:30_000], "new", *words[30_000:]])), (3, " ".join(reversed(words))), (4, "short text")]
    frame = docs(rows).selectExpr("*", "'p' as __k1", "'q' as __k2", "'r' as `row`", "'s' as one", "'t' as id", "'u' as `a.b`")
    kept = neardup.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    assert {tuple(r) for r in kept.select("__k1", "__k2", "`row`", "one", "id", "`a.b`").collect()} == {tuple("pqrstu")}


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    sampler = neardup.Sampler(600)
    shared, a, b = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (300, 60, 60))
    weight = lambda s: 1 + (s % np.uint64(3)).astype(float)
    one, two = np.concatenate((shared, a)), np.concatenate((shared, b))
    same = (sampler.samples(one, weight(one)) == sampler.samples(two, weight(two))).mean()
    expected = weight(shared).sum() / (weight(shared).sum() + weight(a).sum() + weight(b).sum())
    assert abs(same - expected) < 0.06


def test_components(spark):
    edges = [(1, 2), (2, 3), (4, 5), (6, 4), (9, 9), *((100, i) for i in range(101, 400)), *((i, i + 1) for i in range(500, 540))]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in (1, 2, 3)} == {1} and {found[i] for i in (4, 5, 6)} == {4}
    assert {found[i] for i in range(100, 400)} == {100} and {found[i] for i in range(500, 541)} == {500}
