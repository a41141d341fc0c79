import collections
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcatlas.llm import toxicity

BAD = ["gruk", "vlorp", "snizzle", "snizzlers"]
PLAIN = [f"word{i}" for i in range(80)]


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randrange(5, 80))]
        toxic = i % 5 == 0
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_index_returns_the_nearest(seed):
    toxicity.BLOCK, block = (8, 32, 256)[seed % 3], toxicity.BLOCK
    try:
        nearest_by_all_pairs(seed)
    finally:
        toxicity.BLOCK = block


def nearest_by_all_pairs(seed):
    rng = np.random.default_rng(seed)
    size, n, k = 20, int(rng.integers(0, 150)), int(rng.integers(1, 8))
    dense = rng.random((n, size)) * (rng.random((n, size)) < 0.15)
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.divide(dense, norm, out=np.zeros_like(dense), where=norm > 0)
    index = toxicity.BlockMaxIndex([(np.flatnonzero(v), v[v > 0]) for v in dense], size)
    query = rng.random(size) * (rng.random(size) < 0.2)
    found = index.nearest(np.flatnonzero(query), query[query > 0], k)
    scores = dense @ query
    expected = sorted([(round(-s, 9), i) for i, s in enumerate(scores) if s > 0])[:k]
    assert [(round(-s, 9), i) for s, i in found] == expected


def test_pruning_skips_blocks(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 32)
    vectors = [(np.array([i // 64]), np.array([1.0])) for i in range(640)]
    index = toxicity.BlockMaxIndex(vectors, 10)
    assert [i for _, i in index.nearest(np.array([3]), np.array([1.0]), 5)] == [192, 193, 194, 195, 196]
    assert index.opened <= 3


def test_held_out_accuracy_and_evidence(spark, docs):
    rows, labels = corpus()
    frame, marks = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame, marks, F.col("doc_id") % 3 != 0)
    out = {r["doc_id"]: r for r in toxicity.score(frame, model).collect()}
    held = [(out[i]["score"] >= toxicity.THRESHOLD, toxic) for i, _, toxic in labels if i % 3 == 0]
    assert sum(p == bool(t) for p, t in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values())
    for i in (0, 15, 30):
        assert out[i]["neighbours"] and all(n % 3 for n in out[i]["neighbours"])
        assert out[i]["similarities"] == sorted(out[i]["similarities"], reverse=True)


def test_nulls_repeats_and_missing_labels(spark, docs):
    rows, labels = corpus(100)
    frame = docs([*rows, (500, None), (501, ""), (500, None), (None, "gruk vlorp")])
    marks = spark.createDataFrame([*labels, (500, 1, None), (None, 1, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(frame, toxicity.fit(frame, marks, F.lit(True))).collect()
    assert len(out) == 104 and len({r["score"] for r in out if r["doc_id"] in (500, 501)}) == 1
    none = marks.limit(0)
    assert {r["score"] for r in toxicity.score(frame, toxicity.fit(frame, none, F.lit(True))).collect()} == {0.5}
    one = marks.where("toxic = 0")
    assert all(r["score"] < 0.1 for r in toxicity.score(frame, toxicity.fit(frame, one, F.lit(True))).collect())
    empty = docs([])
    assert toxicity.score(empty, toxicity.fit(empty, none, F.lit(True))).count() == 0


def brute(rows, labels, usable):
    """Neighbours and cosines of every text by all pairs, in plain Python."""
    counts = {i: collections.Counter((t or "").split()) for i, t in rows}
    df = collections.Counter(w for c in counts.values() for w in c)
    known = sorted((i, t) for i, _, t in labels if usable(i))
    yes, no = sum(t for _, t in known), sum(1 - t for _, t in known)
    factor = {}
    for w in {w for i, _ in known for w in counts[i]}:
        a, b = sum(t for i, t in known if w in counts[i]), sum(1 - t for i, t in known if w in counts[i])
        cross = a * (no - b) - b * (yes - a)
        chi = cross * cross * (yes + no) / (yes * no * (a + b) * (yes + no - a - b + 0.5)) if cross > 0 else 0
        factor[w] = toxicity.FLOOR + (1 - toxicity.FLOOR) * chi / (chi + toxicity.EVIDENCE)

    def unit(c):
        v = {w: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[w])) + 1) * factor[w] for w, n in c.items() if w in factor}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    units = {i: unit(counts[i]) for i, _ in known}
    out = {}
    for i, _ in rows:
        v = unit(counts[i])
        near = sorted((-round(sum(x * u.get(w, 0) for w, x in v.items()), 9), k) for k, u in units.items())
        out[i] = [(k, -s) for s, k in near if s < 0][: toxicity.NEIGHBOURS]
    return out


def test_whole_query_against_all_pairs(spark, docs):
    rows, labels = corpus(240, seed=6)
    rows += [(900, "gruk " * 20_000 + "word1"), (901, "unseen words only"), (902, None)]
    usable = lambda i: i % 3 != 1
    model = toxicity.fit(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("doc_id") % 3 != 1)
    expected = brute(rows, labels, usable)
    toxic = {i: t for i, _, t in labels}
    for r in toxicity.score(docs(rows), model).collect():
        want = expected[r["doc_id"]]
        assert np.allclose(r["similarities"], [s for _, s in want], atol=1e-6)
        # at equal cosines (copies) any order of the last digits will do
        clear = {k for k, s in want if not want or s > want[-1][1] + 1e-6}
        assert clear <= set(r["neighbours"])
        if want and len(clear) == len(want) - 1:
            weight = [1 / (1 + toxicity.SHARPNESS - min(s, 1.0)) for _, s in want]
            vote = (sum(w * toxic[k] for w, (k, _) in zip(weight, want, strict=True)) + toxicity.PRIOR * model.base) / (sum(weight) + toxicity.PRIOR)
            assert abs(r["score"] - np.interp(vote, *model.steps)) < 1e-6
        elif not want:
            assert r["score"] == model.bare
