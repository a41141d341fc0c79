"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A text's terms are its words (letters and digits, lower case).  Of the labelled
examples at most ``POSITIVE`` toxic and ``NEGATIVE`` others are used, those with
the smallest hashes.  All their terms are the vocabulary; terms in no example
cannot bring a text nearer to one and are left out.  A term weighs

    (1 + ln count) * (ln((1 + N) / (1 + df)) + 1) * (FLOOR + chi / (chi + EVIDENCE))

with the frequency df over all N documents, and chi the term's chi-squared with
the label if it is more frequent in toxic examples, else 0.  Without the last
factor the many ordinary words of a text, all rarer than the telling ones,
decide which examples are near; with it no term is dropped.

The examples' unit vectors form an inverted index.  Examples are ordered so
that similar ones share a block; every term keeps, per block, its postings and
their largest weight.  A query bounds each block by the sum of
its weights times those maxima, opens the blocks of the largest bounds, and then
all others whose bounds reach the k-th best score so far, so the k nearest
examples are exact.  Neighbours vote with weight 1 / (1 + SHARPNESS - cosine);
leave-one-out votes of the examples calibrate the result monotonically.

Cases: a null text is an empty one; a text without vocabulary terms has no
neighbours and gets the calibrated rate of such examples; without any labelled
example every score is 0.5, and with one class that class's smoothed rate;
null labels are ignored, an id labelled twice counts as toxic if either says
so; of several texts under one labelled id one is the example; ties among
neighbours go to the earlier example; repeated rows give equal rows; an empty
table gives no rows; every text is scored whole, however long: a query touches
each posting at most once; only doc_id and text of the documents and doc_id and
toxic of the labels are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, text_or_empty
from .wordhash import Words, plain_words

POSITIVE = 2000
NEGATIVE = 4000
#: Share of its weight that a term without any link to the label keeps, and the chi-squared that gives half of the rest.
FLOOR = 0.1
EVIDENCE = 100.0
NEIGHBOURS = 15
SHARPNESS = 0.05
BLOCK = 256
#: Rounds that settle the two halves of the examples when blocks are formed.
HALVINGS = 3
#: Blocks opened at first, whose k-th score bounds the rest.
OPEN = 8
#: Scores of equal texts that a task remembers.
KNOWN = 20_000
THRESHOLD = 0.7
PRIOR = 1.0
BITS = 20
SCHEMA = "doc_id long, score double, neighbours array<long>, similarities array<float>"


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [begin, begin + size), one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(begin - (ends - size), size)


class Lookup:
    """Numbers of the vocabulary's terms among many hashes.

    A hash's first ``BITS`` bits say where in the sorted vocabulary it would
    be, up to the few terms that share them.
    """

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary  # sorted
        top = (vocabulary >> np.uint64(64 - BITS)).astype(np.int64)
        held = np.bincount(top, minlength=1 << BITS)
        self.first = (np.cumsum(held) - held).astype(np.int32)
        self.most = int(held.max())

    def counts(self, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text: its vocabulary terms, ascending, and how often each occurs."""
        texts = words.first.size - 1
        hashes = words.hashes()
        if not self.vocabulary.size or not hashes.size:
            return [(np.empty(0, np.int64), np.empty(0, np.int64))] * texts
        begin = self.first.take((hashes >> np.uint64(64 - BITS)).astype(np.int64))
        at = np.full(hashes.size, -1, np.int64)
        for i in range(self.most):
            here = np.minimum(begin + i, self.vocabulary.size - 1)
            at = np.where(self.vocabulary.take(here) == hashes, here, at)
        maybe = np.flatnonzero(at >= 0)
        hit = at[maybe]
        text = np.searchsorted(words.first, maybe, "right") - 1
        keys, n = np.unique(text * self.vocabulary.size + hit, return_counts=True)
        owner, term = np.divmod(keys, self.vocabulary.size)
        cut = np.searchsorted(owner, np.arange(texts + 1))
        return [(term[a:b], n[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def arranged(term: np.ndarray, weight: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Examples in an order that puts similar ones into one block.

    Halves the examples, again and again, along the difference of the two
    halves' centroids, beginning with an example and the one least like it.
    """
    first = np.cumsum(count) - count

    def split(rows: np.ndarray) -> list[np.ndarray]:
        if rows.size <= BLOCK:
            return [rows]
        held = spans(first[rows], count[rows])
        t, w, owner = term[held], weight[held], np.repeat(np.arange(rows.size), count[rows])

        def like(chosen: np.ndarray) -> np.ndarray:
            mine = chosen[owner]
            centre = np.bincount(t[mine], w[mine], size)
            return np.bincount(owner, w * centre[t], rows.size)

        half = BLOCK * (-(-rows.size // BLOCK) // 2)
        side = np.arange(rows.size)
        one = like(side == 0)
        lean = one - like(side == int(one.argmin()))
        for _ in range(HALVINGS):
            near = np.argsort(-lean, kind="stable")[:half]
            side = np.zeros(rows.size, bool)
            side[near] = True
            lean = like(side) - like(~side)
        return [*split(rows[side]), *split(rows[~side])]

    return np.concatenate(split(np.arange(count.size))).astype(np.int64)


class BlockMaxIndex:
    """Exact top-k cosine over unit vectors, with block-max pruning.

    Postings lie by term and place; an entry is the run of a term's postings in
    one block, with their largest weight.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], size: int):
        self.blocks = -(-len(vectors) // BLOCK)
        count = np.array([t.size for t, _ in vectors], np.int64)
        term = np.concatenate([t for t, _ in vectors] or [np.empty(0, np.int64)])
        weight = np.concatenate([w for _, w in vectors] or [np.empty(0)])
        self.order = arranged(term, weight, count, size)
        self.home = np.empty(len(vectors), np.int64)
        self.home[self.order] = np.arange(len(vectors))
        at = np.repeat(self.home, count)
        by = np.lexsort((at, term))
        term, self.place, self.weight = term[by], at[by].astype(np.int32), weight[by]
        block = self.place // BLOCK
        fresh = np.ones(term.size, bool)
        fresh[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        begin = np.flatnonzero(fresh)
        self.cut = np.append(begin, term.size)
        self.block = block[begin].astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, begin) if begin.size else np.empty(0)
        self.first = np.searchsorted(term[begin], np.arange(size + 1))
        self.opened = 0

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine, as (cosine, example)."""
        if not term.size or not self.blocks:
            return []
        n = self.first[term + 1] - self.first[term]
        entries, w = spans(self.first[term], n), np.repeat(weight, n)
        block = self.block.take(entries)
        bound = np.bincount(block, w * self.top.take(entries), self.blocks)
        ranked = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound > 0)]
        found = np.zeros(self.order.size)
        # the best blocks give a k-th score; then all blocks that may beat it are opened at once
        least = 0.0
        for chosen in (ranked[:OPEN], ranked[OPEN:]):
            # sums in another order may differ in their last digits
            chosen = chosen[bound[chosen] >= least - 1e-9]
            if not chosen.size:
                break
            self.opened += chosen.size
            mark = np.zeros(self.blocks, bool)
            mark[chosen] = True
            held = np.flatnonzero(mark.take(block))
            entry = entries.take(held)
            begin = self.cut.take(entry)
            size = self.cut.take(entry + 1) - begin
            postings = spans(begin, size)
            found += np.bincount(self.place.take(postings), np.repeat(w.take(held), size) * self.weight.take(postings), found.size)
            if without >= 0:
                found[self.home[without]] = 0
            if np.count_nonzero(found) >= k:
                least = np.partition(found, found.size - k)[found.size - k]
        hit = np.flatnonzero((found > 0) & (found >= least))
        score, example = found[hit], self.order[hit]
        best = np.lexsort((example, -score))[:k]
        return list(zip(score[best].tolist(), example[best].tolist(), strict=True))


class Model:
    """Vocabulary, index and calibration."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, ids: list[int], counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        self.lookup, self.weights, self.ids = Lookup(vocabulary), weights, ids
        self.labels = labels.astype(float)
        self.base = (self.labels.sum() + PRIOR / 2) / (labels.size + PRIOR)
        vectors = [self.vector(*c) for c in counts]
        self.index = BlockMaxIndex(vectors, vocabulary.size)
        bare = np.array([not v[0].size for v in vectors], bool)
        self.bare = float((self.labels[bare].sum() + PRIOR * self.base) / (bare.sum() + PRIOR)) if labels.size else self.base
        with_terms = np.flatnonzero(~bare)
        raw = np.array([self.vote(self.index.nearest(*vectors[i], NEIGHBOURS, i)) for i in with_terms])
        self.steps = isotonic(raw, self.labels[with_terms])

    def vector(self, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(np.maximum(count, 1))) * self.weights[term]
        norm = math.sqrt(float(weight @ weight))
        return term, weight / norm if norm else weight

    def vote(self, near: list[tuple[float, int]]) -> float:
        weight = np.array([1 / (1 + SHARPNESS - min(c, 1.0)) for c, _ in near])
        label = self.labels[[i for _, i in near]]
        return float((weight @ label + PRIOR * self.base) / (weight.sum() + PRIOR))

    def score(self, term: np.ndarray, count: np.ndarray) -> tuple[float, list[int], list[float]]:
        near = self.index.nearest(*self.vector(term, count), NEIGHBOURS)
        if not near:
            return self.bare, [], []
        return float(np.interp(self.vote(near), *self.steps)), [self.ids[i] for _, i in near], [c for c, _ in near]


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a monotone map from votes to rates (pool adjacent violators, smoothed)."""
    if not raw.size:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for x, y in zip(raw[order].tolist(), label[order].tolist(), strict=True):
        pools.append([x, y, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            x2, y2, n2 = pools.pop()
            x1, y1, n1 = pools.pop()
            pools.append([(x1 * n1 + x2 * n2) / (n1 + n2), y1 + y2, n1 + n2])
    x = np.array([p[0] for p in pools])
    # one pseudo-example at the vote itself keeps rates off 0 and 1
    y = np.array([(p[1] + p[0]) / (p[2] + 1) for p in pools])
    return np.concatenate(([0.0], x, [1.0])), np.maximum.accumulate(np.concatenate(([min(0.0, y[0])], y, [max(y[-1], 1 - 1e-3)])))


def examples(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """doc_id, toxic and the terms (array of hash, count) of the bounded sample."""
    known = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    turn = F.xxhash64("doc_id", F.lit(3))
    # top-n by hash: partial in every task; the bound makes the broadcast safe
    taken = known.where("toxic = 1").orderBy(turn, "doc_id").limit(POSITIVE).unionByName(known.where("toxic = 0").orderBy(turn, "doc_id").limit(NEGATIVE))
    joined = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(taken), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    joined = joined.dropDuplicates(["doc_id"])

    def go(batches):
        for batch in batches:
            words = plain_words(batch.column(2))
            text, hashes = np.repeat(np.arange(len(batch.column(0))), np.diff(words.first)), words.hashes()
            order = np.lexsort((hashes, text))
            text, hashes = text[order], hashes[order]
            fresh = np.concatenate(([True], (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1]))) if text.size else np.empty(0, bool)
            begin = np.flatnonzero(fresh)
            n = np.diff(np.concatenate((begin, [text.size])))
            cut = np.searchsorted(text[begin], np.arange(len(batch.column(0)) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()),
                    pa.ListArray.from_arrays(cut, pa.array(hashes[begin].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(n.astype(np.int32))),
                ],
                ["doc_id", "toxic", "terms", "counts"],
            )

    return joined.mapInArrow(go, "doc_id long, toxic int, terms array<long>, counts array<int>")


def evidence(owner: np.ndarray, term: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """Each term's factor: how clearly its presence goes with the label."""
    yes, no = float(toxic.sum()), float(toxic.size - toxic.sum())
    if not yes or not no:
        return np.ones(size)
    a = np.bincount(term[toxic[owner] == 1], minlength=size).astype(float)
    n = np.bincount(term, minlength=size).astype(float)
    # chi-squared of the 2 x 2 table of label and presence
    cross = a * (no - (n - a)) - (n - a) * (yes - a)
    chi = np.where(cross > 0, cross * cross * (yes + no) / (yes * no * np.maximum(n, 1) * (yes + no - n + 0.5)), 0)
    return FLOOR + (1 - FLOOR) * chi / (chi + EVIDENCE)


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """Trains on the usable labelled rows; document frequencies cover all documents."""
    small_batches(docs.sparkSession)
    sample = materialise(examples(docs, labels, usable), "examples").orderBy("doc_id").toArrow()  # at most POSITIVE + NEGATIVE rows
    ids, toxic = sample.column("doc_id").to_pylist(), np.array(sample.column("toxic").to_pylist(), np.int64)
    lists = [sample.column(c).combine_chunks() for c in ("terms", "counts")]
    size = np.array(pa.compute.list_value_length(lists[0]).to_pylist(), np.int64)
    hashes, counts = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    vocabulary, term = np.unique(hashes.astype(np.int64).view(np.uint64), return_inverse=True)
    owner = np.repeat(np.arange(toxic.size), size)
    weights = frequencies(docs, vocabulary) * evidence(owner, term, toxic, vocabulary.size)
    cut = np.cumsum(size)[:-1] if size.size else []
    held = list(zip(np.split(term, cut), np.split(counts.astype(np.int64), cut), strict=True)) if size.size else []
    return Model(vocabulary, weights, ids, held, toxic)


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Smoothed inverse document frequencies of the vocabulary over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def go(batches):
        lookup = Lookup(shared.value)
        total, texts = np.zeros(lookup.vocabulary.size, np.int64), 0
        for batch in batches:
            for term, _ in lookup.counts(plain_words(batch.column(0))):
                total[term] += 1
            texts += len(batch.column(0))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, hit).astype(np.int32)), pa.array(np.append(texts, total[hit]))], ["term", "n"])

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(go, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    term, n = (rows.column(c).to_numpy() for c in ("term", "n"))
    df, texts = np.zeros(vocabulary.size), float(n[term < 0].sum())
    df[term[term >= 0]] = n[term >= 0]
    return np.log((1 + texts) / (1 + df)) + 1


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the nearest labelled examples with their cosines."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches):
        held = shared.value
        known: dict[bytes, tuple] = {}
        for batch in batches:
            out = []
            for term, count in held.lookup.counts(plain_words(batch.column(1))):
                key = hashlib.blake2b(term.tobytes() + count.tobytes(), digest_size=16).digest()
                if key not in known:
                    if len(known) > KNOWN:
                        known.clear()
                    known[key] = held.score(term, count)
                out.append(known[key])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), pa.array([o[0] for o in out], pa.float64()),
                    pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float32())),
                ],
                ["doc_id", "score", "neighbours", "similarities"],
            )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(go, SCHEMA)
