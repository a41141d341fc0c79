"""Benchmark passages in documents, found through CGK embeddings.

Texts and benchmark items become words (letters and digits, lower case).  The
CGK random walk (Chakraborty, Goldenberg and Koucky, 2016) reads a window word
by word, at every step writing the current word and moving on if a shared
random function of (step, word) says so.  Windows within a small edit distance
then differ in few places, so sampling the embedding's places is a
locality-sensitive hash for edit distance.  Several walks with several samples
each are repeated until edited copies of the items, drawn at the threshold on
the driver and searched as documents are, are found at ``RECALL`` and two
standard errors more.  The walk over a long window loses its place after a few
edits, so items of ``LONG`` words and more are found by their parts: an item is
cut into parts of ``PART`` words, walks read windows of that length, and some
part of every match has no more than its share of the edits.

Windows start at every word.  Items of similar length (``GROUP``) share
windows as long as the shortest of them, or as a part.  Words in no item share
one symbol; a window with more of those than a match (or the part of it with
fewest edits) may have is skipped, and so is a match of hashes whose item has
too many words that the stretch lacks.  Both lose nothing, as each such word
costs an edit.
Candidates are verified exactly: the item's edit distance, in words, to the
best stretch of the document around the window must be at most
``floor((1 - SIMILARITY) * words of the item)``.

The benchmark is a stated query set: items are read in blocks of at most
``ITEMS`` items and ``WORDS`` words (a longer item is a block of its own), so
what is broadcast is bounded; documents are never shuffled.

Cases: null or empty texts and items without words match nothing; items of
fewer than ``1 / (1 - SIMILARITY)`` words must occur unchanged; repeated rows
give repeated results; an item found at several places of a document gives one
row, the nearest, then the first; an empty table gives no rows; very long texts
are searched whole, ``WINDOWS`` windows at a time; only doc_id and text, and
item_id and text of the benchmark, are read.  ``clean`` judges each row by its
own text, so rows that share an id or have none stay apart, and returns the
columns of its input whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty
from .wordhash import mix, plain_words

SIMILARITY = 0.8
RECALL = 0.95
#: Items of a block, and their words: a walk broadcasts a bit for each word and step, and has at most 1.6 * LONG + 1 steps.
ITEMS = 20_000
WORDS = 200_000
#: Words from which items are found by their parts, and words of a part.
LONG = 64
PART = 16
#: Places sampled for one hash of a whole item's window, and of a part's, of which an item has several; hashes for one walk.
SAMPLED = 3
PART_SAMPLED = 5
HASHES = 6
#: Longest to shortest item of a length group.
GROUP = 1.25
#: Windows hashed at once.
WINDOWS = 50_000
#: Edited copies drawn to measure the recall.
DRAWN = 2000
SCHEMA = "doc_id long, item_id long, word int, words int, distance int"


def allowed(words: int, similarity: float = SIMILARITY) -> int:
    return math.floor((1 - similarity) * words + 1e-9)


@dataclass
class Group:
    """Items of similar length; their windows are as long as the shortest, or as a part."""

    items: np.ndarray  # rows of ``Index.items``
    least: int
    length: int  # words of a window
    parts: dict[int, list[int]]  # where in each item its windows begin; some part of a match has at most ``spare`` edits
    reach: int  # words that such a part has at least
    spare: int  # unknown words that it has at most
    local: np.ndarray  # the block's symbols as numbers of this group's words, 0 for others
    words: int  # distinct words of the group


class Walk:
    """One CGK walk over windows of ``length`` words, its samples and hash tables.

    Symbol 0 is any word in no item, -1 the padding after a window.
    """

    def __init__(self, seed: int, symbols: int, length: int, sampled: int = SAMPLED):
        rng = np.random.default_rng(seed)
        self.length = length
        steps = int(1.6 * length) + 1
        self.moves = rng.integers(0, 256, (symbols + 1, (steps + 7) // 8), np.uint8)  # a bit per symbol and step
        samples = [np.sort(rng.choice(steps, min(sampled, steps), replace=False)) for _ in range(HASHES)]
        self.keep = np.unique(np.concatenate(samples))
        self.rows = [np.searchsorted(self.keep, s) for s in samples]
        self.tables: list[tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]] = []

    def keys(self, grid: np.ndarray) -> list[np.ndarray]:
        """One key per sample for every row of ``grid`` (windows x length symbols)."""
        padded = np.concatenate((grid, np.full((grid.shape[0], 1), -1, np.int32)), axis=1).ravel()
        begin = np.arange(grid.shape[0]) * (self.length + 1)
        at = np.zeros(grid.shape[0], np.int64)
        kept = []
        for step in range(int(self.keep[-1]) + 1):
            symbol = padded[begin + at]
            if step == self.keep[len(kept)]:
                kept.append(symbol.astype(np.int64).view(np.uint64))
            at += (self.moves[symbol, step >> 3] >> np.uint8(step & 7)) & 1
            np.minimum(at, self.length, out=at)
        keys = []
        for r in self.rows:
            h = np.zeros(grid.shape[0], np.uint64)
            for k in r:
                h = h * np.uint64(0x9E3779B97F4A7C15) + kept[k]
            keys.append(mix(h))
        return keys

    def learn(self, parts: list[tuple[int, int]], grid: np.ndarray) -> None:
        """``parts``: an item and a place in it for every row of ``grid``."""
        for key in self.keys(grid):
            table: dict[int, list[tuple[int, int]]] = {}
            for part, k in zip(parts, key.tolist(), strict=True):
                table.setdefault(k, []).append(part)
            keys = np.array(sorted(table), np.uint64)
            bits = np.zeros(1 << 16, bool)
            bits[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.tables.append((keys, bits, [table[k] for k in sorted(table)]))

    def lookup(self, grid: np.ndarray):
        """(window, parts with its key) of every match."""
        for key, (keys, bits, parts) in zip(self.keys(grid), self.tables, strict=True):
            maybe = np.flatnonzero(bits[(key >> np.uint64(48)).astype(np.int64)])
            if maybe.size:
                k = np.minimum(np.searchsorted(keys, key[maybe]), keys.size - 1)
                hit = keys[k] == key[maybe]
                yield from zip(maybe[hit].tolist(), [parts[j] for j in k[hit].tolist()], strict=True)


class Index:
    """The items of one block with their walks and hash tables."""

    def __init__(self, ids: list[int], items: list[np.ndarray], similarity: float = SIMILARITY, recall: float = RECALL):
        self.similarity = similarity
        pairs = [(i, w) for i, w in zip(ids, items, strict=True) if w.size]
        self.ids = [i for i, _ in pairs]
        self.vocabulary = np.unique(np.concatenate([w for _, w in pairs] or [np.empty(0, np.uint64)]))
        self.items = [(np.searchsorted(self.vocabulary, w) + 1).astype(np.int32) for _, w in pairs]
        self.sets = [frozenset(w.tolist()) for w in self.items]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.groups = self._groups()
        self.plans = [self._plan(g, recall) for g in self.groups]

    def _groups(self) -> list[Group]:
        sizes = np.array([w.size for w in self.items], np.int64)
        order, groups, at = np.argsort(sizes, kind="stable"), [], 0
        while at < order.size:
            least = int(sizes[order[at]])
            stop = at + int(np.searchsorted(sizes[order[at:]], max(least, int(least * GROUP)), "right"))
            rows = order[at:stop]
            own = np.unique(np.concatenate([self.items[i] for i in rows.tolist()]))
            local = np.zeros(self.vocabulary.size + 1, np.int32)
            local[own] = np.arange(1, own.size + 1)
            groups.append(Group(rows, least, *self._windows(rows.tolist(), least), local, own.size))
            at = stop
        return groups

    def _windows(self, rows: list[int], least: int) -> tuple[int, dict[int, list[int]], int, int]:
        """Length, parts, reach and spare of a group's windows."""
        if least < LONG:
            spare = max(allowed(self.items[i].size, self.similarity) for i in rows)
            return least, {i: [0] for i in rows}, least - allowed(least, self.similarity), spare
        parts = {i: np.linspace(0, self.items[i].size - PART, self.items[i].size // PART).astype(int).tolist() for i in rows}
        # parts do not overlap, so not all of them have more than their share
        spare = max(allowed(self.items[i].size, self.similarity) // len(parts[i]) for i in rows)
        return PART, parts, max(1, PART - spare), spare

    def _plan(self, group: Group, recall: float) -> list[Walk]:
        """As many walks as the recall asks for, measured on edited items."""
        rng = np.random.default_rng(group.least)
        drawn = [self._edited(group, rng) for _ in range(DRAWN)]
        symbols = np.concatenate([words for _, words in drawn])
        first = np.concatenate(([0], np.cumsum([words.size for _, words in drawn])))
        # stopping at the first walk that reaches it favours lucky draws
        enough = recall + 2 * math.sqrt(recall * (1 - recall) / DRAWN)
        found = np.zeros(DRAWN, bool)
        parts = [(i, place) for i, places in group.parts.items() for place in places]
        grid = np.stack([group.local[self.items[i][place : place + group.length]] for i, place in parts])
        plan = []
        while found.mean() < enough and (group.spare or not plan):
            walk = Walk(1000 * group.least + len(plan), group.words, group.length, SAMPLED if group.length == group.least else PART_SAMPLED)
            walk.learn(parts, grid)
            plan.append(walk)
            for text, item, _ in self.candidates(symbols, first, [(group, [walk])]):
                found[text] = found[text] or item == drawn[text][0]
        return plan

    def _edited(self, group: Group, rng) -> tuple[int, np.ndarray]:
        """An item with as many random edits as are allowed, between unknown words."""
        item = int(rng.choice(group.items))
        words = self.items[item].tolist()
        for _ in range(allowed(len(words), self.similarity)):
            at, kind = int(rng.integers(0, len(words))), int(rng.integers(0, 3))
            if kind == 0:
                words[at] = 0
            elif kind == 1:
                words.insert(at, 0)
            elif len(words) > 1:
                del words[at]
        return item, np.array([0, 0, *words, *[0] * (group.least + 4)], np.int32)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """0 for words in no item, else the word's number."""
        out = np.zeros(hashes.size, np.int32)
        maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)])
        if maybe.size:
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), self.vocabulary.size - 1)
            hit = self.vocabulary[at] == hashes[maybe]
            out[maybe[hit]] = at[hit] + 1
        return out

    def candidates(self, symbols: np.ndarray, first: np.ndarray, plans: list | None = None) -> set[tuple[int, int, int]]:
        """(text, item, window start) of the hash matches in a batch that may be within the threshold."""
        found: set[tuple[int, int, int]] = set()
        n = symbols.size
        unknown = np.concatenate(([0], np.cumsum(symbols == 0))).astype(np.int32)
        ends = np.repeat(first[1:], np.diff(first))
        for group, plan in plans or zip(self.groups, self.plans, strict=True):
            # a word in no item of the group costs each of them an edit
            own = group.local.take(symbols)
            missing = np.concatenate(([0], np.cumsum(own == 0))).astype(np.int32)
            few = missing[group.reach :] - missing[: n + 1 - group.reach] <= group.spare if n >= group.reach else np.empty(0, bool)
            # a match may as well begin at a known word: dropping an unknown first word costs no more
            start = np.flatnonzero(few[:n] & (own[: few.size] > 0))
            start = start[ends[start] - start >= group.reach]
            for low in range(0, start.size, WINDOWS):
                part = start[low : low + WINDOWS]
                # words after the text's end are unknown
                at = part[:, None] + np.arange(group.length)
                grid = np.where(at < ends[part][:, None], own[np.minimum(at, n - 1)], 0).astype(np.int32)
                for walk in plan:
                    for w, parts in walk.lookup(grid):
                        here = int(part[w])
                        text = int(np.searchsorted(first, here, "right")) - 1
                        for item, place in parts:
                            size = self.items[item].size
                            slack = allowed(size, self.similarity)
                            if group.length == group.least:
                                stop = here + size - slack
                                if stop <= first[text + 1] and missing[stop] - missing[here] <= slack:
                                    found.add((text, item, here))
                                continue
                            # a match begins within the allowed edits of where its part puts it
                            begin = here - place
                            low, high = max(int(first[text]), begin - slack), min(int(first[text + 1]), begin + size + 2 * slack)
                            if high - low - (missing[high] - missing[low]) >= size - slack:
                                found.add((text, item, max(int(first[text]), begin)))
        return found

    def matches(self, symbols: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, first word, words, distance) of every verified item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        for text, item, start in sorted(self.candidates(symbols, first)):
            words = self.items[item]
            slack = allowed(words.size, self.similarity)
            block = start // (slack + 1) * (slack + 1)
            if (text, item, block) in seen:
                continue  # the stretch around a neighbouring window held this one
            seen.add((text, item, block))
            # the stretch holds every match that begins within a slack of any window of its block
            low = max(int(first[text]), block - slack)
            high = min(int(first[text + 1]), block + words.size + 3 * slack + 1)
            # every distinct word that is missing costs an edit
            if len(self.sets[item].difference(symbols[low:high].tolist())) > slack:
                continue
            distance, begin, end = nearest(words, symbols[low:high], slack)
            if distance <= slack:
                here = (distance, low - int(first[text]) + begin, end - begin)
                best[text, item] = min(best.get((text, item), here), here)
        return [(text, self.ids[item], at, size, distance) for (text, item), (distance, at, size) in sorted(best.items())]


def nearest(item: np.ndarray, words: np.ndarray, most: int) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to any stretch of ``words``: (distance, begin, end).

    Symbol 0 differs from every word.  A distance above ``most`` comes back as
    ``most + 1``.
    """
    size = item.size
    column = np.arange(size + 1)
    origin = np.zeros(size + 1, np.int64)
    best = (min(size, most + 1), 0, 0)  # the empty stretch
    ramp = np.arange(size + 1)
    for j, word in enumerate(words.tolist(), 1):
        swap = column[:-1] + (item != word)
        drop = column[1:] + 1
        step = np.concatenate(([0], np.minimum(swap, drop)))
        source = np.concatenate(([j], np.where(swap <= drop, origin[:-1], origin[1:])))
        # skipped words of the item: a running minimum along the column
        low = step - ramp
        least = np.minimum.accumulate(low)
        from_at = np.maximum.accumulate(np.where(low == least, ramp, 0))
        column, origin = least + ramp, source[from_at]
        if column[-1] < best[0]:
            best = (int(column[-1]), int(origin[-1]), j)
    return best


def blocks(benchmark: DataFrame, size: int = ITEMS, most: int = WORDS):
    """The benchmark's items as arrays of word hashes, at most ``size`` items and ``most`` words at a time."""
    ids, items, words = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), text_or_empty().alias("text")).toLocalIterator():
        item = _hashed([row[1]])[0]
        if ids and (len(ids) == size or words + item.size > most):
            yield ids, items
            ids, items, words = [], [], 0
        ids.append(row[0])
        items.append(item)
        words += item.size
    if ids:
        yield ids, items


def _hashed(texts: list[str]) -> list[np.ndarray]:
    words = plain_words(pa.array(texts, pa.string()))
    return np.split(words.hashes(), words.first[1:-1])


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, word, words, distance) of every item in every document."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    result = None
    for ids, items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index(ids, items, similarity, recall))

        def go(batches, shared=shared):
            for batch in batches:
                words = plain_words(batch.column(1))
                found = shared.value.matches(shared.value.symbols(words.hashes()), words.first)
                doc = batch.column(0).to_pylist()
                rows = [(doc[t], i, at, n, d) for t, i, at, n, d in found]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "word", "words", "distance"])

        part = texts.mapInArrow(go, SCHEMA)
        result = part if result is None else result.unionByName(part)
    if result is None:
        result = texts.where(F.lit(False)).select(
            "doc_id", F.lit(0).cast("long").alias("item_id"), *[F.lit(0).alias(c) for c in ("word", "words", "distance")]
        )
    return result


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    for ids, items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index(ids, items, similarity, recall))
        docs = docs.where(~_holds(shared)(text_or_empty()))
    return docs


def _holds(shared):
    """Whether a text holds an item of the index: each row is judged by its own text, whatever its id."""

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        words = plain_words(pa.array(texts, pa.string()))
        found = np.zeros(len(texts), bool)
        found[[t for t, *_ in shared.value.matches(shared.value.symbols(words.hashes()), words.first)]] = True
        return pd.Series(found)

    return holds
