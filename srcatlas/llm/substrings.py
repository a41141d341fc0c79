"""Removal of repeated passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the smallest hash
among its runs of ``RUN`` words; consecutive windows that share one form a
super-k-mer.  Equal windows have equal minimisers, so

1. every text gives its super-k-mers as (first window, windows, minimiser);
   exact copies of a text count once, under their smallest id, and of equal
   rows one travels on;
2. minimisers seen in one text only cannot hold a repeated window and go;
3. the other super-k-mers travel as one packed string each to the bucket of
   their minimiser; equal strings are combined before the shuffle.  In the
   bucket, sorting ranks the windows exactly and gives each its smallest id;
4. minimisers with more than ``HOT`` different strings (a passage that a large
   share of the corpus holds in changing surroundings) are split: their
   windows are dealt out one by one by 128-bit hashes, again combined before
   the shuffle, so no bucket grows with the corpus.  Both ways rank every
   window, so the limit decides where the work is done, not what is found;
5. every word covered by a window that also starts in a text with a smaller id
   is removed.  Windows are judged on the input.

Cases: a null text has no words; texts shorter than a window keep all words;
equal (id, text) rows share one result and do not count against each other; a
null id owns nothing and loses only what others own; an empty table gives no
rows; very long texts are handled whole; only doc_id and text are read, so
further columns of any name do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, text_or_empty
from .wordhash import raw_words, sequence_hashes

WINDOW = 50
RUN = 8
HOT = 2000
#: Different texts that a task remembers, to pass on one of equal rows.
SEEN = 1 << 20
#: Words that a bucket task ranks at once.
RANKED = 400_000

_KEYS = "doc_id long, k1 long, k2 long"
_FIELDS = [("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a 128-bit key of the text, and the text."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(17), text).alias("k2"),
        text.alias("text"),
    )


def once(texts: DataFrame) -> DataFrame:
    """Without the repeats of (id, text) that a task meets itself; those of other tasks stay."""

    def go(batches):
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            yield batch.filter(pa.array([not (k in seen or seen.add(k)) for k in keys], pa.bool_()))

    return texts.mapInArrow(go, texts.schema)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: out.size - rest], out[rest:]) if rest else out


def super_kmers(words: np.ndarray, first: np.ndarray, window: int, run: int):
    """(text, first window, windows, minimiser) of every super-k-mer of a batch."""
    if words.size < window:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    low = sliding_min(sequence_hashes(words, run), window - run + 1)
    text = np.repeat(np.arange(first.size - 1), np.diff(first))[: low.size]
    whole = np.arange(low.size) + window <= first[1:][text]
    opens = whole.copy()
    opens[1:] &= ~whole[:-1] | (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(opens)
    stops = np.flatnonzero(whole & ~np.concatenate((whole[1:] & ~opens[1:], [False]))) + 1
    return text[begin], begin - first[text[begin]], stops - begin, low[begin].view(np.int64)


def scan(docs: DataFrame, window: int, run: int) -> DataFrame:
    """Per text: its words' number and digest, and its super-k-mers."""

    def go(batches):
        for batch in batches:
            texts = batch.column(3)
            words = raw_words(texts)
            at, start, n, low = super_kmers(words.hashes(), words.first, window, run)
            cut = np.searchsorted(at, np.arange(len(texts) + 1)).astype(np.int32)
            kept = [hashlib.sha256(b" ".join(t.as_buffer().to_pybytes().split())).hexdigest() for t in texts.cast(pa.large_binary())]
            lists = [pa.ListArray.from_arrays(cut, pa.array(v, t)) for v, t in ((start, pa.int32()), (n, pa.int32()), (low, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(words.first), pa.int64()), pa.array(kept, pa.string()), *lists],
                ["doc_id", "k1", "k2", "n_words", "sha", "starts", "ns", "lows"],
            )

    return docs.mapInArrow(go, f"{_KEYS}, n_words long, sha string, starts array<int>, ns array<int>, lows array<long>")


def window_classes(words: np.ndarray, window: int) -> np.ndarray:
    """Equal numbers for equal windows: ranks of doubling runs of exact word ids."""
    rank, have = words, 1
    while 2 * have <= window:
        pair = rank[: rank.size - have] * np.int64(rank.max() + 1) + rank[have:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        have *= 2
    rest = window - have
    if rest:
        pair = rank[: rank.size - rest] * np.int64(rank.max() + 1) + rank[rest:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    return rank


def _owners(packed: list[bytes], docs: np.ndarray, window: int) -> list[np.ndarray]:
    """For every string the smallest id holding each of its windows."""
    ids: dict[bytes, int] = {}
    words, bounds = [], [0]
    for p in packed:
        words += [ids.setdefault(w, len(ids)) for w in p.split()]
        bounds.append(len(words))
    edges = np.array(bounds)
    classes = window_classes(np.array(words, np.int64), window)
    n = np.diff(edges) - window + 1
    at = np.concatenate([np.arange(b, b + k) for b, k in zip(edges[:-1], n, strict=True)])
    kind = classes[at]
    least = np.full(classes.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, np.repeat(docs, n))
    return np.split(least[kind], np.cumsum(n)[:-1])


def bucket_owners(strings: DataFrame, window: int) -> DataFrame:
    """Sorts each minimiser's windows; one row per packed string with its windows' owners."""

    def flush(rows):
        found = _owners([r[3] for r in rows], np.array([r[4] for r in rows], np.int64), window)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2)] + [pa.array(found, pa.list_(pa.int64()))],
            ["p1", "p2", "owners"],
        )

    def go(batches):
        rows, words = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words > RANKED and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, words = [], 0
                rows.append(row)
                words += row[3].count(b" ") + 1
        if rows:
            yield flush(rows)

    ordered = strings.repartition("low").sortWithinPartitions("low")
    return ordered.select("low", "p1", "p2", "packed", "doc_id").mapInArrow(go, "p1 long, p2 long, owners array<long>")


def split_owners(strings: DataFrame, window: int) -> DataFrame:
    """The same for hot minimisers, window by window."""

    def go(batches):
        for batch in batches:
            out = []
            for p1, p2, packed, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = packed.split()
                for at in range(len(words) - window + 1):
                    h = xxhash.xxh3_128_intdigest(b" ".join(words[at : at + window]))
                    out.append((p1, p2, at, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), doc))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["p1", "p2", "at", "w1", "w2", "doc_id"])

    windows = materialise(strings.select("p1", "p2", "packed", "doc_id").mapInArrow(go, "p1 long, p2 long, at long, w1 long, w2 long, doc_id long"), "windows")
    least = materialise(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner")), "owners")
    placed = windows.join(least, ["w1", "w2"]).groupBy("p1", "p2").agg(F.sort_array(F.collect_set(F.struct("at", "owner"))).alias("o"))
    return placed.select("p1", "p2", F.col("o.owner").alias("owners"))


def packed_strings(held: DataFrame, window: int) -> DataFrame:
    """The surviving super-k-mers of each text, as packed strings with a 128-bit key."""

    def go(batches):
        for batch in batches:
            out = []
            doc, k1, k2 = (c.to_pylist() for c in batch.columns[:3])
            for i, (text, found) in enumerate(zip(batch.column(3).cast(pa.large_binary()), batch.column(4).to_pylist(), strict=True)):
                words = text.as_buffer().to_pybytes().split()
                for s in found:
                    packed = b" ".join(words[s["start"] : s["start"] + s["n"] + window - 1])
                    h = xxhash.xxh3_128_intdigest(packed)
                    out.append((doc[i], k1[i], k2[i], s["start"], s["low"], (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), packed))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "k1", "k2", "start", "low", "p1", "p2", "packed"]
            )

    return held.mapInArrow(go, f"{_KEYS}, start int, low long, p1 long, p2 long, packed binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every row."""
    small_batches(docs.sparkSession)
    texts = keyed(docs)
    seen = materialise(scan(texts, window, run), "kmers")

    # exact copies count once, under their smallest id
    firsts = seen.groupBy("k1", "k2").agg(F.min_by(F.struct("starts", "ns", "lows"), "doc_id").alias("s"), F.min("doc_id").alias("doc_id"))
    firsts = firsts.where(F.col("doc_id").isNotNull() & (F.size("s.starts") > 0))
    kmers = firsts.select("doc_id", "k1", "k2", F.explode(F.arrays_zip("s.starts", "s.ns", "s.lows")).alias("z")).select(
        "doc_id", "k1", "k2", F.col("z.starts").alias("start"), F.col("z.ns").alias("n"), F.col("z.lows").alias("low")
    )
    # written first: a join of two plain shuffles can split a hot minimiser, one with an aggregate cannot
    shared = materialise(kmers.groupBy("low").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("low"), "shared")
    surviving = kmers.join(shared, "low").groupBy("doc_id", "k1", "k2").agg(F.collect_list(F.struct("start", "n", "low")).alias("found"))
    # texts travel once, one of equal rows; those with surviving super-k-mers are kept for the cut
    joined = once(texts).join(surviving, ["doc_id", "k1", "k2"]).groupBy("doc_id", "k1", "k2").agg(F.first("text").alias("text"), F.first("found").alias("found"))
    held = materialise(joined, "held")
    occurrences = materialise(packed_strings(held, window), "packed")

    # equal strings are combined in every task before they travel
    strings = occurrences.groupBy("low", "p1", "p2", "packed").agg(F.min("doc_id").alias("doc_id"))
    crowded = materialise(occurrences.groupBy("low").agg(F.approx_count_distinct("p1").alias("n")).where(F.col("n") > hot).select("low"), "crowded")
    strings = materialise(strings, "strings")
    cool = bucket_owners(strings.join(crowded, "low", "left_anti"), window)
    warm = split_owners(strings.join(crowded, "low", "left_semi"), window)
    owners = cool.unionByName(warm)

    lost = occurrences.select("doc_id", "k1", "k2", "start", "p1", "p2").join(owners, ["p1", "p2"])
    lost = lost.select(
        "doc_id", "k1", "k2",
        F.expr("filter(transform(owners, (o, i) -> if(o < doc_id, start + i, -1)), x -> x >= 0)").alias("at"),
    ).where(F.size("at") > 0)
    marks = lost.groupBy("doc_id", "k1", "k2").agg(F.flatten(F.collect_list("at")).alias("at"))
    marked = _cut(held.drop("found"), marks, window)

    first = materialise(seen.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id")), "firsts")
    base = seen.select("doc_id", "k1", "k2", "n_words", "sha").join(first, ["k1", "k2"])
    copy = (F.col("first_id") < F.col("doc_id")) & (F.col("n_words") >= window)
    nothing = hashlib.sha256(b"").hexdigest()
    joined = base.join(marked, (base["k1"] == marked["m1"]) & (base["k2"] == marked["m2"]) & base["doc_id"].eqNullSafe(marked["m0"]), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def _cut(texts: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """Removes the marked windows' words; one row per marked (id, text)."""

    def go(batches):
        for batch in batches:
            out = []
            for text, at in zip(batch.column(3).cast(pa.large_binary()), batch.column(4), strict=True):
                words = text.as_buffer().to_pybytes().split()
                cover = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(at.values.to_numpy())
                cover[starts] += 1
                np.subtract.at(cover, starts + window, 1)
                stay = np.cumsum(cover[:-1]) == 0
                kept = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                out.append((int((~stay).sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], ["m0", "m1", "m2", "n_removed", "kept_sha256"]
            )

    return texts.join(marks, ["doc_id", "k1", "k2"]).mapInArrow(go, "m0 long, m1 long, m2 long, n_removed long, kept_sha256 string")
