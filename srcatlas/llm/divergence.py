"""Source divergence audit: how far the sources of a language differ in their words.

A term is a run of ASCII letters and other letters beyond ASCII, in lower case
for A-Z alone.  A language keeps the terms of at least ``LEAST_DOCS`` of its
documents.  A group (language, source), and a language as a whole, gives each
kept term a share ``p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``;
two groups differ by the sum of ``f(p, q) = floor((p - q)^2 / (p + q))`` over all
kept terms.

The sum is never taken term by term for each pair.  Let z be a group's share at
count zero.  By inclusion and exclusion over the supports of g and h,

    sum = V f(zg, zh)                                      as if all were zero
        + sum over terms of g  of f(pg, zh) - f(zg, zh)    one-sided, from g's histogram of counts
        + sum over terms of h  of f(zg, ph) - f(zg, zh)    one-sided, from h's histogram
        + sum over common terms of f(pg, ph) - f(pg, zh) - f(zg, ph) + f(zg, zh)

and only the last needs terms: a join of the postings (language, term, source,
count) with themselves, on language and term, once for each unordered pair as f
is symmetric.  The result itself has a row for every pair of sources of a
language, so work grows with the square of their number and with nothing else
faster than the input.

Terms are counted in Arrow batches and combined in the task before they travel.
Tables with one row for a group are spread over ``SALTS`` salts where they meet
larger ones, so that no language or source holds a task alone.  Counts are exact;
products beyond 64 bits go through decimals.

Cases: null text, lang and source count as empty strings; each row is a document,
repeated or not, whatever its id; a group whose documents hold no kept term has
N = 0 and takes part; a language that keeps no term has value 0 for every pair;
a language of one source has no pairs; ties rank by item; very long texts are
counted whole; an empty table gives no rows; only text, lang and source are read,
so further columns of any name do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, text_or_empty
from .wordhash import Words, buffers

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
PRIOR = 2
SALTS = 32
#: Counted terms that a task holds before it hands them on.
HELD = 1 << 19

_SEPARATES = np.ones(256, bool)
_SEPARATES[128:] = _SEPARATES[65:91] = _SEPARATES[97:123] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a batch in order, and the text that each comes from."""
    raw, offsets = buffers(texts)
    words = Words(raw, offsets, _SEPARATES)
    ends = np.zeros(words.begin.size + 1, np.int64)
    np.cumsum(words.end - words.begin, out=ends[1:])
    kept = np.ascontiguousarray(_LOWER[raw[~_SEPARATES[raw]]])
    found = pa.LargeStringArray.from_buffers(words.begin.size, pa.py_buffer(ends), pa.py_buffer(kept))
    return found, np.repeat(np.arange(len(texts)), np.diff(words.first))


def counted_batch(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n and docs of a batch; a term that is null stands for the group itself."""
    langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    groups: dict[tuple[str, str], int] = {}
    group = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, sources, strict=True)], np.int64)
    found, doc = terms(batch.column(0))
    coded = found.dictionary_encode()
    code, size = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    pairs, times = np.unique(doc * size + code, return_counts=True)
    merged, first, inverse = np.unique(group[pairs // size] * size + pairs % size, return_index=True, return_inverse=True)
    n = np.zeros(merged.size, np.int64)
    np.add.at(n, inverse, times)
    docs = np.bincount(inverse, minlength=merged.size)
    names = list(groups)
    of = np.concatenate((merged // size, np.arange(len(names))))
    term = coded.dictionary.take(pa.array(merged % size)).cast(pa.string())
    zero = np.zeros(len(names), np.int64)
    return pa.table(
        {
            "lang": pa.array([g[0] for g in names], pa.string()).take(pa.array(of)),
            "source": pa.array([g[1] for g in names], pa.string()).take(pa.array(of)),
            "term": pa.concat_arrays([term, pa.nulls(len(names), pa.string())]),
            "n": np.concatenate((n, zero)),
            "docs": np.concatenate((docs, zero)),
        }
    )


def postings(docs: DataFrame, hold: int = HELD) -> DataFrame:
    """lang, source, term, n occurrences in docs documents; one row with a null term for every group."""
    small_batches(docs.sparkSession)

    def go(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(counted_batch(batch))
            rows += held[-1].num_rows
            if rows > hold:
                held = [combined(held)]
                rows = held[0].num_rows
                if rows > hold // 2:
                    yield from held[0].to_batches(max_chunksize=1 << 16)
                    held, rows = [], 0
        if held:
            yield from combined(held).to_batches(max_chunksize=1 << 16)

    def combined(parts):
        whole = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return whole.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])

    read = docs.select(text_or_empty().alias("text"), text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"))
    parts = read.mapInArrow(go, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column, scale: int = SCALE, prior: int = PRIOR) -> Column:
    """p of a count; a language without kept terms has none, so its divisor is of no matter."""
    up = F.lit(scale).cast("decimal(10,0)") * (count + prior).cast("decimal(20,0)")
    down = F.greatest(total + prior * kept, F.lit(1).cast("long")).cast("decimal(20,0)")
    return (F.call_function("div", up, down) + 1).cast("long")


def distance(p: Column, q: Column) -> Column:
    """f(p, q); shares are at most about 10^9, so squares fit 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def meet(large: DataFrame, salt: Column, small: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """An equality join with a table of groups, spread over salts so that no key holds a task alone."""
    left = large.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "salt"]).drop("salt")


def vocabulary(found: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term and the language's count of each kept term."""
    sums = found.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    return sums.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n")


def shares(found: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per group: V, N, its share at zero; per kept posting: count, the group's and the language's share."""
    held = materialise(found.where(F.col("term").isNotNull()).join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-postings")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = found.where(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, ["lang"], "left")
    groups = groups.fillna(0, ["total", "v", "lang_total"])
    zero = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v")))
    groups = materialise(groups.withColumn("z", zero), "groups")
    told = meet(held, F.col("term"), groups, ["lang", "source"])
    p = share(F.col("n"), F.col("total"), F.col("v"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    return groups, materialise(told.select("lang", "source", "term", "n", p.alias("p"), q.alias("q"), "z"), "shares")


def pair_values(groups: DataFrame, told: DataFrame) -> DataFrame:
    """lang, source, item, value of every ordered pair of sources of a language."""
    one = groups.select("lang", F.col("source").alias("a"), F.col("z").alias("za"), "v")
    two = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    zeros = meet(one, F.col("a"), two, ["lang"]).where("a < b")
    zeros = zeros.select("lang", "a", "b", F.coalesce(F.col("v") * distance(F.col("za"), F.col("zb")), F.lit(0).cast("long")).alias("value"))

    histogram = told.groupBy("lang", F.col("source").alias("a"), "p", F.col("z").alias("za")).agg(F.count("*").alias("m"))
    priced = meet(histogram, F.col("p"), two, ["lang"]).where("a != b")
    gain = F.col("m") * (distance(F.col("p"), F.col("zb")) - distance(F.col("za"), F.col("zb")))
    one_sided = priced.select("lang", *ordered, gain.alias("value"))

    left = told.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    right = told.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    pa_, za, pb, zb = (F.col(c) for c in ("pa", "za", "pb", "zb"))
    fix = distance(pa_, pb) - distance(pa_, zb) - distance(za, pb) + distance(za, zb)
    common = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", fix.alias("value"))

    sums = zeros.unionByName(one_sided).unionByName(common).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return sums.select("lang", "value", F.inline(ways))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, hold: int = HELD) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: all other sources, and the ``top`` terms above the language's share."""
    found = materialise(postings(docs, hold), "postings")
    kept = materialise(vocabulary(found, least_docs), "vocabulary")
    groups, told = shares(found, kept)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pair_values(groups, told).withColumn("rank", F.row_number().over(order))
    over = told.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    best = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    def part(frame: DataFrame, name: str) -> DataFrame:
        return frame.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")

    return part(pairs, "pair").unionByName(part(best, "term"))
