"""Language identification with bit-sliced Bloom filters of n-grams.

A language holds the n-grams that its training texts use at least ``LEAST``
times and at no less than ``SHARE`` of their largest rate in any language (so a
stray quotation does not make an n-gram part of a language).  A Bloom filter
has one bit slice per language: a slot is a machine word, or several, with a
bit for each language.  One probe ANDs the words at ``HASHES`` slots and
returns the bitmask of all languages that hold the n-gram.  A document's score
for a language is the popcount of its bit over all n-grams of the text,
corrected for that slice's false-positive rate; the largest one decides.

Training takes at most ``TRAIN_DOCS`` labelled documents per language, those
with the smallest hashes, or all labelled rows if asked to, and counts their whole texts on the executors; what
reaches the driver is the filter's non-empty slots, at most ``SLOTS`` words for
every 64 languages, whatever the corpus.  Every document is scored on its whole
text; long texts go through in parts that give the n-grams of the whole.

Cases: a null text, or one without a letter, is ``und`` with score 0; without
any trained language every text is ``und``; ties go to the first language in
alphabetical order; repeated rows give equal rows; an empty table gives no
rows; null languages do not train, null texts count for nothing; only doc_id,
text and lang are read, so further columns of any name do not matter, and
``keep_recognised`` returns them as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, materialise, small_batches

GRAM = 4
SLOTS = 1 << 20
HASHES = 2
SHARE = 0.3
LEAST = 3
TRAIN_DOCS = 1000
#: N-grams that a task holds before it counts them.
HELD = 1 << 23
#: Code points scored at once.
CHUNK = 1 << 20
#: Languages in one machine word.
WORD = 64
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double"


def _letters() -> np.ndarray:
    """For code points below 65536: the lower-case letter, or a space."""
    table = np.full(1 << 16, 32, np.uint32)
    for point in range(1 << 16):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            table[point] = ord(low[0])
    return table


@functools.cache
def letters() -> np.ndarray:
    return _letters()


def points(text: str) -> np.ndarray:
    """Letters in lower case with single spaces between and around words."""
    return _single(np.concatenate(([32], _mapped(text), [32])))


def _mapped(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    mapped = letters()[np.minimum(raw, 65535)]
    if (raw > 65535).any():  # astral letters stand for themselves
        mapped = np.where(raw > 65535, np.fromiter((ord(c) if c.isalpha() else 32 for c in text), np.uint32, len(raw)), mapped)
    return mapped


def _single(mapped: np.ndarray) -> np.ndarray:
    """Runs of spaces become one."""
    mapped = mapped.astype(np.uint32)
    space = mapped == 32
    return mapped[np.concatenate(([True], ~(space[1:] & space[:-1])))]


def text_grams(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a whole text, part by part."""
    tail = np.array([32], np.uint32)
    for at in range(0, len(text), CHUNK):
        last = [32] if at + CHUNK >= len(text) else []
        spelled = _single(np.concatenate((tail, _mapped(text[at : at + CHUNK]), last)))
        yield grams(spelled)
        # windows that begin here end in the next part
        tail = spelled[-(GRAM - 1) :]


def grams(spelled: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every window of GRAM letters."""
    n = spelled.size - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h << np.uint64(16)) ^ spelled[k : k + n].astype(np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    width = SLOTS.bit_length() - 1
    return [((hashes >> np.uint64(k * width + 4)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


class Model:
    """The filter (slots x words), its languages, and each slice's false-positive rate."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table
        self.places = [(bit // WORD, np.uint64(1 << bit % WORD)) for bit in range(len(languages))]
        self.false = np.array([((table[:, w] & b) > 0).mean() for w, b in self.places]) ** HASHES

    @classmethod
    def of(cls, languages: list[str], slot: np.ndarray, word: np.ndarray, bits: np.ndarray) -> Model:
        table = np.zeros((SLOTS, max(1, -(-len(languages) // WORD))), np.uint64)
        np.bitwise_or.at(table, (slot, word), bits)
        return cls(languages, table)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """For every n-gram the bits of all languages that hold it."""
        return functools.reduce(np.bitwise_and, [self.table[w] for w in slots(hashes)])

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Per-language popcounts over all n-grams of the whole text, and their number."""
        hits, total = np.zeros(len(self.languages)), 0
        for hashes in text_grams(text):
            mask = self.masks(hashes)
            hits += [np.count_nonzero(mask[:, w] & b) for w, b in self.places]
            total += hashes.size
        return hits, total

    def weigh(self, text: str | None) -> tuple[str, float, float]:
        """The language, its share among the languages' popcounts, and its share of the text's n-grams."""
        if not text or not self.languages:
            return UNKNOWN, 0.0, 0.0
        hits, total = self.counts(text)
        if not total and not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        true = np.clip((hits - total * self.false) / (1 - self.false), 0, None)
        best = int(true.argmax())
        return self.languages[best], float(true[best] / true.sum()) if true.sum() else 0.0, float(true[best] / max(1, total))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.weigh(text)[:2]

    def recognises(self, text: str | None, least: float) -> bool:
        """Whether the predicted language holds this share of the text's n-grams; without languages, whether there is a letter."""
        if not self.languages:
            return any(map(str.isalpha, text or ""))
        lang, _, share = self.weigh(text)
        return lang != UNKNOWN and share >= least


def training_rows(docs: DataFrame, usable: Column, per_language: int | None = TRAIN_DOCS) -> DataFrame:
    """At most ``per_language`` different documents of each language, those with the smallest hashes of id and text; None: every row.

    Hashes alone are ranked, a few from each partition; whole texts are read only where they are chosen.
    """
    if per_language is None:
        return docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    turn = F.xxhash64("doc_id", "text", F.lit(5))
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", turn.alias("turn"))
    ranked = known.select("lang", "turn").distinct().withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("turn")))
    last = ranked.where(F.col("at") <= per_language).groupBy("lang").agg(F.max("turn").alias("last"))
    # a row a language, as many as the filter has slices on every worker anyway
    picked = known.join(F.broadcast(last), "lang").where(F.col("turn") <= F.col("last"))
    return picked.groupBy("lang", "turn").agg(F.min("text").alias("text")).select("lang", "text")


def filter_bits(texts: DataFrame, languages: list[str]) -> DataFrame:
    """slot, word and bits of the filter that holds every language's n-grams, from lang and text."""
    number = {lang: i for i, lang in enumerate(languages)}

    def counts(held):
        for lang, found in held.items():
            keys, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(keys.size, lang, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    def count(batches):
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for found in text_grams(text):
                    held.setdefault(number[lang], []).append(found)
                    size += found.size
                if size > HELD:
                    yield from counts(held)
                    held, size = {}, 0
        yield from counts(held)

    counted = texts.select("lang", "text").mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counted.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))  # a row a language
    # a gram has at most one row a language
    held = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "n", "rate")).alias("in"))
    held = held.select("gram", F.explode(F.filter("in", lambda x: (x["n"] >= LEAST) & (x["rate"] >= SHARE * F.col("top")))).alias("x"))
    width = SLOTS.bit_length() - 1
    where = F.array(*[F.shiftrightunsigned("gram", k * width + 4).bitwiseAND(F.lit(SLOTS - 1)).cast("int") for k in range(HASHES)])
    set_bits = held.select(F.explode(where).alias("slot"), F.floor(F.col("x.lang") / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, x.lang % {WORD})").alias("bits"))
    return set_bits.groupBy("slot", "word").agg(F.bit_or("bits").alias("bits"))


def train(docs: DataFrame, usable: Column, per_language: int | None = TRAIN_DOCS) -> Model:
    """The filter learned from a draw of each language, or from all labelled rows (``per_language`` None)."""
    small_batches(docs.sparkSession)
    picked = training_rows(docs, usable, per_language)
    if per_language is not None:
        picked = materialise(picked, "training")
    languages = sorted(r["lang"] for r in picked.select("lang").distinct().collect())
    if not languages:
        return Model(languages, np.zeros((1, 1), np.uint64))
    rows = filter_bits(picked, languages).toArrow()
    slot, word, bits = (rows.column(c).to_numpy() for c in ("slot", "word", "bits"))
    return Model.of(languages, slot, word, bits.view(np.uint64))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row; the model travels once per executor."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))

    def run(batches):
        held = Model(*shared.value)
        for batch in batches:
            found = [held.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_recognised(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows, with all their columns, of whose n-grams the predicted language holds at least this share.

    Without a trained language nothing can be told apart, and all rows with a letter stay.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))

    @F.pandas_udf("boolean")
    def recognised(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = Model(*shared.value)
        for texts in batches:
            yield pd.Series([held.recognises(t, least) for t in texts], dtype=bool)

    return docs.where(recognised("text"))


def held_out(column: Column, divisor: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(fold(column, divisor) == remainder, F.lit(False))
