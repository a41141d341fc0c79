"""Best-two-fit packing of tokenised documents into fixed-size sequences.

Documents become pieces of at most ``size`` tokens; only longer documents are
cut.  Pieces are scattered by a hash of their row and number into buckets of
about ``bucket_pieces``, so no long document, hot source or repeated row fills
one bucket, and each bucket is packed on its own: open a sequence, add the longest piece
that still fits until none does, then try to replace the sequence's smallest
piece with two unpacked pieces that fill the enlarged gap more tightly.  A
bucket leaves at most a few sequences short of full, a share that does not
grow with the corpus.

Cases: a null text is an empty one and gives a piece holding the end id alone;
repeated rows and ids are packed as separate documents; ties go to the smaller
id; an empty table gives no rows; very long texts are tokenised whole, word by
word; only ``doc_id`` and ``text`` are read, so further columns of any name do
not matter.  A tokenizer whose file is not of the kind that ``WordTokenizer``
knows encodes whole texts, as slowly as it does by itself.

Rows are numbered by partition as they are read: hand in rows as they lie in
files or a written table, not those of a shuffle that may deliver them in
another order after a lost executor.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty
from .wordhash import Words, raw_words

SIZE = 2048
END = 0
BUCKET_PIECES = 4096
#: Text bytes that make a token, at most, on average: only the number of buckets depends on it.
TOKEN_BYTES = 4
#: Slots of a worker's word table, the ids it points to, and parts of words remembered in each of two generations.
SLOTS = 1 << 20
POOL = 3 << 21
PARTS = 100_000
LONG = 512
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, row long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Generations:
    """A bounded table that forgets what the last two generations did not use."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """The unknown keys; known ones are kept for another generation."""
        if len(self.young) + len(keys) > self.most:
            self.old, self.young = self.young, {}
        absent = keys.difference(self.young)
        for key in absent & self.old.keys():
            self.young[key] = self.old[key]
            absent.discard(key)
        return list(absent)


class WordTokenizer:
    """Ids of whole texts, built from the ids of their words.

    The tokenizer never joins anything across ASCII white space, nor letters
    with the punctuation after them, and it lowers the case.  So a text's ids
    are those of its words in order, and a word's are those of its letters and
    of its punctuation.  Words are looked up by 64-bit hashes in an array of
    ``SLOTS`` (each has two places) that points into a pool of ids; when the
    pool is full both start anew.  At most a few million words are known at a
    time, so two of them share a hash with a chance of one in a million; words
    longer than ``LONG`` bytes, whose hashes could be forged, are not looked up.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = Generations(PARTS)
        self.fresh = 1
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int32)
        self.size = np.zeros(SLOTS, np.int32)
        self.pool = np.zeros(POOL, np.uint32)
        self.used = 0

    def encode_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encode(raw_words(column))

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a batch, and where each text's begin."""
        hashes = np.maximum(words.hashes(), np.uint64(1))  # 0 marks a free slot
        long = np.flatnonzero(words.end - words.begin > LONG)
        if long.size:  # numbers of equal words instead, which no look-up finds twice
            known: dict[bytes, int] = {}
            hashes[long] = [self.fresh + known.setdefault(words.raw[b:e].tobytes(), len(known)) for b, e in zip(words.begin[long].tolist(), words.end[long].tolist(), strict=True)]
            self.fresh += len(known)
        if self.used > POOL // 2:
            self._clear()
        places = [(hashes & np.uint64(SLOTS - 1)).astype(np.int32), ((hashes >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int32)]
        place = np.where(self.keys[places[0]] == hashes, places[0], places[1])
        at, size = self.at[place], self.size[place]
        missed = np.flatnonzero(self.keys[place] != hashes)
        if missed.size:
            new, where, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            where = missed[where]
            start, length = self._add([words.raw[b:e].tobytes() for b, e in zip(words.begin[where].tolist(), words.end[where].tolist(), strict=True)])
            at[missed], size[missed] = start[back], length[back]
            self._store(new, start, length, places[0][where], places[1][where])
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.pool[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if ends.size else 0)]
        return ids, np.concatenate(([0], ends))[words.first]

    def _store(self, new: np.ndarray, start: np.ndarray, length: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """Points a free first slot at each new word, else its second one, whatever that held."""
        free = self.keys[one] == 0
        self.keys[one[free]] = new[free]
        won = self.keys[one] == new
        self.at[one[won]], self.size[one[won]] = start[won], length[won]
        self.keys[two[~won]] = new[~won]
        won = ~won & (self.keys[two] == new)
        self.at[two[won]], self.size[two[won]] = start[won], length[won]

    def _add(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Puts words' ids into the pool."""
        halves = [halve(w.decode("utf-8")) for w in new]
        self._learn(self.parts.missing({p for h in halves for p in h}))
        parts = self.parts.young
        made = [parts[a] + parts[b] for a, b in halves]
        length = np.array([len(m) // 4 for m in made], np.int32)
        ids = np.frombuffer(b"".join(made), "<u4")
        if self.used + ids.size > self.pool.size:
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(max(POOL, ids.size), np.uint32)))
        self.pool[self.used : self.used + ids.size] = ids
        start = (self.used + np.cumsum(length) - length).astype(np.int32)
        self.used += ids.size
        return start, length

    def _learn(self, unknown: list[str]) -> None:
        """Letters in lower case, and runs of punctuation, are single pieces for the BPE model itself."""
        model, known = self.tokenizer.model.tokenize, self.parts.young
        rest = []
        for part in unknown:
            if part.isascii():
                if (part.isalpha() and part.islower()) or not part.rstrip(_TAIL):
                    known[part] = array("I", [t.id for t in model(part)]).tobytes()
                    continue
            elif part.isalpha() and part.lower() == part and is_normalized("NFC", part) and "\u03a3" not in part:
                known[part] = array("I", [t.id for t in model(part.encode().decode("latin-1").translate(_SHOWN))]).tobytes()
                continue
            rest.append(part)
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        known.update((p, array("I", e.ids).tobytes()) for p, e in zip(rest, found, strict=True))


def _shown() -> dict[int, int]:
    """Byte-level BPE shows printable bytes as themselves and the others as code points from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


_SHOWN = _shown()


class WholeTokenizer:
    """The same for any tokenizer, by encoding whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in column.to_pylist()]
        return np.concatenate([*ids, np.empty(0, np.uint32)]), np.cumsum([0, *(i.size for i in ids)])


#: The kind of tokenizer file that gives a text's ids word by word (fixed values).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(path: str) -> bool:
    """Whether the file is of the kind whose texts can be encoded word by word."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model = made.get("model") or {}
    added = all(t.get("special") and not t.get("lstrip") and not t.get("rstrip") and not re.search(r"\s", t["content"]) for t in made.get("added_tokens") or ())
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and not made.get("truncation") and not made.get("padding")
    return plain and added and made.get("normalizer") == NORMALIZER and made.get("pre_tokenizer") == PRE_TOKENIZER


@functools.cache
def shared_tokenizer(path: str) -> WordTokenizer | WholeTokenizer:
    """One per Python worker, which goes on using its tables from task to task."""
    return WordTokenizer(path) if by_words(path) else WholeTokenizer(path)


_TAIL = "!\"#$%&'()*+,-./:;=?@[\\]^_`{|}~"


def halve(word: str) -> tuple[str, str]:
    """Lower-case letters and the punctuation after them; any other word stays whole."""
    letters = word.rstrip(_TAIL)
    # a capital sigma lowers differently at the end of a word
    if letters.isalpha() and "\u03a3" not in letters:
        return letters.lower(), word[len(letters) :]
    return word, ""


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """One row per piece of every document; ``row`` numbers the documents."""
    small_batches(docs.sparkSession)
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        tokenizer = shared_tokenizer(tokenizer_path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, first = tokenizer.encode_texts(batch.column(1))
            out = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                text = ids[first[i] : first[i + 1]].astype("<u4").tobytes() + end
                for at in range(0, len(text), 4 * size):
                    cut = text[at : at + 4 * size]
                    out.append((doc, at // (4 * size), at // 4, len(cut) // 4, zlib.crc32(cut), cut if keep_ids else None, row + i))
            row += len(batch)
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "row"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def best_two_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins, as lists of lengths, that hold exactly the given multiset."""
    left = np.bincount(lengths, minlength=size + 1)
    bins: list[list[int]] = [[size]] * int(left[size])
    left[size] = 0
    kinds = np.flatnonzero(left)
    while kinds.size:
        held, gap = [], size
        while (at := int(np.searchsorted(kinds, gap, "right"))) > 0:
            n = int(kinds[at - 1])
            held.append(n)
            gap -= n
            left[n] -= 1
            if not left[n]:
                kinds = np.delete(kinds, at - 1)
        if gap and kinds.size:
            pair = _best_pair(kinds, left, gap + held[-1], held[-1])
            if pair:
                back = held.pop()
                held.extend(pair)
                left[back] += 1
                for n in pair:
                    left[n] -= 1
                kinds = np.flatnonzero(left)
        bins.append(held)
    return bins


def _best_pair(kinds: np.ndarray, left: np.ndarray, gap: int, replaced: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (replaced, gap]."""
    first = kinds[kinds <= gap - kinds[0]]
    if not first.size:
        return None
    at = np.searchsorted(kinds, gap - first, "right") - 1
    same = (kinds[at] == first) & (left[first] < 2)
    at = at - same
    total = np.where(at >= 0, first + kinds[at], 0)
    best = int(total.argmax())
    if total[best] <= replaced:
        return None
    return int(first[best]), int(kinds[at[best]])


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, bucket_pieces: int = BUCKET_PIECES, keep_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its place there."""
    # every document gives a piece, and one more for each sequence its tokens fill
    held = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(1, round((held["n"] + (held["bytes"] or 0) / (TOKEN_BYTES * size)) / bucket_pieces))
    cut = pieces(docs, tokenizer_path, size, keep_ids)
    cut = cut if keep_ids else cut.drop("ids")
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets))).drop("row")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        length = rows["length"].to_numpy()
        bins = best_two_fit(length, size)
        # the i-th slot of a length takes the i-th piece of that length
        slots = [(n, b, at) for b, held in enumerate(bins) for n, at in zip(held, np.cumsum([0, *held[:-1]]), strict=True)]
        slots.sort(key=lambda s: -s[0])
        rows["sequence_id"] = (int(rows["bucket"].iloc[0]) << 32) + np.array([s[1] for s in slots], np.int64)
        rows["offset"] = np.array([s[2] for s in slots], np.int64)
        return rows.drop(columns="bucket")

    schema = PACKED + (", ids binary" if keep_ids else "")
    order = [c.split()[0] for c in schema.split(", ")]
    return cut.groupBy("bucket").applyInPandas(lambda rows: run(rows)[order], schema)
