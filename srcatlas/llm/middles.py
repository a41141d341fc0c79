"""Fill-in-the-middle: texts become prefix, suffix and middle behind markers.

A text is cut between units: a run of ASCII letters is one unit, any other code
point one of its own.  Each text is decoded to an array of code points; a unit
begins where the class of neighbours says so (``flatnonzero``), two ranks drawn
from a hash of the document's id choose the cuts, and the slices are encoded
again.  Everything random comes from the id, so a rerun gives the same pieces.

``psm`` writes prefix, suffix, middle, ``spm`` suffix, prefix, middle, each piece
behind its marker; ``plain`` leaves the text alone.  ``restored`` is the way back.

Cases: a null text counts as empty; empty texts and texts that hold a marker are
plain, so that the way back has one answer; a null id is hashed as an empty one;
rows with equal ids are cut at equal draws and repeated rows give repeated rows;
very long texts are cut whole, one at a time; an empty table gives no rows; only
doc_id and text are read, so further columns of any name do not matter.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

SEED = "1"
#: Of 100 texts, so many stay plain; of 100 others, so many become spm.
PLAIN_PERCENT = 10
SPM_PERCENT = 20


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = astuple(self)
        if not all(marks) or len(set(marks)) < 3:
            raise ValueError("three different markers that are not empty")
        for a in marks:
            for b in marks:
                within = a != b and a in b
                overlap = any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b))))
                if within or overlap:
                    raise ValueError(f"markers {a!r} and {b!r} overlap, so a text could not be read back")


MARKERS = Markers()


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four 32-bit draws of a document: the first groups of eight hex digits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def unit_starts(points: np.ndarray) -> np.ndarray:
    """Where the units of a text begin, in code points."""
    letter = ((points | 32) - np.uint32(97)) < 26
    opens = ~letter
    opens[:1] = True
    opens[1:] |= ~letter[:-1]
    return np.flatnonzero(opens)


def cut(points: np.ndarray, draw1: int, draw2: int) -> tuple[int, int, int]:
    """The number of units, and where the prefix and the middle end."""
    edges = np.append(unit_starts(points), points.size)
    n = edges.size - 1
    first, second = sorted((draw1 % (n + 1), draw2 % (n + 1)))
    return n, int(edges[first]), int(edges[second])


def fill_in_middle(docs: DataFrame, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, markers: Markers = MARKERS, seed: str = SEED) -> DataFrame:
    """doc_id, n units, form, prefix_chars, middle_chars and output of every row."""
    small_batches(docs.sparkSession)
    text = text_or_empty()
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.lit(False)
    for mark in astuple(markers):
        marked = marked | text.contains(mark)
    plain = (text == "") | marked | (h3 % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    pre, suf, mid = astuple(markers)

    def go(batches):
        for batch in batches:
            out = []
            for text, form, a, b in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                points = np.frombuffer(text.encode("utf-32-le"), "<u4")
                n, low, high = cut(points, a, b)
                if form == "plain":
                    out.append((n, None, None, text))
                    continue
                p, m, s = (part.tobytes().decode("utf-32-le") for part in (points[:low], points[low:high], points[high:]))
                made = f"{pre}{p}{suf}{s}{mid}{m}" if form == "psm" else f"{suf}{s}{pre}{p}{mid}{m}"
                out.append((n, low, high - low, made))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], ["doc_id", "form", "n", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    made = chosen.mapInArrow(go, f"doc_id {kind}, form string, n long, prefix_chars long, middle_chars long, output string")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column, markers: Markers = MARKERS) -> Column:
    """The text that an output of this form was made from."""
    pre, suf, mid = astuple(markers)

    def between(first: str, then: str) -> Column:
        return F.substring_index(F.substring_index(output, first, -1), then, 1)

    middle = F.substring_index(output, mid, -1)
    psm = F.concat(between(pre, suf), middle, between(suf, mid))
    spm = F.concat(between(pre, mid), middle, between(suf, pre))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
