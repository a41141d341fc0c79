import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from srcatlas.llm import middles


def plain(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = ["", None, "a", "ab cd", "  ", "é", "naïve Ωmega\n\n\tx1y2", "𝒳y 😀😀 z", "has <P> inside", "<S>", "<M", "P><S", "<<PS>>", "a<", "word " * 300, "[]@`{}", "\x00a\x00"]


def test_against_the_contract(docs):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(400)] + [(None, "null id"), (None, None), (7, "same id, other text"), (7, "same id, other text")]
    made = middles.fill_in_middle(docs(rows))
    out = made.withColumn("back", middles.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r)[:-1] for r in out))) == sorted(map(repr, (plain(*r) for r in rows)))
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert sorted(r["back"] for r in out) == sorted(t or "" for _, t in rows)


@given(st.text(alphabet=st.one_of(st.sampled_from("aZ <[é😀\n"), st.characters(codec="utf-8")), max_size=60))
def test_units(text):
    points = middles.np.frombuffer(text.encode("utf-32-le"), "<u4")
    assert middles.unit_starts(points).tolist() == [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]


def test_a_very_long_text_and_an_empty_table(docs):
    long = ("word é " * 700_000)[:-1]
    out = middles.fill_in_middle(docs([(i, long) for i in range(3)] + [(9, "x")])).collect()
    assert sorted(map(repr, (tuple(r) for r in out))) == sorted(repr(plain(*r)) for r in [(i, long) for i in range(3)] + [(9, "x")])
    assert middles.fill_in_middle(docs([])).count() == 0


def test_shares_of_forms_and_other_markers(docs):
    marks = middles.Markers("[pre]", "[suf]", "[mid]")
    made = middles.fill_in_middle(docs([(i, f"some <P> text {i}") for i in range(1000)]), plain_percent=50, spm_percent=50, markers=marks)
    forms = {r["form"]: r["count"] for r in made.groupBy("form").count().collect()}
    assert abs(forms["plain"] - 500) < 80 and abs(forms["spm"] - 250) < 60
    back = made.where(middles.restored(F.col("output"), F.col("form"), marks) != F.concat(F.lit("some <P> text "), F.col("doc_id")))
    assert back.count() == 0


@pytest.mark.parametrize("marks", [("", "b", "c"), ("<a>", "<a>", "<b>"), ("ab", "bc", "x"), ("aXa", "y", "z"), ("<a>", "x<a>x", "c")])
def test_markers_that_cannot_be_read_back(marks):
    with pytest.raises(ValueError):
        middles.Markers(*marks)
