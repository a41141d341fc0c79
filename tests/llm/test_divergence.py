import re
from collections import Counter, defaultdict

import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from srcatlas.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least_docs=10, top=10):
    """All kept terms for all pairs of groups, with Python's integers."""
    counts, seen, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = TERM.findall((text or "").translate(LOWER))
        key = (lang or "", source or "")
        counts[key].update(words)
        seen[key[0]].update(set(words))
        whole[key[0]].update(words)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, source in counts:
        kept = sorted(t for t, n in seen[lang].items() if n >= least_docs)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        mine, lang_p = shares(counts[lang, source]), shares(whole[lang])
        pairs = []
        for other in [g for g in counts if g[0] == lang and g[1] != source]:
            theirs = shares(counts[other])
            pairs.append((sum(f(mine[t], theirs[t]) for t in kept), other[1]))
        terms = [(f(mine[t], lang_p[t]), t) for t in kept if counts[lang, source][t] > 0 and mine[t] > lang_p[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            order = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(order)]
    return sorted(out)


def made(rows):
    import random

    draw = random.Random(3)
    words = ["the", "The", "of", "naïve", "été", "Ωmega", "x1y", "don't", "日本", "😀", "a", "b"] + [f"w{c}" for c in "abcdefghij"]
    out = []
    for i in range(rows):
        lang = draw.choice(["en", "en", "en", "fr", None, ""])
        source = "hot" if draw.random() < 0.35 else draw.choice(["s1", "s2", "s3", "Z", "é", None])
        text = " ".join(draw.choices(words, k=draw.randrange(0, 30))) if i % 11 else None
        out.append((i, text, lang, source))
    return out


def facts(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_all_terms_of_all_pairs(docs):
    rows = made(400)
    rows += [(None, "rare", "de", "one"), (None, None, "de", "two"), (1, "42 !", "de", "three"), (2, "solo " * 20, "it", "alone")] + [(5, "copy of a", "en", "s1")] * 40
    assert facts(divergence.audit(docs(rows))) == plain(rows)


def test_settings_long_texts_and_empty_tables(docs):
    rows = made(60) + [(100, "the end " * 300_000, "en", "s1"), (101, "x" * 1_000_000, "fr", "s2")]
    assert facts(divergence.audit(docs(rows), least_docs=1, top=3)) == plain(rows, 1, 3)
    assert divergence.audit(docs([])).count() == 0


def test_a_language_without_kept_terms_has_zero_pairs(docs):
    out = facts(divergence.audit(docs([(1, "a b", "en", "x"), (2, None, "en", "y"), (3, "c", "en", "z")])))
    assert out == [("en", a, "pair", b, 0, i + 1) for a in "xyz" for i, b in enumerate(c for c in "xyz" if c != a)]


def test_many_copies_and_batches(docs):
    """Partial counts handed on early are summed again."""
    rows = made(50) + [(7, "one text many times", "en", "hot")] * 3000
    assert facts(divergence.audit(docs(rows).repartition(2), hold=3)) == plain(rows)


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 10**13
    got = spark.range(1).select(divergence.share(F.lit(big), F.lit(3 * big), F.lit(1000)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (big + 2) // (3 * big + 2000)


@given(st.lists(st.text(max_size=30), max_size=8))
def test_terms(texts):
    found, of = divergence.terms(pa.array(texts, pa.string()))
    want = [(t, i) for i, text in enumerate(texts) for t in TERM.findall(text.translate(LOWER))]
    assert list(zip(found.to_pylist(), of.tolist(), strict=True)) == want
