import hashlib
import random

import pytest

from srcatlas.llm import substrings


def brute(rows, window):
    owner = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for s in range(len(words) - window + 1):
            k = tuple(words[s : s + window])
            if doc is not None:
                owner[k] = min(owner.get(k, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            o = owner.get(tuple(words[s : s + window]))
            if o is not None and doc is not None and o < doc:
                gone[s : s + window] = [True] * window
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((doc, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("hot", [0, 2000])
def test_against_brute_force(docs, hot):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            a = rng.randrange(0, 20)
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = passage[a : a + rng.randrange(5, 30)]
        rows.append((i * 7 % 61, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(100, rows[0][1]), (101, rows[1][1]), (101, rows[1][1]), (102, None), (103, ""), (104, "a b " * 30), (None, rows[2][1]), (105, " ".join(["same"] * 200)), (106, " ".join(["same"] * 50))]
    out = substrings.remove_repeats(docs(rows), window=10, run=3, hot=hot).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == brute(rows, 10)


def test_empty_table(docs):
    assert substrings.remove_repeats(docs([])).count() == 0


def test_a_very_long_text_and_clashing_columns(docs):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words[:200])), (2, " ".join([*words[20_000:], *words[:20_000]])), (3, " ".join(words[-300:]))]
    out = substrings.remove_repeats(docs(rows).selectExpr("*", "1 as start", "2 as low", "3 as found", "4 as at", "5 as m0")).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out)
    assert got == brute(rows, 50) and got[1][2] == 200 and got[2][2] == 300


def test_many_equal_rows(docs):
    """Repeats of (id, text) cost one text, with a repeated passage elsewhere and without."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(5, " ".join(words))] * 20_000 + [(2, " ".join(words[:80])), (9, " ".join(words[200:])), (7, " ".join(words))]
    out = substrings.remove_repeats(docs(rows).repartition(6)).groupBy("doc_id", "n_words", "n_removed", "kept_sha256").count().collect()
    want = {r: n for r, n in zip(brute(list(dict.fromkeys(rows)), 50), (1, 20_000, 1, 1), strict=True)}
    assert {tuple(r)[:4]: r["count"] for r in out} == want
