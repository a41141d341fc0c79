import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcatlas.llm import langid

WORDS = {"aa": "zorba kelun misto trava polin".split(), "bb": "whick strug blenth grump thrift".split(), "cc": "élane ôtrui çapel mèvre".split()}


def text(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def plain(samples):
    """The n-grams that each language holds, and their hashes' slots, counted one by one."""
    counted = {lang: collections.Counter() for lang in samples}
    for lang, texts in samples.items():
        for t in texts:
            letters = " " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " "
            counted[lang].update(letters[i : i + langid.GRAM] for i in range(len(letters) - langid.GRAM + 1))
    rate = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counted.items()}
    top = collections.defaultdict(float)
    for r in rate.values():
        for g, x in r.items():
            top[g] = max(top[g], x)
    return {lang: {g for g, n in c.items() if n >= langid.LEAST and rate[lang][g] >= langid.SHARE * top[g]} for lang, c in counted.items()}


def hashed(gram):
    return langid.grams(np.array([ord(c) for c in gram], np.uint32))


SAMPLES = {lang: [text(lang, 60, s) for s in range(30)] for lang in WORDS}


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame([(lang, t) for lang, texts in SAMPLES.items() for t in texts], "lang string, text string")
    found = langid.filter_bits(rows, sorted(SAMPLES)).toPandas()
    return langid.Model.of(sorted(SAMPLES), found["slot"].to_numpy(), found["word"].to_numpy(), found["bits"].to_numpy().view(np.uint64))


def test_masks_are_those_of_a_plain_set(model):
    held = plain(SAMPLES)
    expected = np.zeros_like(model.table)
    for bit, lang in enumerate(model.languages):
        for gram in held[lang]:
            for where in langid.slots(hashed(gram)):
                expected[where, 0] |= np.uint64(1 << bit)
    assert (model.table == expected).all()
    for gram in set.union(*held.values()):
        mask = int(model.masks(hashed(gram))[0, 0])
        assert all(mask >> bit & 1 for bit, lang in enumerate(model.languages) if gram in held[lang])


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(1)
    names = [f"l{i:03d}" for i in range(150)]
    words = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4)] for n in names}
    rows = spark.createDataFrame([(i, n, " ".join(words[n] * 3)) for i, n in enumerate(names)], "doc_id long, lang string, text string")
    model = langid.train(rows, F.lit(True))
    assert model.languages == names and model.table.shape[1] == 3
    assert all(model.predict(" ".join(words[n]))[0] == n for n in names)


def test_predictions(model):
    for lang in WORDS:
        found, score = model.predict(text(lang, 30, 1000))
        assert found == lang and 0.5 < score <= 1
    assert model.predict(None) == model.predict("") == model.predict("12 + 3 !") == ("und", 0.0)
    mixed = text("aa", 200_000, 5) + text("bb", 10, 6)
    assert model.predict(mixed)[0] == "aa"


def test_long_texts_count_every_gram_once(model, monkeypatch):
    rng = random.Random(3)
    texts = [text("bb", 400, 7), "  a  ,, bc  d" * 40, "x", " ", "", "ab " * 63 + "\U00010400\U00010428 é" * 9, "".join(rng.choice("ab 1.") for _ in range(500))]
    for t in texts:
        whole = model.counts(t)
        assert whole[1] == langid.grams(langid.points(t)).size or not t
        for chunk in (1, 2, 3, 7, 64):
            with monkeypatch.context() as m:
                m.setattr(langid, "CHUNK", chunk)
                parts = model.counts(t)
            assert parts[1] == whole[1] and (parts[0] == whole[0]).all()


def test_whole_query_against_plain_counts(docs):
    """Every score from plain sets of n-grams, with the filter's false positives looked up."""
    rows = [(i, text("aa" if i % 2 else "bb", 30, i) + (" " + text("cc", i % 9, i) if i % 9 else ""), "aa" if i % 2 else "bb") for i in range(60)]
    rows += [(100 + i, text("cc", 20, i), "cc") for i in range(20)] + [(200, text("aa", 3, 1) * 3000, None), (201, None, "aa")]
    frame = docs(rows)
    model = langid.train(frame, F.lit(True))
    samples = {lang: [t for _, t, x in rows if x == lang and t] for lang in ("aa", "bb", "cc")}
    held = plain(samples)
    for r in langid.identify(frame, model).collect():
        t = dict((i, t) for i, t, _ in rows)[r["doc_id"]]
        if not t:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        letters = " " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " "
        grams = [letters[i : i + 4] for i in range(len(letters) - 3)]
        hits = []
        for bit, lang in enumerate(model.languages):
            bits = model.table[:, 0] >> np.uint64(bit) & np.uint64(1)
            hit = sum(all(bits[w[0]] for w in langid.slots(hashed(g))) for g in grams)
            assert hit >= sum(g in held[lang] for g in grams)
            rate = float(bits.mean()) ** langid.HASHES
            hits.append(max(0.0, (hit - len(grams) * rate) / (1 - rate)))
        assert r["lang_pred"] == model.languages[int(np.argmax(hits))]
        assert abs(r["score"] - max(hits) / sum(hits)) < 1e-9


def test_held_out_rows_do_not_train(docs):
    rows = [(i, text("aa" if i % 2 else "bb", 40, i), "aa" if i % 2 else "bb") for i in range(120)]
    rows += [(i, text("cc", 40, i), None) for i in range(120, 140)] + [(None, None, "aa"), (200, "", "bb"), (201, "!!", "bb"), (202, "qxjw vvkq zzxq jqxv", None)]
    frame = docs(rows)
    model = langid.train(frame, ~langid.held_out(F.col("doc_id")))
    assert model.languages == ["aa", "bb"]
    out = {r["doc_id"]: r for r in langid.identify(frame, model).collect()}
    assert all(out[i]["lang_pred"] == ("aa" if i % 2 else "bb") for i in range(120))
    assert out[200]["lang_pred"] == out[201]["lang_pred"] == out[None]["lang_pred"] == "und"
    kept = langid.keep_recognised(frame, model, 0.3)
    assert kept.columns == frame.columns and {200, 201, 202, None}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert langid.identify(docs([]), model).count() == 0


def test_without_labels_everything_is_unknown(docs):
    frame = docs([(1, "abc def", None)])
    model = langid.train(frame, F.lit(True))
    assert langid.identify(frame, model).first()["lang_pred"] == "und"
    assert langid.keep_recognised(frame, model, 0.3).count() == 1


def test_without_labels_texts_without_a_letter_go(docs):
    frame = docs([(1, "abc def", None), (2, "123 !!", None), (3, "", None), (4, None, None)])
    model = langid.train(frame, F.lit(True))
    assert [r["doc_id"] for r in langid.keep_recognised(frame, model, 0.3).collect()] == [1]


def test_a_language_under_one_id_and_equal_rows(docs):
    """The draw takes different texts, whatever their ids and repeats."""
    rows = [(8, f"wort nummer {i} im satz", "de") for i in range(3000)] + [(8, "mots et phrases", "fr")] * 3000 + [(i, f"words {i}", "en") for i in range(50)]
    picked = langid.training_rows(docs(rows).repartition(5), F.lit(True), 100)
    assert {r["lang"]: r["count"] for r in picked.groupBy("lang").count().collect()} == {"de": 100, "fr": 1, "en": 50}
    assert sorted(map(tuple, picked.collect())) == sorted(map(tuple, langid.training_rows(docs(rows).repartition(2), F.lit(True), 100).collect()))


def test_all_labelled_rows_are_learned_from(docs, monkeypatch):
    """A word of the last rows is known, though each language has more rows than a draw takes."""
    monkeypatch.setattr(langid, "HELD", 1000)
    rows = [(i, "wort im satz" if i % 2 else "words in text", "de" if i % 2 else "en") for i in range(5000)]
    frame = docs(rows + [(9000 + i, "qqxqq zzxzz", "de") for i in range(8)])
    grams = langid.grams(langid.points("qqxqq zzxzz"))
    # rare beside the others' rates, but in no other language
    model = langid.train(frame, F.lit(True), per_language=None)
    assert model.languages == ["de", "en"] and all(model.masks(grams)[:, 0] & 1)
    assert not all(langid.train(frame, F.lit(True), per_language=10).masks(grams)[:, 0] & 1)
