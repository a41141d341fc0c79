import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order_on_planted_cases(spark, docs, tmp_path):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = text(30)
    rows = [(i, text(60)) for i in range(80)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " more"), (102, "123 456 !!"), (103, None), (104, f"{text(20)} {item} {text(20)}"), (105, f"{text(30)} bob@example.com {text(30)}")]
    frame = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "packing"]
    held, left = frame, {}
    for name, stage in pipeline.STAGES[:-1]:
        held = stage(spark, held, str(tmp_path))
        assert held.columns == frame.columns
        left[name] = {r["doc_id"]: r["text"] for r in held.collect()}
    clean = set(range(80))
    assert set(left["language_id"]) == {i for i, _ in rows} - {102, 103}
    assert set(left["near_dedup"]) == clean | {104, 105}
    assert set(left["decontamination"]) == clean | {105}
    assert left["pii"][105].count("[EMAIL]") == 1 and "bob@" not in left["pii"][105]
    assert all(left["pii"][i] == t for i, t in rows if i in clean)
    packed = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == clean | {105}
