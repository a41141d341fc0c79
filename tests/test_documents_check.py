"""Rules over whole documents of the six kinds."""

import json

from pyspark.sql import functions as F

from srcatlas.operators import documents_check as check

V = {"version": "1.0.0"}
CACHE = V | {"generated_at": "x", "project": {}, "stats": {}, "files": {}, "symbols": {}}
SECTION = {"id": "s", "category": "c", "tokens": 5, "value": {"base": 1}, "formats": {"md": {}}}
CASES = {
    "a.cache.json": (CACHE, []),
    "b.cache.json": (CACHE | {"files": [{"language": "odd", "lines": -1}], "constraints": {"files": [{"behavior": "wild"}]}}, [("files.0", "unknown language"), ("files.0", "lines is no count"), ("constraints.files.0", "unknown behavior")]),
    "c.cache.json": ({k: v for k, v in CACHE.items() if k != "version"} | {"symbols": {"x.y": {"type": "odd"}}}, [("", "version is missing"), ("symbols.x.y", "unknown type")]),
    "a.vars.json": (V | {"variables": {"A": {"type": "symbol", "value": "v"}, "B": {"type": 5}}}, [("variables.B", "unknown type"), ("variables.B", "value is missing")]),
    "a.config.json": (V | {"projectName": "p", "strictness": "strict", "indexing": {"include": ["a"], "exclude": []}, "defaults": {"lock": "normal"}}, []),
    "b.config.json": ({"version": 1, "constraints": {"defaults": {"lock": "no"}}, "indexing": {"include": "a"}}, [("", "version is no version"), ("constraints.defaults", "unknown lock level"), ("indexing", "include is no list")]),
    "a.attempts.json": (V | {"attempts": {"a": {"status": "lost", "files": [{"hash": "0" * 32}, {"hash": "z"}]}}, "history": [{"started_at": "2024-01-02T00:00:00Z", "ended_at": "2024-01-01T00:00:00Z"}]},
                        [("attempts.a", "unknown status"), ("attempts.a.files.1", "hash is no MD5"), ("history.0", "ended before it started")]),
    "a.sync.json": (V | {"enabled": True, "tools": ["cursor"], "debounceMs": 3000}, []),
    "b.sync.json": (V | {"enabled": "yes", "tools": ["cursor", "none"], "exclude": [7], "debounceMs": -1}, [("", "enabled is no flag"), ("tools.1", "unknown tool"), ("exclude.0", "unknown tool"), ("", "debounceMs is no count")]),
    "a.primer.json": (V | {"sections": [SECTION]}, []),
    "b.primer.json": (V | {"sections": [SECTION | {"formats": {}, "conflictsWith": ["t", "s"]}, {"id": "u"}]}, [("sections.0", "formats is empty"), ("sections.0", "conflicts with itself"), *[("sections.1", f"{f} is missing") for f in ("category", "tokens", "value", "formats")]]),
    "c.primer.json": (V | {"sections": []}, [("", "sections is empty")]),
    "x.json": ({"a": 1}, [("", "is of no known kind")]),
    "y.json": ({"$schema": "https://h/sync.schema.json"}, [("", "version is missing")]),
}


def test_every_kind(spark):
    rows = [(n, json.dumps(d)) for n, (d, _) in CASES.items()] + [("z.cache.json", '{"files":'), ("w.vars.json", "[1]"), ("v.vars.json", None)]
    wanted = {(n, at, m) for n, (_, all_) in CASES.items() for at, m in all_} | {(n, "", "is no JSON object") for n in ("z.cache.json", "w.vars.json", "v.vars.json")}
    made = check.check(spark.createDataFrame(rows, "name string, json string").withColumn("kind", F.lit("clash")))
    got = [(r["name"], r["spot"], r["message"]) for r in made.collect()]
    assert set(got) == wanted
    assert len(got) == len(set(got))
    assert check.check(spark.createDataFrame([], "name string, json string")).count() == 0


def test_unknown_fields_survive(spark):
    document = {"variables": {"A": {"type": "symbol", "extra": {"deep": [1, None, "x"]}}, "b.c": {"n": 1.5}}}
    held = check.table_of(spark.createDataFrame([("d", json.dumps(document))], "name string, json string"), "variables")
    assert {r["key"]: json.loads(r["j"]) for r in held.select("key", F.to_json("entry").alias("j")).collect()} == document["variables"]
