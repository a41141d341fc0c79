"""Variables: generation, references, bounded expansion, inheritance chains."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a reference looks like, and how deep values expand.
REFERENCE = r"\$([A-Z][A-Z0-9_]+)(?:\.(\w+))?"
DEPTH = 3
MODES = ("none", "summary", "inline", "annotated", "block", "interactive")


def _upper(column: Column, pattern: str) -> Column:
    return F.upper(F.regexp_replace(column, pattern, "_"))


def generate(symbols: DataFrame, files: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Variables for exported symbols, domains, described files and layers; one row a name.

    ``symbols``: name, qualified_name, summary, path, exported; ``files``:
    path, module, summary, layer, domains; ``calls``: caller, callee.
    """
    none = F.array().cast("array<string>")
    shown = symbols.where("exported")
    own = shown.select(F.concat(F.lit("SYM_"), _upper(F.col("name"), r"\.")).alias("name"), F.lit("symbol").alias("type"), F.col("qualified_name").alias("value"), F.col("summary").alias("description"), F.col("name").alias("of"))
    if calls is not None:
        known = own.select(F.col("of").alias("callee"), F.col("name").alias("ref")).distinct()
        refs = calls.select(F.col("caller").alias("of"), "callee").distinct().join(known, "callee").groupBy("of").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
        own = own.join(refs, "of", "left").withColumn("refs", F.coalesce("refs", none))
    else:
        own = own.withColumn("refs", none)
    # one pass over the files gives the domains, layers and described files that each stands for
    item = lambda kind, key, text: F.struct(F.lit(kind).alias("type"), key.alias("k"), text.cast("string").alias("text"))
    nothing, told = F.lit(None), F.coalesce("summary", "module")
    found = F.concat(
        F.transform(F.coalesce(F.array_distinct("domains"), none), lambda d: item("domain", d, nothing)),
        F.array(item("layer", F.col("layer"), nothing), F.when(told.isNotNull(), item("file", F.col("path"), told)).otherwise(item("file", nothing.cast("string"), nothing))),
    )
    counted = files.select(F.explode(F.filter(found, lambda x: x["k"].isNotNull())).alias("x")).groupBy("x.type", "x.k").agg(F.count("*").alias("n"), F.max("x.text").alias("text"))
    kind, key = F.col("type"), F.col("k")
    about = F.concat(F.initcap(kind), F.lit(": "), key, F.lit(" ("), F.col("n").cast("string"), F.lit(" files)"))
    prefix = F.when(kind == "domain", "DOM_").when(kind == "layer", "LAYER_").otherwise("FILE_")
    rest = counted.select(
        F.concat(prefix, F.when(kind == "file", _upper(key, "[/.]")).otherwise(_upper(key, "-"))).alias("name"), kind, key.alias("value"),
        F.when(kind == "file", F.col("text")).otherwise(about).alias("description"), none.alias("refs"),
    )
    every = own.drop("of").unionByName(rest)
    last = Window.partitionBy("name").orderBy(F.desc("value"))
    return every.withColumn("at", F.row_number().over(last)).where("at = 1").drop("at")


def references(texts: DataFrame) -> DataFrame:
    """id, name, modifier and order of every reference in (id, text)."""
    found = texts.select(
        "id", F.arrays_zip(F.regexp_extract_all("text", F.lit(REFERENCE), 1).alias("n"), F.regexp_extract_all("text", F.lit(REFERENCE), 2).alias("m")).alias("r")
    )
    return found.select("id", F.posexplode("r").alias("ord", "r")).select("id", F.col("ord").cast("long").alias("ord"), F.col("r.n").alias("name"), F.nullif(F.col("r.m"), F.lit("")).alias("modifier"))


def unresolved(found: DataFrame, variables: DataFrame) -> DataFrame:
    return found.join(variables.select("name"), "name", "left_anti")


def edges(variables: DataFrame) -> DataFrame:
    """(src, dst) of all references between variables."""
    return variables.select(F.col("name").alias("src"), F.explode("refs").alias("dst"))


def expand_values(variables: DataFrame, depth: int = DEPTH) -> DataFrame:
    """name and its value with references replaced, at most ``depth`` rounds.

    A round splits values at their references, joins the references' plain
    values and puts them together again; a reference to a name already on the
    way becomes ``[CYCLE:$NAME]``, an unknown one stays.
    """
    plain = variables.select(F.col("name").alias("ref"), F.col("value").alias("ref_value"))
    piece = F.struct(F.lit("").alias("ref"), F.col("value").alias("text"), F.array("name").alias("way"))
    rows = variables.select("name", F.array(piece).alias("pieces"))
    for _ in range(depth + 1):
        spread = rows.select("name", F.posexplode("pieces").alias("at", "p"))
        cut = spread.select("name", "at", "p.way", F.split("p.text", r"(?=\$[A-Z][A-Z0-9_])|(?<=\x00)").alias("s"))
        parts = cut.select("name", "at", "way", F.posexplode("s").alias("k", "t"))
        named = parts.select("name", "at", "k", "way", "t", F.regexp_extract("t", r"^\$([A-Z][A-Z0-9_]+)", 1).alias("ref"))
        joined = named.join(plain, "ref", "left")
        rest = F.regexp_replace("t", r"^\$[A-Z][A-Z0-9_]+", "")
        cycle = F.array_contains("way", F.col("ref"))
        made = F.when(F.col("ref_value").isNull(), F.array(F.struct(F.lit("").alias("ref"), F.regexp_replace("t", r"\$", "\x01").alias("text"), "way"))).when(
            cycle, F.array(F.struct(F.lit("").alias("ref"), F.concat(F.lit("[CYCLE:\x01"), "ref", F.lit("]"), rest).alias("text"), "way"))
        )
        made = made.otherwise(
            F.array(
                F.struct(F.lit("").alias("ref"), F.col("ref_value").alias("text"), F.concat("way", F.array("ref")).alias("way")),
                F.struct(F.lit("").alias("ref"), rest.alias("text"), "way"),
            )
        )
        held = joined.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "k", made.alias("m")))).alias("l"))
        rows = held.select("name", F.flatten(F.transform("l", lambda x: x["m"])).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return rows.select("name", F.translate(text, "\x01", "$").alias("expanded"))


def expander(table: dict[str, dict], mode: str = "summary") -> Callable[[str], tuple[str, list[str], list[str]]]:
    """A function from a text to its expansion, expanded names and unknown names (last first).

    ``table``: name to value, type and description, as the driver read it.
    """
    pattern = re.compile(REFERENCE)

    def value_of(name: str, depth: int, way: frozenset[str]) -> str | None:
        if name in way:
            return f"[CYCLE:${name}]"
        if name not in table:
            return None
        text = table[name]["value"]
        if not depth:
            return text
        return pattern.sub(lambda m: value_of(m[1], depth - 1, way | {name}) or m[0], text)

    def shown(name: str, modifier: str | None) -> str:
        entry = table[name]
        told = entry.get("description")
        if modifier:
            return {"description": told or "", "summary": told or "", "type": entry["type"]}.get(modifier, entry["value"])
        if mode == "none":
            return f"${name}"
        if mode == "inline":
            return value_of(name, DEPTH, frozenset()) or entry["value"]
        if mode == "annotated":
            pairs = [p.split(":", 1) for p in entry["value"].split("|") if ":" in p]
            return f"**${name}** → " + " | ".join(f"{k[:1].upper()}{k[1:]}: {v}" for k, v in pairs)
        if mode == "block":
            return "\n".join((f"> **{name}**: {told or ''}", ">", f"> - **type**: {entry['type']}", f"> - **value**: {entry['value']}"))
        if mode == "interactive":
            return f'<var name="{name}" description="{told or name}">{told or name}</var>'
        return told or name

    def expand(text: str) -> tuple[str, list[str], list[str]]:
        known, unknown = [], []
        for m in pattern.finditer(text):
            (known if m[1] in table else unknown).append(m[1])
        out = pattern.sub(lambda m: shown(m[1], m[2]) if m[1] in table else m[0], text)
        return out, known[::-1], unknown[::-1]

    return expand


def expand_texts(texts: DataFrame, variables: DataFrame, mode: str = "summary", most: int = 200_000) -> DataFrame:
    """(id, text) with references expanded.

    A dictionary of at most ``most`` names goes to every executor; of a larger
    one each text is joined with the entries that it can need.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if variables.limit(most + 1).count() > most:
        return _measured(_joined(texts, variables, mode))
    table = {r["name"]: {"value": r["value"], "type": r["type"], "description": r["description"]} for r in variables.select("name", "value", "type", "description").collect()}
    shared = texts.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("struct<expanded:string,known:array<string>,unknown:array<string>>")
    def run(column: pd.Series) -> pd.DataFrame:
        expand = expander(shared.value, mode)
        return pd.DataFrame([expand(t or "") for t in column], columns=["expanded", "known", "unknown"])

    return _measured(texts.select("id", "text", run("text").alias("r")))


def _joined(texts: DataFrame, variables: DataFrame, mode: str) -> DataFrame:
    """id, text and expansion, by a join: names in a text, and for values within values those that they name in turn."""
    names = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(REFERENCE), 1))
    by = ["id", "text", "copies"]
    counted = texts.groupBy("id", "text").agg(F.count("*").alias("copies"))
    wanted = level = counted.select(*by, F.explode_outer(names("text")).alias("name"))
    inner = variables.select("name", F.explode(names("value")).alias("next"))
    for _ in range(DEPTH if mode == "inline" else 0):
        level = level.join(inner.hint("merge"), "name").select(*by, F.col("next").alias("name")).distinct()
        wanted = wanted.unionByName(level)
    entry = variables.select("name", F.struct("name", "value", "type", "description").alias("entry"))
    held = wanted.distinct().join(entry.hint("merge"), "name", "left").groupBy(*by).agg(F.collect_list("entry").alias("entries"))

    @F.pandas_udf("struct<expanded:string,known:array<string>,unknown:array<string>>")
    def run(column: pd.Series, entries: pd.Series) -> pd.DataFrame:
        made = [expander({e["name"]: e for e in es}, mode)(t or "") for t, es in zip(column, entries, strict=True)]
        return pd.DataFrame(made, columns=["expanded", "known", "unknown"])

    return held.select("id", "text", "copies", run("text", "entries").alias("r")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))


def _measured(found: DataFrame) -> DataFrame:
    return found.select("id", "r.*", F.ceil(F.octet_length("text") / 4).cast("long").alias("tokens_before"), F.ceil(F.octet_length("r.expanded") / 4).cast("long").alias("tokens_after"))


def chain(table: dict[str, list[str]], root: str, by_path: bool = True) -> tuple[list[str], bool]:
    """Depth-first names below ``root`` and whether a cycle was met.

    ``by_path`` calls only a name on the way a cycle; otherwise any name met
    twice is one, and the walk stops there.
    """
    order, seen = [root], {root}

    def walk(name: str, way: tuple[str, ...]) -> bool:
        for ref in table.get(name, []):
            if ref in way or (not by_path and ref in seen):
                return True
            if ref in seen:
                continue
            seen.add(ref)
            order.append(ref)
            if walk(ref, (*way, ref)):
                return True
        return False

    return order, walk(root, (root,))


def chains(variables: DataFrame, depth: int | None = None) -> DataFrame:
    """Every variable with the names it reaches, nearest first, their number and whether it is on a cycle."""
    from .graph import reach

    found = reach(edges(variables), depth)
    held = found.groupBy(F.col("node").alias("name")).agg(
        F.array_sort(F.collect_list(F.struct("depth", "reached"))).alias("r"), F.count("*").alias("reached"), F.max("depth").alias("depth"), F.bool_or(F.col("node") == F.col("reached")).alias("has_cycle")
    )
    return held.select("name", F.transform("r", lambda x: x["reached"]).alias("chain"), "reached", "depth", "has_cycle")


def inheritance(variables: DataFrame, roots: DataFrame | None = None, by_path: bool = True) -> DataFrame:
    """name, chain, depth, has_cycle: for each root (name) the names below it in depth-first order.

    Every name is placed by the least path of reference numbers that leads to
    it, which is the order of a depth-first walk.  The walk stops at its first
    repeat: by path, at a reference to a name on its own way (names met
    elsewhere are passed over); otherwise at any name met before.  Only what
    the asked roots lead to is walked.
    """
    from .graph import relax

    steps = variables.select(F.col("name").alias("src"), F.posexplode("refs").alias("pos", "dst"))
    names = variables.select("name") if roots is None else roots.select("name")
    begin = F.struct(F.array().cast("array<int>").alias("key"), F.array("name").alias("way"))
    onward = F.struct(F.concat("best.key", F.array("pos")).alias("key"), F.concat("best.way", F.array("dst")).alias("way"))
    placed = relax(names.distinct().select(F.col("name").alias("root"), F.col("name").alias("node"), begin.alias("best")), steps, ["root", "node"], F.when(~F.array_contains("best.way", F.col("dst")), onward))
    placed = placed.select("root", "node", "best.key", "best.way")
    taken = placed.join(steps, placed["node"] == steps["src"]).select("root", "dst", "way", F.concat("key", F.array("pos")).alias("at"))
    if by_path:
        repeats = taken.where(F.array_contains("way", F.col("dst")))
    else:
        first = placed.select("root", F.col("node").alias("dst"), F.col("key").alias("first"))
        repeats = taken.join(first, ["root", "dst"]).where("at != first")
    stops = repeats.groupBy("root").agg(F.min("at").alias("stop"))
    met = placed.join(stops, "root", "left").where("stop is null or key < stop")
    held = met.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("key", "node"))).alias("r"), F.bool_or(F.col("stop").isNotNull()).alias("has_cycle"))
    return held.select(F.col("root").alias("name"), F.transform("r", lambda x: x["node"]).alias("chain"), (F.size("r") - 1).cast("long").alias("depth"), "has_cycle")
