"""Suggested annotations: heuristics, gaps, priorities, coverage, rendering."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import file_name, parent, stem
from ..functions.text import bound, capitalize, humanize, share, words
from ..schema import MARKER, SYMBOL_WITHIN

# Parts of names, and what they suggest as (kind, value, confidence).
SECURITY = (
    "auth", "authenticate", "authorization", "authorize", "token", "jwt", "session", "credential", "password", "secret", "key",
    "encrypt", "decrypt", "hash", "verify", "sign", "validate", "sanitize", "escape", "permission", "role", "access", "grant",
    "revoke", "login", "logout",
)
DATA = (
    "repository", "repo", "store", "storage", "database", "db", "query", "fetch", "save", "update", "delete", "insert", "cache",
    "persist", "serialize", "deserialize",
)
NAMES = (
    (SECURITY, (("lock", "restricted", 0.8), ("ai-hint", "security-sensitive", 0.8), ("domain", "security", 0.7))),
    (DATA, (("domain", "data", 0.7), ("layer", "repository", 0.6))),
    (("test", "spec", "mock", "stub", "fake", "fixture"), (("domain", "tests", 0.9),)),
    (("experimental", "beta", "alpha", "wip", "todo", "hack", "temp", "temporary", "draft"), (("stability", "experimental", 0.8),)),
    (("handler", "controller", "endpoint", "route"), (("layer", "handler", 0.7),)),
    (("service", "svc", "manager", "provider"), (("layer", "service", 0.7),)),
    (("middleware", "interceptor", "filter", "guard"), (("layer", "middleware", 0.7),)),
)

# Parts of folder names, first match first, and the domain or layer they suggest.
DOMAINS = {
    "auth": "authentication", "authentication": "authentication", "login": "authentication", "user": "users", "users": "users",
    "account": "users", "billing": "billing", "payment": "billing", "payments": "billing", "stripe": "billing", "api": "api",
    "rest": "api", "graphql": "api", "grpc": "api", "db": "database", "database": "database", "models": "database",
    "repository": "database", "repositories": "database", "cache": "caching", "redis": "caching", "queue": "messaging",
    "messaging": "messaging", "events": "messaging", "pubsub": "messaging", "util": "utilities", "utils": "utilities",
    "helpers": "utilities", "common": "utilities", "shared": "utilities", "test": "testing", "tests": "testing", "spec": "testing",
    "__tests__": "testing", "e2e": "testing", "integration": "testing", "config": "configuration", "settings": "configuration",
    "middleware": "middleware", "interceptor": "middleware", "handlers": "handlers", "controllers": "handlers",
    "services": "services", "domain": "domain", "core": "core", "lib": "library", "pkg": "library", "internal": "internal",
    "vendor": "vendor", "third_party": "vendor", "security": "security", "crypto": "security", "notifications": "notifications",
    "email": "notifications", "sms": "notifications", "analytics": "analytics", "metrics": "analytics", "monitoring": "monitoring",
    "logging": "monitoring", "admin": "administration", "dashboard": "administration",
}
LAYERS = {
    "handlers": "handler", "controllers": "handler", "api": "handler", "routes": "handler", "endpoints": "handler",
    "services": "service", "usecases": "service", "application": "service", "repository": "repository",
    "repositories": "repository", "dao": "repository", "db": "repository", "models": "model", "entities": "model",
    "domain": "model", "middleware": "middleware", "interceptors": "middleware", "filters": "middleware", "guards": "middleware",
    "utils": "utility", "helpers": "utility", "lib": "utility", "common": "utility", "config": "config", "settings": "config",
}

# What a visibility suggests, and the confidence.
VISIBILITY = {
    "private": (("lock", "restricted", 0.7),),
    "protected": (("lock", "normal", 0.6), ("ai-hint", "internal API", 0.5)),
    "internal": (("lock", "restricted", 0.6), ("ai-hint", "crate-internal", 0.5)),
    "crate": (("lock", "restricted", 0.6), ("ai-hint", "crate-internal", 0.5)),
}

# Which annotations each level asks for, and which are written in quotes.
LEVELS = {
    "minimal": ("module", "summary"),
    "standard": ("module", "summary", "domain", "lock", "layer", "deprecated"),
    "full": ("module", "summary", "domain", "lock", "layer", "deprecated", "stability", "ai-hint", "ref", "hack", "lock-reason"),
}
QUOTED = ("module", "summary", "deprecated", "ai-hint", "ref", "lock-reason")
SOURCES = {"explicit": 0, "converted": 1, "heuristic": 2}
GENERIC_STEMS = ("index", "mod", "main", "lib", "__init__", "init")

# Thresholds of the history heuristics.
CHURN_COMMITS, SINGLE_AUTHOR_COMMITS, STABLE_DAYS, VOLATILE_LINES, VOLATILE_COMMITS = 20, 5, 180, 500, 10


def _one(kind: str, value, confidence: float) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(confidence).alias("confidence"))


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,value:string,confidence:double>>")


def _when(test: Column, items) -> Column:
    return F.when(test, F.array(*[_one(*i) for i in items])).otherwise(_none())


def _emit(rows: DataFrame, found: Column, source: str = "heuristic") -> DataFrame:
    spread = rows.select("target", "line", F.posexplode(found).alias("ord", "s"))
    return spread.select("target", "line", F.col("s.kind").alias("kind"), F.col("s.value").alias("value"), F.col("s.confidence").alias("confidence"), F.lit(source).alias("source"), F.col("ord").cast("long").alias("ord"))


def by_name(symbols: DataFrame, security: tuple[str, ...] = ()) -> DataFrame:
    """Suggestions from parts of symbol names (target, line)."""
    return _emit(symbols, _of_name(F.col("target"), security))


def _of_name(target: Column, security: tuple[str, ...] = ()) -> Column:
    low = F.lower(target)
    rules = [((*NAMES[0][0], *(s.lower() for s in security)), NAMES[0][1]), *NAMES[1:]]
    return F.concat(*[_when(low.rlike("|".join(parts)), made) for parts, made in rules])


def _first_of(part: Column, table: dict[str, str]) -> Column:
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, value in table.items():
        found = found.when(part.contains(key), F.lit(value))
    return found


def by_path(files: DataFrame, custom: dict[str, str] | None = None) -> DataFrame:
    """Domains and layers from the parts of a file's path (path, target, line); each value once."""
    spread = _emit(files, _of_path(F.col("path"), custom))
    return spread.groupBy("target", "line", "kind", "value", "source").agg(F.min_by("confidence", "ord").alias("confidence"), F.min("ord").alias("ord"))


def _of_path(path: Column, custom: dict[str, str] | None = None) -> Column:
    part = lambda p: F.lower(p)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    own = F.create_map(*[F.lit(x) for pair in (custom or {"": ""}).items() for x in pair])

    def of(p: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.array(
            _one("domain", F.try_element_at(own, part(p)) if custom else none, 0.8),
            _one("domain", _first_of(part(p), DOMAINS), 0.7),
            _one("layer", _first_of(part(p), LAYERS), 0.6),
        )

    return F.filter(F.flatten(F.transform(parts, of)), lambda s: s["value"].isNotNull())


def by_visibility(symbols: DataFrame) -> DataFrame:
    """Locks and hints from (target, line, visibility, exported)."""
    return _emit(symbols, _of_visibility(F.col("visibility"), F.col("exported")))


def _of_visibility(visibility: Column, exported: Column) -> Column:
    rules = [_when(visibility == v, items) for v, items in VISIBILITY.items()]
    return F.concat(*rules, _when((visibility == "public") & exported, (("lock", "normal", 0.5),)))


def by_history(history: DataFrame) -> DataFrame:
    """Hints from (target, line, commits, authors, days, added, removed)."""
    return _emit(history, _of_history(F.col))


def _of_history(past) -> Column:
    """``past`` gives a column of the history by its name."""
    churn = past("added") + past("removed")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    n, authors = past("commits"), F.size(past("authors"))
    return F.concat(
        _when(n >= CHURN_COMMITS, (("ai-hint", text("High-churn file: ", n, " commits by ", authors, " contributors"), 0.7),)),
        _when(
            (authors < 2) & (n > SINGLE_AUTHOR_COMMITS),
            (("ai-hint", text("Single author: ", F.coalesce(F.get(past("authors"), F.lit(0)), F.lit("unknown")), ". Consider code review for bus factor."), 0.6),),
        ),
        _when(
            past("days") >= STABLE_DAYS,
            (("stability", "stable", 0.7), ("ai-hint", text("Stable code: unchanged for ", past("days"), " days"), 0.7)),
        ),
        _when(
            (churn > VOLATILE_LINES) & (n > VOLATILE_COMMITS),
            (("lock", "normal", 0.6), ("ai-hint", text("Volatile code: ", churn, " lines changed across ", n, " commits"), 0.6)),
        ),
    )


def module_name(path: Column) -> Column:
    """A readable name from the file's stem, or its folder's for generic stems."""
    return F.when(stem(path).isin(*GENERIC_STEMS), humanize(file_name(parent(path)))).otherwise(humanize(stem(path)))


# Verbs whose summary does not follow from their ending.
VERBS = {
    "is": "Checks if", "has": "Checks if has", "can": "Checks if can", "should": "Determines if should", "will": "Determines if will",
    "does": "Checks if does", "concat": "Concatenates", "calc": "Calculates", "init": "Initializes", "setup": "Sets up",
    "teardown": "Tears down", "cleanup": "Cleans up", "login": "Logs in", "logout": "Logs out", "equals": "Checks equality",
    "spy": "Spies on", "rollback": "Rolls back", "checkout": "Checks out", "mkdir": "Creates directory", "rmdir": "Removes directory",
    "chmod": "Changes permissions", "chown": "Changes ownership", "stat": "Gets stats for", "exists": "Checks if exists",
}


def third_person(verb: Column) -> Column:
    """A verb as a summary begins: fixed phrases, else its third person by its ending."""
    table = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])

    def told(low: Column) -> Column:
        ending = (
            F.when(low.rlike("(x|ch|sh|ss|us|is)$"), F.concat(low, F.lit("es")))
            .when(low.rlike("s$"), low)
            .when(low.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(low, "y$", ""), F.lit("ies")))
            .otherwise(F.concat(low, F.lit("s")))
        )
        return F.coalesce(F.try_element_at(table, low), bound(ending, capitalize))

    return bound(F.lower(verb), told)


def summary(name: Column, kind: Column) -> Column:
    """A first summary from a symbol's name and kind, or null for short names and other kinds."""

    def of(parts: Column) -> Column:
        low = F.transform(parts, F.lower)
        head = third_person(F.get(parts, F.lit(0)))
        verb = F.trim(F.concat_ws(" ", head, F.array_join(F.slice(low, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " ")))
        return (
            F.when(kind.isin("function", "method"), verb)
            .when(kind.isin("class", "struct"), bound(F.array_join(low, " "), capitalize))
            .when(kind.isin("interface", "trait"), F.concat_ws(" ", F.array_join(parts, ""), kind))
        )

    def checked(made: Column) -> Column:
        poor = (F.length(made) < 5) | made.rlike(r"(eses|sses)(\s|$)|  ")
        return F.when((F.length(name) < 3) | made.isNull(), F.lit(None)).when(poor, F.concat_ws(" ", capitalize(F.lower(name)), kind)).otherwise(made)

    return bound(bound(words(name), of), checked)


def by_file(files: DataFrame) -> DataFrame:
    """Module name and summary for whole files (path, target, line)."""
    return _emit(files, _of_file(F.col("path")))


def _of_file(path: Column) -> Column:
    made = lambda name: F.when(name.isNotNull() & (name != ""), F.array(_one("module", name, 0.7), _one("summary", F.concat(name, F.lit(" module")), 0.5))).otherwise(_none())
    return bound(module_name(path), made)


def found(path: Column, target: Column, kind: Column, visibility: Column, exported: Column, past: Column | None = None) -> Column:
    """What ``heuristic`` finds of one target, in its order: structs of kind, value, confidence, source and ord.

    ``past``: the history of the target's file.
    """
    made = bound(summary(target, kind), lambda made: F.when(made.isNotNull(), F.array(_one("summary", made, 0.6))).otherwise(_none()))
    parts = [_of_name(target), _of_path(path), _of_visibility(visibility, exported), made]
    if past is not None:
        parts.append(F.when(past.isNotNull(), _of_history(lambda c: past[c])).otherwise(_none()))

    def numbered(part: Column, k: int) -> Column:
        told = lambda s, i: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), s["confidence"].alias("confidence"), F.lit("heuristic").alias("source"), (i + 1000 * k).cast("long").alias("ord"))
        return F.transform(part, told)

    return F.when(kind.isNull(), numbered(_of_file(path), 1)).otherwise(F.concat(*[numbered(p, k + 2) for k, p in enumerate(parts)]))


def heuristic(targets: DataFrame, history: DataFrame | None = None, summaries: bool = True) -> DataFrame:
    """All heuristics of every target, in their order.

    ``targets``: path, target, line, kind (null for a whole file), visibility,
    exported.  Whole files get module suggestions only; symbols those of their
    name, path, visibility, summary, and of their file's history (``history``:
    path, commits, authors, days, added, removed).
    """
    wanted = ["path", "target", "line"]
    symbols = targets.where(F.col("kind").isNotNull())
    parts = [by_file(targets.where(F.col("kind").isNull()).select(*wanted)), by_name(symbols), by_path(symbols.select(*wanted))]
    parts.append(by_visibility(symbols.where(F.col("visibility").isNotNull())))
    if summaries:
        made = symbols.withColumn("made", summary(F.col("target"), F.col("kind"))).where(F.col("made").isNotNull())
        parts.append(_emit(made, F.array(_one("summary", F.col("made"), 0.6))))
    if history is not None:
        parts.append(by_history(symbols.select(*wanted).join(history, "path")))
    columns = ["target", "line", "kind", "value", "confidence", "source"]
    # a later heuristic's suggestions come after all of an earlier one's
    rows = [p.select(*columns, (F.lit(1000 * (i + 1)) + F.col("ord")).cast("long").alias("ord")) for i, p in enumerate(parts)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def assemble(converted: DataFrame, found: DataFrame, level: str = "standard", least: float = 0.0, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """One suggestion for each gap's kind: from its doc comment first, else from the heuristics.

    ``converted`` and ``found``: target, line, kind, value, confidence, source, ord.
    """
    columns = ["target", "line", "kind", "value", "confidence", "source", "ord"]
    return priority(converted.select(*columns).unionByName(found.select(*columns)), level, least, by)


def eligible(visibility: Column, kind: Column) -> Column:
    """Which symbols to annotate: public ones, and other visible types."""
    types = kind.isin("class", "struct", "interface", "trait")
    return F.when(visibility == "public", True).when(visibility.isin("protected", "internal", "crate"), types).otherwise(False)


def priority(suggestions: DataFrame, level: str = "full", least: float = 0.0, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """The best suggestion for each kind of what ``by`` names: explicit before converted before heuristic, then the first."""
    rank = F.when(F.lit(False), 0)
    for name, value in SOURCES.items():
        rank = rank.when(F.col("source") == name, value)
    kept = suggestions.where(F.col("kind").isin(*LEVELS[level]) & (F.col("confidence") >= least))
    best = Window.partitionBy(*by, "kind").orderBy("rank", "ord", "value")
    return kept.withColumn("rank", rank).withColumn("at", F.row_number().over(best)).where("at = 1").drop("rank", "at")


def gaps(targets: DataFrame, existing: DataFrame, level: str = "standard") -> DataFrame:
    """Missing annotations of each target: what the level asks for and nobody wrote.

    ``targets``: target, line, is_file, exported; ``existing``: target, kind.
    Files need a module, and the others of file and symbol kinds by level.
    """
    kinds = LEVELS[level]
    file_kinds = [k for k in ("module", "summary", "domain") if k in kinds]
    symbol_kinds = [k for k in kinds if k != "module"]
    wanted = F.when(F.col("is_file"), F.array(*map(F.lit, file_kinds))).otherwise(
        F.array_distinct(F.concat(F.when(F.col("exported"), F.array(F.lit("summary"))).otherwise(F.array().cast("array<string>")), F.array(*map(F.lit, symbol_kinds))))
    )
    asked = targets.select("target", "line", F.explode(wanted).alias("kind"))
    return asked.join(existing.select("target", "kind").distinct().hint("merge"), ["target", "kind"], "left_anti")


def attach(notes: DataFrame, symbols: DataFrame, within: int = SYMBOL_WITHIN) -> DataFrame:
    """Annotations with the next symbol that starts at most ``within`` lines below: a forward as-of join.

    ``notes``: path, line_no, kind, value; ``symbols``: path, name, line_start.
    """
    one = notes.select("path", "line_no", "kind", "value", F.lit(None).cast("string").alias("name"))
    two = symbols.select("path", F.col("line_start").alias("line_no"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"), "name")
    below = Window.partitionBy("path").orderBy("line_no").rangeBetween(1, within)
    following = F.min(F.when(F.col("name").isNotNull(), F.struct("line_no", "name"))).over(below)
    joined = one.unionByName(two).withColumn("next", following).where(F.col("kind").isNotNull())
    return joined.select("path", "line_no", "kind", "value", F.col("next.name").alias("symbol"))


def coverage(counts: DataFrame) -> DataFrame:
    """Existing annotations as a share of existing and missing ones, by path; nothing to do is 100."""
    return counts.select("path", "existing", "missing", share(F.col("existing"), F.col("existing") + F.col("missing"), 100.0).alias("coverage"))


def total_coverage(counts: DataFrame) -> DataFrame:
    summed = counts.agg(F.sum("existing").alias("existing"), F.sum("missing").alias("missing"))
    return summed.select("existing", "missing", share(F.col("existing"), F.col("existing") + F.col("missing"), 100.0).alias("coverage"))


def report(suggestions: DataFrame) -> DataFrame:
    """Counts and mean confidence by kind, by source and over all."""
    made = suggestions.groupingSets([("kind",), ("source",), ()], "kind", "source").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.countDistinct("target").alias("targets"), F.grouping_id().alias("g")
    )
    label = F.when(F.col("g") == 1, F.concat(F.lit("kind:"), "kind")).when(F.col("g") == 2, F.concat(F.lit("source:"), "source")).otherwise(F.lit("all"))
    return made.select(label.alias("label"), "n", "confidence", "targets")


def rendered(kind: Column, value: Column) -> Column:
    """An annotation as text, quoted where its kind is."""
    body = F.when(kind.isin(*QUOTED), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)
    return F.concat(F.lit(MARKER), kind, F.lit(" "), body)


def with_source_lines(kind: Column, value: Column, source: Column, confidence: Column, generation: Column) -> Column:
    """The annotation's text and the lines that state its source."""
    line = lambda name, v: F.concat(F.lit(f"{MARKER}source{name} "), v)
    parts = F.array(
        rendered(kind, value),
        line("", source),
        F.when(confidence < 1, line("-confidence", F.format_number(confidence, 2))),
        line("-reviewed", F.lit("false")),
        F.when(generation.isNotNull(), F.concat(F.lit(f'{MARKER}source-id "'), generation, F.lit('"'))),
    )
    return F.array_compact(parts)


def levels_include(level: str) -> tuple[str, ...]:
    return LEVELS[level]


def name_rules() -> list[tuple[str, str, str, float]]:
    """(part, kind, value, confidence) of every name rule, for reports."""
    return [(part, *made) for parts, items in NAMES for part, made in itertools.product(parts, items)]
