"""Budgeted selection of document sections."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of safety, efficiency, accuracy and base by preset.
PRESETS = {
    "safe": (2.5, 0.8, 1.0, 0.8), "efficient": (1.2, 2.0, 0.9, 0.8), "accurate": (1.2, 0.9, 2.0, 0.8), "balanced": (1.5, 1.0, 1.0, 1.0),
}
# Budgets below which a tier ends, and the tiers' target tokens (command line, protocol).
TIERS = (("micro", 300, 250, 178), ("minimal", 450, 400, 320), ("standard", 700, 600, 480), ("full", None, 1400, 1100))
# Selection thresholds and defaults.
SAFE, SAFE_PERCENT, PRIORITY, TOKENS = 80, 40.0, 100, 50
DIMENSIONS = ("safety", "efficiency", "accuracy", "base")


def tier(budget: Column) -> Column:
    made = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, end, _, _ in TIERS[:-1]:
        made = made.when(budget < end, name)
    return made.otherwise(TIERS[-1][0])


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0)), F.lit(255))


def modified(value: Column, modifiers: Column, dimension: str) -> Column:
    """A 0 to 255 value after its modifiers, in order: add, then multiply and cut, then set.

    ``modifiers``: array of struct(dimension, add, multiply, set, active).
    """

    def step(v: Column, m: Column) -> Column:
        added = F.when(m["add"].isNotNull(), clamp(v + m["add"])).otherwise(v)
        scaled = F.when(m["multiply"].isNotNull(), clamp((added * m["multiply"]).cast("int"))).otherwise(added)
        put = F.when(m["set"].isNotNull(), clamp(m["set"])).otherwise(scaled)
        here = m["active"] & (F.coalesce(m["dimension"], F.lit("all")).isin(dimension) | ~F.coalesce(m["dimension"], F.lit("all")).isin(*DIMENSIONS))
        return F.when(here, put.cast("int")).otherwise(v)

    return F.aggregate(modifiers, value.cast("int"), step)


def score(sections: DataFrame, preset: str = "balanced", modifiers: str | None = None) -> DataFrame:
    """Adds ``value``, the weighted sum of the dimensions, and ``density``, value per token."""
    weights = PRESETS.get(preset, PRESETS["balanced"])
    own = lambda d: modified(F.col(d), F.col(modifiers), d) if modifiers else F.col(d)
    value = sum((own(d).cast("double") * w for d, w in zip(DIMENSIONS, weights, strict=True)), F.lit(0.0))
    return sections.withColumn("value", value).withColumn("density", F.when(F.col("tokens") > 0, F.col("value") / F.col("tokens")).otherwise(0.0))


def dynamic_tokens(count: Column, item_tokens: Column, max_items: Column) -> Column:
    """Tokens of a section that lists items."""
    return F.least(F.coalesce(count, F.lit(5)), F.coalesce(max_items, F.lit(10))) * F.coalesce(item_tokens, F.lit(10))


def capable(any_of: Column, all_of: Column, offered: list[str]) -> Column:
    """True without requirements, else any of the first and all of the second."""
    have = F.array(*map(F.lit, offered)) if offered else F.array().cast("array<string>")
    one = F.coalesce(F.size(any_of), F.lit(0)) <= 0
    every = F.coalesce(F.size(all_of), F.lit(0)) <= 0
    return (one | F.arrays_overlap(any_of, have)) & (every | F.forall(all_of, lambda c: F.array_contains(have, c)))


@dataclass
class Section:
    """What the selection needs of one section."""

    id: str
    tokens: int
    value: float
    density: float
    safety: int = 0
    required: bool = False
    wanted: bool = False  # its condition holds
    priority: int = PRIORITY
    depends: list[str] = field(default_factory=list)
    conflicts: list[str] = field(default_factory=list)


def select(sections: list[Section], budget: int, safe_percent: float = SAFE_PERCENT) -> list[tuple[Section, str]]:
    """Sections and the phase that took each.

    Phases: required; wanted; safe ones by value within their share of the
    budget; the rest by density.  A phase's list leaves out what earlier phases
    excluded; the last two also need a section's dependencies to be in.
    """
    taken: dict[str, tuple[Section, str]] = {}
    barred: set[str] = set()
    left = budget

    def phase(name: str, rows: list[Section], most: int | None = None, dependent: bool = False) -> None:
        nonlocal left
        spent = 0
        for s in rows:
            if s.tokens > left or (most is not None and spent + s.tokens > most) or (dependent and not set(s.depends) <= taken.keys()):
                continue
            taken[s.id] = (s, name)
            barred.update(s.conflicts)
            left -= s.tokens
            spent += s.tokens

    open_ = lambda keep: [s for s in sections if s.id not in taken and s.id not in barred and keep(s)]
    phase("required", open_(lambda s: s.required))
    phase("conditional", open_(lambda s: s.wanted))
    phase("safety", sorted(open_(lambda s: s.safety >= SAFE), key=lambda s: -s.value), int(budget * safe_percent / 100), True)
    phase("value", sorted(open_(lambda s: True), key=lambda s: -s.density), None, True)
    return sorted(taken.values(), key=lambda t: t[0].priority)


def select_sections(scored: DataFrame, budget: int, safe_percent: float = SAFE_PERCENT) -> DataFrame:
    """The selection for every catalogue (column ``catalogue``; a catalogue has a few hundred sections)."""
    columns = ["id", "tokens", "value", "density", "safety", "required", "wanted", "priority", "depends", "conflicts"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        listed = [Section(**{c: r[c] for c in columns[:8]}, depends=list(r["depends"]), conflicts=list(r["conflicts"])) for r in rows.sort_values("ord").to_dict("records")]
        picked = select(listed, budget, safe_percent)
        return pd.DataFrame(
            {"catalogue": [rows["catalogue"].iloc[0]] * len(picked), "at": range(len(picked)), "id": [s.id for s, _ in picked], "tokens": [s.tokens for s, _ in picked], "phase": [p for _, p in picked]}
        )

    return scored.select("catalogue", "ord", *columns).groupBy("catalogue").applyInPandas(run, "catalogue string, at long, id string, tokens long, phase string")


def merge_sections(base: DataFrame, project: DataFrame, key: str = "id") -> DataFrame:
    """The project's sections replace those of the same id and append others."""
    return base.join(project.select(key), key, "left_anti").unionByName(project, allowMissingColumns=True)


def apply_overrides(sections: DataFrame, overrides: DataFrame, fields: list[str], disabled: list[str]) -> DataFrame:
    """Overridden fields win; disabled sections go."""
    given = overrides.select("id", *[F.col(f).alias(f"new_{f}") for f in fields])
    joined = sections.join(given, "id", "left")
    kept = [F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in sections.columns]
    return joined.select(*kept).where(~F.col("id").isin(*disabled)) if disabled else joined.select(*kept)


def render(template: str, variables: dict[str, str]) -> str:
    """``{{name}}`` replaced; lines of ``{{#if name}}`` with nothing to show go."""
    lines = []
    for line in template.split("\n"):
        start = line.find("{{#if ")
        if start >= 0:
            end = line.index("}}", start)
            name = line[start + 6 : end].strip()
            body = line[end + 2 :].replace("{{/if}}", "")
            if not variables.get(name):
                continue
            line = line[:start] + body
        for name, value in variables.items():
            line = line.replace("{{" + name + "}}", value)
        lines.append(line)
    return "\n".join(lines)


def render_list(items: Column, header: str, footer: str, separator: str, empty: str) -> Column:
    """A list section's text from its rendered items."""
    body = F.concat(F.lit(header), F.array_join(items, separator), F.lit(footer))
    return F.when(F.size(items) > 0, body).otherwise(F.lit(empty))


def dynamic_rows(items: DataFrame, sections: DataFrame) -> DataFrame:
    """The items that listing sections show.

    ``items``: source, key, level, expired, fields (map); ``sections``: id,
    source, levels, expired, max_items.  A null filter keeps all; the first
    ``max_items`` by key stay.
    """
    joined = items.join(sections, "source")
    kept = joined.where(
        (F.col("levels").isNull() | F.array_contains("levels", F.col("level"))) & (F.col("wanted_expired").isNull() | (F.col("expired") == F.col("wanted_expired")))
    )
    ranked = kept.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("key")))
    return ranked.where(F.col("at") <= F.coalesce("max_items", F.lit(10))).select("id", F.col("at").cast("long").alias("at"), "key", "level", "fields")


def filled(template: Column, values: Column) -> Column:
    """A template with ``{{name}}`` replaced from a map; unknown names become nothing."""
    done = F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))
    return F.regexp_replace(done, r"\{\{[^}]*\}\}", "")


def render_sections(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Each section's text from its rows: header, items joined by the separator, footer, or the text for none.

    ``sections``: id, header, item, separator, footer, empty.
    """
    listed = rows.join(sections.select("id", "item"), "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", filled(F.col("item"), F.col("fields")).alias("t")))).alias("l"))
    joined = sections.join(listed, "id", "left")
    body = F.concat("header", F.expr("array_join(transform(l, x -> x.t), separator)"), "footer")
    return joined.select("id", F.when(F.coalesce(F.size("l"), F.lit(0)) > 0, body).otherwise(F.col("empty")).alias("text"))


def listing(sections: DataFrame) -> DataFrame:
    """What the sections are: id, name (the id without one), category, tokens, required, capabilities."""
    return sections.select("id", F.coalesce("name", "id").alias("name"), "category", "tokens", F.coalesce("required", F.lit(False)).alias("required"), "capabilities")


def presets() -> list[tuple[str, float, float, float, float]]:
    """The presets with their weights of safety, efficiency, accuracy and base."""
    return [(name, *weights) for name, weights in PRESETS.items()]
