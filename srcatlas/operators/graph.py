"""Call and import graphs as edge tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normalize, parent
from ..schema import IMPORT_EXTENSIONS
from ..storage import shared_dir, written


def hotpaths(edges: DataFrame, most: int = 10) -> DataFrame:
    """The symbols with most incoming calls; repeated calls count, ties go by name."""
    return edges.groupBy("callee").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "callee").limit(most)


def callers(edges: DataFrame) -> DataFrame:
    """Reverse adjacency: callers of each symbol, sorted, repeated calls kept."""
    return edges.groupBy("callee").agg(F.array_sort(F.collect_list("caller")).alias("callers"))


def callees(edges: DataFrame) -> DataFrame:
    """Forward adjacency, each callee once."""
    return edges.groupBy("caller").agg(F.array_sort(F.collect_set("callee")).alias("callees"))


def last_callee(edges: DataFrame) -> DataFrame:
    """The compatible forward view that holds only a caller's last call."""
    return edges.groupBy("caller").agg(F.max_by("callee", F.struct("path", "line_no", "callee")).alias("callee"))


def target(importer: Column, spec: Column) -> Column:
    """The normal path that an import names, or null for packages."""
    folder = parent(importer)
    joined = F.when(spec.startswith(".") & (folder != ""), F.concat_ws("/", folder, spec)).otherwise(spec)
    return F.when(spec.startswith(".") | spec.startswith("/"), normalize(joined))


def meanings(path: Column) -> Column:
    """What a file may be imported as, with the rank of that meaning: itself, without its extension, as a folder's index."""
    ends = ["", *IMPORT_EXTENSIONS, *[f"/index{e}" for e in IMPORT_EXTENSIONS]]
    made = [F.when(path.endswith(e), F.struct(F.expr("left(k, length(k) - {})".format(len(e))).alias("key"), F.lit(rank).alias("rank"))) for rank, e in enumerate(ends)]
    return F.array_compact(F.array(*made))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """importer, spec, imported: the first file that an import may mean.

    ``imports``: importer, spec; ``files``: path.  A file has at most three
    meanings and an import one target, so one equi join finds them all.  It is
    merged at every size: paths take few bytes on disk, and Spark would
    broadcast those of a million files.
    """
    wanted = imports.select("importer", "spec").distinct().withColumn("key", target(F.col("importer"), F.col("spec"))).where(F.col("key").isNotNull())
    known = files.select("path", normalize(F.col("path")).alias("k")).distinct().select("path", F.explode(meanings(F.col("k"))).alias("m")).select("path", "m.key", "m.rank")
    return wanted.join(known.hint("merge"), "key").groupBy("importer", "spec").agg(F.min_by("path", F.struct("rank", "path")).alias("imported"))


def imported_by(resolved: DataFrame) -> DataFrame:
    """Each imported file with its importers, sorted, each once."""
    return resolved.groupBy(F.col("imported").alias("path")).agg(F.array_sort(F.collect_set("importer")).alias("imported_by"))


def key_files(reverse: DataFrame, most: int = 10) -> DataFrame:
    """The files with most importers, from stored lists of them."""
    return reverse.select("path", F.size("imported_by").cast("long").alias("importers")).orderBy(F.desc("importers"), "path").limit(most)


def most_imported(resolved: DataFrame, most: int = 10) -> DataFrame:
    """The same from imports (importer, imported), counted without making lists."""
    pairs = resolved.select(F.col("imported").alias("path"), "importer").distinct()
    return pairs.groupBy("path").agg(F.count("*").alias("importers")).orderBy(F.desc("importers"), "path").limit(most)


def reach(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, reached, depth): the shortest distance from every node, at most ``most`` steps if given.

    Each round extends only what the last one found and drops what is known,
    so cycles end and the rounds stop when nothing is new.  A round's rows are checkpointed, so none is computed twice.
    """
    shared_dir(edges.sparkSession)
    steps = edges.select("src", "dst").distinct().checkpoint()
    fresh = steps.select(F.col("src").alias("node"), F.col("dst").alias("reached"), F.lit(1).cast("long").alias("depth"))
    known = fresh
    for depth in count(2):
        if most is not None and depth > most:
            break
        found = fresh.join(steps, fresh["reached"] == steps["src"]).select("node", F.col("dst").alias("reached")).distinct()
        fresh = found.join(known, ["node", "reached"], "left_anti").withColumn("depth", F.lit(depth).cast("long")).checkpoint()
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
        if depth % 16 == 0:
            known = known.checkpoint()  # the union of long chains stays short
    return known


def cycles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Nodes that reach themselves, with the length of their shortest cycle."""
    return reach(edges, most).where("node = reached").select("node", F.col("depth").alias("length"))


def relax(start: DataFrame, edges: DataFrame, keys: list[str], offer: Column) -> DataFrame:
    """(*keys, best): the least value of every node, from ``start`` along ``edges`` (src, dst, ...) until nothing improves.

    The last of ``keys`` is the node; ``offer`` makes the value at ``dst`` from
    ``best`` at ``src`` and the edge.  A round extends only what the last one
    improved, and what is known is cut from its lineage.
    """
    *others, node = keys
    known = fresh = written(start.select(*keys, "best"))
    while not fresh.isEmpty():
        met = fresh.join(edges, fresh[node] == edges["src"]).select(*others, F.col("dst").alias(node), offer.alias("best")).where("best is not null")
        offered = met.groupBy(*keys).agg(F.min("best").alias("best"))
        old = known.select(*keys, F.col("best").alias("old"))
        fresh = written(offered.join(old, keys, "left").where("old is null or best < old").select(*keys, "best"))
        known = written(known.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh))
    return known


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without edges that no cycle holds because they begin where none ends or end where none begins."""
    return edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")


def _passed(edges: DataFrame, loops: DataFrame) -> DataFrame:
    """node, before: nodes with one edge in and one out, larger than the node before them and without a loop of their own.

    All cycles of such a node hold the node before it, so the smallest node of a component is never one.
    """
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("before"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("m"))
    return into.join(out, "node").where("n = 1 and m = 1 and node > before").join(loops.select(F.col("src").alias("node")), "node", "left_anti").select("node", "before")


def _contracted(edges: DataFrame, passed: DataFrame, turn: int) -> DataFrame:
    """Some of the passed nodes become part of a longer edge; coins decide which of two neighbours goes."""
    heads = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 0
    ahead = passed.select(F.col("node").alias("before"), F.lit(True).alias("too"))
    gone = passed.join(ahead, "before", "left").where(heads(F.col("node")) & (F.col("too").isNull() | ~heads(F.col("before")))).select("node")
    first = edges.join(gone, edges["dst"] == gone["node"], "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("mid"), F.col("via").alias("one"))
    second = edges.join(gone, edges["src"] == gone["node"], "left_semi").select(F.col("src").alias("mid"), F.col("dst").alias("b"), F.col("via").alias("two"))
    longer = first.join(second, "mid").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.concat("one", F.array("mid"), "two").alias("via"))
    kept = edges.join(gone, edges["src"] == gone["node"], "left_anti").join(gone, edges["dst"] == gone["node"], "left_anti")
    return kept.unionByName(longer)


def _shortest(edges: DataFrame) -> DataFrame:
    """One edge for each two nodes: the one over fewest others, of those the first by name."""
    via = F.min(F.struct(F.size("via").alias("n"), "via"))["via"]
    return edges.groupBy("src", "dst").agg(via.alias("via"))


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.toDF("src"), "src", "left_anti").join(nodes.toDF("dst"), "dst", "left_anti")


def cycle_paths(edges: DataFrame) -> DataFrame:
    """component, length, path: for every strongly connected component that holds a cycle its shortest one through its smallest node.

    A component is called after its smallest node, at which the path begins and
    ends; of paths of equal length the first by names counts.  Nodes that no
    cycle holds are peeled off and runs of nodes with one way through are drawn
    together, in rounds, so that long rings and chains take few of them.  Of the
    rest, every node takes the smallest node that leads to it for its colour;
    what leads back to that node in its colour is its component, and the other
    nodes go round again.  No table of reachable pairs is made.
    """
    none = F.array().cast(f"array<{edges.schema['src'].dataType.simpleString()}>")
    rest = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct().withColumn("via", none))
    loops, turn = rest.where(F.lit(False)).select("src", "via"), 0
    while True:
        count = -1
        while True:
            turn += 1
            size = rest.agg(F.count("*").alias("n"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("loops")).first()
            if size["loops"]:
                loops = written(loops.unionByName(rest.where("src = dst").select("src", "via")))
                rest = rest.where("src != dst")
            passed = written(_passed(rest, loops))
            last, count = count, size["n"]
            if passed.isEmpty() and not size["loops"] and count in (0, last):
                break
            rest = written(_trimmed(_shortest(_contracted(rest, passed, turn))))
        if not count:
            break
        nodes = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
        colours = relax(nodes.withColumn("best", F.col("node")), rest, ["node"], F.col("best")).select("node", F.col("best").alias("colour"))
        inside = written(rest.join(colours.toDF("src", "colour"), "src").join(colours.toDF("dst", "colour"), ["dst", "colour"]))
        roots = colours.where("node = colour").select("node", F.lit(0).alias("best"))
        members = relax(roots, inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["node"], F.lit(0)).select("node")
        core = written(inside.join(members.toDF("src"), "src", "left_semi").join(members.toDF("dst"), "dst", "left_semi"))
        step = F.struct((F.size("via") + 1).alias("n"), F.col("via").alias("way"))
        start = core.where("src = colour").groupBy(F.col("dst").alias("node")).agg(F.min(step).alias("best"))
        onward = F.struct((F.col("best.n") + F.size("via") + 1).alias("n"), F.concat("best.way", F.array("src"), "via").alias("way"))
        ends = relax(start, core.where("src != colour"), ["node"], onward)
        closed = ends.join(colours.where("node = colour"), "node").select(F.col("node").alias("src"), F.col("best.way").alias("via"))
        # loops of nodes within a larger component are no component of their own
        inner = members.join(colours, "node").where("node != colour").select(F.col("node").alias("src"))
        loops = written(loops.join(inner, "src", "left_anti").unionByName(closed))
        rest = written(_without(rest, members))
    best = loops.groupBy(F.col("src").alias("component")).agg(F.min(F.struct(F.size("via").alias("n"), "via"))["via"].alias("via"))
    return best.select("component", (F.size("via") + 1).cast("long").alias("length"), F.concat(F.array("component"), "via", F.array("component")).alias("path"))
