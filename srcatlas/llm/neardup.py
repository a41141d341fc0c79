"""Near-duplicate classes by improved consistent weighted sampling.

A text is a weighted set of its runs of ``SHINGLE`` words (letters and digits,
lower case); a shingle weighs its term frequency times its inverse document
frequency

    tf = 1 + ln(count),   idf = 1 + log10(1 + N / max(df, FLOOR * N)).

At most (mean shingles per text) / FLOOR shingles occur in a share FLOOR of
all documents, whatever N, so the table of frequencies that differ from the
floor has a fixed bound and is broadcast.  It is exact: blocks of documents
name the shingles that half that share of them hold; one frequent overall has
at least half of its share in the blocks that name it, which leaves at most
twice as many candidates, and a second pass counts those over all documents.

``BANDS`` x ``ROWS`` samples of improved consistent weighted sampling (Ioffe,
2010) make the bands.  Exact copies are one representative.  Texts that share
a band are linked when their weighted Jaccard similarity, computed exactly
from the texts, is at least ``SIMILARITY``; classes are the components of the
links.  A first round pairs the members of a band's bucket with the one of most
company (the text others were copied from shares most bands); then members
outside a bucket's largest component meet pivots of the other components, drawn
anew every round.  That joins most of a large group at the cost of a few pairs
for each member.  A last step then verifies every pair of different components
that shares a band, so no pair of a bucket goes untested but those whose class
is already one: small buckets pair by pair, larger ones in blocks of at most
about ``CHUNK`` by ``CHUNK`` members, each pair in the first band it shares.

Cases: null and empty texts are equal to each other and form one class; texts
of fewer words than a shingle are one shingle; a null id forms its own class
under its copies; repeated rows share a class and all but one are dropped;
ties go to the smaller id; an empty table gives no rows; very long texts are
shingled and sampled whole, a slice of their shingles at a time; only doc_id and
text are read, and ``deduplicate`` returns the columns of its input whatever
their names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .components import components
from .substrings import keyed
from .wordhash import mix, plain_words, sequence_hashes

SHINGLE = 5
SIMILARITY = 0.8
FLOOR = 0.01
BANDS = 16
ROWS = 3
ROUNDS = 3
#: Members of a bucket that go to the last step pair by pair, not in blocks.
FEW = 8
#: Members on each side of a block of the last step.
CHUNK = 512
#: Documents of a block that names frequent shingles, and of a partition on average.
BLOCK = 2000
#: Weight classes per factor of two; samples use the class, verification the weight.
STEPS = 8


class Shingles:
    """Distinct shingles of each text of a batch, with their counts."""

    def __init__(self, column: pa.Array, length: int = SHINGLE):
        words = plain_words(column)
        hashes, first = words.hashes(), words.first
        runs = sequence_hashes(hashes, length)
        sizes = np.diff(first)
        self.sets = []
        for begin, n in zip(first[:-1].tolist(), sizes.tolist(), strict=True):
            if n >= length:
                h = runs[begin : begin + n - length + 1]
            elif n:
                h = sequence_hashes(hashes[begin : begin + n], n)
            else:
                h = runs[:0]
            self.sets.append(np.unique(h, return_counts=True))


class Weights:
    """Inverse document frequencies: a table of frequent shingles, the floor for the rest."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, documents: int):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.idf = 1 + np.log10(1 + documents / np.maximum(df[order], 1))
        self.rest = 1 + np.log10(1 + 1 / FLOOR)

    def of(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idf = np.full(shingles.size, self.rest)
        if self.keys.size and shingles.size:
            at = np.minimum(np.searchsorted(self.keys, shingles), self.keys.size - 1)
            hit = self.keys[at] == shingles
            idf[hit] = np.minimum(self.idf[at[hit]], self.rest)
        return (1 + np.log(np.maximum(counts, 1))) * idf


def frequent(texts: DataFrame, documents: int, floor: float = FLOOR) -> Weights:
    """Exact document frequencies of all shingles in at least a share ``floor`` of the documents."""

    def heavy(sets):
        keys, n = np.unique(np.concatenate([s for s, _ in sets]), return_counts=True)
        named = n >= floor / 2 * len(sets)
        return pa.RecordBatch.from_arrays([pa.array(keys[named].view(np.int64)), pa.array(n[named])], ["s", "n"])

    def name(batches):
        sets = []
        for batch in batches:
            sets += Shingles(batch.column(0)).sets
            if len(sets) >= BLOCK:
                yield heavy(sets)
                sets = []
        if sets:
            yield heavy(sets)

    least = floor * documents
    # a block of few texts names most of their shingles, so small partitions are merged
    merged = texts.select("text").coalesce(max(1, documents // BLOCK))
    named = merged.mapInArrow(name, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least / 2).select("s").toArrow()
    known = np.sort(named.column("s").to_numpy().astype(np.int64).view(np.uint64))  # at most 2 / floor of a mean text's shingles
    if not known.size:
        return Weights(np.empty(0, np.uint64), np.empty(0, np.int64), documents)
    table = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        known = table.value
        total = np.zeros(known.size, np.int64)
        for batch in batches:
            for shingles, _ in Shingles(batch.column(0)).sets:
                at = np.minimum(np.searchsorted(known, shingles), known.size - 1)
                total[at[known[at] == shingles]] += 1
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[hit].view(np.int64)), pa.array(total[hit])], ["s", "n"])

    counted = texts.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    table.unpersist()
    return Weights(counted.column("s").to_numpy().astype(np.int64).view(np.uint64), counted.column("n").to_numpy().astype(np.int64), documents)


class Sampler:
    """Improved consistent weighted sampling, with its random variables tabulated.

    For sample k, a shingle's hash picks r ~ Gamma(2, 1), beta ~ Uniform(0, 1)
    (together one of 65536 quantised pairs) and c ~ Gamma(2, 1) (one of 65536
    quantiles).  Weights fall in classes of 1/STEPS of a factor of two; per
    class t = floor(ln w / r + beta) and ln y = r (t - beta) are tabulated, and
    the shingle with the smallest ln c - ln y - r is sampled as (shingle, t).
    """

    def __init__(self, samples: int):
        rng = np.random.default_rng(29)
        self.keys = (rng.integers(1, 1 << 63, samples, np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
        gamma = rng.gamma(2.0, size=(3, 1 << 16))
        self.r, self.beta = gamma[0], rng.random(1 << 16)
        self.c = np.log(np.sort(gamma[1])).astype(np.float32)
        self.c = self.c[rng.permutation(1 << 16)]
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        if step not in self.tables:
            weight = step * np.log(2) / STEPS
            t = np.floor(weight / self.r + self.beta)
            # ln a = ln c - ln y - r
            self.tables[step] = ((-(self.r * (t - self.beta)) - self.r).astype(np.float32), t.astype(np.int32))
        return self.tables[step]

    def samples(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        steps = np.rint(np.log2(weights) * STEPS).astype(np.int64)
        out = np.empty(self.keys.size, np.uint64)
        kinds, at = np.unique(steps, return_inverse=True)
        # the k x n matrix of hashes in slices, so a long text stays small
        best_a = np.full(self.keys.size, np.inf, np.float32)
        for low in range(0, shingles.size, 8192):
            part = shingles[low : low + 8192]
            h = part[None, :] * self.keys[:, None]
            h ^= h >> np.uint64(31)
            pair = ((h >> np.uint64(7)) & np.uint64(0xFFFF)).astype(np.intp)
            c = ((h >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.intp)
            a = self.c[c]
            if kinds.size == 1:
                a += self.table(int(kinds[0]))[0][pair]
            else:
                local = at[low : low + 8192]
                for j in np.unique(local):
                    sel = local == j
                    a[:, sel] += self.table(int(kinds[j]))[0][pair[:, sel]]
            least = a.argmin(axis=1)
            rows = np.arange(self.keys.size)
            won = a[rows, least] < best_a
            best_a = np.where(won, a[rows, least], best_a)
            for k in np.flatnonzero(won):
                i = int(least[k])
                t = self.table(int(steps[low + i]))[1][pair[k, i]]
                out[k] = part[i] ^ np.uint64((int(t) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        return mix(out)


def signatures(texts: DataFrame, weights: Weights, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The band keys of every text; none for a text without words."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def go(batches):
        sampler = Sampler(bands * rows)
        mark = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            found = []
            for shingles, counts in Shingles(batch.column(3)).sets:
                if shingles.size:
                    s = sampler.samples(shingles, shared.value.of(shingles, counts)).reshape(bands, rows)
                    key = mark.copy()
                    for j in range(rows):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, j])
                    found.append(key.view(np.int64))
                else:
                    found.append(np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "bands"])

    return texts.select("doc_id", "k1", "k2", "text").mapInArrow(go, "doc_id long, k1 long, k2 long, bands array<long>")


def similarity(left, right, weights: Weights) -> float:
    """Weighted Jaccard similarity of two shingle sets."""
    (a, n), (b, m) = left, right
    every, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    weight = np.zeros((2, every.size))
    weight[0, at[: a.size]] = weights.of(a, n)
    weight[1, at[a.size :]] = weights.of(b, m)
    top = float(weight.max(axis=0).sum())
    return float(weight.min(axis=0).sum()) / top if top else 1.0


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The pairs (a, b) with their similarity, null where it is below the threshold."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def go(batches):
        last: tuple = (None, None)
        for batch in batches:
            left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ones = Shingles(batch.column(3)).sets
            fresh = [i for i, a in enumerate(left) if a != (left[i - 1] if i else last[0])]
            pivots = dict(zip(fresh, Shingles(batch.column(2).take(pa.array(fresh, pa.int32()))).sets, strict=True))
            out = []
            for i, (a, b) in enumerate(zip(left, right, strict=True)):
                if i in pivots:
                    last = (a, pivots[i])
                s = similarity(last[1], ones[i], shared.value)
                out.append((a, b, s if s >= threshold else None))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["a", "b", "s"])

    one = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    two = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(one, "b").join(two, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(go, "a long, b long, s double")


def first_pairs(members: DataFrame) -> DataFrame:
    """Every member of a bucket with the bucket's member of most company."""
    busy = F.max(F.struct("company", (-F.col("node")).alias("less"))).alias("busy")
    pivots = materialise(members.groupBy("band").agg(busy).select("band", (-F.col("busy.less")).alias("p")), "pivots")
    return _ordered(members.join(pivots, "band").where("p != node"))


def stray_pairs(members: DataFrame, turn: int) -> DataFrame:
    """In buckets of several components, members outside the largest one with pivots of other components.

    ``members``: band, node, part.  The pivots are three members of the
    largest component and one of the others, drawn anew each turn, so a bucket
    gives at most four pairs for each stray, however many it holds.
    """
    sizes = members.groupBy("band", "part").agg(
        F.count("*").alias("n"), *[F.max(F.struct(F.xxhash64("node", F.lit(7 * turn + k)).alias("h"), "node"))["node"].alias(f"p{k}") for k in range(3)]
    )
    largest = sizes.groupBy("band").agg(F.max(F.struct("n", "part", "p0", "p1", "p2")).alias("main"), F.min("part").alias("low"), F.max("part").alias("high"))
    largest = materialise(largest.where("low < high").select("band", "main"), "largest")
    strays = materialise(members.join(largest, "band").where("part != main.part").select("band", "node", "part", "main"), "strays")
    with_main = strays.select("node", F.explode(F.array_distinct(F.array("main.p0", "main.p1", "main.p2"))).alias("p"))
    drawn = materialise(strays.groupBy("band").agg(F.max(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "part")).alias("d")), "drawn")
    among = strays.join(drawn, "band").where("part != d.part").select("node", F.col("d.node").alias("p"))
    pairs = with_main.unionByName(among)
    return _ordered(pairs)


def few_pairs(members: DataFrame, few: int = FEW) -> DataFrame:
    """All pairs of different components in buckets of at most ``few`` members."""
    sizes = members.groupBy("band").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
    sizes = materialise(sizes.where((F.col("n") <= few) & (F.col("low") < F.col("high"))).select("band"), "few")
    held = materialise(members.join(sizes, "band").select("band", "node", "part"), "held")
    others = held.select("band", F.col("node").alias("p"), F.col("part").alias("p_part"))
    return _ordered(held.join(others, "band").where("p < node and p_part != part").select("node", "p"))


def block_links(members: DataFrame, banded: DataFrame, texts: DataFrame, weights: Weights, threshold: float, few: int = FEW, chunk: int = CHUNK) -> DataFrame:
    """The links among all pairs of different components in buckets of more than ``few`` members.

    ``members``: band, node, part; ``banded``: node, bands.  A bucket's members
    outside its largest component (strays) meet all its members.  Both are
    dealt into chunks, and each block of a chunk of strays and a chunk of
    members is one group of bounded size.  A pair that shares several bands is
    verified in the first.
    """
    sizes = members.groupBy("band", "part").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("main"), F.count("*").alias("parts"))
    buckets = buckets.where((F.col("parts") > 1) & (F.col("n") > few))
    count = lambda n: F.ceil(n / chunk).cast("int")
    buckets = materialise(buckets.select("band", F.col("main.part").alias("main"), count(F.col("n") - F.col("main.n")).alias("us"), count(F.col("n")).alias("vs")), "blocks")
    held = members.join(buckets, "band").withColumn("stray", F.col("part") != F.col("main"))
    dealt = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = held.select("band", "node", "part", "stray", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("us") - 1)).alias("u"), dealt("vs", 3).alias("v"))
    strays = held.where("stray").select("band", "node", "part", "stray", F.lit(True).alias("left"), dealt("us", 5).alias("u"), F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("v"))
    rows = every.unionByName(strays).join(banded, "node").join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def go(block: pa.Table) -> pa.Table:
        left = block.column("left").to_numpy()
        found = _block(block.filter(pa.array(left)), block.filter(pa.array(~left)), shared.value, threshold) if left.any() and not left.all() else []
        columns = list(zip(*found, strict=True)) or [()] * 2
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64())], ["a", "b"])

    rows = rows.select("band", "u", "v", "left", "stray", "node", "part", "bands", "text")
    return rows.groupBy("band", "u", "v").applyInArrow(go, "a long, b long")


def _block(one: pa.Table, two: pa.Table, weights: Weights, threshold: float) -> list[tuple[int, int]]:
    """The linked pairs of a stray of ``one`` and a member of ``two`` whose first shared band is the block's."""
    sets = [Shingles(t.column("text").combine_chunks()).sets for t in (one, two)]
    bands = [np.array(t.column("bands").to_pylist(), np.int64) for t in (one, two)]
    node, part = ([t.column(c).to_numpy() for t in (one, two)] for c in ("node", "part"))
    stray = two.column("stray").to_numpy()
    band = one.column("band")[0].as_py()
    place = int(np.flatnonzero(bands[0][0] == band)[0])
    sizes = np.array([s.size for s, _ in sets[1]])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # the members' shingles as numbers; a stray's weights are spread over them
    known, at = np.unique(np.concatenate([s for s, _ in sets[1]]), return_inverse=True)
    weight = np.concatenate([weights.of(s, n) for s, n in sets[1]])
    total = np.add.reduceat(weight, begin)
    spread = np.zeros(known.size)
    links = []
    for i, (shingles, counts) in enumerate(sets[0]):
        wanted = (part[1] != part[0][i]) & (~stray | (node[0][i] < node[1]))
        wanted &= (bands[1] == bands[0][i]).argmax(axis=1) == place
        if not wanted.any():
            continue
        own = weights.of(shingles, counts)
        where = np.minimum(np.searchsorted(known, shingles), known.size - 1)
        hit = known[where] == shingles
        spread[where[hit]] = own[hit]
        common = np.add.reduceat(np.minimum(spread[at], weight), begin)
        spread[where[hit]] = 0
        near = common / (own.sum() + total - common) >= threshold - 1e-9
        # the last digits as in all other rounds
        links += [(int(node[0][i]), int(node[1][j])) for j in np.flatnonzero(wanted & near) if similarity((shingles, counts), sets[1][j], weights) >= threshold]
    return links


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct()


def classes(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, k1, k2 (its text's key), representative, class_id and kept for every row.

    ``kept`` is true for one row of each class: the first with the smallest id.
    """
    small_batches(docs.sparkSession)
    texts = keyed(docs)
    documents = docs.count()
    weights = frequent(texts, documents)
    signed = materialise(signatures(texts, weights, bands, rows), "signatures")

    # exact copies are one representative; an unnamed text (all its ids null) stays out of the links
    groups = materialise(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.min("bands").alias("bands")), "groups")
    # equal ids are one document, whatever their texts
    nodes = groups.where(F.col("node").isNotNull() & (F.size("bands") > 0))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    # written first: a join of two plain shuffles can split a hot band, one with an aggregate cannot
    shared = materialise(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = banded.join(shared, "band")
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    members = materialise(members.join(company, "node").select("band", "node", "company"), "members")
    named = groups.select("k1", "k2", "node").join(members.select("node").distinct(), "node", "left_semi")
    wanted = texts.join(named, (texts["k1"] == named["k1"]) & (texts["k2"] == named["k2"]) & (texts["doc_id"] == named["node"]))
    wanted = materialise(wanted.select(texts["doc_id"], texts["text"]).dropDuplicates(["doc_id"]), "candidates")

    def placed():
        if parts is None:
            return members.select("band", "node", F.col("node").alias("part"))
        return members.join(parts, "node", "left").select("band", "node", F.coalesce("component", "node").alias("part"))

    parts = tried = None  # (node, component) of linked nodes; all pairs verified so far
    for turn in range(rounds):
        pairs = first_pairs(members) if turn == 0 else stray_pairs(placed(), turn)
        tests = materialise(verified(pairs, wanted, weights, threshold), "links")
        tried = tests if tried is None else tried.unionByName(tests)
        links = tests.where("s is not null").select("a", "b")
        if links.isEmpty():
            break
        parts = materialise(_joined(parts, links), "parts")

    # whatever the rounds left: all pairs of a bucket that are not in one component
    rest = materialise(placed(), "placed")
    few = few_pairs(rest)
    few = few if tried is None else few.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    links = verified(few, wanted, weights, threshold).where("s is not null").select("a", "b")
    links = materialise(links.unionByName(block_links(rest, nodes.select("node", "bands"), wanted, weights, threshold)), "links")
    if not links.isEmpty():
        parts = materialise(_joined(parts, links), "parts")

    joined = signed.select("doc_id", "k1", "k2").join(groups.select("k1", "k2", "node"), ["k1", "k2"])
    if parts is not None:
        joined = joined.join(parts, "node", "left")
    else:
        joined = joined.withColumn("component", F.lit(None).cast("long"))
    return joined.select(
        "doc_id", "k1", "k2",
        F.col("node").alias("representative"),
        F.coalesce("component", "node").alias("class_id"),
        (F.col("doc_id").eqNullSafe(F.coalesce("component", "node"))).alias("kept"),
    )


def _joined(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after further links; later links join components, not single nodes."""
    if parts is None:
        return components(links)
    for side in ("a", "b"):
        named = parts.select(F.col("node").alias(side), "component")
        links = links.join(named, side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
    joined = components(links).select(F.col("node").alias("old"), F.col("component").alias("new"))
    every = parts.select("node", "component").unionByName(joined.select(F.col("old").alias("node"), F.col("old").alias("component"))).distinct()
    return every.join(joined, every["component"] == joined["old"], "left").groupBy("node").agg(F.min(F.coalesce("new", "component")).alias("component"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, with all its columns."""
    found = classes(docs, **options).where("kept").select("doc_id", "k1", "k2")
    text = F.coalesce(F.col("text"), F.lit(""))
    # all of a row in one column, so that no name can clash
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("one"), F.xxhash64(F.lit(17), text).alias("two"),
    )
    on = (marked["one"] == found["k1"]) & (marked["two"] == found["k2"]) & marked["id"].eqNullSafe(found["doc_id"])
    return marked.join(found, on, "left_semi").dropDuplicates(["id", "one", "two"]).select("row.*")
