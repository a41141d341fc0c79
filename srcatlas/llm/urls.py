"""URL filters: rules for hosts and paths (DataFrame functions only).

A rule names a host and the beginning of a path.  It fits a URL whose host is
the rule's or one below it and whose path starts with the rule's.  Every URL is
expanded into expressions, each a suffix of its host followed by a prefix of its
path; an expression equals a rule's own text exactly if that rule fits.  URLs
and rules meet in an equality join on the first eight hex digits of the
expressions' SHA-256; the full digests then confirm, and of the rules that fit
the longest decides.

Prefixes are cut after each slash, and at the few lengths at which rules end
without one.  Nothing longer than the longest rule is expanded, so a URL of any
length gives at most (labels of the longest rule) x (its path's length)
expressions.  A URL's best rule travels as one number, its length and verdict;
the rule's text is read from the URL again.  Expressions of one row are combined
in the task that made them, so a hot host's rows shuffle once each, under their
own row numbers.

Up to ``BROADCAST_RULES`` rules, counted first, are broadcast (about 100 bytes
each).  Larger lists are joined by a shuffle on (hash prefix, salt), in which
every rule is repeated for each of ``SALTS`` salts, so that no expression holds
a task alone.

Rows are numbered by partition as they are read: hand in rows as they lie in
files or a written table, not those of a shuffle that may deliver them in
another order after a lost executor.

Cases: a null url or one without ``://`` has an empty host and path and no rule;
only A-Z are lower-cased, in hosts of URLs and of rules; ports and user names
belong to the host; an empty path does not start with ``/``; repeated rows, also
those of equal or null ids, are judged one by one; an empty table gives no rows;
no rules leave every URL to ``otherwise``; a rule without a host fits nothing;
rules of equal text count once, and ``block`` wins over ``allow``; of rules of
equal length that fit, the one with the longer host decides; of the table only
the id and the url are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the contract: verdict, and host with path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The verdict where no rule fits.
OTHERWISE = "allow"
BROADCAST_RULES = 100_000
SALTS = 32
HASH_DIGITS = 8


def listed_rules(spark: SparkSession, rules=RULES) -> DataFrame:
    """A list of (verdict, rule) as a table."""
    if not rules:
        return spark.sql("select cast(null as string) as verdict, cast(null as string) as rule where false")
    made = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules])
    return spark.range(1).select(F.inline(made))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://``; both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def prepared(rules: DataFrame) -> DataFrame:
    """host, path and block of each rule, once."""
    text = F.col("rule")
    host = ascii_lower(F.substring_index(text, "/", 1))
    path = F.substring(text, F.length(F.substring_index(text, "/", 1)) + 1, F.length(text))
    named = rules.select(host.alias("r_host"), path.alias("r_path"), (F.col("verdict") == "block").cast("int").alias("block"))
    return named.where("r_host != '' and block is not null").groupBy("r_host", "r_path").agg(F.max("block").alias("block"))


def host_suffixes(host: Column, longest: int, most_labels: int) -> Column:
    """The host and those above it, as far as a rule could name them."""
    labels = F.split(F.right(host, F.lit(longest + 1)), "\\.")
    counts = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels)))
    return F.transform(counts, lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))


def path_prefixes(path: Column, longest: int, lengths: list[int]) -> Column:
    """Prefixes that end in a slash, up to ``longest``, and those of the given lengths."""
    parts = F.split(F.substring(path, 1, longest), "/")
    found = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda _, i: F.concat(F.array_join(F.slice(parts, F.lit(1), i + 1), "/"), F.lit("/")))
    if not lengths:
        return found
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    return F.array_union(found, F.transform(fitting, lambda n: F.substring(path, F.lit(1), n)))


def rank(host_length: Column, path_length: Column, block: Column) -> Column:
    """Precedence as one number: length of the rule, length of its host, verdict."""
    return F.shiftleft((host_length + path_length).cast("long"), 32) + F.shiftleft(host_length.cast("long"), 1) + block


def judge(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    otherwise: str = OTHERWISE,
    broadcast_rules: int = BROADCAST_RULES,
    hash_digits: int = HASH_DIGITS,
) -> DataFrame:
    """The key, host, path, deciding rule and verdict of every row."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())

    known = prepared(rules)
    slashed = F.col("r_path").endswith("/")
    bounds = known.agg(
        F.count("*").alias("n"),
        F.max(F.length("r_host")).alias("host"),
        F.max(F.size(F.split("r_host", "\\."))).alias("labels"),
        F.max(F.when(slashed, F.length("r_path"))).alias("path"),
        F.sort_array(F.collect_set(F.when(~slashed, F.length("r_path")))).alias("lengths"),
    ).first()
    suffixes = host_suffixes(F.col("host"), bounds["host"] or 0, bounds["labels"] or 1)
    prefixes = path_prefixes(F.col("path"), bounds["path"] or 0, bounds["lengths"])

    def hashed(frame: DataFrame, text: Column, prefix: str, digest: str) -> DataFrame:
        return frame.withColumn(digest, F.sha2(text.cast("binary"), 256)).withColumn(prefix, F.substring(digest, 1, hash_digits))

    made = rows.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode_outer(prefixes))
    made = hashed(made, F.concat("suffix", F.coalesce("prefix", F.lit(""))), "short", "digest").drop("suffix", "prefix")
    listed = hashed(known, F.concat("r_host", "r_path"), "r_short", "r_digest")
    listed = listed.select("r_short", "r_digest", rank(F.length("r_host"), F.length("r_path"), F.col("block")).alias("rank"))

    on = (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest"))
    if bounds["n"] <= broadcast_rules:
        met = made.join(F.broadcast(listed), on, "left")
    else:
        spread = listed.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = made.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        met = salted.join(spread.hint("merge"), on & (F.col("salt") == F.col("r_salt")), "left")
    best = met.groupBy("row", "key", "host", "path").agg(F.max("rank").alias("rank"))

    length = F.shiftright("rank", 32).cast("int")
    of_host = F.shiftright("rank", 1).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    rule = F.when(F.col("rank").isNotNull(), F.concat(F.right("host", of_host), F.substring(F.col("path"), F.lit(1), length - of_host)))
    verdict = F.when(F.col("rank").isNull(), otherwise).when(F.col("rank") % 2 == 1, "block").otherwise("allow")
    return best.select(F.col("key").alias(key), "host", "path", rule.alias("rule"), verdict.alias("verdict"))
