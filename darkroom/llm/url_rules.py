r"""URL filters as a sort-merge range join, in DataFrame operations only.

A rule is a host and a path prefix; it fits its host and all subdomains where the url's path starts with its path. The host's
labels in reverse order, a separator and the path make a canonical key, in which every rule's urls are one interval of
keys: those that start with the rule's key. A url is looked up once for each suffix of its host that has as many labels as some
rule's host, so that rules of a domain meet the urls of its subdomains; longer suffixes can meet no rule.

Each lookup is a point. Points and interval ends are dealt by ranges of keys and swept in order. Intervals of prefixes
nest, so the active rules are a stack: at a rule's start the rule is the top, at its end its parent is. The sweep carries the
top along with a running last value, and the parent pointers are the rest of the stack. Of a url's suffixes, the longest rule
(host and path together, then host) wins.

Dealing out: equal urls are looked up once, and meet their rows again in a join that Spark may split. There are as many ranges
as shuffle partitions, 64 at least, cut at quantiles of a bounded hash sample of the keys (it decides only how evenly work is
dealt). A key finds its range in two steps, among every so many cuts and then among the cuts between two of these, so that
it is compared with about twice the square root of their number. Rules that are open over several ranges are repeated in
each. Only the sample, 16 keys for each range, and the distinct numbers of labels of the rules' hosts reach the driver.

Defined cases: a null url or one without :// has empty host and path and no rule; an empty host has no suffix and no
rule; equal rules count once (block before allow where they differ); repeated rows and null ids keep a row each; an
empty table of pages or of rules works; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts a reversed host from the path: below every character of a host or path but controls.
MARK = "\x01"
#: Above every byte of UTF-8.
LAST = b"\xff"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column, path: Column) -> Column:
    """Canonical key: the bytes of labels in reverse order, MARK, path."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(MARK), path).cast("binary")


def suffixes(host: Column, sizes: list[int]) -> Column:
    """Of a host and its parent domains those of so many labels."""
    labels = F.split(host, r"\.")
    some = F.filter(F.array(*(F.lit(n) for n in sizes)).cast("array<int>"), lambda n: (n <= F.size(labels)) & (host != ""))
    return F.transform(some, lambda n: F.array_join(F.slice(labels, -n, n), "."))


def intervals(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) -> (start, top, parent): what is on top of the stack within a rule and after its end."""
    once = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where(F.col("host").isNotNull())
    once = once.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    top = F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), "verdict").alias("top")
    keyed = once.select("host", "path", key_of(F.col("host"), F.col("path")).alias("start"), top)
    # a rule's parent is the longest rule among the proper prefixes of its path at its host
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda i: F.concat(key_of(F.col("host"), F.lit("")), F.substring(F.col("path"), F.lit(1), i).cast("binary"))))
    up = keyed.where(F.length("path") > 0).select("start", cut.alias("up")).join(keyed.select(F.col("start").alias("up"), "top"), "up")
    parents = up.groupBy("start").agg(F.max("top").alias("parent"))
    none = F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("n", "int"), ("h", "int"), ("rule", "string"), ("verdict", "string"))))
    return keyed.join(parents, "start", "left").select("start", "top", F.coalesce("parent", none).alias("parent"))


def range_of(key: Column, cuts: list[bytes]) -> Column:
    """How many of the ascending cuts are no larger than a key."""
    below = lambda some: F.size(F.filter(some, lambda c: c <= key))
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    group = below(F.array(*(F.lit(g[0]) for g in groups)))
    inside = F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), F.greatest(group, F.lit(1)))
    return F.when(group == 0, 0).otherwise((group - 1) * step + below(inside))


def judge(pages: DataFrame, row: str, url: str, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """(row, host, path, rule, verdict) of every page; without a rule, rule is null and the verdict is the default."""
    ranges = ranges or max(64, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = pages.select(F.col(row).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    targets = rows.select("host", "path").distinct()
    sizes = sorted(r[0] for r in rules.where(F.col("host").isNotNull()).select(F.size(F.split("host", r"\."))).distinct().collect())
    lookups = targets.select("host", "path", F.explode(suffixes(F.col("host"), sizes)).alias("domain"))
    lookups = lookups.select("host", "path", key_of(F.col("domain"), F.col("path")).alias("key"))
    sample = sorted(bytes(r[0]) for r in lookups.select("key").orderBy(F.xxhash64("key"), "key").limit(16 * ranges).collect())
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    at = lambda k: range_of(k, cuts)

    ends = intervals(rules).withColumn("end", F.concat("start", F.lit(LAST))).withColumns({"first": at(F.col("start")), "final": at(F.concat("start", F.lit(LAST)))})
    nowhere = (F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    starts = ends.select(F.col("first").alias("range"), F.col("start").alias("key"), F.lit(0).alias("nth"), "top", *nowhere)
    stops = ends.select(F.col("final").alias("range"), F.col("end").alias("key"), F.lit(0).alias("nth"), F.col("parent").alias("top"), *nowhere)
    # what is open where a range begins, outer rules first
    still = ends.where("final > first").select(F.explode(F.expr("sequence(first + 1, final)")).alias("range"), F.lit(b"").alias("key"), F.length("start").alias("nth"), "top", *nowhere)
    points = lookups.select(at(F.col("key")).alias("range"), "key", F.lit(1).alias("nth"), F.lit(None).cast(ends.schema["top"].dataType).alias("top"), "host", "path")
    swept = starts.unionByName(stops).unionByName(still).unionByName(points)
    sweep = Window.partitionBy("range").orderBy("key", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = swept.withColumn("top", F.last("top", ignorenulls=True).over(sweep)).where(F.col("host").isNotNull() & F.col("top.rule").isNotNull())
    best = found.groupBy("host", "path").agg(F.max("top").alias("top"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select("row", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
