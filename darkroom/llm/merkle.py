r"""A Merkle manifest of a table: a digest for each row, each group and the whole, and a proof of every row.

Bottom-up: each row is a leaf; within a group, leaves in order of their keys become nodes 0, 1, 2, ...; while a group has several
nodes, every WIDTH consecutive ones become their digest. What remains is the group's subroot (a lone leaf is its own), and the
subroots, in order of the groups, become the root in the same way. Every level is persisted as a table of runs: their children's
digests in order and the parent's digest.

Top-down: a node's proof is pushed to its children by a join of parents and children: each child prepends its siblings, those before and
those after it, to what it inherits. At the leaves a run meets its parent's proof once and the children are told apart in the same row, so that proofs of
leaves are never exchanged.

Plan: texts are read once and leave the first projection as digests. Places of leaves come from ranges: leaves are dealt by
(group, key) ranges, numbered within a range and group, and moved by the counts of the ranges before, so a group of any size is spread.
A level is 16 times smaller than the one below it; nothing but one number (the largest group) reaches the driver.

Defined cases: null groups are one group, the first; null keys come first within a group; rows that share key and group are ordered by their
digests, and rows that repeat are leaves of their own; null fields are framed as "-", so that they differ from empty ones; an empty table
gives no rows; columns that are not named are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.llm.common import dropped, stored

#: Nodes that share a parent, and leaves of a range at most, on average.
WIDTH, RANGE_ROWS = 16, 1 << 20
PROOF = "array<struct<before:string,after:string>>"


def framed(value: Column) -> Column:
    """A value with its length in bytes before it; "-" for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*fields: Column) -> Column:
    """Hexadecimal SHA-256 of framed fields, put together."""
    return F.sha2(F.concat(*(framed(f) for f in fields)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Stored rows with a column `grp`, with `idx`, a row's place in its group by `order`, and `n`, the group's rows."""
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    dealt = stored(rows.repartitionByRange(ranges, "grp", *order).withColumn("part", F.spark_partition_id()), "merkle_ranges")
    within = dealt.withColumn("place", F.row_number().over(Window.partitionBy("part", "grp").orderBy(*order)))
    counts = dealt.groupBy("part", "grp").agg(F.count("*").alias("c"))
    group = Window.partitionBy("grp")
    before = counts.select("part", "grp", F.coalesce(F.sum("c").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip"), F.sum("c").over(group).alias("n"))
    return within.join(before, ["part", "grp"]).withColumn("idx", F.col("skip") + F.col("place") - 1).drop("part", "place", "skip")


class Tree(NamedTuple):
    """What a forest of groups holds: level k's runs (grp, run, n, children, digest; n: nodes of the group in level k; children: structs), and the
    subroots (grp, height, digest) of all groups."""

    levels: list[DataFrame]
    subroots: DataFrame


def grown(nodes: DataFrame, name: str, *payload: str) -> Tree:
    """Levels above nodes(grp, idx, n, digest); payload: columns that level 0 keeps with its children. Groups of one node have a run too in level 0, whose digest is the node's."""
    levels, now = [], nodes
    while True:
        child = F.struct("idx", "digest", *(payload if not levels else ()))
        together = now.groupBy("grp", F.expr(f"idx div {WIDTH}").alias("run"), "n").agg(F.array_sort(F.collect_list(child)).alias("children"))
        up = F.sha2(F.array_join("children.digest", ""), 256)
        levels.append(stored(together.withColumn("digest", F.when(F.col("n") == 1, F.col("children")[0]["digest"]).otherwise(up)), f"merkle_{name}_{len(levels)}"))
        above = levels[-1].where("n > 1").select("grp", F.col("run").alias("idx"), F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"), "digest")
        lone = levels[0].where("n = 1").select("grp", F.lit(0).alias("height"), "digest") if len(levels) == 1 else lone
        lone = lone.unionByName(above.where("n = 1").select("grp", F.lit(len(levels)).alias("height"), "digest"))
        now = above.where("n > 1")
        if now.isEmpty():
            return Tree(levels, lone)


def pushed(tree: Tree, tops: DataFrame) -> DataFrame:
    """Level 0's runs with what they inherit: (grp, run, n, children, proof, top). tops: (grp, height, proof, top) of all subroots."""
    down = None
    for k in reversed(range(len(tree.levels))):
        # a lone leaf is its group's subroot; other subroots are the parents of a level's only run
        at = tops.where(F.col("height").isin(0, 1) if k == 0 else F.col("height") == k + 1).select("grp", F.lit(0).cast("long").alias("run"), "proof", "top")
        above = at if down is None else at.unionByName(down)
        met = tree.levels[k].drop("digest").join(above, ["grp", "run"])
        if k == 0:
            return met
        own = F.col("children.digest")
        child = met.select("grp", F.col("run"), own.alias("own"), "proof", "top", F.posexplode(own).alias("j", "_"))
        down = child.select("grp", (F.col("run") * WIDTH + F.col("j")).alias("run"), _prepended("own", "j", "proof").alias("proof"), "top")


def _prepended(own: str, j: str, proof: str) -> Column:
    part = lambda start, length: F.array_join(F.slice(own, start, length), "")
    beside = F.struct(part(F.lit(1), F.col(j)).alias("before"), part(F.col(j) + 2, F.lit(WIDTH)).alias("after"))
    return F.concat(F.array(beside), proof)


def manifest(rows: DataFrame, key: str, group: str, fields: tuple[str, ...], forged: Column | None = None) -> DataFrame:
    """(key, group, leaf, subroot, root, proof, forged), a row for each of rows; fields: the columns of a leaf, in order.

    forged: another digest of the same row, null where there is none, which is kept beside the leaf for a check against its proof.
    """
    kind = dict(rows.dtypes)
    other = F.lit(None).cast("string") if forged is None else forged
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    one = rows.select(grp.alias("grp"), F.col(key).alias("key"), digest(*(F.col(f) for f in fields)).alias("digest"), other.alias("forged"), F.monotonically_increasing_id().alias("tie"))
    leaves = stored(one, "merkle_leaves")
    tree = grown(placed(leaves, "key", "digest", "tie"), "leaves", "key", "forged")
    heads = stored(tree.subroots, "merkle_subroots")
    roots = grown(placed(heads.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "height", "digest"), "key"), "roots", "key", "height")
    none = F.array().cast(PROOF)
    head = pushed(roots, roots.subroots.select("grp", "height", none.alias("proof"), F.col("digest").alias("top")))
    own = F.col("children.digest")
    each = head.select("n", own.alias("own"), "proof", "top", F.posexplode("children").alias("j", "child"))
    tops = stored(each.select(
        F.col("child.key").alias("grp"), F.col("child.height").alias("height"), F.when(F.col("n") == 1, F.col("proof")).otherwise(_prepended("own", "j", "proof")).alias("proof"),
        F.struct(F.col("child.digest").alias("subroot"), F.col("top").alias("root")).alias("top"),
    ), "merkle_tops")
    dropped(leaves)
    runs = pushed(tree, tops).withColumn("own", F.col("children.digest"))
    each = runs.select("grp", "n", "own", "proof", "top", F.posexplode("children").alias("j", "child"))
    proof = F.when(F.col("n") == 1, F.col("proof")).otherwise(_prepended("own", "j", "proof"))
    found = F.when(F.col("grp") != "", F.expr("substring(grp, 2)")).cast(kind[group])
    return each.select(F.col("child.key").alias("key"), found.alias("group"), F.col("child.digest").alias("leaf"), "top.subroot", "top.root", proof.alias("proof"), F.col("child.forged").alias("forged"))
