"""Graphs within albums: components, and groups in which all pairs are linked.

Rows carry the columns of `by` (an album's id, say); nothing links rows that differ in them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.sources.lineage import forgotten, written

#: Links that one task handles at once, about.
BLOCK = 200_000


def components(edges: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, node, component) of every end of an edge; component: the smallest node that it reaches.

    Every round, each node takes the smallest label around it and then its label's label, so that labels jump along a chain in a number of rounds that
    grows with its logarithm. Each round is written down."""
    u, v = F.col(a).alias("u"), F.col(b).alias("v")
    links = edges.select(*by, u, v).unionByName(edges.select(*by, v.alias("u"), u.alias("v"))).where("u IS NOT NULL AND v IS NOT NULL").distinct()
    links = written(links, "links")
    label = written(links.groupBy(*by, "u").agg(F.least("u", F.min("v")).alias("l")), "labels")
    while True:
        # what is around a node, by labels, and the label's own label
        seen = links.join(label.select(*by, F.col("u").alias("v"), F.col("l").alias("lv")), [*by, "v"]).groupBy(*by, "u").agg(F.min("lv").alias("m"))
        low = label.join(seen, [*by, "u"]).select(*by, "u", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        # the old label's node takes it too, so that trees hang on to each other by their roots
        roots = low.where("l < was").groupBy(*by, F.col("was").alias("u")).agg(F.min("l").alias("hook"))
        hooked = written(low.join(roots, [*by, "u"], "left").select(*by, "u", "was", F.least("l", F.coalesce("hook", "l")).alias("l")), "hooked")
        up = hooked.select(*by, F.col("u").alias("l"), F.col("l").alias("ll"))
        now = written(hooked.join(up, [*by, "l"]).select(*by, "u", F.col("ll").alias("l"), (F.col("ll") < F.col("was")).alias("moved")), "labels")
        forgotten(label, hooked)
        label = now
        if label.where("moved").isEmpty():
            forgotten(links)
            return label.select(*by, F.col("u").alias("node"), F.col("l").alias("component"))


def followed(steps: DataFrame, by: list[str], source: str = "source", target: str = "target") -> DataFrame:
    """(by, node, end): where each source's chain of steps ends; a chain that runs into a circle ends at the circle's smallest node. A source with several targets takes the smallest.

    Pointers jump: every round, each node's pointer becomes its pointer's pointer, so that a chain of n steps takes log n rounds."""
    once = steps.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target))).groupBy(*by, F.col(source).alias("node")).agg(F.min(target).alias("at"))
    # least: the smallest node on the way, pointers included
    now = written(once.withColumn("least", F.least("node", "at")), "steps")
    left, rounds = now.count(), 0
    while True:
        ahead = now.select(*by, F.col("node").alias("at"), F.col("at").alias("next"), F.col("least").alias("more"))
        jumped = written(now.join(ahead, [*by, "at"], "left").select(*by, "node", F.coalesce("next", "at").alias("at"), F.least("least", "more").alias("least"), F.col("next").isNotNull().alias("moved")), "steps")
        forgotten(now)
        now, rounds = jumped.drop("moved"), rounds + 1
        if jumped.where("moved").isEmpty():
            return now.select(*by, "node", F.col("at").alias("end"))
        if 2**rounds > left:
            # what still moves has gone around a circle at least once, and so has the node where it is
            circle = now.select(*by, F.col("node").alias("at"), F.col("least").alias("end"))
            ends = now.join(circle, [*by, "at"], "left").select(*by, "node", F.coalesce("end", "at").alias("end"))
            return ends
        now = written(now, "steps")


def reached(start: DataFrame, owns: DataFrame, by: list[str], owner: str = "owner", owned: str = "owned") -> DataFrame:
    """(by, node, depth): what start(by, node) owns, directly or through others, itself with depth 0; depth: the fewest steps. Each round joins what was new in the last.

    Repeated links are not looked for, as what they reach is made distinct in each round: so links are exchanged only where what was new is too large to send around."""
    links = owns.select(*by, F.col(owner).alias("node"), F.col(owned).alias("next")).where("next IS NOT NULL")
    frontier = seen = written(start.select(*by, "node").distinct().withColumn("depth", F.lit(0)), "reached")
    depth = 0
    while True:
        depth += 1
        new = frontier.join(links, [*by, "node"]).select(*by, F.col("next").alias("node")).distinct().join(seen.select(*by, "node"), [*by, "node"], "left_anti")
        frontier = written(new.withColumn("depth", F.lit(depth)), "reached")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def _solved(rows: pd.DataFrame) -> dict:
    """Merges among the rows' nodes: links in order of their rank, of whose clusters only common neighbours stay neighbours. An end that is not known holds up what comes after it at its cluster."""
    near: dict = {}
    known: dict = {}
    for a, b, ka, kb in zip(rows["a"], rows["b"], rows["known_a"], rows["known_b"], strict=True):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
        known[a], known[b] = known.get(a, False) or ka, known.get(b, False) or kb
    weight: dict = dict(zip(rows["a"], rows["wa"], strict=True)) | dict(zip(rows["b"], rows["wb"], strict=True))
    root: dict = {i: i for i in near}
    parts: dict = {i: [i] for i in near}
    held: set = set()
    for a, b in zip(rows["a"], rows["b"], strict=True):
        x, y = root[a], root[b]
        if x == y or y not in near[x]:
            continue
        if not (known[x] and known[y]) or x in held or y in held:
            held |= {x, y}
            continue
        if weight[x] + weight[y] > rows.attrs["most"]:
            near[x].discard(y)
            near[y].discard(x)
            continue
        if len(parts[x]) < len(parts[y]):
            x, y = y, x
        both = near[x] & near[y]
        for z in near[x] - both:
            near[z].discard(x)
        for z in near.pop(y):
            near[z].discard(y)
        near[x] = both
        weight[x] += weight[y]
        for i in parts.pop(y):
            root[i] = x
            parts[x].append(i)
    return {i: min(p) for p in parts.values() if len(p) > 1 for i in p}


def _pairs_of(links: DataFrame, by: list[str], most: int) -> DataFrame:
    """links(by, a, b, rank, wa, wb, na, nb) between clusters, each pair once with its first rank: those with links between all parts, na times nb, whose weights fit."""
    ends = [F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")]
    turned = F.col("a") > F.col("b")
    side = lambda n, m: (F.when(turned, F.col(m)).otherwise(F.col(n))).alias(n)
    rows = links.where("a <> b").select(*by, *ends, "rank", side("wa", "wb"), side("wb", "wa"), side("na", "nb"), side("nb", "na"))
    once = rows.groupBy(*by, F.col("x").alias("a"), F.col("y").alias("b"), "wa", "wb", "na", "nb").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    return once.where((F.col("n") == F.col("na") * F.col("nb")) & (F.col("wa") + F.col("wb") <= most)).select(*by, "a", "b", "rank", "wa", "wb")


def complete_groups(nodes: DataFrame, links: DataFrame, by: list[str], most: int, block: int = BLOCK) -> DataFrame:
    """(by, node, cluster) of nodes that merge: links are taken by rank, and two clusters merge if all pairs across them are linked and their weight stays within `most`.

    nodes(by, node, weight); links(by, a, b, n, rank): linked pairs of nodes with the number of links that stand for one, which must be the product of their weights
    to count as complete, and a struct that orders them all; cluster: its smallest node.

    Two clusters that are not completely linked never will be, as clusters only grow; so such pairs leave at once, and of two that merge only common neighbours stay
    neighbours. A link that is the first of all at both its clusters can be decided whatever happens elsewhere. Albums of at most `block` links are decided
    by one task each. Larger ones go by component; components that are still larger are dealt by ranges of nodes, a task decides what it can see all of, links that are
    the first at both clusters are decided too, and what is left goes round again with other ranges."""
    kinds = dict(nodes.dtypes) | dict(links.dtypes)
    side = lambda x: nodes.select(*by, F.col("node").alias(x), F.col("weight").alias(f"w{x}"))
    left = written(links.join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"]).where((F.col("n") == F.col("wa") * F.col("wb")) & (F.col("wa") + F.col("wb") <= most)).select(*by, "a", "b", "rank", "wa", "wb"), "complete")
    merged_kind = ", ".join([*(f"{c} {kinds[c]}" for c in by), f"node {kinds['node']}, cluster {kinds['node']}"])

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, part in rows.sort_values(["rank0", "rank1", "rank2", "rank3"]).groupby(by, dropna=False, sort=False):
            part.attrs["most"] = most
            out += [(*own, i, c) for i, c in _solved(part).items()]
        return pd.DataFrame(out, columns=[*by, "node", "cluster"])

    def decided(rows: DataFrame, *task: str) -> DataFrame:
        flat = rows.select(*by, *task, "a", "b", "wa", "wb", "known_a", "known_b", *(F.col(f"rank.{c}").alias(f"rank{i}") for i, c in enumerate(("kind", "distance", "a", "b"))))
        return flat.groupBy(*(task or by)).applyInPandas(solve, merged_kind)

    whole = {"known_a": F.lit(True), "known_b": F.lit(True)}
    size = left.groupBy(*by).agg(F.count("*").alias("links"))
    small = left.join(size.where(F.col("links") <= block).select(*by), by, "left_semi")
    found = [decided(small.withColumns(whole))]
    rest, turn = left.join(size.where(F.col("links") > block).select(*by), by, "left_semi"), 0
    rest = written(rest, "large")
    while not rest.isEmpty():
        turn += 1
        merges, rest = _round(rest, by, most, block, turn, decided, whole)
        found.append(merges)
    # a cluster of one round is a node of the next
    out = written(found[0], "groups")
    for more in found[1:]:
        then = more.select(*by, F.col("node").alias("cluster"), F.col("cluster").alias("next"))
        out = out.join(then, [*by, "cluster"], "left").select(*by, "node", F.coalesce("next", "cluster").alias("cluster")).unionByName(more.join(out.select(*by, "node"), [*by, "node"], "left_anti"))
    return out


def _round(rest: DataFrame, by: list[str], most: int, block: int, turn: int, decided, whole: dict) -> tuple[DataFrame, DataFrame]:
    """Merges of one round over large albums, and the links between clusters that are left."""
    owner = components(rest, by)
    tagged = rest.join(owner.select(*by, F.col("node").alias("a"), "component"), [*by, "a"])
    size = tagged.groupBy(*by, "component").agg(F.count("*").alias("links"))
    told = written(tagged.join(size, [*by, "component"]), "components")
    fit = F.col("links") <= block
    tasks = told.where(fit).agg(F.count("*")).first()[0] // block + 1
    merges = decided(told.where(fit).withColumns(whole).withColumn("task", F.pmod(F.xxhash64(*by, "component"), F.lit(tasks))), "task")
    large = told.where(~fit)
    count = large.count()
    if not count:
        merges = written(merges, "merges")
        return merges, rest.limit(0)
    # ranges of nodes, other ones each round; a link goes to the ranges of both its ends, each of which knows its own nodes
    ends = large.select(*by, F.explode(F.array("a", "b")).alias("node")).distinct()
    ranges = written(ends.repartitionByRange(2 + 2 * count // block + turn, *by, "node").withColumn("range", F.spark_partition_id()), "ranges")
    at = lambda x: ranges.select(*by, F.col("node").alias(x), F.col("range").alias(f"r{x}"))
    placed = written(large.join(at("a"), [*by, "a"]).join(at("b"), [*by, "b"]), "placed")
    each = placed.withColumn("task", F.explode(F.array_distinct(F.array("ra", "rb")))).withColumns({"known_a": F.col("ra") == F.col("task"), "known_b": F.col("rb") == F.col("task")})
    merges = merges.unionByName(decided(each, "task"))
    merges = written(merges, "merges")
    first = written(_contracted(large, merges, by, most), "left")
    # links that come first at both their clusters
    both = first.select(*by, F.col("a").alias("node"), "rank").unionByName(first.select(*by, F.col("b").alias("node"), "rank")).groupBy(*by, "node").agg(F.min("rank").alias("rank"))
    mutual = first.join(both.withColumnRenamed("node", "a"), [*by, "a", "rank"]).join(both.withColumnRenamed("node", "b"), [*by, "b", "rank"])
    pairs = written(mutual.select(*by, F.explode(F.array("a", "b")).alias("node"), F.least("a", "b").alias("cluster")), "mutual")
    rest = written(_contracted(first, pairs, by, most), "left")
    then = pairs.select(*by, F.col("node").alias("cluster"), F.col("cluster").alias("next"))
    merges = merges.join(then, [*by, "cluster"], "left").select(*by, "node", F.coalesce("next", "cluster").alias("cluster")).unionByName(pairs.join(merges.select(*by, "node"), [*by, "node"], "left_anti"))
    return written(merges, "merges"), rest


def _contracted(links: DataFrame, merges: DataFrame, by: list[str], most: int) -> DataFrame:
    """links(by, a, b, rank, wa, wb) between clusters after merges(by, node, cluster): pairs that are linked completely and fit."""
    weights = links.select(*by, F.col("a").alias("node"), F.col("wa").alias("w")).unionByName(links.select(*by, F.col("b").alias("node"), F.col("wb").alias("w"))).distinct()
    named = weights.join(merges, [*by, "node"], "left").withColumn("cluster", F.coalesce("cluster", "node"))
    total = named.groupBy(*by, "cluster").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    told = named.select(*by, "node", "cluster").join(total, [*by, "cluster"])
    side = lambda x: told.select(*by, F.col("node").alias(x), F.col("cluster").alias(f"c{x}"), F.col("w").alias(f"W{x}"), F.col("n").alias(f"n{x}"))
    rows = links.select(*by, "a", "b", "rank").join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"])
    return _pairs_of(rows.select(*by, F.col("ca").alias("a"), F.col("cb").alias("b"), "rank", F.col("Wa").alias("wa"), F.col("Wb").alias("wb"), "na", "nb"), by, most)
