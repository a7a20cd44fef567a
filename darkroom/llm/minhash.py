r"""Near duplicates by b-bit MinHash: band candidates, bit-count estimates, and links confirmed on full sets.

A document's set holds its distinct five-word shingles, lower-cased. Equal sets are one class from the start, so copies are
never paired. Of each class's 128 minima, 32 bands of four are hashed to buckets, and the low two bits are packed into
256 bits. At the link threshold of 0.75, a pair is in no common bucket once in 190,000 cases.

Candidates never become all pairs of a bucket:
1. each bucket's smallest member is its leader; leader and member form a candidate pair, whose similarity is estimated from
   the packed bits (share of equal 2-bit values, corrected for values equal by chance); pairs estimated 6 standard deviations
   below the threshold are left, the others are confirmed on full sets, a leader's members in chunks of bounded size.
2. what a bucket still holds in more than one component may be linked past its leader. Such buckets' members are
   gathered into groups, or stay by bucket where groups would be far larger. A component with many members in a group is dealt into blocks of its own, small ones
   share blocks, all of bounded size in members and bytes. Two blocks are compared on full sets by a matrix product within one task, unless both are of one component, as members of
   one component need no more links; a task emits what its links join.
Components of all links follow, and class members get their class's component.

Scale: text is read twice (the second time only candidates' texts become sets); what is shuffled is 16 bytes a band and class.
A group of copies collapses before any pairing; a group of near copies costs a test for each member and leader, and one more with each
block of members that remain apart: linear in the linked members, of the square of the unlinked ones only.

Defined cases: without words or with a null text the set is empty and linked with nothing; rows with a null id are kept, in no
component; rows that repeat an id are one node, so that texts of one id are in one component, and deduplicated() keeps one of them; an empty table gives no rows; other columns are ignored by group().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import stored
from darkroom.llm.components import components
from darkroom.llm.shingles import mix, shingles

BANDS, ROWS, BITS = 32, 4, 2
HASHES = BANDS * ROWS
PERCENT = 75
#: Estimates below this are 6 standard deviations from the threshold.
LEAST_ESTIMATE = 0.45
CHUNK, SLOTS = 256, 32
#: Bytes of the sets of a chunk or block, about; groups this many times as large as their largest bucket are compared by bucket.
CHUNK_BYTES, WIDE = 8 << 20, 4
_RANDOM = np.random.default_rng(20)
_MULTIPLY = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
_PLACE = np.arange(0, 64, BITS, dtype=np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), CHUNK):
        np.minimum(out, (s[at : at + CHUNK, None] * _MULTIPLY + _ADD).min(0), out=out)
    return out


def bands(m: np.ndarray) -> np.ndarray:
    """A bucket's key for each band; the band is part of the key."""
    key = _BAND.copy()
    for part in m.reshape(BANDS, ROWS).T:
        key = mix(key + part)
    return key.view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """Low BITS bits of the mixed minima, 64 // BITS to a number."""
    low = mix(m) & np.uint64((1 << BITS) - 1)
    return np.bitwise_or.reduce(low.reshape(-1, 64 // BITS) << _PLACE, axis=1).view(np.int64)


def class_key(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    if not len(s):
        return b""
    return np.array([np.bitwise_xor.reduce(mix(s + np.uint64(1))), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64).tobytes()


def signatures(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, n, class, bands, bits) of every row; class, bands and bits are null for empty sets."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                s = shingles(t)
                if len(s):
                    m = minima(s)
                    rows.append((len(s), class_key(s), bands(m), packed(m)))
                else:
                    rows.append((0, None, None, None))
            out = pd.DataFrame(rows, columns=["n", "class", "bands", "bits"])
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    kind = dict(docs.dtypes)[id]
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(sign, f"id {kind}, n long, class binary, bands array<long>, bits array<long>")


def estimate(a: str, b: str) -> F.Column:
    """Similarity from packed bits: the share of equal values less those equal by chance."""
    mask = F.lit(sum(1 << i for i in range(0, 64, BITS)))
    differ = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        any_bit = x
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(any_bit.bitwiseAND(mask))
    chance = 0.5**BITS
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray], percent: int = PERCENT, columns: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs whose intersection is at least percent of their union: exact counts by a blocked matrix product over shared elements."""
    na, nb = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    if not len(na) or not len(nb):
        return np.zeros(0, int), np.zeros(0, int)
    a, b = np.concatenate(sets_a), np.concatenate(sets_b)
    shared = np.intersect1d(a, b)
    both = np.zeros((len(na), len(nb)), np.float32)
    places = [(x[keep], np.repeat(np.arange(len(n)), n)[keep]) for x, n in ((a, na), (b, nb)) for keep in [np.isin(x, shared, kind="sort")]]
    at = [np.searchsorted(shared, x) for x, _ in places]
    for low in range(0, len(shared), columns):
        width = min(columns, len(shared) - low)
        m = []
        for (_, row), col, n in zip(places, at, (len(na), len(nb)), strict=True):
            inside = (col >= low) & (col < low + width)
            x = np.zeros((n, width), np.float32)
            x[row[inside], col[inside] - low] = 1
            m.append(x)
        both += m[0] @ m[1].T
    k = both.astype(np.int64)
    return np.nonzero((100 * k >= percent * (na[:, None] + nb[None, :] - k)) & (k > 0))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Of n places, the smallest that links i-j reach from each: what the links join, in n numbers whatever their count."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root != root[root]).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def confirmed(tests: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """tests(test, side, id) -> (a, b): of each test, rows of side A against rows of side B, and rows of side S against each other.

    Each row that a link joins to others comes once, with a representative of what is joined: as connected as all links, in rows
    that don't outnumber the test's."""
    kind = dict(sets.dtypes)["id"]

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["side", "id", "members"])
        alone = rows[rows["side"] == "S"]
        left, right = (alone, alone) if len(alone) else (rows[rows["side"] == "A"], rows[rows["side"] == "B"])
        unpack = lambda x: [np.frombuffer(m, np.uint64) for m in x["members"]]
        i, j = linked(unpack(left), unpack(right), percent)
        ids = np.concatenate([left["id"].to_numpy(), right["id"].to_numpy()])
        # equal ids on both sides are one place
        names, place = np.unique(ids, return_inverse=True)
        root = forest(place[i], place[j + len(left)], len(names))
        joined = np.flatnonzero(root != np.arange(len(names)))
        return pd.DataFrame({"a": names[root[joined]], "b": names[joined]})

    return tests.join(sets, "id").groupBy("test").applyInPandas(compare, f"a {kind}, b {kind}")


def loose_members(shared: DataFrame, apart: DataFrame, groups: DataFrame) -> DataFrame:
    """(of, id): members that are compared with each other, by group of buckets that share members, or by bucket.

    A group is as good as its buckets, and compares two members once however many buckets they share, while it is not much larger than its largest bucket. Buckets of
    pages with common parts can hang together in groups far larger than any of them; such groups are compared bucket by bucket, so that no two are that share none.
    shared(bucket, id), apart(bucket, least, n): buckets to compare, groups(node, component) of these."""
    size = groups.groupBy(F.col("component").alias("g")).agg((F.count("*") + 1).alias("members"))
    of_bucket = apart.join(groups.withColumnRenamed("node", "least"), "least", "left").select("bucket", "n", F.coalesce("component", "least").alias("g"))
    wide = of_bucket.groupBy("g").agg(F.max("n").alias("most")).join(size, "g").where(F.col("members") > F.greatest(F.lit(CHUNK), WIDE * F.col("most"))).select("g")
    whole = groups.select("component", "node").unionByName(groups.select("component", F.col("component").alias("node")).distinct())
    whole = whole.join(wide.withColumnRenamed("g", "component"), "component", "left_anti").select(F.concat(F.lit("g"), F.col("component").cast("string")).alias("of"), F.col("node").alias("id"))
    parts = shared.join(of_bucket.join(wide, "g").select("bucket"), "bucket").select(F.concat(F.lit("b"), F.col("bucket").cast("string")).alias("of"), "id")
    return whole.unionByName(parts)


def blocked(members: DataFrame, so_far: DataFrame, bytes_of: DataFrame) -> DataFrame:
    """(test, side, id): members(of, id) dealt into blocks of about CHUNK and CHUNK_BYTES within each `of`; a test for each two blocks
    whose members are not all of one component so far. so_far(node, component), bytes_of(id, bytes): sizes of sets.

    Joins are merged: stored tables of few distinct values are small as files, by which Spark would choose to broadcast them, and many times larger in memory."""
    named = members.join(so_far.hint("merge"), F.col("id") == F.col("node"), "left").select("of", "id", F.coalesce("component", "id").cast("string").alias("label")).join(bytes_of.hint("merge"), "id")
    # in blocks: how many a label fills
    fill = F.greatest(F.count("*") / CHUNK, F.sum("bytes") / CHUNK_BYTES)
    size = named.groupBy("of", "label").agg(fill.alias("n"))
    kinds = size.groupBy("of").agg(F.count("*").alias("labels"), F.coalesce(F.sum(F.when(F.col("n") < 1, F.col("n"))), F.lit(0.0)).alias("rest")).where("labels > 1")
    # groups and labels with very many members meet these in slots
    slots = F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot")
    kinds, big = kinds.select("of", "rest", slots), size.where(F.col("n") >= 1).select("of", "label", "n", slots)
    met = named.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int")).join(kinds.hint("merge"), ["of", "slot"]).join(big.hint("merge"), ["of", "label", "slot"], "left")
    large = F.col("n").isNotNull()
    # a block is a label of its own and a number, or, of small labels together, a number alone
    number = F.when(large, F.pmod(F.xxhash64("id"), F.ceil(F.col("n")))).otherwise(F.pmod(F.xxhash64("label"), F.greatest(F.ceil(F.col("rest")), F.lit(1))))
    placed = stored(met.select("of", "id", F.when(large, F.col("label")).alias("own"), number.cast("int").alias("number")), "placed")
    blocks = placed.select("of", "own", "number").distinct()
    key = lambda x: F.struct(F.col(f"{x}.own").isNotNull(), F.coalesce(f"{x}.own", "of"), f"{x}.number")
    pairs = blocks.select("of", F.struct("own", "number").alias("x")).join(blocks.select("of", F.struct("own", "number").alias("y")).hint("merge"), "of").where((key("x") <= key("y")) & ~F.coalesce(F.col("x.own") == F.col("y.own"), F.lit(False)))
    alone = key("x") == key("y")
    text = lambda x: F.concat_ws("/", F.coalesce(F.col(f"{x}.own").cast("string"), F.lit("")), f"{x}.number")
    named_tests = pairs.withColumn("test", F.concat_ws(":", "of", text("x"), text("y"))).withColumn("alone", alone)
    sides = F.when(F.col("alone"), F.array(F.struct(F.col("x").alias("block"), F.lit("S").alias("side")))).otherwise(F.array(F.struct(F.col("x").alias("block"), F.lit("A").alias("side")), F.struct(F.col("y").alias("block"), F.lit("B").alias("side"))))
    wanted = named_tests.select("of", "test", F.explode(sides).alias("s")).select("of", "test", "s.side", F.coalesce("s.block.own", "of").alias("own"), F.col("s.block.own").isNotNull().alias("pure"), "s.block.number")
    have = placed.select("of", "id", F.col("own").isNotNull().alias("pure"), F.coalesce("own", "of").alias("own"), "number")
    return wanted.join(have.hint("merge"), ["of", "own", "pure", "number"]).select("test", "side", "id")


def group(docs: DataFrame, id: str, text: str, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; component_id is the smallest id reachable by links, and kept marks it."""
    signed = stored(signatures(docs, id, text), "signatures")
    some = signed.where(F.col("class").isNotNull() & F.col("id").isNotNull())
    reps = stored(some.groupBy("class").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), (8 * F.first("n")).alias("bytes")), "classes")
    banded = reps.select("id", F.explode("bands").alias("bucket"))
    leaders = banded.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("size")).where("size > 1").select("bucket", "leader")
    shared = stored(banded.join(leaders, "bucket"), "buckets")
    stars = shared.where("id <> leader").select("leader", "id").distinct()
    bits = reps.select("id", "bits", "bytes")
    guess = stars.join(bits, "id").join(bits.select(F.col("id").alias("leader"), F.col("bits").alias("leader_bits")), "leader")
    pairs = stored(guess.where(estimate("bits", "leader_bits") >= LEAST_ESTIMATE).select("leader", "id", "bytes"), "pairs")

    def member_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "members": [shingles(t).tobytes() for t in b["text"]]})

    asked = shared.select("id").distinct()
    kind = dict(docs.dtypes)[id]
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(asked, "id", "left_semi")
    sets = stored(texts.mapInPandas(member_sets, f"id {kind}, members binary"), "sets")

    # 1. leaders against their members, in chunks
    size = pairs.groupBy("leader").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("bytes") / CHUNK_BYTES)).cast("int").alias("chunks"))
    dealt = pairs.join(size, "leader")
    name = lambda chunk: F.concat_ws(":", F.col("leader").cast("string"), chunk)
    tests = dealt.select(name(F.pmod(F.xxhash64("id"), F.col("chunks"))).alias("test"), F.lit("B").alias("side"), "id")
    tests = tests.unionByName(size.select("leader", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select(name(F.col("chunk")).alias("test"), F.lit("A").alias("side"), F.col("leader").alias("id")))
    first = stored(confirmed(tests, sets, percent), "links")

    # 2. buckets that still hold several components, in blocks
    so_far = stored(components(first, "a", "b"), "components")
    labelled = shared.join(so_far.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("least"), F.count("*").alias("n")).where("low <> high")
    apart = stored(apart.select("bucket", "least", "n"), "apart")
    # a bucket of two members, leader and member, was tested
    loose = stored(shared.join(apart.select("bucket", "least"), "bucket").where("id <> least").select("least", "id").distinct(), "loose")
    members = loose_members(shared.select("bucket", "id"), apart, stored(components(loose, "least", "id"), "groups"))
    second = confirmed(blocked(members, so_far, reps.select("id", "bytes")), sets, percent)
    # rows that share an id are one node: the representatives of its texts are linked with the smallest of them
    again = some.groupBy("id").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("id")
    own = stored(some.join(again, "id").select("id", "class").distinct().join(reps.select("class", F.col("id").alias("b")), "class").select("id", "b"), "repeated_ids")
    same = own.join(own.groupBy("id").agg(F.min("b").alias("a")), "id").select("a", "b").where("a <> b")

    more = stored(second.unionByName(same), "links")
    # what is joined so far stands for the links that joined it
    final = so_far if more.isEmpty() else components(so_far.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more), "a", "b")
    # a table of its own, so that Spark may split the join where a class has very many rows
    named = stored(reps.select("class", "id").join(final.withColumnRenamed("node", "id"), "id", "left").select("class", F.coalesce("component", "id").alias("component")), "class_components")
    out = signed.select("id", "n", "class").join(named, "class", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    return out.select("id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id: str, text: str) -> DataFrame:
    """docs with one document of each group."""
    found = group(docs, id, text)
    gone = found.where(~F.col("kept")).select(F.col("id").alias(id)).distinct()
    kept = docs.join(gone, id, "left_anti")
    again = docs.where(F.col(id).isNotNull()).groupBy(id).agg(F.count("*").alias("_n")).where("_n > 1")
    if again.isEmpty():
        return kept
    # of rows that repeat an id one stays; only these meet
    several = kept.join(again, id).drop("_n").dropDuplicates([id])
    return kept.join(again.select(id), id, "left_anti").unionByName(several.select(kept.columns))
