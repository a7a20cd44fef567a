r"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-cased runs of letters and digits. Seeds, runs of `LEAST` tokens, that a
document shares with an item are joined first; only pairs whose seeds could cover enough of the item go on. For these the tiles are
found by running Karp-Rabin: windows of the search length are matched by rolling hashes, matches are extended and the
longest are marked first, never overlapping marked tokens of either side, and the search length falls down to `LEAST`.
The share of the item's tokens that tiles cover decides, in whatever order its parts occur. An item of fewer tokens is one seed of all
of them, and matches where these occur in a row.

Plan. Documents are read once, whatever the benchmark's size: a bitmap of bounded size, broadcast, tells which seeds of a document may be
a benchmark's; of documents with such seeds, the stretches that these cover go on, as token hashes. Their seeds are joined with an index
of the benchmark's, which has for each item all seeds but the most frequent ones that could not cover enough of it by themselves: so a
phrase that many items share makes no pairs unless it is half of them. Pairs then meet stretches and items, and are tiled one at a time.
Any match of `LEAST` tokens or more consists of seeds, so tiling needs the stretches only.

Bounds: the bitmap has at most 2**BITS bits (32 MB); beyond about 16 million seeds it lets more through, which the join removes. Tokens and
seeds are hashes of 64 bits.

Defined cases: null and empty documents match nothing, nor do items without a token; equal items are all reported; repeated documents
and null keys have their own rows, and remove() drops rows, not keys; empty tables give no rows; other columns are ignored, and stay in remove().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import stored
from darkroom.llm.shingles import mix, word_hashes

APART = re.compile(r"[\W_]+")
LEAST = 5
COVERAGE = 0.5
BITS, SLICE = 28, 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's tokens, in order."""
    return word_hashes(APART.sub(" ", text.lower())) if text else np.zeros(0, np.uint64)


_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of a base, kept as far as the longest text so far needs."""
    out = _known.get(base, np.ones(1, np.uint64))
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    _known[base] = out
    return out[:n]


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of that width: differences of running sums, so that time does not depend on the width."""
    n = len(ids)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids.astype(np.uint64) * _powers(BASE, n))])
    return (total[width:] - total[: n - width + 1]) * _powers(INVERSE, n - width + 1)


def tile(doc: list[int], item: list[int], least: int = LEAST, start: int = 20) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length) of the tiles. Equal tokens of doc and item are equal numbers; negative ones match nothing."""
    taken_d, taken_i, tiles = bytearray(len(doc)), bytearray(len(item)), []
    width = max(least, min(start, len(item), len(doc)))
    while width >= least:
        found, longest = _scan(doc, item, taken_d, taken_i, width)
        if longest > 2 * width:
            width = longest
            continue
        for n in sorted(found, reverse=True):
            for d, i in found[n]:
                # what was marked since cuts a match off; a rest of the search length is found again below
                if not (taken_d[d] or taken_i[i] or taken_d[d + n - 1] or taken_i[i + n - 1]):
                    taken_d[d : d + n] = taken_i[i : i + n] = b"\1" * n
                    tiles.append((d, i, n))
                else:
                    k = [j for j in range(n) if not (taken_d[d + j] or taken_i[i + j])]
                    runs = np.split(k, [x + 1 for x, (a, b) in enumerate(pairwise(k)) if b != a + 1]) if k else []
                    for r in runs:
                        if len(r) >= width:
                            a, m = int(r[0]), len(r)
                            taken_d[d + a : d + a + m] = taken_i[i + a : i + a + m] = b"\1" * m
                            tiles.append((d + a, i + a, m))
        width = width // 2 if width > 2 * least else least if width > least else 0
    return sorted(tiles)


def _scan(doc: list[int], item: list[int], taken_d: bytearray, taken_i: bytearray, width: int) -> tuple[dict[int, list[tuple[int, int]]], int]:
    """Maximal matches of unmarked tokens of that width at least, by length; stops at one of more than twice the width."""
    table: dict[int, list[int]] = {}
    hi, hd = rolling(np.array(item), width).tolist(), rolling(np.array(doc), width).tolist()
    for i, h in enumerate(hi):
        if not any(taken_i[i : i + width]):
            table.setdefault(h, []).append(i)
    found: dict[int, list[tuple[int, int]]] = {}
    for d, h in enumerate(hd):
        if h not in table or any(taken_d[d : d + width]):
            continue
        for i in table[h]:
            if d and i and doc[d - 1] == item[i - 1] and not taken_d[d - 1] and not taken_i[i - 1]:
                continue  # not maximal to the left
            n = 0
            while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and doc[d + n] >= 0 and not taken_d[d + n] and not taken_i[i + n]:
                n += 1
            if n > 2 * width:
                return {}, n
            if n >= width:
                found.setdefault(n, []).append((d, i))
    return found, 0


def seeds(ids: np.ndarray, width: int) -> np.ndarray:
    return mix(rolling(ids, width) + np.uint64(width))


def _bits(seed: np.ndarray, bits: int) -> np.ndarray:
    return (seed >> np.uint64(64 - bits)).astype(np.int64)


def indexed(size: int, times: np.ndarray, coverage: float) -> np.ndarray:
    """Places of the seeds by which an item must be found: all but the most frequent, as far as what these cover stays under the share that matters."""
    width = min(LEAST, size)
    covered, left = np.zeros(size, bool), np.ones(len(times), bool)
    for at in np.argsort(-times, kind="stable"):
        more = covered.copy()
        more[at : at + width] = True
        if more.sum() >= coverage * size:
            break
        covered, left[at] = more, False
    return np.flatnonzero(left)


class Benchmark:
    """A benchmark's tables: names (name, item), items (item, tokens) without equal ones, index (seed, item), and what is broadcast of it."""

    def __init__(self, benchmark: DataFrame, name: str, text: str, coverage: float) -> None:
        kind = dict(benchmark.dtypes)[name]

        def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(n, len(h), h.tobytes(), int(mix(seeds(h, len(h)))[0].view(np.int64))) for n, h in zip(b["name"], map(tokens, b["text"]), strict=True) if len(h)]
                yield pd.DataFrame(rows, columns=["name", "size", "tokens", "item"])

        def sown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for item, blob in zip(b["item"], b["tokens"], strict=True):
                    h = np.frombuffer(blob, np.uint64)
                    s = seeds(h, min(LEAST, len(h)))
                    yield pd.DataFrame({"item": item, "size": len(h), "at": np.arange(len(s)), "seed": s.view(np.int64)})

        def pick(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("at")
            found = rows.iloc[indexed(int(rows["size"].iloc[0]), rows["n"].to_numpy(), coverage)]
            return found[["seed", "item"]].drop_duplicates()

        rows = stored(benchmark.select(F.col(name).alias("name"), F.col(text).alias("text")).mapInPandas(hashed, f"name {kind}, size int, tokens binary, item long"), "benchmark")
        self.names = rows.select("name", "item")
        self.items = rows.groupBy("item").agg(F.first("tokens").alias("tokens"))
        every = stored(self.items.mapInPandas(sown, "item long, size int, at int, seed long"), "benchmark_seeds")
        self.index = stored(every.join(every.groupBy("seed").agg(F.count("*").alias("n")), "seed").groupBy("item").applyInPandas(pick, "seed long, item long"), "benchmark_index")
        told = every.agg(F.count("*").alias("n"), F.collect_set(F.least("size", F.lit(LEAST))).alias("widths")).first()
        self.widths, self.bits = sorted(told["widths"]), min(BITS, max(SLICE, int(16 * told["n"]).bit_length()))
        self.bitmap = self._bitmap(every)

    def _bitmap(self, every: DataFrame) -> np.ndarray:
        """Made in slices of equal size, of which the driver gets each once."""
        bits = self.bits

        def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(1 << SLICE, bool)
            out[rows["place"].to_numpy() & ((1 << SLICE) - 1)] = True
            return pd.DataFrame({"part": [key[0]], "slice": [np.packbits(out).tobytes()]})

        place = F.shiftrightunsigned("seed", 64 - bits)
        slices = every.select(place.alias("place")).distinct().groupBy(F.shiftright("place", SLICE).alias("part")).applyInPandas(fill, "part long, slice binary")
        out = np.zeros(1 << (bits - 3), np.uint8)
        for r in slices.collect():
            at = r["part"] << (SLICE - 3)
            out[at : at + (1 << (SLICE - 3))] = np.frombuffer(r["slice"], np.uint8)
        return out


def stretches(h: np.ndarray, widths: list[int], bits: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct seeds of a text that the bitmap has, and places of the tokens that they cover."""
    found, covered = [np.zeros(0, np.uint64)], np.zeros(len(h) + 1, np.int64)
    for width in widths:
        s = seeds(h, width)
        at = _bits(s, bits)
        hit = np.flatnonzero(bitmap[at >> 3] & (128 >> (at & 7)).astype(np.uint8))
        found.append(s[hit])
        covered += np.bincount(hit, minlength=len(covered)) - np.bincount(hit + width, minlength=len(covered))
    return np.unique(np.concatenate(found)), np.flatnonzero(np.cumsum(covered)[:-1] > 0)


def tiled(place: np.ndarray, h: np.ndarray, item: np.ndarray, coverage: float) -> list[tuple[int, int, int]]:
    """Tiles of an item in a text's stretches; none if its seeds there can't cover enough."""
    width = min(LEAST, len(item))
    # stretches are parted by a token that matches nothing
    new = np.flatnonzero(np.diff(place) > 1) + 1
    where = np.insert(place, new, -1)
    known, number = np.unique(item, return_inverse=True)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    ids = np.insert(np.where(known[at] == h, at + 1, -1), new, -1)
    mine, theirs = seeds(number + 1, width), seeds(np.where(ids < 0, 1 << 40, ids), width)
    shared = np.isin(mine, theirs)
    reach = np.zeros(len(item), bool)
    for i in range(width):
        reach[np.flatnonzero(shared) + i] = True
    if reach.sum() < coverage * len(item):
        return []
    hit = np.flatnonzero(np.isin(theirs, mine))
    spots = np.unique((hit[:, None] + np.arange(width)).ravel())
    cut = np.flatnonzero(np.diff(spots) > 1) + 1
    doc, back = np.insert(ids[spots], cut, -1), np.insert(where[spots], cut, -1)
    tiles = tile(doc.tolist(), (number + 1).tolist(), width)
    return [(int(back[d]), i, n) for d, i, n in tiles] if sum(n for _, _, n in tiles) >= coverage * len(item) else []


def _names(key: str, text: str) -> tuple[F.Column, F.Column]:
    """Two hashes that name a row by its key and text; rows equal in both are contaminated together."""
    return F.xxhash64(key, text), F.xxhash64(F.lit(1), text, key)


def contaminated(docs: DataFrame, key: str, text: str, benchmark: DataFrame, item: str, item_text: str, coverage: float = COVERAGE) -> DataFrame:
    """(key, item, item_tokens, covered, coverage, tiles): pairs of a document and an item that it covers to that share at least."""
    return _found(docs, key, text, benchmark, item, item_text, coverage).drop("x", "y")


def _found(docs: DataFrame, key: str, text: str, benchmark: DataFrame, item: str, item_text: str, coverage: float) -> DataFrame:
    """contaminated(), with the names (x, y) of the rows."""
    kind, b = dict(docs.dtypes)[key], Benchmark(benchmark, item, item_text, coverage)
    shared = docs.sparkSession.sparkContext.broadcast((b.widths, b.bits, b.bitmap))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for k, x, y, t in zip(part["key"].astype(object), part["x"], part["y"], part["text"], strict=True):
                h = tokens(t)
                found, place = stretches(h, *shared.value)
                if len(found):
                    rows.append((None if k is None or k != k else k, x, y, found.view(np.int64), place.astype(np.int64).tobytes(), h[place].tobytes()))
            if rows:
                yield pd.DataFrame(rows, columns=["key", "x", "y", "seeds", "place", "hashes"])

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for k, x, y, i, place, h, whole in zip(part["key"].astype(object), part["x"], part["y"], part["item"], part["place"], part["hashes"], part["tokens"], strict=True):
                own = np.frombuffer(whole, np.uint64)
                tiles = tiled(np.frombuffer(place, np.int64), np.frombuffer(h, np.uint64), own, coverage)
                if tiles:
                    covered = sum(n for _, _, n in tiles)
                    rows.append((None if k is None or k != k else k, x, y, i, len(own), covered, covered / len(own), [{"doc_at": d, "item_at": t, "length": n} for d, t, n in tiles]))
            if rows:
                yield pd.DataFrame(rows, columns=["key", "x", "y", "item", "item_tokens", "covered", "coverage", "tiles"])

    x, y = _names(key, text)
    named = docs.select(F.col(key).alias("key"), x.alias("x"), y.alias("y"), F.col(text).alias("text"))
    hits = stored(named.mapInPandas(scan, f"key {kind}, x long, y long, seeds array<long>, place binary, hashes binary"), "seeded")
    pairs = hits.select("x", "y", F.explode("seeds").alias("seed")).join(b.index, "seed").select("x", "y", "item").distinct()
    met = hits.select("key", "x", "y", "place", "hashes").join(pairs, ["x", "y"]).join(b.items, "item").select("key", "x", "y", "item", "place", "hashes", "tokens")
    tiles = "tiles array<struct<doc_at:int,item_at:int,length:int>>"
    found = met.mapInPandas(match, f"key {kind}, x long, y long, item long, item_tokens int, covered int, coverage double, {tiles}")
    return found.join(b.names, "item").select("key", "x", "y", F.col("name").alias("item"), "item_tokens", "covered", "coverage", "tiles")


def remove(docs: DataFrame, key: str, text: str, benchmark: DataFrame, item: str, item_text: str, coverage: float = COVERAGE) -> DataFrame:
    """docs without the rows that hold a benchmark item, whatever their keys; a clean row that shares its key with one stays."""
    bad = _found(docs, key, text, benchmark, item, item_text, coverage).select("x", "y").distinct()
    x, y = _names(f"doc.{key}", f"doc.{text}")
    named = docs.select(F.struct(*docs.columns).alias("doc")).withColumns({"x": x, "y": y})
    return named.join(bad, ["x", "y"], "left_anti").select("doc.*")
