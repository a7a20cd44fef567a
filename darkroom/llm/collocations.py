r"""Phrase collocations, mined with position bitmaps.

Texts are cut into pieces and words. Every task deals its words into shards of at most SHARD positions, in which each word has a compressed
bitmap of its positions: blocks of BLOCK positions of which only those that hold the word exist, as (block, mask). A gap between pieces holds
no word. A phrase is extended as in SPAM: its bitmap, moved by one position with the carry into the next block, is ANDed with the masks
of all words that have the block; what is left are the bitmaps of the longer phrases, and their popcounts the shard's counts. Extension goes
depth-first: the longer phrases of one batch of first words are counted and forgotten before the next batch. Popcounts are summed over shards.

Only phrases that reach `least` in all shards together can be part of longer ones that do. So passes over the texts come before the one that counts: for
k = 2 up to one word less than the longest phrases, popcounts of k-word phrases are summed by 64-bit hashes, and the hashes that reach `least` are put into a
bit array of fixed size (FILTER_BITS bits, broadcast, at any size of the corpus), which holds extension back early. Hashes and bits that collide only
let more through: the last pass sums the popcounts of the phrases themselves, of all lengths, and these sums decide.

Scores are exact: integers of up to 37 digits.

Defined cases: null texts are empty; a null language is "und"; texts without words add nothing; repeated rows count again; ties in score and count
go by the phrase's bytes; an empty table gives no rows; other columns are ignored. A text longer than a shard is dealt over several; the words after a
shard's end that its last phrases need are kept as context, in which no phrase begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkroom.llm.common import batches_of, dropped, stored

SHARD, BATCH = 1 << 20, 1 << 16
#: Positions of a block, as a power of two.
SHIFT = 3
BLOCK = 1 << SHIFT
#: Texts that a task is sent at once.
ROWS = 1000
FILTER_BITS, CHUNK_BITS = 1 << 28, 1 << 20
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Lower case; one byte between pieces and one between words.
BYTES = bytes.maketrans(UPPER + b".,;:!?\n\x0b\x0c\r\t", LOWER + b"\n" * 10 + b" ")
SALTS, TURN = 16, 17


class Shard:
    """Words of one language by place; 0: a gap, else the number of a word from 1. Phrases begin at places before `end` only."""

    def __init__(self, words: pa.Array, hashed: np.ndarray, places: np.ndarray, end: int) -> None:
        self.words, self.hashed, self.end = words, hashed, end
        at = np.flatnonzero(places)
        word = places[at]
        order = np.argsort(word, kind="stable")
        word, at = word[order], at[order]
        block = (at >> SHIFT).astype(np.int32)
        new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (block[1:] != block[:-1])])) if len(at) else np.empty(0, np.int64)
        masks = np.left_shift(np.uint32(1), (at & (BLOCK - 1)).astype(np.uint32))
        #: The bitmaps of all words, word by word.
        self.word, self.block, self.mask = word[new], block[new], np.bitwise_or.reduceat(masks, new) if len(new) else masks
        by_block = np.argsort(self.block, kind="stable")
        self.there_word, self.there_mask = self.word[by_block], self.mask[by_block]
        self.count = np.bincount(self.block, minlength=(len(places) >> SHIFT) + 3)
        self.start = np.concatenate([[0], np.cumsum(self.count)[:-1]])

    def extended(self, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps moved by one position, ANDed with all words': (phrase, word, block, mask) of what is left."""
        moved = mask << np.uint32(1)
        low, carry = moved & np.uint32((1 << BLOCK) - 1), moved >> np.uint32(BLOCK)
        a, b = np.flatnonzero(low), np.flatnonzero(carry)
        phrase, block, mask = np.concatenate([phrase[a], phrase[b]]), np.concatenate([block[a], block[b] + 1]), np.concatenate([low[a], carry[b]])
        n = self.count[block]
        row = np.repeat(np.arange(len(block)), n)
        there = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[block], n)
        left = mask[row] & self.there_mask[there]
        hit = np.flatnonzero(left)
        row, there = row[hit], there[hit]
        return phrase[row], self.there_word[there], block[row], left[hit]

    def begun(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, block, mask) of positions at which phrases may begin."""
        last, over = self.end >> SHIFT, self.end & (BLOCK - 1)
        mask = np.where(self.block < last, self.mask, np.where(self.block == last, self.mask & np.uint32((1 << over) - 1), 0)).astype(np.uint32)
        some = np.flatnonzero(mask)
        return self.word[some], self.block[some], mask[some]


def summed(key: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the number of each row's key among them, and the popcounts of each key."""
    keys, at = np.unique(key, return_inverse=True)
    return keys, at, np.bincount(at, weights=np.bitwise_count(mask), minlength=len(keys)).astype(np.int64)


def turned(h: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by)) if by else h


def hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def passes(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    slot = (slot & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 != 0


def mined(shard: Shard, lang: str, length: int, filters: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words of phrases as rows of numbers, counts) in batches, phrases of 2 to `length` words; all but the longest pass filters[k - 2], the one of k words, and so do the ends of the longest."""
    word, block, mask = shard.begun()
    size, at = len(shard.hashed), 0
    while at < len(word):
        to = min(at + BATCH, len(word))
        if to < len(word):  # whole words only
            to = int(np.searchsorted(word, word[to], "left")) if word[to] != word[at] else int(np.searchsorted(word, word[at], "right"))
        path, phrase = np.unique(word[at:to], return_inverse=True)
        path, b, m, at = path[:, None], block[at:to], mask[at:to], to
        for k in range(2, length + 1):
            phrase, following, b, m = shard.extended(phrase, b, m)
            if k > 2:  # the end of a frequent phrase is frequent
                ends = path[:, 1:]
                ok = passes(filters[k - 3], slots(lang, shard.hashed, *(ends[phrase, j] for j in range(k - 2)), following))
                phrase, following, b, m = phrase[ok], following[ok], b[ok], m[ok]
            keys, phrase, n = summed(phrase * size + following, m)
            path = np.hstack([path[keys // size], (keys % size)[:, None]])
            if k < length:
                ok = passes(filters[k - 2], slots(lang, shard.hashed, *path.T))
                number, keep = np.cumsum(ok) - 1, ok[phrase]
                phrase, b, m, path, n = number[phrase[keep]], b[keep], m[keep], path[ok], n[ok]
            if len(path):
                yield path, n


def slots(lang: str, hashed: np.ndarray, *words: np.ndarray) -> np.ndarray:
    """64-bit hashes of phrases whose words are given place by place."""
    out = np.full(len(words[0]), turned(np.uint64(hash_of(lang.encode())), 31), np.uint64)
    for j, w in enumerate(words):
        out ^= turned(hashed[w], TURN * j)
    return out


class Numbers(dict):
    """Numbers of words by their order of arrival; 0 is the gap between pieces."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def shards(batches: Iterator[pa.RecordBatch], reach: int, size: int = SHARD) -> Iterator[tuple[str, Shard]]:
    """Shards of the languages of a task's texts; those that are not full come last. reach: words of context after a shard's end, where one text is dealt over several."""
    held: dict[str, tuple[Numbers, list[int]]] = {}
    total = 0

    def flushed(lang: str) -> Iterator[tuple[str, Shard]]:
        nonlocal total
        number, places = held.pop(lang)
        total -= len(places)
        words, hashed = pa.array(number, pa.binary()), np.fromiter(map(hash_of, number), np.uint64, len(number))
        step = -(-len(places) // max(1, len(places) // size))
        for at in range(0, len(places), step):
            here = np.array(places[at : at + step + reach], np.int64)
            yield lang, Shard(words, hashed, here, min(step, len(here)))

    for part in batches:
        for lang, text in zip(part.column("lang"), part.column("text").cast(pa.binary()), strict=True):
            lang, text = lang.as_py(), text.as_py()
            if text:
                number, places = held.setdefault(lang, (Numbers(), []))
                total -= len(places)
                places.extend(map(number.__getitem__, filter(None, text.translate(BYTES).replace(b"\n", b" \n ").split(b" "))))
                places.append(0)
                total += len(places)
                if len(places) >= size:
                    yield from flushed(lang)
                while total >= 2 * size:  # many languages: the largest goes
                    yield from flushed(max(held, key=lambda x: len(held[x][1])))
    for lang in list(held):
        yield from flushed(lang)


def _rows(lang: str, words: pa.Array, path: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    parts = [words.take(pa.array(path[:, j])) for j in range(path.shape[1])]
    phrase = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, b" ")
    return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int64))), phrase.cast(pa.string()), pa.array(np.full(len(n), path.shape[1], np.int32)), pa.array(n)], names=["lang", "phrase", "words", "n"])


def frequent(texts: DataFrame, length: int, least: int, filters: list[bytes], size: int = SHARD) -> bytes:
    """A bit array of FILTER_BITS bits with the phrases of `length` words that occur `least` times or more, and few others."""
    shared = texts.sparkSession.sparkContext.broadcast(filters)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(f, np.uint8) for f in shared.value]
        for lang, shard in shards(batches, length - 1, size):
            for path, n in mined(shard, lang, length, bits):
                if path.shape[1] == length:
                    yield pa.RecordBatch.from_arrays([pa.array(slots(lang, shard.hashed, *path.T).view(np.int64)), pa.array(n)], names=["slot", "n"])

    def put(part: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(CHUNK_BITS, np.uint8)
        bits[part["bit"].to_numpy() & (CHUNK_BITS - 1)] = 1
        return pd.DataFrame({"chunk": [int(part["bit"].iloc[0]) // CHUNK_BITS], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    with batches_of(texts.sparkSession, ROWS):
        many = stored(texts.mapInArrow(mine, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(F.col("slot").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("bit")), f"frequent-{length}")
    chunks = many.distinct().groupBy(F.expr(f"bit div {CHUNK_BITS}")).applyInPandas(put, "chunk long, bits binary")
    out = bytearray(FILTER_BITS // 8)
    for r in chunks.toLocalIterator():
        out[r.chunk * CHUNK_BITS // 8 : (r.chunk + 1) * CHUNK_BITS // 8] = r.bits
    dropped(many)
    return bytes(out)


def phrases(docs: DataFrame, lang: str, text: str, longest: int = 3, least: int = 10, size: int = SHARD) -> DataFrame:
    """(lang, phrase, words, n): phrases of 1 to `longest` words that occur `least` times or more, and all words of a language as phrase "" of 0 words."""
    texts = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
    filters: list[bytes] = []
    for length in range(2, longest):
        filters.append(frequent(texts, length, least, filters, size))
    shared = texts.sparkSession.sparkContext.broadcast(filters)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(f, np.uint8) for f in shared.value]
        for lang, shard in shards(batches, longest - 1, size):
            word, _, mask = shard.begun()
            path, _, n = summed(word, mask)
            yield _rows(lang, shard.words, path[:, None], n)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([0], pa.int32()), pa.array([int(n.sum())])], names=["lang", "phrase", "words", "n"])
            for path, n in mined(shard, lang, longest, bits):
                yield _rows(lang, shard.words, path, n)

    counts = texts.mapInArrow(mine, "lang string, phrase string, words int, n long").groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.sum("n").alias("n"))
    with batches_of(texts.sparkSession, ROWS):
        return stored(counts.where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of found's phrases of two words or more, at the cut that scores least."""
    n = found.select("lang", "phrase", "n")
    word = F.split("phrase", " ")
    cuts = found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    cuts = cuts.join(n.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(n.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    whole = "CAST(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(14,0)) * CAST(a AS DECIMAL(14,0)) AS DECIMAL(37,0)) div (CAST(l AS DECIMAL(14,0)) * CAST(r AS DECIMAL(14,0)))"
    best = F.min(F.struct(F.expr(whole).alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "words", "a").agg(best.alias("b")).select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score")


def uncovered(found: DataFrame, share: int = 50) -> DataFrame:
    """found without phrases inside a longer one that has at least that share of their occurrences, in hundredths."""
    word = F.split("phrase", " ")
    at = F.explode(F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> struct(i, k))))")).alias("at")
    longer = found.where("words > 2").select("lang", "n", word.alias("w"), at)
    inside = longer.select("lang", F.array_join(F.slice("w", F.col("at.i"), F.col("at.k")), " ").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return found.where("words > 1").join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("n"), F.lit(True))).drop("longer")


def collocations(docs: DataFrame, lang: str, text: str, longest: int = 3, least: int = 10, share: int = 50, most: int = 2000, size: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `most` phrases of each language by score, then count, then bytes."""
    found = phrases(docs, lang, text, longest, least, size)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = scored(found).join(uncovered(found, share).select("lang", "phrase"), ["lang", "phrase"], "left_semi")
    # the first of each salt, then of all: a language with most phrases meets no task as a whole
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    n = found.where("words = 0").select("lang", "n")
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
