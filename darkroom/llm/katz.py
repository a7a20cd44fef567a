r"""Trigram language model with Katz backoff, learned from and evaluated over whole corpora.

Counts are discounted by Good-Turing, for each order by itself: with n_r the number of n-grams seen r times, counts r up to K are
scaled by d_r = (r*/r - A) / (1 - A), r* = (r + 1) n_(r+1) / n_r, A = (K + 1) n_(K+1) / n_1; where these are not all between 0 and
1, by (r - 1/2) / r. What is freed goes to unseen words; each token's probability is found by recursion:

    P(w | u v) = d c(u v w) / c(u v) if c(u v w) > 0, else alpha(u v) P(w | v) if c(u v) > 0, else P(w | v); P(w | v) likewise
    P(w)       = d c(w) / N if c(w) > 0; all unknown words together have what unigrams free
    alpha(h)   = freed(h) / (1 - sum of P(x | h without its first word) over x seen after h)

so that over the vocabulary and the class of unknown words each history's probabilities sum to 1 exactly. A history none
of whose counts are discounted gets one count more in its denominator, for unseen words. A text begins with two marks.

Tables of a `Model`. words: (word, a 64-bit fingerprint; count; id, ranked by count; range; hot). bigrams and trigrams, partitioned by
range of histories: a row holds a range, packed: histories (u, v; u only of trigrams) with alpha and their tokens, their words with
count, and the discounts, of which discounted probabilities p follow. histories() and grams() unpack them; saved() and loaded() keep
a model for score(), in other sessions too.

Dataflow. A corpus is tokenised once into stored blocks of bounded size. Blocks ask for the ids of their distinct words, by
fingerprint. For each order they send their distinct n-grams, pre-aggregated by block and packed, to the ranges of their histories.
There counts meet; when the discounts are known, each range makes its table and answers each block with counts, and alpha
where unseen; of these blocks evaluate the recursion, token by token. The number of ranges follows the tokens, so that each is of bounded size. A history with more than half a range's
tokens is hot: its n-grams are dealt over all ranges by their words too, and its sums meet in a grouping of their own and go back to
the ranges that have it. What is broadcast has one entry for each distinct count of words, at most the square root of twice the
tokens. Of a range's words only their number reaches the driver, and one row for each distinct count.

Defined cases: a null or empty text is one token, the end; null ids belong to training rows and keep their rows; repeated
rows count and score each; without training rows every token is unknown, with probability 1; an empty table gives no rows;
other columns are ignored; very long texts make a block of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm.common import dropped, stored
from darkroom.llm.shingles import hashes_of_texts, mix

K = 5
END = np.uint64(0x2545F4914F6CDD1D)
BLOCK_TOKENS, BLOCK_DOCS = 1_000_000, 60_000
RANGE_TOKENS = 1_000_000


def discounts(n: list[int]) -> np.ndarray:
    """d_1 to d_K from n_1 to n_(K+1)."""
    r = np.arange(1, K + 1)
    if min(n) > 0:
        n_ = np.array(n, float)
        a = (K + 1) * n_[K] / n_[0]
        if a < 1:
            d = ((r + 1) * n_[1:] / (r * n_[:-1]) - a) / (1 - a)
            if ((d > 0) & (d < 1)).all():
                return d
    return (r - 0.5) / r


class Unigrams(NamedTuple):
    """Probabilities by id; ids are ranked by count, the largest first, `unknown` is the first free id; the beginning comes after it."""

    first_id: np.ndarray
    count: np.ndarray
    p: np.ndarray
    p_unknown: float
    unknown: int
    tokens: int

    def _of(self, ids: np.ndarray, values: np.ndarray, unknown: float) -> np.ndarray:
        if not len(values):
            return np.full(len(ids), unknown)
        return np.where(ids < self.unknown, values[np.searchsorted(self.first_id, ids, "right") - 1], unknown)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        return self._of(ids, self.count, 0).astype(np.int64)

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        return self._of(ids, self.p, self.p_unknown)


def unigrams(count: np.ndarray, types: np.ndarray) -> Unigrams:
    """From distinct counts, the largest first, and the number of words of each."""
    tokens, vocabulary = int((count * types).sum()), int(types.sum())
    d = discounts([int(types[count == r].sum()) for r in range(1, K + 2)])
    scale = np.where(count <= K, d[np.clip(count, 1, K) - 1], 1.0)
    freed = float(((1 - scale) * count * types).sum())
    total = tokens if freed > 0 else tokens + 1
    first = np.cumsum(types) - types
    return Unigrams(first.astype(np.int64), count.astype(np.int64), scale * count / total, (freed if freed > 0 else 1.0) / total, vocabulary, tokens)


def scaled(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts, discounted."""
    return np.concatenate([[1.0], d, [1.0]])[np.minimum(count, K + 1)] * count


class Model(NamedTuple):
    """What scores texts: tables, what is broadcast of the words, and how n-grams are dealt."""

    words: DataFrame
    bigrams: DataFrame
    trigrams: DataFrame
    unigrams: Unigrams
    ranges: int
    most: int  # tokens of a history that is not hot
    beginnings: int  # training texts
    bigram_discounts: np.ndarray | None = None
    trigram_discounts: np.ndarray | None = None

    def alone(self) -> Model:
        """Without tables, for tasks."""
        return self._replace(words=None, bigrams=None, trigrams=None)

    def totals(self, ids: np.ndarray) -> np.ndarray:
        """How often ids begin a bigram: texts for the beginning, else a word's count; no text's end begins one, and none is asked for."""
        return np.where(ids == self.unigrams.unknown + 1, self.beginnings, self.unigrams.counts(ids))


#: Made once for a worker. Level 1: of a block's trigrams it makes a tenth more than level 3, in nine tenths of its time.
_SQUEEZE, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


#: Types of packed arrays; with 128 added, numbers below 0 are folded in between the others.
_KINDS = ["|b1", "|i1", "|u1", "<i2", "<u2", "<i4", "<u4", "<i8", "<u8", "<f8"]


def _packed(*parts: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """Blobs of slices of arrays, each given with the places where its slices begin and the end. A blob: the number of arrays, of each its type and how
    many bytes of its numbers are not 0 throughout, the sizes, and planes of bytes. Planes are made of whole arrays, each copied by itself: a copy of the transpose
    takes ten times as long, and so do planes of many small slices."""
    head, sizes, planes = bytes([len(parts)]), [], []
    for x, cut in parts:
        x = np.ascontiguousarray(x)
        code, n = _KINDS.index(x.dtype.str), x.itemsize
        if x.dtype.kind in "iu" and len(x):
            if x.min() < 0:
                code, x = code + 128, (x << 1) ^ (x >> (8 * x.itemsize - 1))
            n = (int(x.view(f"<u{x.itemsize}").max()).bit_length() + 7) // 8
        head += bytes([code, n])
        sizes.append(np.diff(cut))
        cut = cut.tolist()
        planes += [(np.ascontiguousarray(x.view(np.uint8)[k :: x.itemsize]).data, cut) for k in range(n)]
    sizes = np.stack(sizes, 1).astype("<u4")
    return [_SQUEEZE.compress(b"".join([head, size.tobytes(), *(p[cut[i] : cut[i + 1]] for p, cut in planes)])) for i, size in enumerate(sizes)]


def _pack(*parts: np.ndarray) -> bytes:
    return _packed(*((x, np.array([0, len(x)])) for x in parts))[0]


def _unpacked(blobs: Iterable[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Arrays, all slices one after another, and of each array the sizes of its slices; of one slice at least."""
    raws = [memoryview(_EXPAND.decompress(b)) for b in blobs]
    n = raws[0][0]
    head = np.frombuffer(b"".join([r[1 : 1 + 6 * n] for r in raws]), np.uint8).reshape(len(raws), 6 * n)
    codes, planes = head[:, 0 : 2 * n : 2], head[:, 1 : 2 * n : 2].astype(np.int64)
    sizes = np.ascontiguousarray(head[:, 2 * n :]).view("<u4").astype(np.int64)
    begin = 1 + 6 * n + np.cumsum(planes * sizes, 1) - planes * sizes
    out = []
    for code, plane, size, at in zip(codes.T, planes.T, sizes.T, begin.T, strict=True):
        x = np.zeros(size.sum(), np.result_type(*(_KINDS[c & 127] for c in set(code.tolist()))))
        each = list(zip(raws, plane.tolist(), size.tolist(), at.tolist(), strict=True))
        for k in range(plane.max()):
            x.view(np.uint8)[k :: x.itemsize] = np.frombuffer(b"".join([r[a + k * z : a + k * z + z] if k < p else bytes(z) for r, p, z, a in each]), np.uint8)
        folded = np.repeat(code >= 128, size)
        if folded.any():
            y = x.view(f"<u{x.itemsize}")
            y[folded] = (y[folded] >> 1) ^ -(y[folded] & 1)
        out.append(x)
    return out, list(sizes.T)


def _unpack(blob: bytes) -> list[np.ndarray]:
    return _unpacked([blob])[0]


def _steps(x: np.ndarray, cut: np.ndarray | None = None) -> np.ndarray:
    """Differences of neighbours, for numbers that mostly ascend; np.cumsum() undoes it. cut: of slices, each with its first number whole; _summed() undoes it."""
    out = x.astype(np.int64)
    out[1:] -= x[:-1]
    if cut is not None:
        out[cut[:-1]] = x[cut[:-1]]
    return out


def _summed(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.cumsum(x)
    if len(x):
        first = np.cumsum(size) - size
        total -= np.repeat((total - x)[np.minimum(first, len(x) - 1)], size)
    return total


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are not negative in order, and their places; by one sort of both together where they fit in 64 bits, four times as fast as one of places."""
    bits = len(key).bit_length()
    if not len(key) or int(key.max()) >> (64 - bits):
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = key.astype(np.uint64)
    both <<= np.uint64(bits)
    both |= np.arange(len(key), dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << bits) - 1)).view(np.int64)
    both >>= np.uint64(bits)
    return both.view(key.dtype) if key.itemsize == 8 else both.astype(key.dtype), order


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _placed(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of rows, sorted by order, which distinct one each is; new: whether a sorted one differs from the one before."""
    of = np.empty(len(order), np.int32)
    nth = np.cumsum(new, dtype=np.int32)
    nth -= 1
    of[order] = nth
    return of


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """np.unique(key, return_index=True, return_inverse=True, return_counts=True) of numbers that are not negative."""
    key, order = _sorted(key)
    new = _changes(key)
    lead = np.flatnonzero(new)
    return key[lead], order[lead], _placed(order, new), np.diff(np.append(lead, len(key)))


def _distinct_hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(x, return_inverse=True) of 64-bit numbers: by their high bits, and where these are not enough by all."""
    high, order = _sorted(x >> np.uint64(len(x).bit_length()))
    ascending = x[order]
    if (ascending[1:] < ascending[:-1]).any():
        order = np.argsort(x, kind="stable")
        ascending = x[order]
    new = _changes(ascending)
    return ascending[new], _placed(order, new)


# ---- words ----


def _blocks(docs: DataFrame, id: str, text: str, held_out: Column) -> DataFrame:
    """(block, ids, held, tokens, all_tokens, words, body): tokens: of training rows; words: fingerprints and their training counts; body: documents' lengths and tokens as places in words."""

    def out(number: int, ids: list, held: list, parts: list[np.ndarray], lengths: list[np.ndarray]) -> pd.DataFrame:
        lengths = np.concatenate(lengths)
        words, place = _distinct_hashes(np.concatenate(parts))
        total = np.bincount(place, minlength=len(words))
        order = np.argsort(-total, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        mine = np.repeat(~np.array(held), lengths)
        train = np.bincount(place[mine], minlength=len(words)).astype(np.uint32)
        name = (TaskContext.get().partitionId() << 32) + number
        return pd.DataFrame({"block": [name], "ids": [ids], "held": [held], "tokens": [int(mine.sum())], "all_tokens": [len(place)], "words": [_pack(words[order], train[order])], "body": [_pack(lengths, rank[place])]})

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, ids, held, parts, lengths, size = 0, [], [], [], [], 0
        for b in batches:
            all_ids, all_held, at = [None if i is None or i != i else i for i in b["id"].astype(object)], b["held"].tolist(), 0
            for hashes, n in hashes_of_texts(b["text"]):
                parts.append(np.insert(hashes, np.cumsum(n), END))
                lengths.append(n + 1)
                ids += all_ids[at : at + len(n)]
                held += all_held[at : at + len(n)]
                at += len(n)
                size += len(parts[-1])
                if size >= BLOCK_TOKENS or len(ids) >= BLOCK_DOCS:
                    yield out(number, ids, held, parts, lengths)
                    number, ids, held, parts, lengths, size = number + 1, [], [], [], [], 0
        if ids:
            yield out(number, ids, held, parts, lengths)

    kind = dict(docs.dtypes)[id]
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    return stored(rows.mapInPandas(tokenise, f"block long, ids array<{kind}>, held array<boolean>, tokens long, all_tokens long, words binary, body binary"), "token_blocks")


def _asked(blocks: DataFrame, ranges: int) -> DataFrame:
    """(range, block, blob): a block's distinct words and their training counts by range of fingerprints, in the block's order."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, blob in zip(b["block"], b["words"], strict=True):
                words, train = _unpack(blob)
                at, order, cut = _dealt(_range_of(words, ranges), ranges)
                yield pd.DataFrame({"range": at, "block": block, "blob": _packed((words[order], cut), (train[order], cut))})

    return blocks.select("block", "words").mapInPandas(ask, "range int, block long, blob binary")


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    # of 16 bits a stable sort is by digits
    return (hashes % np.uint64(ranges)).astype(np.uint16 if ranges <= 1 << 16 else np.int64)


def _dealt(range_of: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that get anything, the places of what they get, range by range and in its order, and where each range's begin, and the end."""
    order = np.argsort(range_of, kind="stable")
    size = np.bincount(range_of, minlength=ranges)
    at = np.flatnonzero(size)
    return at, order, np.append(0, np.cumsum(size[at]))


def _ranked(asked: DataFrame, ranges: int, most: int) -> tuple[DataFrame, Unigrams]:
    """The table words, and what is broadcast of it."""

    def total(_key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        words, train = _unpacked(part["blob"])[0]
        word, place = _distinct_hashes(words)
        count = np.bincount(place, train).astype(np.int64)
        return pd.DataFrame({"word": word.view(np.int64)[count > 0], "count": count[count > 0]})

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for b in batches:
            r = (b["word"].to_numpy().view(np.uint64) % np.uint64(ranges)).astype(np.int32)
            yield b.assign(range=r, part=TaskContext.get().partitionId(), nth=np.arange(n, n + len(b)))
            n += len(b)

    counted = asked.groupBy("range").applyInPandas(total, "word long, count long")
    ordered = stored(counted.orderBy(F.desc("count"), "word").mapInPandas(number, "word long, count long, range int, part int, nth long"), "words")
    sizes = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)])]).tolist()
    first = F.element_at(F.array(*(F.lit(int(x)).cast("long") for x in before)), F.col("part") + 1)
    words = ordered.select("word", "count", "range", (F.col("nth") + first).alias("id"), (F.col("count") > most).alias("hot"))
    steps = ordered.groupBy("count").agg(F.count("*").alias("types")).toPandas().sort_values("count", ascending=False)
    return words, unigrams(steps["count"].to_numpy(np.int64), steps["types"].to_numpy(np.int64))


def _coded(blocks: DataFrame, asked: DataFrame, m: Model) -> DataFrame:
    """(block, ids, held, blob): blob: documents' lengths, tokens as places in the block's ascending vocabulary of ids, that, and which are hot."""
    unknown, ranges, start_hot = m.unigrams.unknown, m.ranges, m.beginnings > m.most

    def answer(asks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(known["word"].to_numpy().view(np.uint64))
        word, ids, hot = known["word"].to_numpy().view(np.uint64)[order], known["id"].to_numpy()[order], known["hot"].to_numpy(bool)[order]
        if not len(asks):
            return pd.DataFrame(columns=["block", "range", "blob"])
        (want, _), (size, _) = _unpacked(asks["blob"])
        at = np.minimum(np.searchsorted(word, want), max(0, len(word) - 1))
        there = word[at] == want if len(word) else np.zeros(len(want), bool)
        found = (np.where(there, ids[at], unknown), hot[at] & there) if len(word) else (np.full(len(want), unknown), there)
        cut = np.append(0, np.cumsum(size))
        return pd.DataFrame({"block": asks["block"], "range": asks["range"], "blob": _packed(*((x, cut) for x in found))})

    def code(block: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        words, _ = _unpack(block["words"].iloc[0])
        lengths, tokens = _unpack(block["body"].iloc[0])
        ids, hot = np.full(len(words), unknown, np.int64), np.zeros(len(words), bool)
        _, order, _ = _dealt(_range_of(words, ranges), ranges)
        ids[order], hot[order] = _unpacked(got.sort_values("range")["blob"])[0]
        vocabulary, first, place, _ = _distinct(ids)
        # the beginning is the last entry
        vocabulary, hot = np.append(vocabulary, unknown + 1), np.append(hot[first], start_hot)
        blob = _pack(lengths, place.astype(np.uint32)[tokens], _steps(vocabulary), hot)
        return pd.DataFrame({"block": block["block"], "ids": block["ids"], "held": block["held"], "blob": [blob]})

    answers = asked.groupBy("range").cogroup(m.words.groupBy("range")).applyInPandas(answer, "block long, range int, blob binary")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields[:3])
    return stored(blocks.drop("tokens", "all_tokens").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(code, f"{schema}, blob binary"), "coded_blocks")


# ---- n-grams of a block ----


class Grams(NamedTuple):
    """A block's distinct n-grams of one order, ascending by history and word, and rows that ask for hot histories' alpha alone."""

    of: np.ndarray  # of each token its n-gram, -1 where the model does not know the history
    token: np.ndarray  # of each n-gram one of its tokens, -1 of what asks alone
    times: np.ndarray  # training count; 0 of what asks alone
    history: np.ndarray  # places of histories, ascending
    word: np.ndarray  # places in the vocabulary, after the last of what asks alone
    v: np.ndarray  # ids by places of histories
    u: np.ndarray  # ids by places of histories, empty for bigrams
    ids: np.ndarray  # of words by their places, -1 of what asks alone
    hot: np.ndarray  # by places of histories
    range: np.ndarray  # to which n-grams are dealt


def _history_hash(v: np.ndarray, u: np.ndarray) -> np.ndarray:
    h = mix(v.astype(np.uint64) + np.uint64(1))
    return mix(h + mix(u.astype(np.uint64) + np.uint64(7))) if len(u) else h


def _grams(history: np.ndarray, known: np.ndarray, v: np.ndarray, u: np.ndarray, hot: np.ndarray, b: Block, ranges: int) -> Grams:
    """history: of each token a place in v, u and hot; known: whether the model has it."""
    some = None if known.all() else np.flatnonzero(known)
    tokens, held = b.tokens, ~b.train
    if some is not None:
        history, tokens, held = history[some], tokens[some], held[some]
    # what asks for a hot history's alpha has the last word
    last, n = len(b.vocabulary), len(history)
    bits = np.int64(last.bit_length())
    met = np.zeros(len(v), bool)
    met[history] = True
    asks = np.flatnonzero(met & hot)
    key = np.empty(n + len(asks), np.int64)
    key[:n] = history
    key[n:] = asks
    key <<= bits
    key[:n] |= tokens
    key[n:] |= last
    key, token, of, times = _distinct(key)
    times = (times - np.bincount(of[:n][held], minlength=len(key))).astype(np.int32)
    times[of[n:]], token[of[n:]] = 0, -1
    of = of[:n]
    h, word = (key >> bits).astype(np.int32), (key & ((np.int64(1) << bits) - 1)).astype(np.int32)
    ids = np.append(b.vocabulary, b.vocabulary.dtype.type(-1))
    new = _changes(h)
    each = h[new]
    hashes = _history_hash(v[each], u[each] if len(u) else u)
    nth = np.cumsum(new) - 1
    range_of = _range_of(hashes, ranges)[nth]
    if len(asks):
        spread = np.flatnonzero(hot[h] & (word < last))
        range_of[spread] = _range_of(mix(hashes[nth[spread]] + ids[word[spread]].astype(np.uint64)), ranges)
    if some is not None:
        token[token >= 0] = some[token[token >= 0]]
        place = np.full(len(known), -1, np.int32)
        place[some] = of
        of = place
    return Grams(of, token, times, h, word, v, u, ids, hot, range_of)


class Block(NamedTuple):
    lengths: np.ndarray
    tokens: np.ndarray  # places in the vocabulary
    vocabulary: np.ndarray  # ascending ids, the beginning last
    hot: np.ndarray  # of the vocabulary, as histories
    train: np.ndarray  # of tokens

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths


def _opened(blob: bytes, held: list[bool]) -> Block:
    lengths, tokens, vocabulary, hot = _unpack(blob)
    vocabulary = np.cumsum(vocabulary)
    # half the memory to move, as long as ids fit
    vocabulary = vocabulary.astype(np.int32) if vocabulary[-1] < (1 << 31) - 2 else vocabulary
    return Block(lengths, tokens.astype(np.int32), vocabulary, hot, np.repeat(~np.array(held, bool), lengths))


def _bigrams(b: Block, m: Model) -> Grams:
    before = np.empty_like(b.tokens)
    before[1:] = b.tokens[:-1]
    before[b.starts] = len(b.vocabulary) - 1
    known = (b.vocabulary != m.unigrams.unknown) & ((b.vocabulary < m.unigrams.unknown) | (m.beginnings > 0))
    return _grams(before, known[before], b.vocabulary, np.zeros(0, np.int64), b.hot, b, m.ranges)


def _trigrams(b: Block, two: Two, m: Model) -> Grams:
    # a token's history is the bigram before it; a text's first token has the beginning twice, the last place
    history = np.empty_like(b.tokens)
    history[1:] = two.grams.of[:-1]
    history[b.starts] = len(two.count)
    start = b.vocabulary[-1]
    # the place -1, of a history that the model does not know, is the last here
    known = np.append(two.count > 0, [m.beginnings > 0, False])[history]
    hot, g = np.append(two.count > m.most, b.hot[-1]), two.grams
    return _grams(history, known, np.append(g.ids[g.word], start), np.append(g.v[g.history], start), hot, b, m.ranges)


def _slices(g: Grams, ranges: int, *more: np.ndarray) -> pd.DataFrame:
    """(range, blob) of n-grams: histories with their sizes, words, and more columns."""
    at, order, cut = _dealt(g.range, ranges)
    if not len(at):
        return pd.DataFrame({"range": [], "blob": []})
    history = g.history[order]
    new = _changes(history)
    new[cut[:-1]] = True
    head = np.flatnonzero(new)
    size, lead, of = np.diff(np.append(head, len(order))), history[head], np.searchsorted(head, cut)
    u = (_steps(g.u[lead], of), of) if len(g.u) else (g.u, np.zeros_like(of))
    blobs = _packed((size, of), (_steps(g.v[lead], of), of), u, (g.hot[lead], of), (g.ids[g.word[order]] + 1, cut), *((x[order], cut) for x in more))
    return pd.DataFrame({"range": at, "blob": blobs})


# ---- tables ----


class Part(NamedTuple):
    """A range's distinct n-grams by history (u, v) and word, also those not seen in training."""

    size: np.ndarray  # of histories, which ascend by u and v
    v: np.ndarray
    u: np.ndarray  # empty in bigrams
    w: np.ndarray
    count: np.ndarray
    lower: np.ndarray  # of trigrams the training count of their bigram v w
    fixed: np.ndarray  # and whether v has no discounted counts

    def packed(self) -> bytes:
        return _pack(self.size, _steps(self.v), _steps(self.u), self.w + 1, self.count, self.lower, self.fixed)

    @staticmethod
    def opened(blob: bytes) -> Part:
        size, v, u, w, *rest = _unpack(blob)
        return Part(size, np.cumsum(v), np.cumsum(u), w - 1, *rest)

    def sums(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of histories in this range: counts, r * n_r for r to K, and lower probabilities of the words seen after them."""
        n, h = len(self.size), np.repeat(np.arange(len(self.size)), self.size)
        p = scaled(self.lower, m.bigram_discounts) / np.maximum(m.totals(self.v)[h] + self.fixed, 1) if len(self.u) else m.unigrams.probabilities(self.w)
        few = np.flatnonzero((self.count > 0) & (self.count <= K))
        low = np.bincount(h[few] * K + self.count[few] - 1, minlength=n * K).reshape(n, K) * np.arange(1, K + 1)
        return np.bincount(h, self.count, n).astype(np.int64), low, np.bincount(h, np.where(self.count > 0, p, 0.0), n)

    def only(self, these: np.ndarray) -> Part:
        """Of the histories at these places, which ascend, alone."""
        is_one = np.zeros(len(self.size), bool)
        is_one[these] = True
        mine = np.repeat(is_one, self.size)
        return Part(self.size[these], self.v[these], self.u[these] if len(self.u) else self.u, *(x[mine] if len(x) else x for x in self[3:]))


def _order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ascending by columns of numbers that are not negative, the first first."""
    if not len(first):
        return np.zeros(0, np.int64)
    bits = int(second.max()).bit_length()
    if int(first.max()).bit_length() + bits + len(first).bit_length() > 64:
        first = _distinct(first)[2]
    if int(first.max()).bit_length() + bits > 63:
        return np.lexsort((second, first))
    return _sorted((first.astype(np.int64) << np.int64(bits)) | second)[1]


MET = "range int, blob binary, blocks array<long>, places array<binary>, hv array<long>, hu array<long>, total array<long>, low array<long>, seen array<double>, stat array<long>"


def _met(slices: DataFrame, m: Model, buckets: int) -> DataFrame:
    """One row for each range: its Part, each slice's places in it, sums of its hot histories, and n_1 to n_(K+1)."""
    m = m.alone()

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        (size, v, u, hot, w, times, *lower), sizes = _unpacked(rows["blob"])
        v, u, cut = _summed(v, sizes[1]), _summed(u, sizes[2]), np.append(0, np.cumsum(sizes[4]))
        histories = (u, v) if len(u) else (v,)
        order = _order(u, v) if len(u) else _sorted(v)[1]
        new = _changes(*(x[order] for x in histories))
        of, lead = _placed(order, new), order[new]
        h = np.repeat(of, size)
        order = _order(h, w)
        new = _changes(h[order], w[order])
        place, first = _placed(order, new), order[new]
        del order, new
        n, count = len(lead), np.bincount(place, times, len(first)).astype(np.int64)
        part = Part(np.bincount(h[first], minlength=n), v[lead], u[lead] if len(u) else u, w[first] - 1, count, *([x[first] for x in lower] or [np.zeros(0, np.int64)] * 2))
        places = _packed((_steps(place, cut), cut))
        some = np.flatnonzero(hot[lead])
        total, low, seen = part.only(some).sums(m) if len(some) else (np.zeros((0, K)),) * 3
        stat = [int((count == r).sum()) for r in range(1, K + 2)]
        hu = part.u[some] if len(u) else np.full(len(some), -1)
        return pd.DataFrame([(key[0], part.packed(), rows["block"].to_numpy(), places, part.v[some], hu, total, low.ravel(), seen, stat)], columns=[c.split()[0] for c in MET.split(", ")])

    return stored(slices.groupBy("range").applyInPandas(meet, MET), "met", buckets=(buckets, "range"))


def _weighed(slices: DataFrame, m: Model, buckets: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The table of one order (kind = 'table': range, blob), answers ('answer': range, block, blob) and discounts. An answer: of a slice's n-grams counts and
    whether the history has no discounted counts, and of the unseen ones alpha."""
    met = _met(slices, m, buckets)
    stat = met.select(*(F.sum(F.col("stat")[r]) for r in range(K + 1))).first()
    d = discounts([int(x or 0) for x in stat])
    # sums of hot histories over all ranges go back to each range that has them
    low = F.transform(F.sequence(F.lit(0), F.size("hv") - 1), lambda i: F.slice("low", i * K + 1, K))
    parts = met.where(F.size("hv") > 0).select("range", F.explode(F.arrays_zip("hv", "hu", "total", low.alias("low"), "seen")).alias("h")).select("range", "h.*")
    sums = parts.groupBy("hv", "hu").agg(F.sum("total").alias("total"), F.array(*(F.sum(F.col("low")[r]) for r in range(K))).alias("low"), F.sum("seen").alias("seen"))
    back = parts.select(F.col("range").alias("at"), "hv", "hu").join(sums, ["hv", "hu"]).select("at", "hv", "hu", "total", "low", "seen")
    m = m.alone()

    def weigh(key: tuple, rows: pd.DataFrame, hot: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        t = Part.opened(row["blob"])
        total, low, seen = t.sums(m)
        if len(hot):
            at = _located([hot["hv"].to_numpy(), hot["hu"].to_numpy()] if len(t.u) else [hot["hv"].to_numpy()], [t.v, t.u] if len(t.u) else [t.v])
            total[at], low[at], seen[at] = hot["total"], np.stack(hot["low"].tolist()), hot["seen"]
        fixed = low.sum(1) == 0
        alpha = np.where(fixed, 1.0, low @ (1 - d)) / (total + fixed) / (1 - seen)
        h = np.repeat(np.arange(len(alpha)), t.size)
        (at,), (size,) = _unpacked(row["places"])
        at, cut = _summed(at, size), np.append(0, np.cumsum(size))
        count = t.count[at]
        unseen = np.append(0, np.cumsum(count == 0))[cut]
        answers = _packed((count, cut), (fixed[h[at]], cut), (alpha[h[at[count == 0]]], unseen))
        out = [("answer", key[0], block, blob) for block, blob in zip(row["blocks"], answers, strict=True)]
        known, seen = total > 0, t.count > 0
        out.append(("table", key[0], None, _pack(np.bincount(h[seen], minlength=len(known))[known], _steps(t.v[known]), _steps(t.u[known]) if len(t.u) else t.u, alpha[known], fixed[known], total[known], t.w[seen], t.count[seen], d)))
        return pd.DataFrame(out, columns=["kind", "range", "block", "blob"])

    made = stored(met.groupBy("range").cogroup(back.groupBy("at")).applyInPandas(weigh, "kind string, range int, block long, blob binary"), "weighed", "kind")
    dropped(met)
    return made, made.where("kind = 'answer'").select("range", "block", "blob"), d


def _opened_table(blobs: list[bytes]) -> list[np.ndarray]:
    """size, v, u, alpha and fixed of histories, and w, count, p of n-grams, of rows of a table."""

    def opened(size, v, u, alpha, fixed, total, w, count, d) -> tuple[np.ndarray, ...]:
        return size, np.cumsum(v), np.cumsum(u), alpha, fixed, w, count, scaled(count, d) / np.repeat(total + fixed, size)

    parts = [opened(*_unpack(x)) for x in blobs]
    kinds = (np.int64, np.int64, np.int64, float, bool, np.int64, np.int64, float)
    return [np.concatenate([*x, np.zeros(0, k)]) for x, k in zip(zip(*parts, strict=True) if parts else [()] * 8, kinds, strict=True)]


def histories(table: DataFrame) -> DataFrame:
    """(range, u, v, alpha) of a model's table, a row for each history; u is null in bigrams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r, blob in zip(b["range"], b["blob"], strict=True):
                _, v, u, alpha, *_ = _opened_table([blob])
                yield pd.DataFrame({"range": r, "u": u if len(u) else None, "v": v, "alpha": alpha})

    return table.mapInPandas(run, "range int, u long, v long, alpha double")


def grams(table: DataFrame) -> DataFrame:
    """(range, u, v, w, count, p) of a model's table, a row for each n-gram; u is null in bigrams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r, blob in zip(b["range"], b["blob"], strict=True):
                size, v, u, _, _, w, count, p = _opened_table([blob])
                yield pd.DataFrame({"range": r, "u": np.repeat(u, size) if len(u) else None, "v": np.repeat(v, size), "w": w, "count": count, "p": p})

    return table.mapInPandas(run, "range int, u long, v long, w long, count long, p double")


def _located(keys: list[np.ndarray], known: list[np.ndarray]) -> np.ndarray:
    """The place of each key among known ones, which are distinct; -1 where there is none. Columns of ids."""
    if not len(known[0]):
        return np.full(len(keys[0]), -1)
    for salt in range(1, 1 << 30):
        hashed = lambda columns, h: [h := mix(h + c.astype(np.uint64)) for c in columns][-1]  # noqa: B023, E731
        mine = hashed(known, np.uint64(salt))
        order = np.argsort(mine)
        mine = mine[order]
        if not (mine[1:] == mine[:-1]).any():
            break
    at = order[np.minimum(np.searchsorted(mine, hashed(keys, np.uint64(salt))), len(mine) - 1)]
    same = np.logical_and.reduce([k[at] == q for k, q in zip(known, keys, strict=True)])
    return np.where(same, at, -1)


def _looked_up(slices: DataFrame, table: DataFrame) -> DataFrame:
    """Answers as of _weighed(), for n-grams of other texts; alpha is nan where a hot history is not in this range."""

    def answer(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        size, v, u, alpha, fixed, words, counts, _ = _opened_table(rows["blob"].tolist())
        if not len(asks):
            return pd.DataFrame(columns=["block", "range", "blob"])
        (n, qv, qu, _, qw, *_), sizes = _unpacked(asks["blob"])
        ask = [_summed(qv, sizes[1]), _summed(qu, sizes[2])] if len(qu) else [_summed(qv, sizes[1])]
        h = np.repeat(_located(ask, [v, u] if len(qu) else [v]), n)
        place = _located([h, qw], [np.repeat(np.arange(len(v)), size), words + 1])
        count = np.where(place >= 0, np.append(counts, 0)[place], 0)
        cut = np.append(0, np.cumsum(sizes[4]))
        unseen = np.append(0, np.cumsum(count == 0))[cut]
        blobs = _packed((count, cut), (np.append(fixed, False)[h], cut), (np.append(alpha, np.nan)[h[count == 0]], unseen))
        return pd.DataFrame({"block": asks["block"], "range": asks["range"], "blob": blobs})

    return table.groupBy("range").cogroup(slices.groupBy("range")).applyInPandas(answer, "block long, range int, blob binary")


def _probabilities(g: Grams, got: pd.DataFrame, ranges: int, totals: np.ndarray, d: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each n-gram its probability, count, and whether its history has no discounted counts. totals: of histories, by place; lower: probabilities of the next lower order."""
    n = len(g.word)
    count, fixed, alpha = np.zeros(n, np.int64), np.zeros(n, bool), np.full(n, np.nan)
    if not n:
        return alpha, count, fixed
    _, order, _ = _dealt(g.range, ranges)
    seen, fixed[order], weights = _unpacked(got.sort_values("range")["blob"])[0]
    count[order] = seen
    alpha[order[seen == 0]] = weights
    # a hot history's alpha is with what asked for it, the last of the history
    hot = np.flatnonzero(g.hot[g.history])
    asked = np.flatnonzero(g.token[hot] < 0)
    last = hot[np.repeat(asked, np.diff(np.append(-1, asked)))]
    alpha[hot], fixed[hot] = alpha[last], fixed[last]
    return np.where(count > 0, scaled(count, d) / np.maximum(totals[g.history] + fixed, 1), alpha * lower), count, fixed


def _rows(blocks: DataFrame, make) -> DataFrame:
    """(range, block, blob) of what make(row) returns for each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                yield make(row).assign(block=row.block)[["range", "block", "blob"]]

    return blocks.mapInPandas(run, "range int, block long, blob binary")


def _bigram_slices(coded: DataFrame, m: Model) -> DataFrame:
    def make(row) -> pd.DataFrame:
        g = _bigrams(_opened(row.blob, row.held), m)
        return _slices(g, m.ranges, g.times)

    m = m.alone()
    return _rows(coded.select("block", "held", "blob"), make)


def _with_bigrams(coded: DataFrame, answers: DataFrame, m: Model, buckets: int) -> DataFrame:
    """coded with a column two: of each of a block's bigrams its count and whether its history has no discounted counts, and of the unseen ones the probability."""
    m = m.alone()

    def put(block: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        b = _opened(block["blob"].iloc[0], block["held"].iloc[0])
        g = _bigrams(b, m)
        one = np.append(m.unigrams.probabilities(b.vocabulary), 0.0)[g.word]
        p, count, fixed = _probabilities(g, got, m.ranges, m.totals(b.vocabulary), m.bigram_discounts, one)
        return block.assign(two=[_pack(count, fixed, p[count == 0])])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema.fields)
    return stored(coded.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(put, f"{schema}, two binary"), "coded_bigrams", buckets=(buckets, "block"))


class Two(NamedTuple):
    """A block's bigrams, with what is known of them."""

    grams: Grams
    count: np.ndarray
    fixed: np.ndarray
    rest: np.ndarray  # of the unseen ones the probability

    def lower(self, b: Block, m: Model) -> np.ndarray:
        """P(w | v) of the block's tokens."""
        g = self.grams
        p = scaled(self.count, m.bigram_discounts) / np.maximum(m.totals(b.vocabulary)[g.history] + self.fixed, 1)
        p[self.count == 0] = self.rest
        out = np.append(p, 0.0)[g.of]
        none = np.flatnonzero(g.of < 0)
        out[none] = m.unigrams.probabilities(b.vocabulary)[b.tokens[none]]
        return out


def _two(b: Block, blob: bytes, m: Model) -> Two:
    return Two(_bigrams(b, m), *_unpack(blob))


def _trigram_slices(coded: DataFrame, m: Model) -> DataFrame:
    def make(row) -> pd.DataFrame:
        b = _opened(row.blob, row.held)
        two = _two(b, row.two, m)
        g = _trigrams(b, two, m)
        lower = np.where(g.token >= 0, two.grams.of[g.token], -1)
        return _slices(g, m.ranges, g.times, np.append(two.count, 0)[lower], np.append(two.fixed, False)[lower])

    m = m.alone()
    return _rows(coded.select("block", "held", "blob", "two"), make)


def _finished(coded: DataFrame, answers: DataFrame, m: Model, kind: str) -> DataFrame:
    m = m.alone()

    def finish(block: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        b, u = _opened(block["blob"].iloc[0], block["held"].iloc[0]), m.unigrams
        two = _two(b, block["two"].iloc[0], m)
        g, lower = _trigrams(b, two, m), two.lower(b, m)
        top, _, _ = _probabilities(g, got, m.ranges, np.append(two.count, m.beginnings), m.trigram_discounts, lower[g.token] if len(lower) else lower)
        doc, n = np.repeat(np.arange(len(b.lengths)), b.lengths), len(b.lengths)
        score = np.bincount(doc, np.log10(np.where(g.of >= 0, np.append(top, 0.0)[g.of], lower)), n)
        counts = u.counts(b.vocabulary)
        base = np.bincount(doc, np.log10((counts + 1) / (u.tokens + u.unknown + 1))[b.tokens], n)
        known = np.bincount(doc, (counts > 0)[b.tokens], n).astype(np.int64)
        return pd.DataFrame({"id": pd.Series(list(block["ids"].iloc[0]), dtype=object), "held_out": block["held"].iloc[0], "n_tokens": b.lengths, "n_known": known, "train_tokens": u.tokens, "base_score": base, "score": score})

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return coded.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, schema)


def _buckets(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fit_and_score(docs: DataFrame, id: str, text: str, held_out: Column, ranges: int | None = None) -> tuple[DataFrame, Model]:
    """Learns from the rows that are not held out, and scores all: (id, held_out, n_tokens, n_known, train_tokens, base_score, score), and the model."""
    blocks, buckets = _blocks(docs, id, text, held_out), _buckets(docs)
    sums = blocks.agg(F.sum("all_tokens"), F.sum("tokens"), F.sum(F.size(F.filter("held", lambda h: ~h)))).first()
    every, train, beginnings = (int(x or 0) for x in sums)
    ranges = ranges or max(buckets, -(-every // RANGE_TOKENS))
    most = max(1, -(-train // (2 * ranges)))
    asked = _asked(blocks, ranges)
    words, uni = _ranked(asked, ranges, most)
    m = Model(words, None, None, uni, ranges, most, beginnings)
    coded = _coded(blocks, asked, m)
    dropped(blocks)
    made, answers, d = _weighed(_bigram_slices(coded, m), m, buckets)
    m = m._replace(bigrams=made.where("kind = 'table'").select("range", "blob"), bigram_discounts=d)
    both = _with_bigrams(coded, answers, m, buckets)
    dropped(coded)
    dropped(made, part="kind=answer")
    made, answers, d = _weighed(_trigram_slices(both, m), m, buckets)
    m = m._replace(trigrams=made.where("kind = 'table'").select("range", "blob"), trigram_discounts=d)
    return _finished(both, answers, m, dict(docs.dtypes)[id]), m


def score(docs: DataFrame, id: str, text: str, m: Model) -> DataFrame:
    """Scores of other texts from a model's tables, columns as of fit_and_score(); none is held out."""
    blocks, buckets = _blocks(docs, id, text, F.lit(False)), _buckets(docs)
    coded = _coded(blocks, _asked(blocks, m.ranges), m)
    both = _with_bigrams(coded, _looked_up(_bigram_slices(coded, m), m.bigrams), m, buckets)
    return _finished(both, _looked_up(_trigram_slices(both, m), m.trigrams), m, dict(docs.dtypes)[id])


def saved(m: Model, path: str) -> None:
    """Writes a model's tables below a path; bigrams and trigrams are partitioned by range."""
    spark, u = m.words.sparkSession, m.unigrams
    steps = spark.createDataFrame(pd.DataFrame({"count": u.count, "p": u.p, "first_id": u.first_id}), "count long, p double, first_id long")
    m.words.join(F.broadcast(steps.select("count", "p")), "count").write.parquet(f"{path}/words")
    m.bigrams.write.partitionBy("range").parquet(f"{path}/bigrams")
    m.trigrams.write.partitionBy("range").parquet(f"{path}/trigrams")
    steps.coalesce(1).write.parquet(f"{path}/counts")
    row = (u.p_unknown, u.unknown, u.tokens, m.ranges, m.most, m.beginnings, m.bigram_discounts.tolist(), m.trigram_discounts.tolist())
    spark.createDataFrame([row], "p_unknown double, unknown long, tokens long, ranges int, most long, beginnings long, two array<double>, three array<double>").coalesce(1).write.parquet(f"{path}/model")


def loaded(spark: SparkSession, path: str) -> Model:
    """A model that saved() has written."""
    steps = spark.read.parquet(f"{path}/counts").toPandas().sort_values("first_id")
    x = spark.read.parquet(f"{path}/model").first()
    uni = Unigrams(*(steps[c].to_numpy() for c in ("first_id", "count", "p")), x["p_unknown"], x["unknown"], x["tokens"])
    grams = [spark.read.schema("range int, blob binary").parquet(f"{path}/{t}") for t in ("bigrams", "trigrams")]
    return Model(spark.read.parquet(f"{path}/words"), *grams, uni, x["ranges"], x["most"], x["beginnings"], np.array(x["two"]), np.array(x["three"]))
