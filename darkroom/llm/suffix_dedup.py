r"""Removal of repeated byte strings by a sparse suffix array, sorted by a common-prefix-aware distributed merge sort.

Every byte that lies in a string of LENGTH bytes that also starts anywhere else, in any document, is removed.

Suffixes. Not every suffix is needed. Each string of LENGTH bytes has an anchor, the place of its least GRAM-byte hash (the
leftmost of equals) among the WINDOW grams that it holds; equal strings have equal anchors. Only suffixes at anchors are
sorted, about 2 of WINDOW + 1, each as far as the strings with this anchor reach, and with the bytes before it that they reach.

Sort. Within a task, blocks of documents yield sorted runs of suffixes, cut at splitters of their bytes. A run is front
coded: each suffix is stored as the length of the prefix that it shares with the one before, and the rest. Runs are exchanged by
range and merged by a loser tree whose nodes remember the prefix that a loser shares with its winner, so known
prefixes are never compared again. The merge yields the order and the common prefixes of neighbours.

Answer. A string that starts d bytes before an anchor repeats if another anchor has the same d bytes before it and the same
LENGTH - d after it. Only suffixes that share LENGTH - d bytes with a neighbour can have such a partner; for these, windows are
brought together for each d by a rolling hash of 64 bits and then compared byte by byte, so that strings whose hashes collide are kept. The
bytes from the farthest start to the nearest start's end go.

Hot strings: equal contexts within a run travel once and are answered where they are, so a passage of very many documents is one
entry of each run. Splitters are GRAM bytes long, the least that partners share from the anchor on, so none can part two partners. Where very
many suffixes share these bytes but not what lies around them, this would be one range. Such hot grams go out once for each of SHARES
intervals of d instead: partners whose d is within an interval share the LENGTH - d bytes of its far end after the anchor, and the d bytes
of its near end before it, so a hash of both deals them without parting partners, and what lies farther is cut off, so more of them are equal.

Bounds: the number of ranges follows the bytes of the texts; splitters and hot grams come from a bounded sample for each range and decide
only how evenly work is dealt. Texts are handled in overlapping pieces of bounded size. Rows are told apart by two hashes of 64 bits each.

Defined cases: null and empty texts, and those under LENGTH bytes, lose nothing; equal rows are documents of their own, so
each loses what both hold; null and repeated ids have their own rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.shingles import mix

LENGTH, GRAM = 200, 16
WINDOW = LENGTH - GRAM + 1
LEFT = WINDOW - 1
BLOCK, PIECE = 6 << 20, 1 << 20
#: Bytes of text for each range; about so many documents for each range are sampled, 400 at least, and at most. Each gives 200 grams of 16 bytes at most to the driver.
RANGE_BYTES, SAMPLE_DOCS, MOST_DOCS = 8 << 20, 4, 20_000
#: Intervals of d of a hot gram, which is one that the sample has so many times.
SHARES, HOT = 4, 24
#: Base of the rolling hash, odd.
BASE = 0x9E3779B97F4A7C15
INTERVALS = [(i * WINDOW // SHARES, (i + 1) * WINDOW // SHARES - 1) for i in range(SHARES)]


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of all strings of LENGTH bytes, ascending, and the first and last start of the strings that each anchors."""
    n = len(raw) - GRAM + 1
    if len(raw) < LENGTH:
        return (np.zeros(0, np.int64),) * 3
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    x = mix(eight[:n] * np.uint64(0x9E3779B97F4A7C15) + eight[8 : n + 8])
    key = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    # sliding minimum: of the rest of one stretch and the beginning of the next
    rows = -(-n // WINDOW)
    held = np.full(rows * WINDOW, np.iinfo(np.uint64).max, np.uint64)
    held[:n] = key
    held = held.reshape(rows, WINDOW)
    ahead = np.minimum.accumulate(held[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(held, 1).ravel()
    place = (np.minimum(ahead[: n - LEFT], behind[LEFT:n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # places never go back as the start goes on, so an anchor's starts are one stretch
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return place[first], first, np.append(first[1:], len(place)) - 1


def contexts(raw: bytes, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """`right` bytes from each anchor, then the `left` bytes before it, nearest first; zeros fill up LENGTH and LEFT places."""
    padded = np.frombuffer(bytes(LEFT) + raw + bytes(LENGTH), np.uint8)
    ahead, back = np.arange(LENGTH), np.arange(LEFT)
    out = padded[at[:, None] + np.concatenate([ahead, -1 - back]) + LEFT]
    out[:, :LENGTH][ahead >= right[:, None]] = 0
    out[:, LENGTH:][back >= left[:, None]] = 0
    return out


def common(a: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Shared prefix of each row with the row before (the first: 0), no longer than either row's length."""
    out = np.zeros(len(a), np.int64)
    if len(a) > 1:
        differ = a[1:] != a[:-1]
        first = np.where(differ.any(1), differ.argmax(1), a.shape[1])
        out[1:] = np.minimum(first, np.minimum(most[1:], most[:-1]))
    return out


def _pack(*parts) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts, protocol=5))


def _unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def pieces(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes): overlapping pieces, so that each string of LENGTH bytes starts in one alone."""
    for at in range(0, max(0, len(raw) - LENGTH + 1), PIECE):
        yield at, raw[at : at + PIECE + LENGTH - 1]


class Suffixes(NamedTuple):
    """Suffixes at anchors of a block, columns of equal length."""

    context: np.ndarray
    row: np.ndarray  # places in the block's documents
    place: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def of(self, which: np.ndarray) -> Suffixes:
        return Suffixes(*(x[which] for x in self))


def _text(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(f"S{x.shape[1]}").ravel()


def _within(s: Suffixes, low: int, high: int) -> Suffixes:
    """What strings that start low to high bytes before an anchor need: their anchors, and no farther bytes."""
    left, right = np.minimum(s.left, high), np.minimum(s.right, LENGTH - low)
    can = np.maximum(low, LENGTH - right) <= left
    s, left, right = s.of(can), left[can], right[can]
    s.context[:, :LENGTH][np.arange(LENGTH) >= right[:, None]] = 0
    s.context[:, LENGTH:][np.arange(LEFT) >= left[:, None]] = 0
    return s._replace(left=left, right=right)


def _run(s: Suffixes, names: np.ndarray, dealt) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """Front-coded runs (range, blob) of suffixes, and (row, start, end) of what repeats among them by whole contexts. dealt(suffixes in order): ranges."""
    order = np.lexsort((s.left, _text(s.context[:, LENGTH:]), s.right, _text(s.context[:, :LENGTH])))
    s = s.of(order)
    same = np.zeros(len(s.row), bool)
    same[1:] = (s.context[1:] == s.context[:-1]).all(1) & (s.left[1:] == s.left[:-1]) & (s.right[1:] == s.right[:-1])
    head = np.flatnonzero(~same)
    times = np.diff(np.append(head, len(s.row)))
    many = np.repeat(times > 1, times)
    local = np.stack([s.row, s.place - s.left, s.place + s.right], 1)[many]
    s = s.of(head)
    to, out, columns = dealt(s), [], np.arange(LENGTH)
    by = np.argsort(to, kind="stable")
    for mine in np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if len(by) else []:
        part = s.of(mine)
        suffix = part.context[:, :LENGTH]
        lcp = common(suffix, part.right)
        rest = suffix[(columns >= lcp[:, None]) & (columns < part.right[:, None])].tobytes()
        before = part.context[:, LENGTH:][np.arange(LEFT) < part.left[:, None]].tobytes()
        rows, index = np.unique(part.row, return_inverse=True)
        out.append((int(to[mine[0]]), _pack(lcp.astype(np.uint8), part.right.astype(np.uint8), part.left.astype(np.uint8), rest, before, names[rows], index.astype(np.uint32), part.place, times[mine] > 1)))
    return out, local


class Dealing(NamedTuple):
    """Where suffixes go: ranges 0 to n - 1 between splitters; those of hot grams, by hash, to ranges n * (1 + i) on for the i-th interval."""

    splitters: np.ndarray
    hot: np.ndarray
    ranges: int


def runs(docs: list[tuple[tuple[int, int], int, bytes]], how: Dealing) -> tuple[list[tuple[int, bytes]], np.ndarray, np.ndarray]:
    """Front-coded runs (range, blob) of a block of pieces (name, offset, bytes), and names and (start, end) of what repeats within the block by whole contexts."""
    names, parts = np.array([n for n, _, _ in docs], np.int64).reshape(-1, 2), []
    for k, (_, offset, raw) in enumerate(docs):
        at, first, last = anchors(raw)
        if len(at):
            left, right = at - first, last + LENGTH - at
            parts.append(Suffixes(contexts(raw, at, left, right), np.full(len(at), k, np.int64), at + offset, left, right))
    if not parts:
        return [], np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
    whole = Suffixes(*map(np.concatenate, zip(*parts, strict=True)))
    del parts
    hot = np.isin(_text(whole.context[:, :GRAM]), how.hot) if len(how.hot) else np.zeros(len(whole.row), bool)
    made, local = _run(whole.of(~hot), names, lambda s: np.searchsorted(how.splitters, _text(s.context[:, :GRAM]), "right"))
    found = [local]
    some = whole.of(hot)
    for i, (low, high) in enumerate(INTERVALS if hot.any() else []):

        def dealt(s: Suffixes, i=i, low=low, high=high) -> np.ndarray:
            shared = np.concatenate([s.context[:, : LENGTH - high], s.context[:, LENGTH : LENGTH + low]], 1)
            h = np.array([zlib.crc32(x.tobytes()) for x in shared], np.int64)
            return how.ranges * (1 + i) + h % how.ranges

        more, local = _run(_within(some.of(np.arange(len(some.row))), low, high), names, dealt)
        made += more
        found.append(local)
    local = np.concatenate(found)
    return made, names[local[:, 0]], local[:, 1:]


class LoserTree:
    """Merges sorted runs of strings. shared[i]: the prefix that run i's head shares with the last string put out, or with the string that beat it at its node."""

    def __init__(self, strings: list[list[bytes]], prefixes: list[list[int]]) -> None:
        self.strings, self.prefixes = strings, prefixes
        self.k = 1 << max(0, len(strings) - 1).bit_length()
        self.heads = [s[0] if s else None for s in strings] + [None] * (self.k - len(strings))
        self.shared, self.next = [0] * self.k, [0] * self.k
        self.losers = [-1] * self.k
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, self.losers[node] = (a, b) if self._wins(a, b) else (b, a)
        return win

    def _wins(self, a: int, b: int) -> bool:
        """Whether a's head comes first; the loser's shared prefix becomes that with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None
        h = self.shared[a]
        if h != self.shared[b]:
            return h > self.shared[b]
        most = min(len(x), len(y))
        while h < most and x[h : h + 16] == y[h : h + 16]:
            h += 16
        h = min(h, most)
        while h < most and x[h] == y[h]:
            h += 1
        first = x[h:] <= y[h:]
        self.shared[b if first else a] = h
        return first

    def merged(self) -> Iterator[tuple[int, int, int]]:
        """(run, place in the run, prefix shared with the string put out before)."""
        k, heads, shared, losers = self.k, self.heads, self.shared, self.losers
        win = self.winner
        while heads[win] is not None:
            at = self.next[win]
            yield win, at, shared[win]
            self.next[win] = at = at + 1
            if at < len(self.strings[win]):
                heads[win], shared[win] = self.strings[win][at], self.prefixes[win][at]
            else:
                heads[win] = None
            node = (win + k) >> 1
            while node:
                other = losers[node]
                if not self._wins(win, other):
                    losers[node], win = win, other
                node >>= 1


def decoded(lcp: np.ndarray, length: np.ndarray, rest: bytes) -> list[bytes]:
    """The strings of a front-coded run."""
    out, last, at = [], b"", 0
    for h, n in zip(lcp.tolist(), length.tolist(), strict=True):
        last = last[:h] + rest[at : at + n - h]
        at += n - h
        out.append(last)
    return out


def repeats(blobs: list[bytes], low: int = 0, high: int = LEFT) -> tuple[np.ndarray, np.ndarray]:
    """Names and (start, end) of what repeats among the runs of a range, of strings that start low to high bytes before an anchor."""
    opened = [_unpack(b) for b in blobs]
    strings = [decoded(o[0], o[1], o[3]) for o in opened]
    order = list(LoserTree(strings, [o[0].tolist() for o in opened]).merged())
    first = np.cumsum([0, *(len(s) for s in strings)])
    order_of = np.array([first[r] + i for r, i, _ in order], np.int64)
    lcp = np.array([h for _, _, h in order], np.int64)
    near = np.maximum(lcp, np.append(lcp[1:], 0))
    pick = np.flatnonzero(near >= LENGTH - LEFT)
    joined = lambda n: np.concatenate([o[n] for o in opened])[order_of][pick]
    near, n = near[pick], len(pick)
    if not n:
        return np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
    after = np.frombuffer(b"".join(strings[order[i][0]][order[i][1]].ljust(LENGTH, b"\0") for i in pick), np.uint8).reshape(n, LENGTH)
    del strings
    before, run, nth = np.zeros((n, LEFT), np.uint8), np.array([r for r, _, _ in order])[pick], np.array([i for _, i, _ in order])[pick]
    for r, o in enumerate(opened):
        mine = np.flatnonzero(run == r)
        _spread(o[4], o[2], nth[mine], before, mine)
    right, left = joined(1).astype(np.int64), joined(2).astype(np.int64)
    base, top = BASE, np.uint64(pow(BASE, LENGTH - 1, 1 << 64))
    h = np.zeros(n, np.uint64)
    for c in range(LENGTH - 1, -1, -1):
        h = h * np.uint64(base) + after[:, c]
    # h: sum of byte c times base**c; a step to the left drops the last byte and shifts the others up
    far, close = np.full(n, -1), np.full(n, LENGTH)
    for d in range(LEFT + 1):
        if d:
            h = (h - after[:, LENGTH - d].astype(np.uint64) * top) * np.uint64(base) + before[:, d - 1]
        if not low <= d <= high:
            continue
        can = np.flatnonzero((near >= LENGTH - d) & (left >= d) & (right >= LENGTH - d))
        if len(can) > 1:
            by = can[np.argsort(h[can], kind="stable")]
            hit = _twins(by, h, before, after, d)
            far[hit] = d
            close[hit] = np.minimum(close[hit], d)
    names = np.concatenate([o[5][o[6]] for o in opened])[order_of][pick]
    place = joined(7).astype(np.int64)
    found = (far >= 0) & ~joined(8)
    return names[found], np.stack([place - far, place - close + LENGTH], 1)[found]


def _twins(by: np.ndarray, h: np.ndarray, before: np.ndarray, after: np.ndarray, d: int, step: int = 8192) -> np.ndarray:
    """Of rows in order of their hashes, those whose windows (d bytes before, LENGTH - d after) equal another's."""
    twin = np.flatnonzero(h[by[1:]] == h[by[:-1]])
    equal = np.zeros(len(by), bool)
    for i in range(0, len(twin), step):
        at = twin[i : i + step]
        a, b = by[at], by[at + 1]
        same = (after[a, : LENGTH - d] == after[b, : LENGTH - d]).all(1) & (before[a, :d] == before[b, :d]).all(1)
        equal[at[same]] = equal[at[same] + 1] = True
        for k in at[~same]:  # hashes that collide: rows of this hash are told apart by their bytes
            first, last = np.searchsorted(h[by], h[by[k]], "left"), np.searchsorted(h[by], h[by[k]], "right")
            seen: dict[bytes, int] = {}
            for j in range(first, last):
                other = seen.setdefault(after[by[j], : LENGTH - d].tobytes() + before[by[j], :d].tobytes(), j)
                if other != j:
                    equal[other] = equal[j] = True
    return by[equal]


def _spread(flat: bytes, length: np.ndarray, rows: np.ndarray, out: np.ndarray, to: np.ndarray, step: int = 4096) -> None:
    """Puts the strings of some rows, which lie end to end in flat, into rows of out, a few at a time."""
    text, size = np.frombuffer(flat, np.uint8), length.astype(np.int64)
    start, columns = np.cumsum(size) - size, np.arange(LEFT)
    for i in range(0, len(rows), step):
        r = rows[i : i + step]
        inside = columns < size[r][:, None]
        part = np.zeros(inside.shape, np.uint8)
        part[inside] = text[(start[r][:, None] + columns)[inside]]
        out[to[i : i + step]] = part


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what spans cover, ascending."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dealing(docs: DataFrame, ranges: int, rows: int) -> Dealing:
    """Quantiles of the first GRAM bytes of suffixes of a bounded sample of documents, by a hash, and those that it has very often. rows: the number of documents."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["text"]:
                grams = []
                for _, raw in pieces(t.encode("utf-8", "surrogatepass")):
                    grams += [raw[i : i + GRAM] for i in anchors(raw)[0]]
                # each gram of a text counts once
                yield pd.DataFrame({"suffix": [g for n, g in enumerate(dict.fromkeys(grams)) if n % max(1, len(grams) // 200) == 0]})

    every = max(1, rows // min(max(400, SAMPLE_DOCS * ranges), MOST_DOCS))
    some = docs.where((F.length("text") > 0) & (F.pmod("a", F.lit(every)) == 0))
    got = np.array(sorted(some.select("text").mapInPandas(sample, "suffix binary").toPandas()["suffix"]), f"S{GRAM}")
    gram, times = np.unique(got, return_counts=True)
    hot = gram[times >= max(HOT, len(got) // (2 * ranges))]
    cool = got[~np.isin(got, hot)]
    picked = np.unique(cool[np.arange(1, ranges) * len(cool) // ranges]) if len(cool) else cool
    return Dealing(picked, hot, ranges)


def repeated_spans(docs: DataFrame, id: str, text: str, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text, a, b) of docs, a and b hashes that name a row, and spans (a, b, start, end) of what repeats in them."""
    value = F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(id).alias("id"), value.alias("text"), F.xxhash64(id, value).alias("a"), F.xxhash64(F.lit(1), value, id).alias("b"))
    # two ranges a partition at least: what a task holds at once is one range
    size, count = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    ranges = ranges or max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size or 0) // RANGE_BYTES))
    how = dealing(rows, ranges, count)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, n = [], 0, 0

        def out() -> pd.DataFrame:
            made, names, spans = runs(held, how)
            made = [(r, True, blob) for r, blob in made]
            if len(spans):
                made.append((n % ranges, False, _pack(names, spans)))
            return pd.DataFrame(made, columns=["range", "run", "blob"])

        for b in batches:
            for x, y, t in zip(b["a"], b["b"], b["text"], strict=True):
                for offset, raw in pieces(t.encode("utf-8", "surrogatepass")):
                    held.append(((x, y), offset, raw))
                    size += len(raw)
                    if size >= BLOCK:
                        yield out()
                        held, size, n = [], 0, n + 1
        if held:
            yield out()

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        known = [_unpack(b) for b in part["blob"][~part["run"]]]
        if part["run"].any():
            interval = INTERVALS[key[0] // ranges - 1] if key[0] >= ranges else (0, LEFT)
            known.append(repeats(part["blob"][part["run"]].tolist(), *interval))
        names, spans = (np.concatenate(x) for x in zip(*known, strict=True))
        return pd.DataFrame({"a": names[:, 0], "b": names[:, 1], "start": spans[:, 0], "end": spans[:, 1]})

    exchanged = rows.select("a", "b", "text").mapInPandas(cut, "range int, run boolean, blob binary")
    return rows, exchanged.groupBy("range").applyInPandas(merge, "a long, b long, start long, end long")


def remove_repeats(docs: DataFrame, id: str, text: str, keep_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, removed, kept, kept_sha256) of every row; removed: maximal spans of removed bytes; kept: the remaining bytes, null unless keep_bytes."""
    rows, spans = repeated_spans(docs, id, text)
    by_row = spans.groupBy("a", "b").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 512):
                out = []
                part = b.iloc[at : at + 512]
                for i, t, found in zip(part["id"], part["text"], part["spans"], strict=True):
                    raw = t.encode("utf-8", "surrogatepass")
                    gone = united([(s["start"], s["end"]) for s in found]) if found is not None else []
                    kept = b"".join(raw[a:z] for a, z in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(raw)], strict=True))
                    out.append((i, len(raw), [{"start": s, "end": e} for s, e in gone], kept if keep_bytes else None, hashlib.sha256(kept).hexdigest()))
                yield pd.DataFrame(out, columns=["id", "n_bytes", "removed", "kept", "kept_sha256"])

    kind = dict(docs.dtypes)[id]
    return rows.join(by_row, ["a", "b"], "left").select("id", "text", "spans").mapInPandas(strip, f"id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary, kept_sha256 string")
