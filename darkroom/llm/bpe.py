r"""Byte-pair encoding and decoding with a given public vocabulary, over a contiguous rank array.

A word is an array of part boundaries with, beside each boundary, the rank of the merge of the two parts that meet there.
The array is short, so the encoder scans it for its minimum (the leftmost of equals), deletes that boundary,
refreshes the ranks of both neighbours, and repeats until no merge is left. Words are cached for each worker, in a cache of
bounded size, as packed ids.

Vocabulary files have word ends, lower-cased NFC text and white space dropped; their path is a parameter.
Special tokens in a text become their ids. Executors read the file themselves where it is installed.

Rows are handled a few at a time within a task, so a worker holds its vocabulary, its cache and one small block of texts.

Defined cases: null and empty texts and texts of white space have no ids and decode to the empty string; very long words
are encoded by the same rule with a heap of the same order beyond `SHORT` bytes; null keys, repeated rows, empty tables
and clashing column names are harmless, since only the text column is read and one column is added.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SHORT = 256
CACHED_WORDS = 400_000
BITS = 24
MASK = (1 << BITS) - 1
NONE = 1 << 62
END = "</w>"
# fixed values: white space that a pattern's \s matches, and the pattern that splits text into words
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACES + r"\p{L}\p{N}]+"


def strict_pieces() -> str:
    """PIECES by the Unicode version of Python's own tables, for texts beyond Latin-1: characters that regex knows as letters or numbers but Python's tables don't have are neither."""
    known = regex.compile(r"[\p{L}\p{N}]")
    newer = [i for i in range(0x250, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) == "Cn" and known.match(chr(i))]
    runs: list[list[int]] = []
    for i in newer:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    new = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]" if runs else r"[^\s\S]"
    return rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--{new}]+|[\p{{N}}--{new}]|[[^{SPACES}\p{{L}}\p{{N}}]||{new}]+"


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself where it is printable Latin-1, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in signs:
            signs[b] = chr(free)
            free += 1
    return [signs[b] for b in range(256)]


def merge_parts(parts: list[int], merges: dict[int, int]) -> list[int]:
    """Merges adjacent parts in place, the lowest rank first and the leftmost of equals, on an array of parts and the ranks between them.

    merges: (left part << BITS | right part) -> (rank << BITS | merged part)."""
    get = merges.get
    ranks = [get(a << BITS | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while ranks and (best := min(ranks)) != NONE:
        i = ranks.index(best)
        parts[i] = made = best & MASK
        del parts[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = get(made << BITS | parts[i + 1], NONE)
        if i:
            ranks[i - 1] = get(parts[i - 1] << BITS | made, NONE)
    return parts


def merge_long(parts: list[int], merges: dict[int, int]) -> list[int]:
    """merge_parts for long words, where scanning would take time with the square of the length: a heap of the same order over linked parts."""
    after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
    heap = [(merges[p], i, p) for i, p in enumerate(a << BITS | b for a, b in zip(parts, parts[1:], strict=False)) if p in merges]
    heapq.heapify(heap)
    while heap:
        found, i, pair = heapq.heappop(heap)
        j = after[i]
        if j < 0 or parts[i] < 0 or parts[i] << BITS | parts[j] != pair:
            continue
        parts[i], parts[j], after[i] = found & MASK, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] >= 0 and (p := parts[a] << BITS | parts[after[a]]) in merges:
                heapq.heappush(heap, (merges[p], a, p))
    return [p for p in parts if p >= 0]


class _Words(dict):
    """Packed ids of each word; cleared when full, so a worker's memory is bounded."""

    def __init__(self, first: list[int], last: list[int], merges: dict[int, int]) -> None:
        self.first, self.last, self.merges = first, last, merges

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        out = np.array((merge_parts if len(ids) <= SHORT else merge_long)(ids, self.merges), np.int32).tobytes()
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
        return out


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        signs = byte_signs()
        ranked = {vocab[a] << BITS | vocab[b]: rank << BITS | vocab[a + b] for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.words = _Words([vocab[c] for c in signs], [vocab[c + END] for c in signs], ranked)
        self.special = {t["content"]: np.array([t["id"]], np.int32).tobytes() for t in spec["added_tokens"]}
        names = vocab | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = np.empty(max(names.values()) + 1, object)
        for name, i in names.items():
            self.names[i] = name
        self.split = regex.compile("(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.pieces, self.strict = regex.compile(PIECES), None

    def encode(self, text: str | None) -> np.ndarray:
        out = []
        for part in self.split.split(text or "") if self.split else [text or ""]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                # one character at a time: no final form of sigma
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += map(self.words.__getitem__, self.pieces_of(low))
        return np.frombuffer(b"".join(out), np.int32)

    def pieces_of(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self.pieces.findall(text)
        except UnicodeEncodeError:
            self.strict = self.strict or regex.compile(strict_pieces())
            return self.strict.findall(text)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' own strings, joined by spaces."""
        return " ".join(self.names[np.asarray(ids, np.int64)].tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each worker process and file."""
    return Codec(path)


def _added(rows: DataFrame, columns: list[T.StructField], make: Callable[[pa.RecordBatch, Codec], list[pa.Array]], path: str, block: int) -> DataFrame:
    """rows with more columns, made of so many rows at a time, in place of columns of their names; the others pass through as they are."""
    new = {c.name for c in columns}
    kept = [(i, f) for i, f in enumerate(rows.schema.fields) if f.name not in new]
    schema = T.StructType([*(f for _, f in kept), *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i, _ in kept), *make(part, c)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _listed(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def _ids(texts: pa.Array, c: Codec) -> list[np.ndarray]:
    return [c.encode(t) for t in texts.to_pylist()]


def encode(docs: DataFrame, text: str, path: str, into: str = "ids", block: int = 128) -> DataFrame:
    """docs with an array column of token ids."""
    at = docs.columns.index(text)
    return _added(docs, [T.StructField(into, T.ArrayType(T.IntegerType()))], lambda b, c: [_listed(_ids(b.column(at), c))], path, block)


def decode(rows: DataFrame, ids: str, path: str, into: str = "decoded", block: int = 128) -> DataFrame:
    """rows with a text column decoded from an array column of ids; null ids decode to the empty string."""
    at = rows.columns.index(ids)
    return _added(rows, [T.StructField(into, T.StringType())], lambda b, c: [pa.array([c.decode(a.values.to_numpy()) if a.is_valid else "" for a in b.column(at)], pa.string())], path, block)


def round_trip(docs: DataFrame, text: str, path: str, ids: str = "ids", decoded: str = "decoded", block: int = 128) -> DataFrame:
    """docs with token ids and what they decode to, in one pass: one worker for each task, with one vocabulary."""
    at = docs.columns.index(text)

    def make(b: pa.RecordBatch, c: Codec) -> list[pa.Array]:
        made = _ids(b.column(at), c)
        return [_listed(made), pa.array([c.decode(a) for a in made], pa.string())]

    return _added(docs, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())], make, path, block)
