"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of terms: its words, by hash, trigrams over 16 character classes, and a few repetition terms (echoed words, repeated
lines). Log counts, weighted by inverse document frequency and projected to a few dimensions by a truncated singular value
decomposition, are its vector. Vectors of labelled texts are broadcast; every document's exact cosines with all of
them are one blocked matrix product, and the labels of its nearest neighbours vote, weighted by similarity.

Bounds: at most `max_labels` labelled texts (chosen by a hash of the key) are learned from and broadcast, each as a vector
of `dims` floats: 3000 x 32 x 4 bytes = 0.4 MB, whatever the input. The projection has TERMS x dims floats (1 MB).

Ties: similarities count to six places, so that they do not depend on how documents are blocked; of learned texts that are equally
near, those of smaller keys vote first.

Defined cases: null and empty texts are the zero vector, without neighbours, and score the share of label 1 among the
learned rows; without learned rows every score is 0.5; null keys and repeated rows are scored like others; repeated labels
of one key count once, with the lower label, and of several texts of a labelled key one, chosen by a hash, is learned from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import one_text
from darkroom.llm.shingles import word_hashes

CLASSES = 16
GRAMS = CLASSES**3
EXTRA = 8
WORDS = 2048
TERMS = GRAMS + EXTRA + WORDS


def _table() -> bytes:
    """The class of each byte of UTF-8."""
    kinds = {c: 1 for c in b" \t\r\x0b\x0c"} | {10: 2} | {c: 3 for c in b"aeiou"} | {c: 4 for c in range(97, 123) if c not in b"aeiou"} | {c: 5 for c in range(65, 91)} | {c: 6 for c in range(48, 58)}
    kinds |= {46: 7, 44: 8, 33: 9, 63: 9, 124: 10} | {c: 11 for c in b"#*$%&"} | {c: 12 for c in b"<>{}[]()"} | {c: 13 for c in b"-_/\\=+~^@"} | {c: 14 for c in range(128, 256)}
    return bytes(kinds.get(b, 15) for b in range(256))


TABLE = _table()


def term_counts(text: str | None) -> np.ndarray:
    """Log counts of the terms of a text."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    c = np.frombuffer(raw.translate(TABLE), np.uint8).astype(np.int32)
    if len(c) >= 3:
        out[:GRAMS] = np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=GRAMS)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    if words:
        n = len(words)
        # shares as counts of 0 to 30, so that they weigh like frequent trigrams, and spread over terms of low, middle and high
        for k, share in enumerate((sum(map(bytes.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(words)) / n)):
            out[GRAMS + 2 * k], out[GRAMS + 2 * k + 1] = 30 * share * (share > 0.3), 30 * share
        out[GRAMS + EXTRA :] = np.bincount((word_hashes(text) % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)
    # shares of trigrams and of words, in thousands
    for part in (out[:GRAMS], out[GRAMS + EXTRA :]):
        if total := part.sum():
            part *= 1000 / total
    return np.log1p(out)


class Voters(NamedTuple):
    """What is broadcast: term weights, the projection, unit vectors and labels of the learned texts."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        v = (counts * self.idf) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray, k: int) -> np.ndarray:
        """Share of label 1 among the k nearest learned texts, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        sims = np.round((self.embed(counts) @ self.vectors.T).astype(np.float64), 6)
        k = min(k, len(self.labels))
        least = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        above, tied = sims > least, sims == least
        near = above | (tied & (np.cumsum(tied, 1) <= k - above.sum(1, keepdims=True)))
        w = np.where(near, np.maximum(sims, 0), 0) ** 8
        total = w.sum(1)
        return np.where(total > 0, w @ self.labels / np.where(total > 0, total, 1), self.labels.mean())


def fit(counts: np.ndarray, labels: np.ndarray, dims: int = 32, seed: int = 7) -> Voters:
    """Weights and a randomised truncated decomposition of the learned texts' counts."""
    n = len(counts)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1 if n else np.ones(TERMS, np.float32)
    x = counts * idf
    dims = max(1, min(dims, n))
    sketch = x @ np.random.default_rng(seed).standard_normal((TERMS, dims + 8)).astype(np.float32)
    for _ in range(3):
        sketch, _ = np.linalg.qr(x @ (x.T @ sketch)) if n else (sketch, None)
    basis = np.linalg.svd(sketch.T @ x, full_matrices=False)[2][:dims].T.copy() if n else np.zeros((TERMS, dims), np.float32)
    out = Voters(idf, basis.astype(np.float32), np.zeros((0, dims), np.float32), labels.astype(np.float64))
    return out._replace(vectors=out.embed(counts)) if n else out


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_labels: int = 3000, dims: int = 32) -> Voters:
    """Voters from at most max_labels labelled texts. The driver gets their counts, max_labels x TERMS half floats (37 MB)."""
    keys = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("label"))
    keys = keys.orderBy(F.xxhash64("k"), "k").limit(max_labels)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["_k"], "label": b["_label"], "counts": [term_counts(t).astype(np.float16).tobytes() for t in b["_t"]]})

    kinds = dict(keys.dtypes)
    one = one_text(docs, key, text, F.broadcast(keys.withColumnsRenamed({"k": "_k", "label": "_label"})))
    got = one.mapInPandas(count, f"k {kinds['k']}, label {kinds['label']}, counts binary").toPandas().sort_values("k", ignore_index=True)
    x = np.frombuffer(b"".join(got["counts"]), np.float16).reshape(-1, TERMS).astype(np.float32)
    return fit(x, got["label"].to_numpy(), dims)


def score(docs: DataFrame, key: str, text: str, voters: Voters, k: int = 15, block: int = 256) -> DataFrame:
    """(key, score) of every row, in blocks of so many documents."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(voters))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = Voters(*shared.value)
        for b in batches:
            for at in range(0, len(b), block):
                part = b.iloc[at : at + block]
                yield pd.DataFrame({"key": part["key"], "score": v.scores(np.stack([term_counts(t) for t in part["text"]]), k)})

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(vote, f"key {dict(docs.dtypes)[key]}, score double")
