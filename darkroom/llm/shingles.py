r"""Hashed word shingles of whole texts, without a Python object for each word.

A-Z are lower-cased; words are runs of bytes other than the space and \x09-\x0D. A word's hash is the polynomial hash of its bytes
modulo 2**64, mixed; a shingle's combines the hashes of five words in order; a text of fewer words is one shingle, of its whole
sequence, hashed with its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

from darkroom.llm.common import WHITE

WORDS = 5
#: Bytes of a text that are hashed at once; a text needs about 40 bytes for each of these, whatever its length.
PIECE = 1 << 20
#: Texts up to this many bytes are hashed together, whose numbers then stay in a core's cache.
GROUP = 1 << 16
_WHITE = re.compile(b"[" + re.escape(WHITE) + b"]")
_R = 0x9E3779B97F4A7C15
_INVERSE = pow(_R, -1, 1 << 64)
_ISWHITE = np.zeros(256, bool)
_ISWHITE[[32, *range(9, 14)]] = True
_COEF = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _R and of its inverse, as far as the longest piece so far needs."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((_R, _INVERSE)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            _powers[k] = p
    return _powers[0], _powers[1]


def _hashes(raw: bytes) -> np.ndarray:
    return _hashes_and_starts(raw)[0]


def _hashes_and_starts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, np.uint8)
    word = np.zeros(len(b) + 2, bool)
    np.logical_not(_ISWHITE[b], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _power(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b + np.uint64(1)) * up[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def _long_word(raw: memoryview) -> np.ndarray:
    """The hash of one word, a piece at a time."""
    total, up = 0, _power(PIECE)[0]
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw[at : at + PIECE], np.uint8)
        total += int(((b + np.uint64(1)) * up[: len(b)]).sum(dtype=np.uint64)) * pow(_R, at, 1 << 64)
    return mix(np.array([(total + len(raw)) % (1 << 64)], np.uint64))


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word, in order; texts are hashed in pieces of bounded size, cut between words."""
    raw = _raw(text)
    if len(raw) <= PIECE:
        return _hashes(raw)
    out, at, view = [], 0, memoryview(raw)
    while at < len(raw):
        found = _WHITE.search(raw, at + PIECE)
        end = found.start() if found else len(raw)
        # the last word of the piece may be longer than the piece itself
        last = max(raw.rfind(bytes([c]), at, end) for c in WHITE) + 1
        if end - max(at, last) > PIECE:
            cut = max(at, last)
            out += [_hashes(raw[at:cut]), _long_word(view[cut:end])]
        else:
            out.append(_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


def hashes_of_texts(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """word_hashes() of all texts, in runs of short ones: (the hashes of a run's texts one after another, how many each text has)."""

    def together(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hashes, start = _hashes_and_starts(b"\n".join(run))
        ends = np.cumsum([len(x) + 1 for x in run])
        return hashes, np.diff(np.searchsorted(start, ends), prepend=0)

    run, size = [], 0
    for t in texts:
        raw = _raw(t)
        if run and size + len(raw) > GROUP:
            yield together(run)
            run, size = [], 0
        if len(raw) > GROUP:
            h = word_hashes(t)
            yield h, np.array([len(h)])
        else:
            run.append(raw)
            size += len(raw) + 1
    if run:
        yield together(run)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; none without words."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    if n < WORDS:
        total = np.array([n], np.uint64)
        for i in range(n):
            total = mix(total * _COEF[0] + w[i : i + 1])
        return total
    out = np.zeros(n - WORDS + 1, np.uint64)
    for i in range(WORDS):
        out += w[i : i + len(out)] * _COEF[i]
    return np.unique(mix(out))
