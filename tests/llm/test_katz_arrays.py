"""Arrays of the language model: packing, sorting and hashing against plain NumPy, and what packing costs."""

import time

import numpy as np
import pytest

from darkroom.llm import katz
from darkroom.llm.shingles import GROUP, hashes_of_texts, word_hashes


@pytest.mark.parametrize("kind", ["i8", "u8", "i4", "u4", "u2", "u1", "f8", "?"])
def test_packed_arrays_come_back(kind):
    rng = np.random.default_rng(1)
    some = [np.zeros(0), np.zeros(3), np.ones(1), rng.integers(0, 100, 1000), rng.integers(0, 2, 77)]
    if kind in "i8 u8 i4 u4":
        top = np.iinfo(kind)
        some += [np.array([top.min, top.max, 0], kind), np.array([top.max], kind), np.array([255, 256, 65535, 65536, 1 << 24]), np.arange(40)[::3]]
    if kind[0] == "i":
        some.append(np.array([-1, -128, 129, -40000]))
    if kind == "f8":
        some.append(np.array([np.nan, -0.0, np.inf, 1e-300, 0.1]))
    parts = [x.astype(kind) for x in some]
    back = katz._unpack(katz._pack(*parts))
    assert [x.dtype for x in back] == [x.dtype for x in parts]
    assert all(x.tobytes() == y.tobytes() for x, y in zip(back, parts, strict=True))


def test_packing_takes_less_than_half_a_transpose_of_the_bytes():
    x = np.repeat(np.arange(40_000), 25)

    def seconds(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(lambda: katz._unpack(katz._pack(x))) < 0.4 * seconds(lambda: x.view(np.uint8).reshape(-1, 8).T.tobytes())


@pytest.mark.parametrize("top", [1, 50, 1 << 30, (1 << 62) + 5])
def test_distinct_numbers_as_numpy_finds_them(top):
    x = np.random.default_rng(2).integers(0, top, 5000)
    x = np.append(x, x[:100])
    for got, want in zip(katz._distinct(x), np.unique(x, return_index=True, return_inverse=True, return_counts=True), strict=True):
        assert (got == want).all()


def test_distinct_hashes_whose_high_bits_are_equal():
    rng = np.random.default_rng(3)
    for x in (rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), rng.integers(0, 100, 5000).astype(np.uint64), np.zeros(0, np.uint64)):
        x = np.append(x, x[:50])
        for got, want in zip(katz._distinct_hashes(x), np.unique(x, return_inverse=True), strict=True):
            assert (got == want).all()


@pytest.mark.parametrize("tops", [(10, 10), (1 << 20, 1 << 24), (1 << 40, 1 << 20), (1 << 40, 1 << 60)])
def test_order_of_two_columns(tops):
    a, b = (np.random.default_rng(4).integers(0, t, 3000) for t in tops)
    a[1500:] = a[:1500]
    order = katz._order(a, b)
    want = np.lexsort((b, a))
    assert sorted(order) == list(range(3000)) and (a[order] == a[want]).all() and (b[order] == b[want]).all()


def test_texts_hashed_together_are_hashed_as_alone():
    texts = ["", None, " ", "One two", "two ", " \n", "ÄÖ one\ttwo\x0bthree", "a", "x" * (GROUP + 10), "w " * GROUP, "end", "lone \ud800 surrogate", None, "z y " * (GROUP // 5), "z y " * (GROUP // 5)]
    hashes, counts = zip(*hashes_of_texts(texts), strict=True)
    want = [word_hashes(t) for t in texts]
    assert np.concatenate(counts).tolist() == [len(x) for x in want]
    assert (np.concatenate(hashes) == np.concatenate(want)).all()
    assert list(hashes_of_texts([])) == []


def test_many_slices_packed_at_once_come_back_and_cost_little():
    rng = np.random.default_rng(5)
    x = np.sort(rng.integers(0, 1 << 40, 40_000))
    cut = np.append(0, np.sort(rng.integers(0, len(x), 3999)))
    cut = np.append(cut, len(x))
    others = [(rng.integers(-300, 300, len(x)).astype(np.int32), cut), (x > 5, cut), (np.zeros(0), np.zeros_like(cut))]
    parts = [(katz._steps(x, cut[:-1][np.diff(cut) > 0].tolist() + [len(x)]), cut), *others]

    def seconds(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    blobs = katz._packed(*parts)
    arrays, sizes = katz._unpacked(blobs)
    assert len(blobs) == 4000 and all((s == np.diff(c)).all() for s, (_, c) in zip(sizes, parts, strict=True))
    assert (katz._summed(arrays[0], sizes[0]) == x).all()
    assert all(a.dtype == b.dtype and (a == b).all() for a, (b, _) in zip(arrays, parts, strict=True))
    one = lambda: [katz._unpack(katz._pack(*(p[c[i] : c[i + 1]] for p, c in parts))) for i in range(4000)]
    assert seconds(lambda: katz._unpacked(katz._packed(*parts))) < 0.3 * seconds(one)


def test_slices_of_blocks_with_other_types_are_unpacked_together():
    several = [np.array([1, 2, 1 << 20]), np.array([-7, 3]), np.array([5], np.int32), np.zeros(0, np.int64)]
    (got,), (sizes,) = katz._unpacked([katz._pack(x) for x in several])
    assert got.dtype == np.int64 and got.tolist() == [1, 2, 1 << 20, -7, 3, 5] and sizes.tolist() == [3, 2, 1, 0]
