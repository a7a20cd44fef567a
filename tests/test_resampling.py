"""Resampled and turned pictures against plain loops and recorded values."""

from fractions import Fraction
from math import ceil, floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.operators import images, resampling


def plain_filter(name, t):
    if name == "linear":
        return max(0.0, 1 - abs(t))
    if t == 0:
        return 1.0
    return np.sin(np.pi * t) / (np.pi * t) * np.sin(np.pi * t / 3) / (np.pi * t / 3) if -3 <= t < 3 else 0.0


def plain_line(values, out, name, length):
    """One line of pixels at another length, place by place."""
    scale = length / out
    stretch, reach, made = max(1.0, scale), {"sinc": 3, "linear": 1}[name], []
    for o in range(out):
        c = (o + 0.5) * scale
        places = range(max(0, int(c - reach * stretch + 0.5)), min(len(values), int(c + reach * stretch + 0.5)))
        w = [plain_filter(name, (i - c + 0.5) / stretch) for i in places]
        total, acc = sum(w), 1 << 21
        for i, v in zip(places, w, strict=True):
            k = v / total * (1 << 22)
            acc += int(values[i]) * int(k + (0.5 if k >= 0 else -0.5))
        made.append(min(255, max(0, acc >> 22)))
    return made


def plain_resized(x, width, height, name, box=None):
    across, down = box or (x.shape[1], x.shape[0])
    if width != x.shape[1] or across != width:
        x = np.array([plain_line(r, width, name, across) for r in x])
    if height != x.shape[0] or down != height:
        x = np.array([plain_line(c, height, name, down) for c in x.T]).T
    return x


def plain_cells(x, a, b):
    """Averages of cells of a x b, by a cut reciprocal of their size."""
    cells = [[x[i : i + b, j : j + a] for j in range(0, x.shape[1], a)] for i in range(0, x.shape[0], b)]
    return np.array([[(int(c.sum()) + c.size // 2) * int(np.float32(2**24) / np.float32(c.size)) >> 24 for c in row] for row in cells])


def quarters(n, level):
    """Two bright and two dark squares."""
    x = np.full((n, n), 255 - level, np.uint8)
    x[: n // 2, : n // 2] = x[n // 2 :, n // 2 :] = level
    return x


# fixed values: recalled from the tests of the common imaging library, which is not on this box
RECORDED = [
    (16, 8, "sinc", ["e1 e0 e4 d7", "e0 df e3 d6", "e4 e3 e7 da", "d7 d6 d9 ce"]),
    (8, 4, "linear", ["e1 c9", "c9 b7"]),
]


@pytest.mark.parametrize("n, out, name, corner", RECORDED)
def test_recorded_values(n, out, name, corner):
    got = resampling.resized(quarters(n, 0xE1), out, out, name)
    assert [" ".join(f"{v:02x}" for v in r[: out // 2]) for r in got[: out // 2]] == corner
    assert (got == got[::-1, ::-1]).all() and (got.astype(int) + got[::-1] == 255).all()


@pytest.mark.parametrize("name", ["sinc", "linear"])
@pytest.mark.parametrize("size", [(1, 1), (7, 5), (31, 32), (32, 32), (50, 11), (3, 90)])
def test_resized_equals_plain_loops(name, size):
    x = np.random.default_rng(3).integers(0, 256, (37, 41)).astype(np.uint8)
    x[:20, :9] = 255
    assert (resampling.resized(x, *size, name) == plain_resized(x, *size, name)).all()
    colour = np.stack([x, x[::-1], 255 - x], 2)
    assert all((resampling.resized(colour, *size, name)[..., c] == plain_resized(colour[..., c], *size, name)).all() for c in range(3))


@pytest.mark.parametrize("width, height, edge", [(41, 37, 8), (37, 41, 8), (100, 3, 9), (9, 9, 9), (10, 9, 9), (64, 1, 4), (90, 61, 10)])
def test_thumbnails_equal_plain_loops(width, height, edge):
    x = np.random.default_rng(width).integers(0, 256, (height, width)).astype(np.uint8)
    got = resampling.thumbnail(x, edge)
    if max(width, height) <= edge:
        assert got is x
        return
    # of the two nearest whole lengths of the short side the one whose proportions come closest
    long, short = max(width, height), min(width, height)
    side = max(1, min((floor(edge * short / long), ceil(edge * short / long)), key=lambda n: abs(Fraction(long, short) - Fraction(edge, n)) if width > height else abs(Fraction(width, height) - Fraction(n, edge))) if edge * short // long else 1)
    size = (edge, side) if width >= height else (side, edge)
    assert (got.shape[1], got.shape[0]) == size
    a, b = max(1, int(width / size[0] / 2)), max(1, int(height / size[1] / 2))
    assert (got == plain_resized(plain_cells(x, a, b), *size, "sinc", (width / a, height / b))).all()


def test_averages():
    for a, b in ((1, 2), (2, 1), (2, 2), (3, 3), (4, 5), (7, 3)):
        x = np.random.default_rng(a * b).integers(0, 256, (23, 29)).astype(np.uint8)
        got = resampling.averaged(x, a, b)
        assert (got == plain_cells(x, a, b)).all()
        means = np.array([[x[i : i + b, j : j + a].mean() for j in range(0, 29, a)] for i in range(0, 23, b)])
        assert np.abs(got - means).max() < 1
    assert (resampling.averaged(np.full((9, 9, 3), 254, np.uint8), 4, 4) == 254).all()


def test_hashes_by_plain_transform():
    rng = np.random.default_rng(11)
    for shape in ((40, 50, 3), (32, 32, 3), (9, 200, 3)):
        g = images.gray(rng.integers(0, 256, shape).astype(np.uint8))
        x = plain_resized(g, 32, 32, "sinc").astype(float)
        wave = lambda f, n: (np.sqrt(1 / 32) if f == 0 else np.sqrt(2 / 32)) * np.cos(np.pi * (2 * n + 1) * f / 64)
        low = [sum(wave(v, i) * wave(u, j) * x[i, j] for i in range(32) for j in range(32)) for v in range(8) for u in range(8)]
        middle = sorted(low[1:])[31]
        assert images.perceptual_hash(g) == f"{sum(int(c > middle) << (63 - i) for i, c in enumerate(low)):016x}"
    # one colour: all frequencies but the first are nothing
    assert images.perceptual_hash(np.full((70, 90), 77, np.uint8)) == "8000000000000000"
    assert images.perceptual_hash(np.zeros((1, 1), np.uint8)) == "0000000000000000"


def test_gray_is_whole():
    x = np.random.default_rng(2).integers(0, 256, (30, 30, 3)).astype(np.uint8)
    assert (images.gray(x) == [[(19595 * int(r) + 38470 * int(g) + 7471 * int(b) + 32768) // 65536 for r, g, b in row] for row in x]).all()


def test_upright_of_odd_pictures(spark):
    """Sizes that don't fit the bytes, nulls in any column and no rows; further columns stay, though named like those within."""
    px = bytes(range(12))
    rows = [(1, 2, 2, px, 6, "a"), (2, 2, 3, px, 6, "b"), (3, None, 2, px, 6, "c"), (4, 2, 2, None, 6, None), (5, 0, 2, b"", 6, "e"), (6, 2, 2, px, None, "f"), (7, 2, 2, px, 99, "g"), (8, 4, 1, px, 8, "h"), (9, 4, 1, px, 1, "i")]
    df = spark.createDataFrame(rows, "id int, width int, height int, pixels binary, o int, orientation string")
    got = {r.id: r for r in resampling.upright(df, F.col("o")).collect()}
    assert bytes(got[1].pixels) == bytes([6, 7, 8, 0, 1, 2, 9, 10, 11, 3, 4, 5]) and got[1].orientation == "a"
    assert all(got[i].pixels is None for i in (2, 3, 4, 5)) and (got[2].width, got[2].height, got[3].width) == (2, 3, None)
    assert bytes(got[6].pixels) == bytes(got[7].pixels) == bytes(got[9].pixels) == px
    assert (got[8].width, got[8].height, bytes(got[8].pixels)) == (1, 4, bytes([9, 10, 11, 6, 7, 8, 3, 4, 5, 0, 1, 2]))
    assert resampling.upright(df.where("id < 0"), F.col("o")).count() == 0
