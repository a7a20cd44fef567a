"""Merkle manifests, main text and collocations against plain versions, with odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from darkroom.llm import collocations, main_text, merkle
from tests.llm.test_texts import empty

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """(root, proof of each node as lists of (before, after)) by plain loops."""
    proofs, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        runs = [now[i : i + 16] for i in range(0, len(now), 16)]
        for i in range(len(nodes)):
            run, j = runs[at[i] // 16], at[i] % 16
            proofs[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            at[i] //= 16
        now = [h("".join(r)) for r in runs]
    return now[0], proofs


FIELDS = ("doc_id", "source", "text")


def plain_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17}, {"a": 300, None: 5, "": 2, "é": 1, "z": 33}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_equals_plain_loops(spark, sizes):
    rows = [(n * 7 % 1009, s, f"text {n} of {s}") for s, k in sizes.items() for n in range(k)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"leaf": F.lit(1), "grp": F.lit(2), "key": F.lit(3), "n": F.lit(4)})
    got = {r.key: r for r in merkle.manifest(df, "doc_id", "source", FIELDS).withColumn("key", F.concat_ws("|", "key", "group")).withColumn("back", merkle.folded(F.col("leaf"), F.col("proof"))).collect()}
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([plain_leaf(r) for r in sorted(groups[s])]) for s in order}
    root, tops = plain_tree([trees[s][0] for s in order])
    for s, top in zip(order, tops, strict=True):
        for r, proof in zip(sorted(groups[s]), trees[s][1], strict=True):
            g = got.pop("|".join(str(x) for x in (r[0], s) if x is not None))
            assert (g.leaf, g.subroot, g.root, g.back) == (plain_leaf(r), trees[s][0], root, root)
            assert [(x.before, x.after) for x in g.proof] == proof + top
    assert not got


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None), (None, None, None), (5, "a", ""), (5, "a", None), (5, "a", ""), (6, "a", "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = merkle.manifest(df, "doc_id", "source", FIELDS, F.when(F.col("doc_id") == 6, F.lit("f" * 64))).withColumn("back", merkle.folded(F.coalesce("forged", "leaf"), F.col("proof"))).collect()
    assert len(got) == len(rows) and len({r.root for r in got}) == 1
    assert all((r.back == r.root) == (r.key != 6) for r in got)
    assert {r.leaf for r in got if r.key is None} == {plain_leaf((None, None, None))}
    assert merkle.manifest(empty(spark, "doc_id long, source string, text string"), "doc_id", "source", FIELDS).count() == 0


PAGE = """<!DOCTYPE html><html class="no-js"><head><title>T &amp; t</title><style>p{}</style><script>if (a < b) document.write("<p>no</p>")</script></head><body class="has-sidebar">
<div class="cookieNotice">We use cookies, a great many of them, and this sentence is long enough for a surge.</div><header><a href="/">Site</a></header>
<nav><ul><li><a href=/a>Menu</a></ul></nav><!-- <p>not this</p> --><ARTICLE><h1>A &lt;Title&gt;</h1><p><b>First\n paragraph<br>goes   on<p>Short.</p><div class='ad'>Buy</div><form><input name=q>Search</form>
<p>Tail&nbsp;&eacute;&#233;&#xe9; &amp</article><aside>Aside</aside><section id="comments"><article>Nice post, which is a comment and goes on for quite a while so that it would count.</article></section><footer>&copy; me"""


def test_main_text_of_marked_articles():
    assert main_text.main_text(PAGE) == "A <Title>\nFirst paragraph goes on\nShort.\nTail ééé &"
    assert main_text.main_text(PAGE.replace("ARTICLE", "main").replace("</article><aside>", "</main><aside>")) == main_text.main_text(PAGE)


LONG = "A paragraph with quite some words in it, enough of them for a surge of text to be seen here."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<script>only</script>", ""), ("<p>a<p>b", "a\nb"), ("<p>x<!-- never closed", "x"), ("a < b && c > d", "a < b && c > d"),
        ("<p>&lt;b&gt; &amp;lt;</p>", "<b> &lt;"), ('<p title="a>b">c</p>', "c"), ("<article></article><p>rest</p>", "rest"), ("<article><p>kept</article><footer>f</footer>", "kept"),
        (f"<div id=top-menu><a>x</a></div><div class=content><h2>T</h2><div class=ad>no</div><p>{LONG}</p><p>s</p></div><div class=sidebar><p>{LONG}</p></div>", f"T\n{LONG}\ns"),
        (f"<div><a>one</a> <a>two</a></div><div></div><div><p>{LONG}</p></div><div><div></div></div><div><p>small print</p></div>", LONG),
        (f"<div class=sidebar><article><p>{LONG}</p></article></div>", LONG), (f"<form><main><p>{LONG}</p></main></form>", LONG), (f"<div class=header><p>{LONG}</p></div>", LONG),
        (f"<article><p>{LONG}</p><div class=comments><p>{LONG}</p></div><div role=navigation>n</div><p hidden>h</p></article>", LONG),
    ],
)
def test_main_text_of_small_pages(page, text):
    assert main_text.main_text(page) == text


def test_bodies_lie_between_surge_and_dive():
    rng = random.Random(1)
    for _ in range(300):
        lengths = [rng.choice([0, 0, 1, 5]) for _ in range(rng.randrange(30))]
        want, i = [], 0
        while i < len(lengths):
            if lengths[i]:
                end = i + 1
                while any(lengths[end : end + main_text.WINDOW]):
                    end += 1 + next(j for j, x in enumerate(lengths[end:]) if x)
                want.append((i, end))
                i = end
            i += 1
        assert main_text.bodies(np.array(lengths, np.int64)) == want


@pytest.mark.parametrize("page", ["<a " * 50_000, "<p>" * 50_000, "<b>" * 50_000 + "<hr>" * 50_000, "<!--" * 50_000, "<script>" * 50_000, '<a b="' * 50_000, "<li><td><p><b>" * 20_000, "<article><form>" * 20_000, "&" * 100_000])
def test_main_text_of_broken_pages_ends_soon(page):
    main_text.main_text(page)


def test_extract_on_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, "k"), (None, "u", "<p>a", "k"), (2**60 + 1, "u", PAGE, "k"), (2**60 + 1, "u", PAGE, "k")], "page_id long, url string, html string, text string")
    got = main_text.extract(rows, "page_id", "url", "html").collect()
    n = len(main_text.main_text(PAGE))
    assert sorted(((r.key or 0, r.n_chars) for r in got)) == [(0, 1), (1, 0), (2**60 + 1, n), (2**60 + 1, n)]
    assert main_text.extract(empty(spark, "page_id long, url string, html string"), "page_id", "url", "html").count() == 0


def plain_collocations(docs, longest, least, share, most):
    count, out = collections.defaultdict(collections.Counter), []
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang or "und"][tuple(w[i : i + k])] += 1
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most])]
    return sorted(out)


@pytest.mark.parametrize("size, longest, most", [(1 << 20, 3, 2000), (7, 3, 2000), (16, 4, 5), (64, 2, 3)])
def test_collocations_equal_plain_counts(spark, size, longest, most):
    rng = random.Random(7)
    words = "a a a b b C c d e É 漢 x-y".split()
    docs = [(rng.choice(["en", "en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",,"]) for _ in range(rng.randrange(60)))) for _ in range(60)]
    docs += [("en", None), ("en", ""), ("fr", "."), ("fr", "one"), ("en", "p q r " * 40), ("en", "p q r " * 40), (None, "\x00 nul \x00 nul" * 12)]
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({"phrase": F.lit(1), "n": F.lit(2), "words": F.lit(3)}).repartition(3)
    got = collocations.collocations(df, "lang", "text", longest, 3, 50, most, size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(docs, longest, 3, 50, most)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(empty(spark), "extra", "text").count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_037_000_501, 9_000_000_001, 5_000_000_003
    found = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, left), ("en", "y", 1, right)], "lang string, phrase string, words int, n long")
    assert collocations.scored(found).first().score == 10**6 * a * a // (left * right)


def test_bitmaps_extend_across_blocks():
    places = np.array([1, 2] * 20 + [0] + [2, 1] * 3, np.int64)
    shard = collocations.Shard(pa.array([b"", b"a", b"b"], pa.binary()), np.zeros(3, np.uint64), places, len(places))
    got = {(int(p[0]), int(p[1])): int(n) for path, n in collocations.mined(shard, "en", 2, []) for p, n in zip(path, n, strict=True)}
    assert got == {(1, 2): 22, (2, 1): 22}
