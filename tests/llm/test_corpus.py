"""Language model, tiling, near duplicates, suffix removal and the pipeline against brute force, with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.llm import catalogue, decontaminate, katz, minhash, shingles, suffix_dedup
from darkroom.llm.components import components
from tests.comparing import connect, same
from tests.llm.test_texts import DOCS, ODD, empty, odd, plain_verdicts, slow_stats

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, name):
    same(catalogue.queries()[name](spark, SF), connect(SF), catalogue.oracle_sql()[name])


def model(token_lists):
    """(counts by order, tokens, p(u, v, w)) of a trigram model by plain recursion."""
    count = [collections.Counter() for _ in range(4)]
    for w in token_lists:
        p = ["<s>", "<s>", *w]
        for i in range(2, len(p)):
            for n in (1, 2, 3):
                count[n][tuple(p[i - n + 1 : i + 1])] += 1
    d = [None]
    for n in (1, 2, 3):
        seen = collections.Counter(count[n].values())
        d.append(katz.discounts([seen[r] for r in range(1, katz.K + 2)]))
    scale = lambda n, c: d[n][c - 1] if c <= katz.K else 1.0
    after = collections.defaultdict(dict)
    for n in (2, 3):
        for g, c in count[n].items():
            after[g[:-1]][g[-1]] = c
    total = sum(count[1].values())
    freed = sum((1 - scale(1, c)) * c for c in count[1].values())
    size, unknown = (total, freed / total) if freed else (total + 1, 1 / (total + 1))
    known = {}

    def p(h, w):
        if not h:
            c = count[1][(w,)]
            return scale(1, c) * c / size if c else unknown
        n, f = len(h) + 1, after.get(h)
        if f is None:
            return p(h[1:], w)
        if h not in known:
            m, free = sum(f.values()), sum((1 - scale(n, c)) * c for c in f.values())
            if all(c > katz.K for c in f.values()):
                m, free = m + 1, 1
            known[h] = free / m / (1 - sum(p(h[1:], x) for x in f)), m
        alpha, m = known[h]
        c = f.get(w, 0)
        return scale(n, c) * c / m if c else alpha * p(h[1:], w)

    return count, total, lambda u, v, w: p((u, v), w)


def text_score(p, w):
    w = ["<s>", "<s>", *w]
    return sum(math.log10(p(*w[i - 2 : i + 1])) for i in range(2, len(w)))


def test_katz_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    tokens = {k: [*words(t), "</s>"] for k, t in docs}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in docs}
    count, total, p = model([w for k, w in tokens.items() if not held[k]])
    vocabulary = [w for (w,) in count[1]]
    for u, v in (("<s>", "<s>"), ("<s>", "the"), next(iter(count[2])), ("never seen", "the"), ("the", "never seen")):
        assert sum(p(u, v, w) for w in vocabulary) + p(u, v, "unknown") == pytest.approx(1, abs=1e-9)
    got = {r.doc_id: r for r in catalogue.op3_katz(spark, SF).collect()}
    assert set(got) == set(tokens)
    for k, w in tokens.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w), sum(count[1][x,] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[1][x,] + 1) / (total + len(vocabulary) + 1)) for x in w))
        assert r.score == pytest.approx(text_score(p, w), rel=1e-9)


@pytest.mark.parametrize("ranges", [1, 60])
def test_katz_deals_hot_histories_and_scores_new_texts_from_stored_tables(spark, tmp_path, ranges):
    """Of 60 ranges most histories are hot, so that their sums and alphas come from several ranges."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("a a a b b c d e f g".split()) for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, _, p = model([[*words(t), "</s>"] for i, t in enumerate(texts) if i % 5])
    scores, m = katz.fit_and_score(rows, "doc_id", "text", F.col("doc_id") % 5 == 0, ranges)
    for r in scores.collect():
        assert r.score == pytest.approx(text_score(p, [*words(texts[r.id]), "</s>"]), rel=1e-9)
    katz.saved(m, f"file://{tmp_path}/model")
    new = ["a b zz c", "", "g g g g zz zz", "a a b b c"]
    m = katz.loaded(spark, f"file://{tmp_path}/model")
    got = katz.score(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), "doc_id", "text", m).collect()
    for r in got:
        assert r.score == pytest.approx(text_score(p, [*words(new[r.id]), "</s>"]), rel=1e-9)
    # stored weights: over the words seen after a history, and the weight of all others, probabilities sum to 1
    lower = {(r.v, r.w): r.p for r in katz.grams(m.bigrams).collect()}
    top, alpha = collections.defaultdict(dict), {}
    for r in katz.grams(m.trigrams).collect():
        top[r.u, r.v][r.w] = r.p
    for r in katz.histories(m.trigrams).collect():
        assert alpha.setdefault((r.u, r.v), r.alpha) == r.alpha
    first = m.unigrams.unknown + 1
    assert set(alpha) == set(top) and len(top) > 20
    for (u, v), seen in top.items():
        rest = 1 - sum(lower[v, w] for w in seen)
        assert sum(seen.values()) + alpha[u, v] * rest == pytest.approx(1, abs=1e-9) and (u != first or v == first or (first, v) in lower)


def test_katz_on_odd_rows(spark):
    scores, m = katz.fit_and_score(odd(spark), "doc_id", "text", F.col("doc_id") == 5)
    got = scores.collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) for r in got)
    assert sum(r.held_out for r in got) == 2 and {r.n_tokens for r in got if r.id in (1, 2, 3)} == {1}
    for table in (m.bigrams, m.trigrams):
        assert katz.grams(table).select(F.sum("count")).first()[0] == got[0].train_tokens
    nothing, _ = katz.fit_and_score(odd(spark), "doc_id", "text", F.lit(True))
    assert {r.score for r in nothing.collect()} == {0.0}
    assert katz.fit_and_score(empty(spark), "doc_id", "text", F.lit(False))[0].count() == 0


def slow_tiles(doc, item, least):
    taken_d, taken_i, tiles = set(), set(), []
    while True:
        best, found = least, []
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in taken_d and i + n not in taken_i:
                    n += 1
                if n > best:
                    best, found = n, [(d, i)]
                elif n == best:
                    found.append((d, i))
        if not found:
            return sorted(tiles)
        for d, i in found:
            if not (taken_d & set(range(d, d + best)) or taken_i & set(range(i, i + best))):
                taken_d |= set(range(d, d + best))
                taken_i |= set(range(i, i + best))
                tiles.append((d, i, best))


def test_tiles_cover_as_much_as_slow_ones():
    rng = random.Random(2)
    for _ in range(200):
        doc, item = ([rng.randrange(4) for _ in range(rng.randrange(0, 40))] for _ in range(2))
        got = decontaminate.tile(doc, item, 3, 6)
        spots = [x for d, _, n in got for x in range(d, d + n)]
        assert len(spots) == len(set(spots)) and all(doc[d : d + n] == item[i : i + n] and n >= 3 for d, i, n in got)
        # equally long matches may be taken in another order, so what is covered may differ a little, but nothing free is left
        rest_d = [x if k not in spots else -1 - k for k, x in enumerate(doc)]
        marked = {x for _, i, n in got for x in range(i, i + n)}
        rest_i = [x if k not in marked else -100 - k for k, x in enumerate(item)]
        assert slow_tiles(rest_d, rest_i, 3) == []


def test_reordered_passages_are_found_and_clean_ones_left(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    w = item.split()
    docs = spark.createDataFrame([(1, f"x {item.upper()}, y"), (2, " ".join(w[7:] + ["z"] + w[:7])), (3, " ".join(w[::2])), (4, None), (5, ""), (None, item), (6, " ".join(w[:5])), (7, f"{item} " * 5000), (1, f"x {item.upper()}, y"), (8, "is it too Short? yes"), (9, "too, very short")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "too short"), (13, item), (14, "?!"), (15, "yes")], "item_id long, text string")
    got = decontaminate.contaminated(docs, "doc_id", "text", bench, "item_id", "text").collect()
    assert collections.Counter((r.key, r.item) for r in got) == collections.Counter({(k, i): n for i in (10, 13) for k, n in ((1, 2), (2, 1), (None, 1), (7, 1))} | {(8, 12): 1, (8, 15): 1})
    assert {r.coverage for r in got} == {1.0}
    assert sorted(r.doc_id or 0 for r in decontaminate.remove(docs, "doc_id", "text", bench, "item_id", "text").collect()) == [3, 4, 5, 6, 9]
    assert decontaminate.contaminated(docs, "doc_id", "text", bench.limit(0), "item_id", "text").count() == 0
    assert decontaminate.contaminated(docs.limit(0), "doc_id", "text", bench, "item_id", "text").count() == 0


def test_frequent_seeds_make_no_pairs():
    times = np.array([900, 900, 900, 3, 1, 1, 1, 1, 1, 1, 1, 1])
    kept = decontaminate.indexed(16, times, 0.5)
    assert not {0, 1, 2} & set(kept.tolist()) and set(range(4, 12)) <= set(kept.tolist())
    # whatever is left out covers less than half
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 30)
        times = np.array([rng.randrange(1, 50) for _ in range(max(1, n - 4))])
        out = set(range(len(times))) - set(decontaminate.indexed(n, times, 0.5).tolist())
        assert len({j for i in out for j in range(i, i + min(5, n))}) < 0.5 * n


def plain_tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def slow_contaminated(docs, bench):
    """(doc, item) -> share of the item that plain greedy tiles cover, of pairs with enough common runs of five tokens."""
    out = {}
    for k, text in docs:
        w = plain_tokens(text)
        runs = collections.defaultdict(list)
        for i in range(len(w) - 4):
            runs[tuple(w[i : i + 5])].append(i)
        for i, item in bench:
            if len(item) < 5:
                if any(w[j : j + len(item)] == item for j in range(len(w) - len(item) + 1)) and item:
                    out[k, i] = 1.0
                continue
            hits = [j for j in range(len(item) - 4) if tuple(item[j : j + 5]) in runs]
            if len({x for j in hits for x in range(j, j + 5)}) < 0.3 * len(item):
                continue
            spots = sorted({x for j in hits for p in runs[tuple(item[j : j + 5])] for x in range(p, p + 5)})
            part = []
            for n, x in enumerate(spots):
                part += ["|"] if n and x > spots[n - 1] + 1 else []
                part.append(w[x])
            if len(part) < 400:
                out[k, i] = sum(n for _, _, n in slow_tiles(part, item, 5)) / len(item)
            else:
                out[k, i] = None
    return out


def test_decontamination_query(spark):
    """All documents against all items, both ways: what a plain version finds and what it leaves."""
    bench = [(r.item_id, plain_tokens(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = slow_contaminated(docs, bench)
    got = {(r.doc_id, r.item_id): r for r in catalogue.op4_decontaminate(spark, SF).collect()}
    assert set(got) <= set(want) and sum(s == 1 for s in want.values()) > 2
    # parts of items in another order, and too small parts, within long texts
    rng = random.Random(7)
    mixed = []
    for n, (_, w) in enumerate(bench):
        cuts = sorted(rng.sample(range(1, len(w)), 3)) if len(w) > 8 else []
        parts = [w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)])]
        rng.shuffle(parts)
        mixed.append((10_000 + n, f" odd{n} ".join(" ".join(p) for p in parts[: rng.randrange(1, 5)])))
    rows = spark.createDataFrame(mixed, "doc_id long, text string")
    want |= slow_contaminated(mixed, bench)
    found = decontaminate.contaminated(rows, "doc_id", "text", spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text").collect()
    got |= {(r.key, r.item): r for r in found}
    assert sum(r.coverage < 1 for r in found) > 3
    for pair, share in want.items():
        if share is not None and abs(share - 0.5) > 0.1:
            assert (pair in got) == (share > 0.5), (pair, share)
        if share == 1:
            assert got[pair].covered == got[pair].item_tokens


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(50)] + [(7, 7)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for e in edges for x in e if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"v{i}{rng.randrange(5000)}"
        out.append(" ".join(w))
    return out


def test_groups_equal_all_pairs(spark):
    texts = near_copies(40, 1) + near_copies(30, 2) + near_copies(5, 3)[:1] * 20 + ["a b", "A  b", "b a", "", None, "one two three four five", "x" * 100_000]
    rows = spark.createDataFrame([(1000 - 7 * i, t, "e") for i, t in enumerate(texts)] + [(None, "a b", "e"), (None, None, "e")], DOCS)
    sets = {1000 - 7 * i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in enumerate(texts)}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = minhash.group(rows, "doc_id", "text").collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.id]), find(r.id), find(r.id) == r.id)
    assert minhash.group(rows.limit(0), "doc_id", "text").count() == 0
    assert minhash.deduplicated(rows, "doc_id", "text").where("doc_id IS NOT NULL").count() == len({find(x) for x in sets})


def block_tests(groups, so_far):
    """minhash.blocked() of groups(node, component) and their smallest members, with sets of a few bytes."""
    members = groups.unionByName(groups.select("component", F.col("component").alias("node")).distinct()).select(F.col("component").cast("string").alias("of"), F.col("node").alias("id"))
    return minhash.blocked(members, so_far, members.select("id", F.lit(8).alias("bytes")).distinct())


def test_outliers_cost_no_square(spark):
    """Near copies in one component are compared with the few that remain apart, not with each other."""
    n = 5000
    groups = spark.range(1, n + 3).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component"))
    so_far = spark.range(1, n).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component"))
    sides = block_tests(groups, so_far).groupBy("test").pivot("side", ["A", "B", "S"]).count().na.fill(0)
    compared = sides.select(F.sum(F.col("A") * F.col("B") + F.col("S") * F.col("S"))).first()[0]
    # the three that are apart meet each of the others once, and each other
    assert compared <= 3 * n + 9


def test_blocks_pair_different_components_only(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 3)
    groups = [(0, i) for i in range(1, 12)] + [(20, 21), (20, 22)]
    label = {i: 0 for i in range(8)} | {8: 8, 9: 9, 10: 9, 11: 9, 20: 20, 21: 20, 22: 20}
    rows = spark.createDataFrame([(n, g) for g, n in groups], "node long, component long")
    tests = collections.defaultdict(lambda: collections.defaultdict(set))
    for r in block_tests(rows, spark.createDataFrame([(n, c) for n, c in label.items() if n != c], "node long, component long")).collect():
        tests[r.test][r.side].add(r.id)
    met = set()
    for sides in tests.values():
        a, b = (sides["S"], sides["S"]) if sides["S"] else (sides["A"], sides["B"])
        met |= {(min(i, j), max(i, j)) for i in a for j in b if i != j}
    need = {(i, j) for i in range(12) for j in range(i + 1, 12) if label[i] != label[j]}
    assert need <= met and not {x for x in met if max(x) >= 20}
    assert not {(i, j) for i, j in met if label[i] == label[j] == 0}


def test_repeated_ids_are_one_node(spark):
    a, b, c = "one two three four five six seven", "quite another text of seven words here", "a third text that is like no other one"
    rows = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (7, c), (9, b), (None, b)], "doc_id long, text string")
    got = minhash.group(rows, "doc_id", "text").collect()
    assert sorted((r.id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (3, 3, True), (5, 3, False), (5, 3, False), (5, 3, False), (7, 7, True), (9, 3, False)]
    assert sorted((r.doc_id or 0) for r in minhash.deduplicated(rows, "doc_id", "text").collect()) == [0, 3, 7]
    alone = rows.where("doc_id = 5").unionByName(rows.where("doc_id = 7"))
    assert sorted(r.doc_id for r in minhash.deduplicated(alone, "doc_id", "text").collect()) == [5, 7]


def test_estimates_and_kernels(spark):
    a, b = (shingles.shingles(t) for t in near_copies(2, 9))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    row = spark.createDataFrame([(minhash.packed(minhash.minima(a)).tolist(), minhash.packed(minhash.minima(b)).tolist())], "a array<long>, b array<long>")
    assert row.select(minhash.estimate("a", "b").alias("e")).first().e == pytest.approx(true, abs=0.2)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(30)]
    i, j = minhash.linked(sets[:15], sets[15:], 40, columns=7)
    want = {(x, y) for x in range(15) for y in range(15) if (k := len(np.intersect1d(sets[x], sets[15 + y]))) and 100 * k >= 40 * len(np.union1d(sets[x], sets[15 + y]))}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab  \n\té") for _ in range(n)) for n in (10, 63, 64, 65, 500)] + ["x" * 300, " " * 200 + "y" * 200, "ab " * 30 + "z" * 130 + " q", "z" * 65]
    want = [shingles.word_hashes(t).tolist() for t in texts]
    monkeypatch.setattr(shingles, "PIECE", 64)
    assert [shingles.word_hashes(t).tolist() for t in texts] == want
    assert [len(w) for w in want] == [len(words(t)) for t in texts]


def slow_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    want = collections.Counter()
    for b in raw:
        m = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                m[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(b, m) if not y)
        want[len(b), sum(m), sum(m[i] and (not i or not m[i - 1]) for i in range(len(m))), hashlib.sha256(kept).hexdigest()] += 1
    return want


def test_repeats_equal_brute_force(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abc é\n") for _ in range(3000))
    texts = [base[i : i + rng.randrange(100, 900)] + rng.choice(["", "zz\0", "q"]) for i in (rng.randrange(2500) for _ in range(30))] + ["ab" * 400, "ab" * 90, None, "", base[:250], base[:250], "x" * 199, "y" * 200, "y" * 100 + "z" * 100]
    rows = spark.createDataFrame([(i if i % 9 else None, t, "e") for i, t in enumerate(texts)], DOCS)
    want = slow_repeats(texts)
    got = suffix_dedup.remove_repeats(rows, "doc_id", "text").collect()
    assert collections.Counter((r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.remove_repeats(rows.limit(0), "doc_id", "text").count() == 0


def test_splitters_part_no_partners(spark):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = next(p for p in iter(lambda: some(200), "") if suffix_dedup.anchors(p.encode())[0][0] >= 175)
    # what follows the anchor differs early, so longer splitters would fall between the copies
    texts = [some(300) + passage + some(300) for _ in range(40)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], DOCS), "doc_id", "text").collect()
    assert collections.Counter((r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), r.kept_sha256) for r in got) == slow_repeats(texts)


def spans_of(texts, hot=(), ranges=3):
    """Spans by text, of all grams dealt as given, without Spark."""
    first = sorted({t[i : i + suffix_dedup.GRAM] for t in texts for _, t in suffix_dedup.pieces(t) for i in suffix_dedup.anchors(t)[0]})
    how = suffix_dedup.Dealing(np.array(first[:: max(1, len(first) // ranges)][1:ranges], f"S{suffix_dedup.GRAM}"), np.array(first if hot == "all" else list(hot), f"S{suffix_dedup.GRAM}"), ranges)
    exchanged, found = collections.defaultdict(list), collections.defaultdict(list)

    def put(names, spans):
        for (a, _), (x, z) in zip(names.tolist(), spans.tolist()):
            found[a].append((x, z))

    for at in range(0, len(texts), 7):
        made, names, spans = suffix_dedup.runs([((at + k, 0), o, p) for k, t in enumerate(texts[at : at + 7]) for o, p in suffix_dedup.pieces(t)], how)
        put(names, spans)
        for r, blob in made:
            exchanged[r].append(blob)
    for r, blobs in exchanged.items():
        put(*suffix_dedup.repeats(blobs, *(suffix_dedup.INTERVALS[r // ranges - 1] if r >= ranges else (0, suffix_dedup.LEFT))))
    return [suffix_dedup.united(found[k]) for k in range(len(texts))]


@pytest.mark.parametrize("hot", [(), "all"])
@pytest.mark.parametrize("piece", [100, 1 << 20])
def test_hot_grams_and_pieces_lose_no_partner(monkeypatch, hot, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(9)
    some = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    shared = [some(n) for n in (199, 200, 201, 260, 420, 700)]
    texts = [some(rng.randrange(0, 300)) + rng.choice(shared) + some(rng.randrange(0, 300)) + rng.choice([b"", shared[4][50:300]]) for _ in range(40)] + [b"ab" * 300, b"x" * 450, b"", shared[3]]
    count = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = [suffix_dedup.united([(i, i + 200) for i in range(len(t) - 199) if count[t[i : i + 200]] > 1]) for t in texts]
    assert spans_of(texts, hot) == want


def test_a_shared_passage_is_dealt_over_ranges(spark):
    """Very many documents share a passage and differ around it: no range has them all."""
    rng = random.Random(10)
    some = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = some(120)
    texts = [some(200) + passage + some(200) for _ in range(400)]
    rows = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], DOCS)
    how = suffix_dedup.dealing(rows.select("text", F.col("doc_id").alias("a"), F.lit(0).alias("b")), 8, 400)
    assert 1 <= len(how.hot) <= 3
    made, _, _ = suffix_dedup.runs([((k, 0), 0, t.encode()) for k, t in enumerate(texts)], how)
    sizes = [len(suffix_dedup._unpack(blob)[0]) for r, blob in made if r >= how.ranges]
    assert sizes and max(sizes) < 0.3 * sum(sizes)
    got = suffix_dedup.remove_repeats(rows, "doc_id", "text").collect()
    assert {len(r.removed) for r in got} == {0}


def test_long_text(spark):
    """A text of many pieces that holds a passage twice."""
    rng = np.random.default_rng(3)
    body = rng.integers(97, 123, 12 << 20).astype(np.uint8).tobytes().decode()
    text = body + body[1000:1400]
    rows = spark.createDataFrame([(1, text, "e")], DOCS)
    got = suffix_dedup.remove_repeats(rows, "doc_id", "text", keep_bytes=False).first()
    assert [(s.start, s.end) for s in got.removed] == [(1000, 1400), (len(body), len(text))]


def test_loser_tree_merges_and_tells_prefixes():
    rng = random.Random(8)
    for k in (1, 2, 3, 7):
        parts = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(0, 20))) for _ in range(k)]
        common = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        lcps = [[0, *(common(a, b) for a, b in zip(p, p[1:]))] if p else [] for p in parts]
        out = list(suffix_dedup.LoserTree(parts, lcps).merged())
        strings = [parts[r][i] for r, i, _ in out]
        assert strings == sorted(s for p in parts for s in p)
        assert [h for _, _, h in out[1:]] == [common(a, b) for a, b in zip(strings, strings[1:])]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("judged", F.lit("clash"))
    odd_rows = spark.createDataFrame([(900_001, None, None, None, None, "j"), (900_002, "", "en", "s", 0, "j")], docs.schema)
    now = docs.unionByName(odd_rows)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, SF)
        if name == "quality_rules":
            failed = {r.doc_id for r in now.collect() if (s := slow_stats(r.text) if len(r.text or "") < 4000 else None) and (s[0] < 10 or 5 * s[4] > s[0])}
            assert not failed & ids(after) and len(ids(after)) > 120
        if name == "near_duplicates":
            assert ids(after) == {r.id for r in minhash.group(now, "doc_id", "text").where("kept").collect()}
        if name == "secret_scan":
            before = {r.doc_id: r.text for r in now.collect()}
            from darkroom.llm.secret_scan import replaced, scan_text

            assert {r.doc_id: r.text for r in after.collect()} == {k: replaced(t, [(a, z, kind) for kind, a, z in scan_text(t)]) for k, t in before.items()}
        if name != "bpe":
            assert after.columns == now.columns
            now = spark.createDataFrame(after.collect(), after.schema)
        else:
            assert ids(after) == ids(now)


def test_pipeline_equals_plain_version(spark):
    """run() against five plain stages: the learned list row by row, all pairs of sets, plain tiles, replaced spans, and the tokenizers library."""
    import corpus_pipeline
    from darkroom.llm import quality_rules
    from darkroom.llm.secret_scan import replaced, scan_text

    tokenizers = pytest.importorskip("tokenizers")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    rules = quality_rules.learn_from(table, spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "text", "quality")
    kept = sorted(k for k, (_, _, ok) in plain_verdicts(docs, rules).items() if ok)
    sets = {k: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(docs[k])) else set() for k in kept}
    first = {k: k for k in kept}
    for n, a in enumerate(kept):
        for b in kept[n + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k) and first[a] != first[b]:
                low, high = sorted((first[a], first[b]))
                first = {x: low if c == high else c for x, c in first.items()}
    kept = [k for k in kept if first[k] == k]
    bench = [(r.item_id, plain_tokens(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    worst = collections.defaultdict(float)
    unclear = set()
    for (k, _), share in slow_contaminated([(k, docs[k]) for k in kept], bench).items():
        worst[k] = max(worst[k], share or 0)
        unclear |= {k} if share is None or abs(share - 0.5) <= 0.1 else set()
    unclear = {k for k in unclear if worst[k] <= 0.6}
    t = tokenizers.Tokenizer.from_file(catalogue.word_bpe_path())
    t.no_truncation()
    t.no_padding()
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) - unclear == {k for k in kept if worst[k] <= 0.5} - unclear and len(unclear) < 5
    for k, ids in got.items():
        clean = replaced(docs[k], [(a, z, kind) for kind, a, z in scan_text(docs[k])])
        assert ids == t.encode(clean, add_special_tokens=False).ids
