"""Inputs that once crashed operators, took quadratic time or had no defined order."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.llm import chat_format, common, decontaminate, quality_rules, quality_vote, secret_scan, suffix_dedup, url_rules


def part(kind, **values):
    return {"type": kind, "text": None, "uri": None, "width": None, "height": None, "seconds": None, "pages": None} | values


def test_parts_without_defined_sizes(spark):
    parts = [None, part("audio", seconds=float("nan")), part("audio", seconds=float("inf")), part("audio", seconds=-3.0), part("audio", seconds=1e300), part("image", width=2**31 - 1, height=2**31 - 1), part("document", pages=2**31 - 1), part(None, text="a"), part("other")]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [None]), (1, 2, "assistant", None)], f"conv long, turn long, role string, content {chat_format.PARTS}")
    out = {r.turn: r for r in chat_format.format_messages(rows, "conv", "turn", "role", "content").collect()}
    assert [a.tokens for a in out[0].attachments] == [1, 1, 1, *[chat_format.MOST_TOKENS] * 3, 1]
    assert out[0].expanded_tokens == 4 + 3 * chat_format.MOST_TOKENS
    assert out[1].segment == out[2].segment == "<|assistant|>\n<|end|>\n"
    assert chat_format.read_back(chat_format.format_messages(rows, "conv", "turn", "role", "content")).first().n_turns == 3


def test_equal_turns_are_ordered_by_their_texts(spark):
    import hashlib

    texts = ["a b", "a", "a<|b", "a<", "a\\", "a]", "", "a\n", "a\\\\z", "a\\|"]
    rows = spark.createDataFrame([(1, 5, "assistant", t) for t in texts], "conv long, turn long, role string, text string").repartition(3)
    got = chat_format.read_back(chat_format.format_messages(rows, "conv", "turn", "role", "text")).first()
    ordered = sorted(texts, key=str.encode)
    assert got.loss_sha256 == hashlib.sha256("".join(ordered).encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256("".join(f"assistant\n{t}\n" for t in ordered).encode()).hexdigest()


def test_web_tokens_equal_their_pattern():
    rule = next(r for r in secret_scan.RULES if r.kind == "web_token")
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["eyJ", "abcdefgh", "x", ".", ".eyJ", "-_", " ", "ab", "."]) for _ in range(rng.randrange(25)))
        assert list(rule.find(text)) == [m.span() for m in rule.pattern.finditer(text)], text


@pytest.mark.parametrize("text", ["eyJabcdefgh" * 100_000 + ".eyJ", "eyJabcdefgh.eyJ" * 70_000, "password " * 100_000, "a://" * 200_000, "-----BEGIN " * 90_000 + "private key-----"])
def test_scans_take_linear_time(text):
    began = time.process_time()
    secret_scan.scan_text(text)
    assert time.process_time() - began < 5


def test_rule_version_follows_the_rules():
    assert secret_scan.RULE_VERSION != "1" and len(secret_scan.RULE_VERSION) == 16


def test_a_labelled_id_of_many_rows_reaches_the_driver_once(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i} " * (1 + i % 7)) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (1, 1)], "doc_id long, quality int")
    keys = labels.groupBy(F.col("doc_id").alias("_k")).agg(F.min("quality").alias("_label"))
    one = common.one_text(docs, "doc_id", "text", keys).collect()
    assert sorted((r._k, r._label) for r in one) == [(0, 1), (1, 0), (2, 1)]
    assert sorted(map(tuple, common.one_text(docs.repartition(7), "doc_id", "text", keys).collect())) == sorted(map(tuple, one))
    voters = [quality_vote.learn(d, labels, "doc_id", "text", "quality", max_labels=2) for d in (docs, docs.repartition(5))]
    assert len(voters[0].labels) == 2 and np.array_equal(voters[0].vectors, voters[1].vectors)
    assert quality_rules.learn_from(docs, labels, "doc_id", "text", "quality", max_labels=2) == quality_rules.learn_from(docs.repartition(5), labels, "doc_id", "text", "quality", max_labels=2)


def test_hosts_of_very_many_labels(spark):
    rules = spark.createDataFrame([("b.com", "/", "block"), ("x", "/", "block"), ("a.b.com", "/q", "allow")], "host string, path string, verdict string")
    long = "a." * 20_000 + "b.com"
    pages = spark.createDataFrame([(1, f"http://{long}/"), (2, f"http://{long}/q"), (3, "http://" + "." * 30_000 + "/"), (4, "http://x/"), (5, "http://com/")], "id long, url string")
    got = {r.row: (r.rule, r.verdict) for r in url_rules.judge(pages, "id", "url", rules).collect()}
    assert got == {1: ("b.com/", "block"), 2: ("a.b.com/q", "allow"), 3: (None, "allow"), 4: ("x/", "block"), 5: (None, "allow")}


def test_decontamination_goes_by_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"so {item} on", "x"), (1, "clean words only", "x"), (None, item, "y"), (None, "clean", None), (2, None, "z")], "doc_id long, text string, item string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = decontaminate.remove(docs, "doc_id", "text", bench, "item_id", "text")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "clean"), (1, "clean words only"), (2, "")]


def test_strings_whose_hashes_collide_are_kept(monkeypatch):
    """With base 1 the rolling hash is a sum of bytes, so that strings of the same bytes in another order collide."""
    monkeypatch.setattr(suffix_dedup, "BASE", 1)
    rng = random.Random(4)
    same = bytes(rng.randrange(97, 123) for _ in range(400))
    tail = bytes(rng.randrange(97, 123) for _ in range(150))
    heads = [bytes(rng.sample(same[:120], 120)) for _ in range(6)]
    texts = [same, b"<" + same + b">", *(h + tail + b"end" for h in heads)]
    how = suffix_dedup.Dealing(np.array([], f"S{suffix_dedup.GRAM}"), np.array([], f"S{suffix_dedup.GRAM}"), 1)
    blobs, found = [], set()
    for n, t in enumerate(texts):  # a block each
        made, names, spans = suffix_dedup.runs([((n, 0), 0, t)], how)
        blobs += [b for _, b in made]
        found |= {(int(a), *map(int, s)) for (a, _), s in zip(names, spans, strict=True)}
    names, spans = suffix_dedup.repeats(blobs)
    found |= {(int(a), *map(int, s)) for (a, _), s in zip(names, spans, strict=True)}
    gone = [set() for _ in texts]
    for n, a, z in found:
        gone[n] |= set(range(a, z))
    starts = [{t[i : i + 200] for i in range(len(t) - 199)} for t in texts]
    for n, t in enumerate(texts):
        want = set()
        for i in range(len(t) - 199):
            if any(t[i : i + 200] in s for m, s in enumerate(starts) if m != n):
                want |= set(range(i, i + 200))
        assert gone[n] == want
    assert len(gone[0]) == 400


def test_buckets_that_hang_together_are_compared_by_themselves(spark):
    """900 buckets of three members, each sharing one with the next, form one group of 1,801: 4.9 million tests of two members become 2,700."""
    from darkroom.llm import minhash
    from darkroom.llm.components import components

    buckets = [(b, 2 * b + k) for b in range(900) for k in range(3)] + [(5000 + b, 10_000 + k) for b in range(20) for k in range(40)]
    shared = spark.createDataFrame(buckets, "bucket long, id long")
    apart = shared.groupBy("bucket").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    groups = components(shared.join(apart, "bucket").where("id <> least"), "least", "id")
    members = minhash.loose_members(shared, apart, groups)
    of = {}
    for r in members.collect():
        of.setdefault(r.of, set()).add(r.id)
    assert of == {f"b{b}": {2 * b, 2 * b + 1, 2 * b + 2} for b in range(900)} | {"g10000": set(range(10_000, 10_040))}
    none = spark.createDataFrame([], "node long, component long")
    tests = minhash.blocked(members, none, shared.select("id").distinct().withColumn("bytes", F.lit(100))).collect()
    met = {}
    for r in tests:
        met.setdefault(r.test, set()).add(r.id)
    assert sum(len(x) * (len(x) - 1) // 2 for x in met.values()) == 900 * 3 + 40 * 39 // 2


def test_long_sets_meet_a_few_at_a_time(spark):
    from darkroom.llm import minhash

    members = spark.range(100).select(F.lit("g0").alias("of"), "id")
    none = spark.createDataFrame([], "node long, component long")
    tests = minhash.blocked(members, none, members.select("id", F.lit(minhash.CHUNK_BYTES // 10).alias("bytes"))).collect()
    met, pairs = {}, set()
    for r in tests:
        met.setdefault(r.test, set()).add(r.id)
    for x in met.values():
        assert len(x) <= 60
        pairs |= {(a, b) for a in x for b in x if a < b}
    assert len(met) > 30 and len(pairs) == 100 * 99 // 2
