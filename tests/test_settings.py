"""Changes of providers against a plain loop; keys as they are shown; which configuration counts."""

import random

from pyspark.sql import functions as F

from darkroom.functions.decisions import STAGE_PROVIDERS
from darkroom.operators import settings

CONFIGS = "owner string, stage string, provider_type string, base_url string, model string, is_active boolean, priority int, remark string, api_key_masked string, reason_of string"
CHANGES = "owner string, stage string, seq int, provider_type string, base_url string, model string, is_active boolean, priority int, remark string, api_key string"


def test_changes_equal_a_plain_loop(spark):
    rng = random.Random(5)
    stages, providers = [*STAGE_PROVIDERS, "cleaning", None], ["openai_compatible", "dashscope_multimodal_embedding", "other", None, None]
    held = [(o, s, rng.choice(providers), "u", "m", True, 100, None, "", "kept") for o in "abc" for s in stages[:3] if (o, s) != ("c", "layout")]
    asked = [(rng.choice(["a", "b", "c", "d", None]), rng.choice(stages), n, rng.choice(providers), rng.choice(["v", None]), rng.choice(["m2", None]), rng.choice([True, False, None]), rng.choice([1, 2, None]), None, rng.choice(["sk-test-12345678", "12345678", "", None])) for n in range(400)]
    now, reasons = {r[:2]: dict(zip(("provider_type", "base_url", "model", "is_active", "priority", "remark", "api_key_masked"), r[2:9], strict=True)) for r in held}, {}
    for o, s, n, p, u, m, a, pr, rem, key in asked:
        c = now.get((o, s))
        if s not in STAGE_PROVIDERS:
            reasons[n] = "unknown_stage"
        elif c is None:
            reasons[n] = "missing"
        elif (p or c["provider_type"]) not in STAGE_PROVIDERS[s]:
            reasons[n] = "unsupported_provider"
        else:
            reasons[n] = None
            c.update({k: v for k, v in zip(("provider_type", "base_url", "model", "is_active", "priority", "remark"), (p, u, m, a, pr, rem), strict=True) if v is not None})
            if key:
                c["api_key_masked"] = key[:4] + "****" + key[-4:] if len(key) > 8 else "*" * len(key)
    rng.shuffle(asked)
    configs, changes = spark.createDataFrame(held, CONFIGS), spark.createDataFrame(asked, CHANGES).repartition(5)
    assert {r.seq: r.reason for r in settings.verdicts(configs, changes, ["owner"], "seq").collect()} == reasons
    assert len(set(reasons.values())) == 4
    got = settings.updated(configs, changes, ["owner"], "seq")
    assert got.columns == configs.columns
    assert {(r.owner, r.stage): {k: r[k] for k in now["a", "layout"]} for r in got.collect()} == now
    assert settings.updated(configs, changes.where("seq < 0"), ["owner"], "seq").exceptAll(configs).count() == 0
    assert settings.updated(configs.where("owner = 'z'"), changes, ["owner"], "seq").count() == 0


def test_changes_of_equal_order(spark):
    configs = spark.createDataFrame([("a", "layout", "other", "u", "m", True, 1, None, "", "")], CONFIGS)
    rows = [("a", "layout", 1, p, None, m, None, None, None, None) for p, m in ((None, "x"), ("openai_compatible", "y"), ("openai_compatible", "z"), (None, None))]
    got = settings.verdicts(configs, spark.createDataFrame([*rows, rows[-1][:2] + (2,) + rows[-1][3:]], CHANGES), ["owner"], "seq").collect()
    assert [r.reason for r in got if r.seq == 1 and r.provider_type is None] == ["unsupported_provider"] * 2 and [r.reason for r in got if r.seq == 2] == [None]
    assert settings.updated(configs, spark.createDataFrame(rows, CHANGES), ["owner"], "seq").first().model == "z"


def test_keys_are_shown_masked(spark):
    rows = spark.createDataFrame([("sk-default-12345678",), ("123456789",), ("12345678",), ("a",), ("",), (None,)], "k string")
    assert [r.m for r in rows.select(settings.masked(F.col("k")).alias("m")).collect()] == ["sk-d****5678", "1234****6789", "********", "*", "", ""]


def test_resolved_in_order(spark):
    own = spark.createDataFrame([
        (1, "chapter", 10, "p1", "m", True, 5, 1), (1, "chapter", 11, "p2", "m", True, 4, 2), (1, "chapter", 12, "p3", "m", True, 4, 1), (1, "chapter", 13, "p4", "m", False, 0, 0),
        (1, None, 14, "p5", "m", True, 9, 1), (2, "layout", 15, "p6", "m", False, 1, 1),
    ], "project_id int, stage string, id int, provider_type string, model string, is_active boolean, priority int, created_at int")
    defaults = spark.createDataFrame([("layout", 1, "d1", "n", True), ("chapter", 2, "d2", "n", False)], "stage string, id int, provider_type string, model string, is_active boolean")
    wanted = spark.createDataFrame([(1, "chapter"), (1, "layout"), (2, "layout"), (2, "chapter"), (None, "layout"), (2, None)], "project_id int, stage string")
    got = {(r.project_id, r.stage): (r.source, r.config_id, r.provider, r.model) for r in settings.resolved(wanted, own, defaults).collect()}
    assert got == {
        (1, "chapter"): ("project_config", 12, "p3", "m"), (1, "layout"): ("project_config", 14, "p5", "m"), (2, "layout"): ("global_default_config", 1, "d1", "n"),
        (2, "chapter"): ("env_fallback", None, "openai_compatible", ""), (None, "layout"): ("global_default_config", 1, "d1", "n"), (2, None): ("env_fallback", None, "openai_compatible", ""),
    }
