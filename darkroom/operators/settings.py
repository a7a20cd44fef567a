"""Providers of stages: changes that are checked before they count, keys that are shown masked, and which configuration a project's stage gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions import decisions
from darkroom.operators import control

FIELDS = ("provider_type", "base_url", "model", "is_active", "priority", "remark")


def masked(key: Column) -> Column:
    """A secret as it may be shown: its first and last four characters around stars; stars alone up to eight characters; empty or null: empty."""
    text = F.coalesce(key, F.lit(""))
    return F.when(F.length(text) <= 8, F.repeat(F.lit("*"), F.length(text))).otherwise(F.concat(F.substring(text, 1, 4), F.lit("****"), F.substring(text, -4, 4)))


def verdicts(configs: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """changes with reason: null if a change counts, else unknown_stage, missing (no such configuration) or unsupported_provider.

    A change must leave its stage with a provider that the stage may have: its own, or else the one in force after the changes before it. As one that
    counts leaves an allowed provider, the changes before only matter to a configuration that was not allowed from the start: to it the first change
    that names an allowed provider, a partial aggregate, tells. Changes of equal order don't see each other.
    configs(*keys, stage, provider_type), one row a key and stage; changes(*keys, stage, `order`, provider_type). Null keys are missing."""
    at, allowed = [*keys, "stage"], decisions.provider_allowed(F.col("stage"), F.col("provider_type"))
    now = configs.select(*at, F.coalesce(allowed, F.lit(False)).alias("_now"))
    first = changes.where(allowed).groupBy(*at).agg(F.min(order).alias("_first"))
    fit = F.when(F.col("provider_type").isNotNull(), allowed).otherwise(F.col("_now") | F.coalesce(F.col("_first") < F.col(order), F.lit(False)))
    known = F.coalesce(F.col("stage").isin(*decisions.STAGE_PROVIDERS), F.lit(False))
    reason = F.when(~known, "unknown_stage").when(F.col("_now").isNull(), "missing").when(~fit, "unsupported_provider")
    return changes.join(now, at, "left").join(first, at, "left").withColumn("reason", reason).select(*changes.columns, "reason")


def updated(configs: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """configs after the changes that count: of every field the last value given, null: not given. A new api_key that is not empty shows as api_key_masked.

    changes(*keys, stage, `order`, provider_type, base_url, model, is_active, priority, remark, api_key); last values are partial aggregates, of
    equal order the greater value."""
    given = verdicts(configs, changes, keys, order).where("reason IS NULL").withColumn("api_key_masked", F.when(F.col("api_key") != "", masked(F.col("api_key"))))
    last = given.groupBy(*keys, "stage").agg(*(F.max(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(f"_{c}") for c in (*FIELDS, "api_key_masked")))
    out = configs.join(last, [*keys, "stage"], "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in (*FIELDS, "api_key_masked")}).select(configs.columns)


def resolved(wanted: DataFrame, own: DataFrame, defaults: DataFrame, fallback: str = "openai_compatible") -> DataFrame:
    """wanted(project_id, stage) with source, config_id, provider and model: the project's active configuration of the stage, else its active one of no stage,
    else the stage's active default, else the fallback provider without a model. Of several the first by priority, created_at and id.

    own(project_id, stage, id, provider_type, model, is_active, priority, created_at); defaults(stage, id, provider_type, model, is_active). Equality joins only."""
    as_one = lambda source: F.struct(F.lit(source).alias("source"), F.col("id").alias("config_id"), F.col("provider_type").alias("provider"), "model")
    order = (F.asc("priority"), F.asc("created_at"), F.asc("id"))
    mine = own.where("is_active")
    exact = control.latest(mine.where("stage IS NOT NULL"), ["project_id", "stage"], *order).select("project_id", "stage", as_one("project_config").alias("_a"))
    any_stage = control.latest(mine.where("stage IS NULL"), ["project_id"], *order).select("project_id", as_one("project_config").alias("_b"))
    default = control.latest(defaults.where("is_active"), ["stage"], F.asc("id")).select("stage", as_one("global_default_config").alias("_c"))
    none = F.struct(F.lit("env_fallback").alias("source"), F.lit(None).cast(dict(own.dtypes)["id"]).alias("config_id"), F.lit(fallback).alias("provider"), F.lit("").alias("model"))
    out = wanted.join(exact, ["project_id", "stage"], "left").join(any_stage, "project_id", "left").join(default, "stage", "left")
    return out.withColumn("_d", F.coalesce("_a", "_b", "_c", none)).select(*wanted.columns, "_d.*")
