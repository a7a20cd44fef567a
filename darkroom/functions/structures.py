"""Maps, lists of texts and knots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def updated(old: Column, new: Column) -> Column:
    """A map with another's entries put over its own; null counts as empty."""
    rest = F.map_filter(old, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))
    return F.coalesce(F.map_concat(rest, new), old, new)


def merged(old: Column, new: Column) -> Column:
    """A map of maps with another's put over it one level deep: maps under the same key are joined; null where nothing is left."""
    both = F.map_zip_with(old, new, lambda _, a, b: updated(a, b))
    out = F.coalesce(both, old, new)
    return F.when(F.size(out) > 0, out)


def some_texts(texts: Column, most: int = 12) -> Column:
    """The first distinct texts of a list, trimmed, in order, without empty ones; empty for null."""
    trimmed = F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.slice(F.array_distinct(trimmed), 1, most), F.array().cast("array<string>"))


def ascending(xs: Column, strictly: bool = False) -> Column:
    """Whether numbers never fall, or always rise; true of fewer than two."""
    n = F.greatest(F.size(xs) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(xs, 1, n).alias("a"), F.slice(xs, 2, n).alias("b"))
    return F.forall(pairs, lambda p: (p["a"] < p["b"]) if strictly else (p["a"] <= p["b"]))


def usable_knots(signal: Column, probability: Column) -> Column:
    """Whether knots map signals to probabilities: two or more, signals rise, probabilities lie between 0 and 1 and never fall."""
    long = (F.size(signal) >= 2) & (F.size(signal) == F.size(probability))
    return F.coalesce(long & ascending(signal, True) & ascending(probability) & F.forall(probability, lambda p: p.between(0, 1)), F.lit(False))


def listed(setting: Column) -> Column:
    """A list from a setting's text: of JSON where it begins with a bracket, else of what commas part, trimmed, without empty ones; empty for null.

    Null where the JSON can't be read."""
    raw = F.trim(setting)
    parts = F.filter(F.transform(F.split(raw, ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>")).when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(parts)


def concepts(texts: Column, most: int = 8) -> Column:
    """The first distinct lower-case texts of a list, trimmed, without empty ones."""
    return some_texts(F.transform(texts, lambda t: F.lower(t)), most)


def without(details: Column, fields: tuple[str, ...], items: str, inner: tuple[str, ...]) -> Column:
    """A struct without some fields, and without some fields of each struct in its array `items`."""
    return details.dropFields(*fields).withField(items, F.transform(details[items], lambda i: i.dropFields(*inner)))


def settled_candidates(candidates: Column) -> Column:
    """Candidates (structs of id, title, summary, include_concepts, exclude_concepts, constraints) without summaries, whose concepts have moved into their
    constraints (a struct of include_concepts and exclude_concepts), where these had none."""
    given = lambda old, new: F.when(F.coalesce(F.size(new), F.lit(0)) > 0, new).otherwise(F.when(F.size(old) > 0, old).otherwise(new))

    def one(c: Column) -> Column:
        held = F.struct(*(given(c[k], c["constraints"][k]).alias(k) for k in ("include_concepts", "exclude_concepts")))
        return F.struct(c["id"].alias("id"), c["title"].alias("title"), held.alias("constraints"))

    return F.coalesce(F.transform(candidates, one), F.array())


def joined(*lists: Column) -> Column:
    """Distinct values of lists in order of their first occurrence; null lists are empty."""
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))
