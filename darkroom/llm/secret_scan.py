r"""Secret scans over a content-addressed blob ledger.

Every historical version of every path is addressed by the SHA-256 of its content. The ledger is a table of
(blob, rule version, spans) pairs that were scanned already; a run scans only pairs that the ledger lacks, appends
them, and joins the spans back to all paths. However often a text occurs, its blob is scanned once for each rule version.

Plan: (key, blob) pairs are pre-aggregated to one representative row per blob before any shuffle of text; text moves
once, by (blob, key), so that a text with many copies does not meet in one task. The ledger has one row per blob;
the join back to the paths may be split by Spark where one blob has many paths.

Defined cases: a null text is an empty text; null and repeated keys keep one output row per input row; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkroom.llm.common import stored

SPANS = "array<struct<kind:string,start:int,end:int>>"


class Rule(NamedTuple):
    """One kind of secret. marker: in lower case, one of these must occur in the lower-cased text; accept: the group and its least length."""

    kind: str
    pattern: re.Pattern
    accept: tuple[int, int] = (0, 1)
    markers: tuple[str, ...] = ()
    find: Callable[[str], Iterator[tuple[int, int]]] | None = None  # the pattern's matches in linear time, where the pattern alone is slower


_RUN = re.compile(r"[A-Za-z0-9_-]+")


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the rule web_token: three runs of its characters with a dot between, of which the first may begin before the token does."""
    runs = [m.span() for m in _RUN.finditer(text)] if ".eyJ" in text else []
    n = 0
    while n + 2 < len(runs):
        (a, b), (c, d), (e, f) = runs[n : n + 3]
        joined = c == b + 1 and e == d + 1 and text[b] == text[d] == "." and d - c >= 11 and f - e >= 8 and text.startswith("eyJ", c)
        start = text.find("eyJ", a, max(a, b - 8)) if joined else -1
        if start >= 0:
            yield start, f
        n += 3 if start >= 0 else 1


#: In the order in which kinds are listed where spans start together; the first three are the base kinds.
#: A private key runs to its END line, or to the end of the text without one.
RULES = (
    Rule("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), (2, 6), ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", re.compile(r"AKIA[A-Z0-9]+"), (0, 20), ("akia",)),
    Rule("hex", re.compile(r"[0-9a-f]{24,}"), (0, 24)),
    Rule("private_key", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[\s\S]*?-----END (?:[A-Z]+ )*PRIVATE KEY-----|[\s\S]*)"), (0, 1), ("private key-----",)),
    Rule("web_token", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), (0, 1), (".eyj",), web_tokens),
    Rule("prefixed", re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})"), (0, 1), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox")),
    Rule("url_login", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@"), (0, 1), ("://",)),
)
BASE_KINDS = ("assign", "access", "hex")
#: Changes with the rules, so that a ledger of other rules is never read as one of these.
RULE_VERSION = hashlib.sha256("\n".join(f"{r.kind} {r.accept} {r.pattern.pattern}" for r in RULES).encode()).hexdigest()[:16]


def scan_text(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of the rules; of each kind leftmost matches that do not overlap."""
    low = text.lower() if text else ""
    found = []
    for n, rule in enumerate(rules):
        if rule.markers and not any(m in low for m in rule.markers):
            continue
        if rule.find:
            found += [(start, n, rule.kind, end) for start, end in rule.find(text)]
            continue
        group, least = rule.accept
        for m in rule.pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), n, rule.kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """blobs(blob, text) -> (blob, rule_version, spans)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan_text(t, rules)] for t in b["text"]]
            yield pd.DataFrame({"blob": b["blob"], "rule_version": version, "spans": spans})

    return blobs.select("blob", "text").mapInPandas(scan, f"blob string, rule_version string, spans {SPANS}")


def scan_versions(versions: DataFrame, key: str, text: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings of every version, and the ledger entries that this run added.

    versions: one row for each historical version of a path. ledger: (blob, rule_version, spans) of earlier runs.
    Returns (key, blob, rule_version, spans), a row for each version, and the new entries as a stored table.
    """
    rows = versions.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    first = rows.groupBy("blob").agg(F.min("key").alias("key"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    first = first.withColumnsRenamed({"blob": "b", "key": "k"})
    unseen = rows.join(first, (F.col("blob") == F.col("b")) & F.col("key").eqNullSafe(F.col("k")), "left_semi")
    # rows that repeat key and text give an entry each; one is kept
    added = stored(scan_blobs(unseen, rules, version).groupBy("blob", "rule_version").agg(F.first("spans").alias("spans")), "blob_ledger")
    known = added if ledger is None else added.unionByName(ledger.where(F.col("rule_version") == version).select("blob", "rule_version", "spans"))
    return rows.select("key", "blob").join(known, "blob"), added


def spans_text(spans: str, kinds: tuple[str, ...] | None = None) -> F.Column:
    """kind:start:end of the spans, joined by commas."""
    picked = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(picked, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@F.pandas_udf(T.StringType())
def _clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([replaced(t, [(s["start"], s["end"], s["kind"]) for s in found]) if found is not None and t is not None else t for t, found in zip(texts, spans, strict=True)], dtype=object)


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with [kind] for each span; overlapping spans, which come by start, are one, named after the first."""
    parts, at, n = [], 0, 0
    while n < len(spans):
        start, end, kind = spans[n]
        n += 1
        while n < len(spans) and spans[n][0] < end:
            end, n = max(end, spans[n][1]), n + 1
        parts += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, key: str, text: str, ledger: DataFrame | None = None) -> DataFrame:
    """docs with the characters of each secret replaced by [kind]. Null texts stay null; rows and other columns stay as they are."""
    _, known = scan_versions(docs, key, text, ledger)
    if ledger is not None:
        known = known.unionByName(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob", "rule_version", "spans"))
    hits = known.where(F.size("spans") > 0).select("blob", "spans")
    rows = docs.select(F.struct(*docs.columns).alias("doc")).withColumn("blob", F.sha2(F.coalesce(f"doc.{text}", F.lit("")), 256))
    marked = rows.join(hits, "blob", "left").withColumn("clean", _clean.asNondeterministic()(f"doc.{text}", "spans"))
    return marked.select(*(F.col("clean").alias(c) if c == text else F.col(f"doc.{c}") for c in docs.columns))
