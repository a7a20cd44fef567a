r"""Quality rules as a learned decision list.

Statistics of whole texts feed an ordered list of rules, each a conjunction of thresholds on scale-free ratios.
The list is learned by sequential covering: on two thirds of the labelled rows a rule is grown one threshold at a time
by information gain, then pruned on the last third by dropping final thresholds; a rule is kept if it is precise on the
pruning rows, the rows it covers leave, and the next rule is learned. The list is emitted as Spark conditional
expressions in its order, so that applying it is a projection.

Learning reads at most `max_labels` labelled rows (a documented bound, chosen by a hash of the key); applying reads all.

Words are runs of characters other than the space and \x09-\x0D.

Defined cases: a null or empty text has no words and zero statistics; null keys stay; repeated labels of one key count
once, a key labelled both ways counts as of low quality, and of several texts of a labelled key one, chosen by a hash, is learned from; without labelled rows the list is empty and accepts all that the
base rules accept; an empty table gives no rows; columns whose names clash are the caller's: statistics live in one struct.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkroom.llm.common import WHITE, one_text

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_distinct", "n_lines", "n_echo", "n_ending")
STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in windows of WINDOW words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def text_stats(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text: n_echo: words equal to the word before; n_ending: words that end in a character that is no letter, digit, full stop or comma."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    letters = raw.translate(None, bytes(b for b in range(128) if not chr(b).isalpha()))
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, WHITE))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(letters) - len(letters.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(letters),
        len(set(words)),
        len(lines),
        sum(map(bytes.__eq__, words, words[1:])),
        sum(w[-1] in ENDINGS for w in words),
    )


ENDINGS = frozenset(b"!#*$%&|<>?;:=+~^/\\")


@F.pandas_udf(STATS)
def _stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in texts], columns=COUNTS)


# one evaluation for each row, also where a filter and a projection use it
stats = _stats.asNondeterministic()


def features(s: F.Column) -> dict[str, F.Column]:
    """Ratios that don't depend on a text's length, by name; 0 where a denominator is 0."""
    per = lambda a, b: F.coalesce(s[a] / F.nullif(s[b], F.lit(0)), F.lit(0.0))
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "chars_per_word": per("word_chars", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "n_letters"),
        "distinct_share": per("n_distinct", "n_words"),
        "echo_share": per("n_echo", "n_words"),
        "ending_share": per("n_ending", "n_words"),
    }


def base_failed(s: F.Column) -> F.Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


class Test(NamedTuple):
    feature: str
    above: bool
    at: float


class DecisionList(NamedTuple):
    """Ordered rules for rejection; what no rule covers is kept."""

    rules: tuple[tuple[Test, ...], ...]

    def rejects(self, f: dict[str, F.Column]) -> F.Column:
        """The list as ordered conditional expressions."""
        out = None
        for rule in self.rules:
            when = F.lit(True)
            for t in rule:
                when = when & ((f[t.feature] >= t.at) if t.above else (f[t.feature] < t.at))
            out = F.when(when, True) if out is None else out.when(when, True)
        return F.lit(False) if out is None else out.otherwise(False)


def _holds(x: np.ndarray, names: list[str], rule: tuple[Test, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        c = x[:, names.index(t.feature)]
        out &= (c >= t.at) if t.above else (c < t.at)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: int, longest: int) -> tuple[Test, ...]:
    rule: tuple[Test, ...] = ()
    inside = np.ones(len(x), bool)
    while len(rule) < longest and bad[inside].any() and not bad[inside].all():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        before, best, pick = math.log2(p / (p + n)), 1e-9, None
        for j, name in enumerate(names):
            v = np.unique(x[inside, j])
            # cut points lie midway between neighbours, so that unseen values fall to the nearer side
            for at in np.unique(np.quantile((v[1:] + v[:-1]) / 2, np.linspace(0, 1, cuts), method="nearest")) if len(v) > 1 else ():
                over = x[:, j] >= at
                for above in (True, False):
                    got = inside & (over if above else ~over)
                    p1, n1 = bad[got].sum(), (~bad[got]).sum()
                    if p1 and (gain := p1 * (math.log2(p1 / (p1 + n1)) - before)) > best:
                        best, pick = gain, Test(name, above, float(at))
        if pick is None:
            break
        rule += (pick,)
        inside &= _holds(x, names, (pick,))
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.9, least: int = 3, cuts: int = 48, longest: int = 3, most: int = 12) -> DecisionList:
    """Sequential covering over rows x (columns as named); bad marks what rules should cover. precision: least share of bad rows among the pruning rows that a rule covers."""
    fold = np.arange(len(x)) % 3 == 2
    gx, gb, px, pb, rules = x[~fold], bad[~fold], x[fold], bad[fold], []
    while gb.any() and len(rules) < most:
        rule = _grow(gx, gb, names, cuts, longest)

        def worth(r: tuple[Test, ...], px=px, pb=pb) -> float:
            held = _holds(px, names, r)
            return (pb[held].sum() - (~pb[held]).sum()) / max(1, held.sum())

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())
        held, got = _holds(px, names, rule), _holds(gx, names, rule)
        if not rule or got.sum() < least or gb[got].mean() < precision or (held.any() and pb[held].mean() < precision):
            break
        rules.append(rule)
        gx, gb, px, pb = gx[~got], gb[~got], px[~held], pb[~held]
    return DecisionList(tuple(rules))


def learn_from(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_labels: int = 8000, **how) -> DecisionList:
    """A decision list from at most max_labels labelled texts; label: 0 marks low quality. Only that many keys and rows of statistics reach the driver."""
    keys = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_label"))
    keys = keys.orderBy(F.xxhash64("_k"), "_k").limit(max_labels)
    rows = one_text(docs, key, text, F.broadcast(keys)).withColumn("_s", stats("_t"))
    rows = rows.select(F.xxhash64("_k").alias("_h"), "_k", "_label", *(c.alias(n) for n, c in features(F.col("_s")).items())).toPandas().sort_values(["_h", "_k"], ignore_index=True)
    names = [c for c in rows.columns if c[0] != "_"]
    return learn(rows[names].to_numpy(float), rows["_label"].to_numpy() == 0, names, **how)


def judge(docs: DataFrame, text: str, rules: DecisionList, into: str = "judged") -> DataFrame:
    """docs with a struct column: the statistics, base_failed, rejected_by_list and kept."""
    s = F.col("__quality_stats")
    failed, rejected = base_failed(s), rules.rejects(features(s))
    out = F.struct(*(s[c].alias(c) for c in COUNTS), failed.alias("base_failed"), rejected.alias("rejected_by_list"), (~failed & ~rejected).alias("kept"))
    return docs.withColumn("__quality_stats", stats(F.col(text))).withColumn(into, out).drop("__quality_stats")


__all__ = ["DecisionList", "Test", "judge", "learn", "learn_from", "text_stats"]
