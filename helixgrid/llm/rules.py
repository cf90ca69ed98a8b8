"""Quality rules: decision lists learned by sequential covering.

Per-document statistics come from one pass over the text. A bounded sample of
labelled documents teaches an ordered list of threshold conjunctions for the
bad class: each rule is grown greedily by information gain on two thirds of
the rows, pruned on the rest, and what it covers is removed before the next.
The list becomes one conditional Spark expression, so applying it is a plain
projection.

Defined cases: null or empty text has zero words and fails the base; repeated
rows are judged one by one; null ids are judged like others (they never match
a label); of several documents under one labelled id the one of the smallest
statistics is learned from, so an id on very many rows does not enlarge the
sample; very long texts are read whole; an empty table gives an empty result; without labels of both kinds
the list is empty and only the base decides. Only doc_id and text are read,
so further columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, sampled, split_words, staged

_SYMBOLS = b"#*$%&|<>"
_KEEP_SYMBOLS = bytes(i for i in range(256) if i not in _SYMBOLS)
_NO_UPPER = bytes(i for i in range(256) if not 65 <= i <= 90)
_NO_DIGIT = bytes(i for i in range(256) if not 48 <= i <= 57)
_MULT = np.uint64(0x9E3779B97F4A7C15)

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_digits long, n_exclaims long, n_distinct_words long"
)

#: Ratios that the rules test, as SQL over the statistics; each is defined for zero words.
FEATURES = {
    "words": "cast(n_words as double)",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "exclaims_per_word": "n_exclaims / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def repeat_words(words: list[bytes], width: int = 5) -> tuple[int, int]:
    """Words inside windows of `width` words that occur twice or more, and the number of distinct words."""
    n = len(words)
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n)
    m = n - width + 1
    if m < 2:
        return 0, len(ids)
    if len(ids) ** width < 2**64:
        base = np.uint64(len(ids))
        key = codes[:m].copy()
        for j in range(1, width):
            key = key * base + codes[j : j + m]
    else:
        # Two packed halves, each renumbered: exact for any number of words.
        base = np.uint64(len(ids))
        pair = np.unique(codes[:-1] * base + codes[1:], return_inverse=True)[1].astype(np.uint64)
        quad = np.unique(pair[: n - 3] * np.uint64(n) + pair[2 : n - 1], return_inverse=True)[1].astype(np.uint64)
        key = quad[:m] * base + codes[4 : 4 + m] if width == 5 else _general(codes, width, m)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[inverse] > 1)
    if not len(hit):
        return 0, len(ids)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), len(ids)


def _general(codes: np.ndarray, width: int, m: int) -> np.ndarray:
    key = codes[:m]
    for j in range(1, width):
        key = np.unique(key * np.uint64(len(codes)) + codes[j : j + m], return_inverse=True)[1].astype(np.uint64)
    return key


def document_stats(text: str | None) -> tuple[int, ...]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    seen: set[bytes] = set()
    lines = repeated = 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            lines += 1
            repeated += line in seen
            seen.add(line)
    again, distinct = repeat_words(words)
    return (
        len(words), chars, len(joined.translate(None, _KEEP_SYMBOLS)), repeated, again,
        lines, len(joined.translate(None, _NO_UPPER)), len(joined.translate(None, _NO_DIGIT)), joined.count(b"!"), distinct,
    )


def text_stats(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row of statistics per document. carry: further columns that go along."""
    kinds = dict(docs.dtypes)
    names = [x.split()[0] for x in STATS.split(", ")]

    def batch(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.array([document_stats(t) for t in pdf["text"]], dtype=np.int64).reshape(-1, len(names))
        out = pd.DataFrame(rows, columns=names)
        for i, c in enumerate(("key", *carry)):
            out.insert(i, c, pdf[c].array)
        return out

    along = "".join(f"{c} {kinds[c]}, " for c in carry)
    return mapped(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *carry), batch, f"key {kinds[key]}, {along}{STATS}").withColumnRenamed("key", key)


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of them in repeated five-word windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<'} {self.threshold!r}D"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules for the bad class; a document that no rule covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        bad = np.zeros(n, bool)
        for rule in self.rules:
            bad |= np.logical_and.reduce([c.holds(x) for c in rule])
        return ~bad

    def expression(self) -> Column:
        """CASE WHEN rule THEN false ... ELSE true END over the statistics."""
        if not self.rules:
            return F.lit(True)
        out = None
        for rule in self.rules:
            test = F.expr(" AND ".join(c.sql() for c in rule))
            out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
        return out.otherwise(F.lit(True))


def _gain(p: int, n: int, p1: np.ndarray, n1: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
    return np.where(p1 > 0, gain, -np.inf)


def _best(x: dict[str, np.ndarray], y: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of the largest gain for the rows with y true."""
    p, n = int(y.sum()), int((~y).sum())
    found: tuple[float, Condition | None] = (0.0, None)
    for name in sorted(x):
        values = x[name]
        order = np.argsort(values, kind="stable")
        v, good = values[order], y[order]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        below_p = np.cumsum(good)[cut - 1]
        below_n = cut - below_p
        for above, p1, n1 in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
            gain = _gain(p, n, p1.astype(float), n1.astype(float))
            i = int(np.argmax(gain))
            if gain[i] > found[0] + 1e-12:
                found = (float(gain[i]), Condition(name, above, float((v[cut[i]] + v[cut[i] - 1]) / 2)))
    return found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9, seed: int = 5) -> DecisionList:
    """Sequential covering. bad: true for the class that the rules describe.

    A rule is accepted while its precision on all rows left (Laplace-corrected)
    reaches `precision`, so clean documents are rarely covered.
    """
    rng = np.random.default_rng(seed)
    left = np.ones(len(bad), bool)
    prune = rng.random(len(bad)) < 1 / 3
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < most_rules and (bad & left).sum() >= 3:
        grow = left & ~prune
        rows = {k: v[grow] for k, v in x.items()}
        y = bad[grow]
        rule: list[Condition] = []
        while y.any() and (~y).any() and len(rule) < most_conditions:
            _, c = _best(rows, y)
            if c is None:
                break
            rule.append(c)
            hit = c.holds(rows)
            rows, y = {k: v[hit] for k, v in rows.items()}, y[hit]
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            hit = np.logical_and.reduce([c.holds(x) for c in r]) & left & prune
            p, n = int((bad & hit).sum()), int((~bad & hit).sum())
            return (p - n) / (p + n) if p + n else -1.0

        best = max(range(len(rule), 0, -1), key=lambda k: (worth(rule[:k]), k))
        rule = rule[:best]
        hit = np.logical_and.reduce([c.holds(x) for c in rule]) & left
        p, n = int((bad & hit).sum()), int((~bad & hit).sum())
        if (p + 1) / (p + n + 2) < precision and not (p >= 3 and n == 0):
            break
        rules.append(tuple(rule))
        left &= ~hit
    return DecisionList(tuple(rules))


def fit(stats: DataFrame, labels: DataFrame, sample: int = 20_000, key: str = "doc_id") -> DecisionList:
    """Learns from at most about `sample` labelled ids, one document each: the one of the smallest statistics (quality 0 is the bad class)."""
    marked = sampled(labels.select(F.col(key), F.col("quality")).where("quality is not null").dropDuplicates([key]), key, sample)
    every = stats.join(marked, key).select(F.col(key).alias("_id"), "quality", *[F.expr(s).cast("double").alias(n) for n, s in FEATURES.items()])
    rows = every.groupBy("_id").agg(F.min(F.struct("quality", *FEATURES)).alias("r")).select("r.*").toPandas().sort_values([*FEATURES, "quality"], ignore_index=True)
    bad = rows["quality"].to_numpy() == 0
    if not len(rows) or not bad.any() or bad.all():
        return DecisionList(())
    return learn({n: rows[n].to_numpy(dtype=float) for n in FEATURES}, bad)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = 20_000, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Statistics, base_failed and kept for every document. carry: further columns that go along."""
    stats = staged(text_stats(docs, key, carry=carry), "stats")
    verdict = fit(stats, labels, sample, key).expression()
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict)
