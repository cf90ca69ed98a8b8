"""Language identification in two steps: the family, then one-versus-one linear support vector machines inside it.

A text's letters, lower-cased, with everything else as single spaces, give
hashed byte n-grams of lengths 1 to 4; the square roots of their counts form a
unit vector of DIMENSIONS coordinates. Families are told apart by one-versus-one
machines too, trained on all their languages together. Each machine minimises
the hinge loss by averaged stochastic subgradient steps.

The sample is bounded and balanced between languages; each sampled text is also
learned from a short passage of itself, so short texts are told apart as well.

Defined cases: null text, or no letter: `und` with score 1 - no machine is
asked; a single learned language is always predicted; no learned language at
all: `und`; very long texts are read whole; repeated rows get equal answers and
are learned from once; rows that share an id, or have none, are drawn apart by
their texts; further columns, whatever their names, are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mapped, remainder, sent

DIMENSIONS = 1 << 12
UNKNOWN = "und"

# Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indo-aryan": ("bn", "hi", "mr", "ne", "ur"),
}

_OTHER = re.compile(r"[\W\d_]+")
_MULT = U64(0x9E3779B97F4A7C15)
_SHIFT = U64(64 - (DIMENSIONS.bit_length() - 1))


def family_of(lang: str) -> str:
    return next((f for f, own in FAMILIES.items() if lang in own), lang)


def letters(text: str | None) -> bytes:
    """The letters of a text in words, with a space around each word; empty if there is no letter."""
    if not text:
        return b""
    words = _OTHER.sub(" ", text).strip().lower()
    if not words or not any(c.isalpha() for c in words):
        return b""
    return b" " + words.encode("utf-8", "surrogatepass") + b" "


def features(data: bytes) -> np.ndarray:
    """The unit vector of a text's letters."""
    b = np.frombuffer(data, np.uint8).astype(U64)
    out, key = np.zeros(DIMENSIONS), b
    for n in range(1, 5):
        if n > 1:
            key = (key[:-1] << U64(8)) | b[n - 1 :]
        if len(key):
            out += np.bincount((((key + U64(n << 40)) * _MULT) >> _SHIFT).astype(np.int64), minlength=DIMENSIONS)
    out = np.sqrt(out)
    return (out / max(1e-9, float(np.sqrt((out * out).sum())))).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, epochs: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine; y: +1 or -1. Small batches, averaged over the later half."""
    rng = np.random.default_rng(seed)
    w, bias, sum_w, sum_b, n, t = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0, 0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for e in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            t += 1
            step = 1 / (penalty * (t + 100))
            miss = part[y[part] * (x[part] @ w + bias) < 1]
            pull = weight[miss] * y[miss] / len(part)
            w *= 1 - step * penalty
            w += step * (pull @ x[miss])
            bias += 0.1 * step * penalty * float(pull.sum())
            if e >= epochs // 2:
                sum_w += w
                sum_b += bias
                n += 1
    return sum_w / max(1, n), sum_b / max(1, n)


@dataclass
class Ladder:
    """classes, and a machine (i, j, weights, bias) for each pair: positive speaks for i."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMENSIONS)))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of most wins (ties: larger sum of margins) and the logistic value of its smallest margin."""
        n = len(x)
        if len(self.classes) == 1:
            return np.zeros(n, int), np.ones(n)
        margin = x @ self.weights.T + self.biases
        wins, least, total = np.zeros((n, len(self.classes))), np.full((n, len(self.classes)), np.inf), np.zeros((n, len(self.classes)))
        for k, (i, j) in enumerate(self.pairs):
            for c, m in ((i, margin[:, k]), (j, -margin[:, k])):
                wins[:, c] += m > 0
                total[:, c] += np.tanh(m)
                least[:, c] = np.minimum(least[:, c], m)
        best = np.argmax(wins + total / (4 * len(self.classes)), axis=1)
        return best, 1 / (1 + np.exp(-4 * np.clip(least[np.arange(n), best], -8, 8)))


def ladder(x: np.ndarray, names: np.ndarray) -> Ladder:
    out = Ladder(sorted(set(names.tolist())))
    machines = []
    for i, j in combinations(range(len(out.classes)), 2):
        own = np.flatnonzero((names == out.classes[i]) | (names == out.classes[j]))
        out.pairs.append((i, j))
        machines.append(svm(x[own], np.where(names[own] == out.classes[i], 1.0, -1.0)))
    if machines:
        out.weights, out.biases = np.stack([w for w, _ in machines]), np.array([b for _, b in machines])
    return out


@dataclass
class Identifier:
    families: Ladder | None
    inside: dict[str, Ladder]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        cut = [letters(t) for t in texts]
        langs, scores = [UNKNOWN] * len(texts), np.ones(len(texts))
        some = [i for i, c in enumerate(cut) if c]
        if not some or self.families is None:
            return langs, scores
        for k in range(0, len(some), 256):
            part = np.array(some[k : k + 256])
            x = np.stack([features(cut[i]) for i in part])
            family, sure = self.families.decide(x)
            for f, name in enumerate(self.families.classes):
                own = np.flatnonzero(family == f)
                if len(own):
                    lang, also = self.inside[name].decide(x[own])
                    for i, c in zip(part[own], lang, strict=True):
                        langs[i] = self.inside[name].classes[c]
                    scores[part[own]] = sure[own] * also
        return langs, scores


def fit(docs: DataFrame, folds: int = 4, held: int = 2, sample: int = 4000, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Identifier:
    """Learns from about `sample` texts at most, shared evenly between languages, none of the held-out fold."""
    # A row is drawn by its content, so rows of one id, or of none, are drawn apart; equal rows are one.
    draw = F.xxhash64(F.col(key), F.col(text), F.col(lang), F.lit(23))
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (remainder(key, folds) != held)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
    # A row for each language reaches the driver; languages are few by nature.
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")).collect()}
    if not counts:
        return Identifier(None, {})
    each = max(1, sample // len(counts))
    chance = F.create_map(*[F.lit(v) for lang_, n in counts.items() for v in (lang_, min(1.0, each / n))])
    drawn = rows.where(F.pmod("draw", F.lit(1_000_000)) < F.lit(1_000_000) * chance[F.col("lang")])
    drawn = drawn.groupBy("draw").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))

    def batch(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, t, draw in zip(pdf["lang"], pdf["text"], pdf["draw"], strict=True):
            data = letters(t)
            if data:
                out.append((draw, 0, name, features(data).astype(np.float16).tobytes()))
                words = data.split()
                at = draw % max(1, len(words) - 8)
                out.append((draw, 1, name, features(b" " + b" ".join(words[at : at + 8]) + b" ").astype(np.float16).tobytes()))
        return pd.DataFrame(out, columns=["draw", "part", "lang", "x"])

    found = mapped(drawn, batch, "draw long, part int, lang string, x binary").toPandas().sort_values(["draw", "part", "lang"], ignore_index=True)
    if not len(found):
        return Identifier(None, {})
    x = np.stack([np.frombuffer(b, np.float16) for b in found["x"]]).astype(np.float32)
    langs = found["lang"].to_numpy(dtype=object)
    family = np.array([family_of(n) for n in langs], dtype=object)
    return Identifier(ladder(x, family), {f: ladder(x[family == f], langs[family == f]) for f in sorted(set(family.tolist()))})


def languages(docs: DataFrame, identifier: Identifier, folds: int = 4, held: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score for every document."""
    kind = dict(docs.dtypes)[key]
    identifier_of = sent(docs.sparkSession, identifier)

    def run(batches):
        own = identifier_of()
        for pdf in batches:
            langs, scores = own.predict(pdf["text"].tolist())
            yield pd.DataFrame({"key": pdf["key"].array, "held_out": pdf["held_out"].array, "lang_pred": langs, "score": scores})

    rows = docs.select(F.col(key).alias("key"), (remainder(key, folds) == held).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("key", key)
