"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document becomes a sparse vector: its words hashed to BUCKETS coordinates
(log counts, of fixed length together) and one coordinate per statistic, for the
quantile bin it falls into; the table's own n_chars is one of the statistics.
The score is the logistic function of

    w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

so all pairwise interactions cost one pass over the non-zero coordinates. The
machine is fitted on a bounded sample of labelled rows by AdaGrad; scoring is
one map over the documents and needs no shuffle.

Defined cases: null and empty texts have no word coordinates and are scored
by their statistics; null n_chars counts as the text's own length, and so does a
table without that column; very long texts are scored whole, a text at a time;
repeated rows and ties get equal scores; of several documents under one
labelled id the one of the smallest hash is learned from, so an id on very many rows
does not enlarge the sample; null ids count as the empty text for the fold;
further columns, whatever their names, are not read; an empty
table gives an empty result; without labels of both kinds every score is the
share of good labels (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, remainder, sampled, sent, split_words
from .rules import document_stats

BUCKETS = 1 << 16
BINS = 12
STATS = 11


def _ratios(text: str | None, n_chars: float | None) -> list[float]:
    n, chars, symbols, dup, again, lines, upper, digits, exclaims, distinct = document_stats(text)
    meta = len(text or "") if n_chars is None or n_chars != n_chars else n_chars
    w, c, li = max(n, 1), max(chars, 1), max(lines, 1)
    return [n, chars / w, symbols / w, upper / c, digits / c, exclaims / w, dup / li, again / w, distinct / w, n / li, float(meta)]


def _words(text: str | None, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of the words."""
    h = known.of(split_words(text, lower=True)) & U64(BUCKETS - 1)
    ids, n = np.unique(h.astype(np.int32), return_counts=True)
    x = 1 + np.log(n)
    return ids, (_WORD_VALUE * x / max(1e-9, float(np.sqrt((x * x).sum())))).astype(np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    edges: np.ndarray

    def stat_ids(self, stats: np.ndarray) -> np.ndarray:
        """(rows, STATS) statistics -> coordinates of their bins."""
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], side="right") for j in range(STATS)], axis=1)
        return (BUCKETS + np.arange(STATS) * BINS + bins).astype(np.int32)

    def margins(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows laid end to end, none of them empty; starts: where each begins."""
        vx = self.factors[ids] * values[:, None]
        s = np.add.reduceat(vx, starts, axis=0)
        q = np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.linear[ids] * values, starts) + 0.5 * (s * s - q).sum(axis=1)


#: Each statistic counts as much as all words together, and more.
_STAT_VALUE, _WORD_VALUE = np.float32(1), 0.3


def _vectors(stats: np.ndarray, machine: Machine, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fixed = machine.stat_ids(stats)
    ids, values, starts, at = [], [], [], 0
    for row, (i, x) in zip(fixed, words, strict=True):
        starts.append(at)
        ids += [row, i]
        values += [np.full(STATS, _STAT_VALUE, np.float32), x]
        at += STATS + len(i)
    return np.concatenate(ids), np.concatenate(values), np.array(starts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, rank: int = 8, epochs: int | None = None, rate: float = 0.15, decay: float = 2e-4, seed: int = 3) -> Machine:
    """AdaGrad on the logistic loss over rows of statistics and word vectors; good: 1 or 0.

    epochs: by default as many as show it 150,000 rows in all, 12 at least.
    """
    epochs = epochs or max(12, 150_000 // max(1, len(good)))
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATS * BINS
    edges = np.stack([np.quantile(stats[:, j], np.arange(1, BINS) / BINS) for j in range(STATS)]) if len(stats) else np.zeros((STATS, BINS - 1))
    share = float(np.clip(good.mean(), 1e-3, 1 - 1e-3)) if len(good) else 0.5
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), (rng.standard_normal((size, rank)) * 0.02).astype(np.float32), edges)
    if not len(good) or good.min() == good.max():
        m.factors[:] = 0
        return m
    past_w, past_v = np.full(size, 1e-2, np.float32), np.full((size, rank), 1e-2, np.float32)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(good)), max(1, len(good) // 128)):
            ids, x, starts = _vectors(stats[part], m, [words[i] for i in part])
            row = np.repeat(np.arange(len(part)), np.diff(np.r_[starts, len(ids)]))
            vx = m.factors[ids] * x[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            q = np.add.reduceat(vx * vx, starts, axis=0)
            margin = m.bias + np.add.reduceat(m.linear[ids] * x, starts) + 0.5 * (s * s - q).sum(axis=1)
            slope = ((_sigmoid(margin) - good[part]) / len(part)).astype(np.float32)
            own, place = np.unique(ids, return_inverse=True)
            gw = np.bincount(place, slope[row] * x, len(own)).astype(np.float32) + decay * m.linear[own]
            gv = np.zeros((len(own), rank), np.float32)
            np.add.at(gv, place, (slope[row] * x)[:, None] * (s[row] - vx))
            gv += decay * m.factors[own]
            past_w[own] += gw * gw
            past_v[own] += gv * gv
            m.linear[own] -= rate * gw / np.sqrt(past_w[own])
            m.factors[own] -= rate * gv / np.sqrt(past_v[own])
            m.bias -= 0.05 * float(slope.sum())
    return m


def _n_chars(docs: DataFrame) -> Column:
    """The table's own count of characters; null, which stands for the text's length, in a table without one."""
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = 6000, key: str = "doc_id", text: str = "text") -> Machine:
    """Learns from about `sample` labelled ids at most, one document each, none of them of fold 0."""
    marked = labels.where("quality is not null").where(remainder(key, folds) != 0).select(F.col(key).alias("key"), F.col("quality").cast("int").alias("good")).dropDuplicates(["key"])
    every = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _n_chars(docs).alias("n_chars")).join(sampled(marked, "key", sample), "key")
    # One text for each label, however many rows share its id: the one of the smallest hash.
    row = F.struct("text", "n_chars", "good")
    rows = every.groupBy("key").agg(F.min_by(row, F.xxhash64("text", "n_chars")).alias("r")).select("key", "r.*")

    def vectors(batches):
        known = WordHashes()
        for pdf in batches:
            stats = [_ratios(t, n) for t, n in zip(pdf["text"], pdf["n_chars"], strict=True)]
            words = [_words(t, known) for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"].array.astype(str), "good": pdf["good"].array, "stats": stats, "ids": [i.tobytes() for i, _ in words], "x": [x.tobytes() for _, x in words]})

    found = rows.mapInPandas(vectors, "key string, good int, stats array<double>, ids binary, x binary").toPandas().sort_values("key", ignore_index=True)
    stats = np.array(found["stats"].tolist(), float).reshape(-1, STATS)
    words = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for i, x in zip(found["ids"], found["x"], strict=True)]
    return train(stats, words, found["good"].to_numpy(dtype=np.float32))


def quality_scores(docs: DataFrame, machine: Machine, folds: int = 5, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for every document."""
    kind = dict(docs.dtypes)[key]
    machine_of = sent(docs.sparkSession, machine)

    def run(batches):
        m, known = machine_of(), WordHashes()
        for pdf in batches:
            scores = [np.empty(0)]
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                stats = np.array([_ratios(t, n) for t, n in zip(part["text"], part["n_chars"], strict=True)], float)
                words = [_words(t, known) for t in part["text"]]
                scores.append(_sigmoid(m.margins(*_vectors(stats, m, words)).astype(float)))
            yield pd.DataFrame({"key": pdf["key"].array, "held_out": pdf["held_out"].array, "score": np.concatenate(scores)})

    rows = docs.select(F.col(key).alias("key"), (remainder(key, folds) == 0).alias("held_out"), F.col(text).alias("text"), _n_chars(docs).alias("n_chars"))
    out = rows.mapInPandas(run, f"key {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("key", key)
