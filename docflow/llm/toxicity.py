"""Toxicity by logistic regression on hashed words, word pairs and skip-grams, learnt by FTRL-proximal.

A bounded sample of the labelled rows is dealt over shards; each learns its own weights
and Spark sums them by coordinate into their mean. FTRL's per-coordinate rates and L1
leave few weights other than 0, so what is broadcast for scoring is small. The mean of
the shards' biases is off; it is set anew on labelled rows kept out of the training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm import text as X
from docflow.llm.common import fold, stash

#: Features are hashed to 2 ** 40 coordinates: with few weights, chance hits are rare even in very long texts.
SPACE = np.uint64((1 << 40) - 1)
BIAS = -1


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled sample, of which a fold sets the bias and the others train.

    There is a shard for each shard_rows of it, shards at most. A coordinate counts in a
    shard from min_rows texts on.
    """

    max_rows: int = 20_000
    shards: int = 8
    shard_rows: int = 2_500
    passes: int = 12
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    min_rows: int = 4
    folds: int = 5


def features(c: X.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of words, pairs of neighbours and pairs around one word, and the row of each."""
    keys = c.word_keys()
    pairs, at = X.runs(keys, c.row, 2)
    _, far = X.runs(keys, c.row, 3)
    skips = X.mix(keys[far] * X.STEPS[3] + keys[far + 2] * X.STEPS[1])
    return (np.concatenate([keys, pairs, skips]) & SPACE).astype(np.int64), np.concatenate([c.row, c.row[at], c.row[far]])


class Ftrl:
    """FTRL-proximal over coordinates 0..n-1; the last is the bias, which has no penalty."""

    def __init__(self, n: int, s: Settings):
        self.s, self.z, self.n = s, np.zeros(n + 1), np.zeros(n + 1)
        self.l1 = np.full(n + 1, s.l1)
        self.l1[n] = 0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, s = self.z[at], self.s
        return np.where(np.abs(z) <= self.l1[at], 0, -(z - np.sign(z) * self.l1[at]) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2))

    def learn(self, at: np.ndarray, y: float) -> None:
        at = np.append(at, len(self.z) - 1)
        w, n = self.weights(at), self.n[at]
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def fitted(texts: pa.Array, labels: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights other than 0 learnt from one shard's texts, in their order."""
    found, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in X.chunks(texts, lower=True):
        f, row = features(c)
        both = np.unique(np.stack([row, f]), axis=1) if len(f) else np.zeros((2, 0), np.int64)
        rows.append(both[0] + c.first)
        found.append(both[1])
    found, rows = np.concatenate(found), np.concatenate(rows)
    names, which, n = np.unique(found, return_inverse=True, return_counts=True)
    common = n >= s.min_rows
    place = np.cumsum(common) - 1
    kept = common[which]
    which, rows = place[which[kept]], rows[kept]
    bounds = np.searchsorted(rows, np.arange(len(labels) + 1))
    model = Ftrl(int(common.sum()), s)
    for _ in range(s.passes):
        for i, y in enumerate(labels):
            model.learn(which[bounds[i] : bounds[i + 1]], y)
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    return np.append(names[common], BIAS)[at], w[at]


def labelled(docs: DataFrame, labels: DataFrame, s: Settings, text: str = "text") -> DataFrame:
    """doc_id, text, y: the training sample.

    Labels of the fold 0 are left out. A document labelled more than once has the
    majority's label, 1 if they are even; null labels don't count. Above max_rows, rows
    are taken by a hash of their id with the chance max_rows / rows.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", s.folds) != 0))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    n = known.count()
    if n > s.max_rows:
        known = known.where(F.pmod(F.xxhash64(F.col("_id"), F.lit(7)), F.lit(1 << 20)) < (1 << 20) * s.max_rows // n)
    rows = F.broadcast(known)  # about max_rows rows of 12 bytes
    texts = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return texts.join(rows, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")


def trained(sample: DataFrame, s: Settings) -> dict[int, float]:
    """coordinate: weight, the mean of the shards' weights by their rows; empty without rows."""

    def shard(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        at, w = fitted(rows["text"].combine_chunks(), rows["y"].to_numpy(), s)
        return pa.table({"at": pa.array(at, pa.int64()), "w": pa.array(w * len(rows), pa.float64()), "rows": pa.array(np.full(len(at), len(rows)), pa.int64())})

    taught = sample.where(fold("doc_id", s.folds) != 1)
    shards = min(s.shards, max(1, taught.count() // s.shard_rows))
    rows = taught.select("doc_id", "text", "y", F.xxhash64(F.col("doc_id"), F.lit(1)).alias("order"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
    parts = rows.groupBy("shard").applyInArrow(shard, "at long, w double, rows long")
    # every shard has a bias, so the rows of all are those of the bias
    summed = parts.groupBy("at").agg(F.sum("w").alias("w"), F.sum("rows").alias("rows")).orderBy("at").toArrow()
    found = dict(zip(summed["at"].to_pylist(), summed["w"].to_pylist(), strict=True))
    total = sum(n for at, n in zip(summed["at"].to_pylist(), summed["rows"].to_pylist(), strict=True) if at == BIAS)
    if not total:
        return {}
    weights = {at: w / total for at, w in found.items()}
    held = scored(sample.where(fold("doc_id", s.folds) == 1), weights, ["y"])
    weights[BIAS] -= calibrated(held.select("y", F.ln(F.col("score") / (1 - F.col("score"))).alias("logit")))
    return weights


def calibrated(held: DataFrame) -> float:
    """The logit from which on the label 1 is predicted with the best F1, in the middle of equally good ones; 0 without both labels."""
    rows = held.groupBy("y", F.round(F.col("logit") * 20).cast("int").alias("bin")).count().toArrow()  # logits lie within 35 of 0
    n = np.zeros((2, 1402))
    n[rows["y"].to_numpy(), rows["bin"].to_numpy() + 700] = rows["count"].to_numpy()
    if not n.any(axis=1).all():
        return 0.0
    right, wrong = (x[::-1].cumsum()[::-1] for x in (n[1], n[0]))
    f1 = 2 * right / (right + wrong + n[1].sum())
    best = np.flatnonzero(np.isclose(f1, f1.max()))
    return float((best[0] + best[-1] - 1401) / 2 / 20)


def scored(docs: DataFrame, weights: dict[int, float], keep: list[str], text: str = "text") -> DataFrame:
    """keep and score of each row's whole text; empty and null texts have the bias alone, and all score 0 without weights."""
    shared = docs.sparkSession.sparkContext.broadcast((np.array([k for k in weights if k != BIAS], np.int64), np.array([w for k, w in weights.items() if k != BIAS]), weights.get(BIAS, 0.0 if weights else -35.0)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        for batch in batches:
            sums = [np.zeros(0)]
            for c in X.chunks(batch.column(len(keep)), lower=True):
                total = np.full(c.rows, bias)
                if len(at):
                    f, row = features(c)
                    place = np.minimum(np.searchsorted(at, f), len(at) - 1)
                    hit = at[place] == f
                    both = np.unique(row[hit] * len(at) + place[hit])  # a feature counts once a text
                    total += c.per_row(both // len(at), w[both % len(at)])
                sums.append(total)
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(sums), -35, 35)))
            yield X.passed(batch, keep, {"score": pa.array(score, pa.float64())})

    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField("score", T.DoubleType())])
    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(work, schema)


def predicted(score: Column) -> Column:
    return (score >= 0.5).cast("int")


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, held_out, score and predicted of each row of docs, learnt from labels(doc_id, toxic).

    Only texts are inputs of a score. Equal texts score alike; repeated rows are scored
    each; an empty table gives an empty result.
    """
    weights = trained(stash(labelled(docs, labels, settings, text), "labelled"), settings)
    rows = scored(docs, weights, ["doc_id"], text)
    return rows.select("doc_id", (fold("doc_id", settings.folds) == 0).alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))
