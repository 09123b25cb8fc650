"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector shared by all ordered thresholds. Features are the
distinct words of a text and their five-letter prefixes. The model is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows that the fit takes at most (drawn by a hash of their id): the bound of the classifier's sample.
TRAIN_ROWS = 12_000
#: The classifier's choice of features, made on that sample: rows that have it, at least, and standard deviations by which the
#: share of grades above the least among them differs from that of all rows. However many pass are used.
LEAST_ROWS, LEAST_Z = 4, 3.0
PREFIX = 5
ROUNDS, RATE, PENALTY = 250, 0.1, 2e-4
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct words in lower case, and the prefixes of longer ones with a mark."""
    found = set(_WORD.findall((text or "").lower()))
    return found | {w[:PREFIX] + "*" for w in found if len(w) > PREFIX}


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]

    def chances(self, texts: list[str | None]) -> np.ndarray:
        """(texts, grades): probability of each grade."""
        get = self.weights.get
        linear = np.array([sum(w for f in features(t) if (w := get(f))) for t in texts], dtype=float)
        below = 1 / (1 + np.exp(-np.clip(np.array(self.thresholds)[None, :] - linear[:, None], -60, 60)))
        edges = np.concatenate([np.zeros((len(texts), 1)), below, np.ones((len(texts), 1))], axis=1)
        return np.diff(edges, axis=1)


def fit(rows: np.ndarray, cols: np.ndarray, n_cols: int, grades: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam, with a step that falls to zero, on the penalised log likelihood; rows and cols are the ones of a 0/1 matrix."""
    n, steps = len(grades), int(grades.max())
    share = np.array([(grades <= k).mean() for k in range(steps)])
    first = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
    gaps = np.log(np.maximum(np.diff(first), 1e-3))
    params = np.concatenate([np.zeros(n_cols), first[:1], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        w = params[:n_cols]
        thetas = np.concatenate([params[n_cols : n_cols + 1], params[n_cols] + np.cumsum(np.exp(params[n_cols + 1 :]))])
        linear = np.bincount(rows, w[cols], minlength=n)
        padded = np.concatenate([[-np.inf], thetas, [np.inf]])
        up, low = padded[grades + 1] - linear, padded[grades] - linear
        s_up, s_low = 1 / (1 + np.exp(-np.clip(up, -60, 60))), 1 / (1 + np.exp(-np.clip(low, -60, 60)))
        s_up, s_low = np.where(np.isposinf(up), 1, s_up), np.where(np.isneginf(low), 0, s_low)
        p = np.maximum(s_up - s_low, 1e-12)
        d_up, d_low = s_up * (1 - s_up) / p, s_low * (1 - s_low) / p
        grad = np.zeros_like(params)
        grad[:n_cols] = np.bincount(cols, (d_up - d_low)[rows], minlength=n_cols) / n + PENALTY * w
        by_theta = np.array([(d_low[grades == k + 1].sum() - d_up[grades == k].sum()) / n for k in range(steps)])
        grad[n_cols] = by_theta.sum()
        for k in range(steps - 1):
            grad[n_cols + 1 + k] = by_theta[k + 1 :].sum() * np.exp(params[n_cols + 1 + k])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - RATE * (1 - (t - 1) / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    thetas = np.concatenate([params[n_cols : n_cols + 1], params[n_cols] + np.cumsum(np.exp(params[n_cols + 1 :]))])
    return params[:n_cols], thetas


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``rows`` rows of labels(doc_id, grade) that have a document; null ids and grades don't count.

    grade is 0, 1, 2, ...; the model has a threshold below each grade up to the largest, whether or not all occur. Labels without
    a document use nothing up; a doc_id that documents repeat counts once, with the text that sorts first. Without two
    grades every text gets the only one (0 without any).
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drawn = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("long").alias("grade"))
        .where("doc_id is not null and grade >= 0")
        .distinct()
        .join(texts.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "grade")
        .limit(rows)
    )
    sample = texts.join(F.broadcast(drawn), "doc_id")  # at most TRAIN_ROWS small rows
    sample = sample.groupBy("doc_id", "grade").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches):
        for batch in batches:
            found = [sorted(features(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "grade", "found"])

    table = sample.mapInArrow(run, "doc_id long, grade long, found array<string>").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    grades = table["grade"].to_numpy()
    if len(set(grades.tolist())) < 2:
        only = int(grades[0]) if len(grades) else 0
        return Model({}, [-60.0] * only + [60.0])
    found = table["found"].combine_chunks()
    names = found.flatten().dictionary_encode()
    cols, sizes = names.indices.to_numpy(), np.diff(found.offsets.to_numpy())
    at = np.repeat(np.arange(len(grades)), sizes)
    df = np.bincount(cols, minlength=len(names.dictionary))
    toxic = grades > grades.min()
    inside = np.bincount(cols[toxic[at]], minlength=len(df))
    share = toxic.mean()
    z = np.abs(inside - share * df) / np.sqrt(share * (1 - share) * df)
    order = np.flatnonzero((df >= LEAST_ROWS) & (z >= LEAST_Z))
    number = np.full(len(df), -1)
    number[order] = np.arange(len(order))
    keep = number[cols] >= 0
    at, cols = at[keep], number[cols[keep]]
    weights, thresholds = fit(at, cols, len(order), grades)
    words = names.dictionary.take(pa.array(order)).to_pylist()
    return Model({w: float(x) for w, x in zip(words, weights) if abs(x) > 1e-4}, thresholds.tolist())


def score(model: Model, docs: DataFrame) -> DataFrame:
    """doc_id, severity (expected grade), toxic_chance (of grade 1 or more), toxic (chance >= 0.5), a row for each row."""

    def run(batches):
        for batch in batches:
            chance = model.chances(batch.column(1).to_pylist())
            toxic = 1 - chance[:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chance @ np.arange(chance.shape[1])), pa.array(toxic), pa.array(toxic >= 0.5)],
                names=["doc_id", "severity", "toxic_chance", "toxic"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, toxic_chance double, toxic boolean")


def severities(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Fits on labels(doc_id, grade) and scores every whole text. Null and empty texts have no feature and get the score
    of none. Repeated rows give a row each, an empty table none; other columns are ignored."""
    return score(train(docs, labels, rows), docs)
