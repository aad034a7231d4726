"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w . x - t_k): the weights w of the hashed text are shared by all grades, and the thresholds
t_1 <= t_2 <= ... are ordered. The sum of these tail probabilities is the expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, free_name

#: Lengths in bytes of the text runs that are hashed.
RUNS = (1, 2, 4)


def buckets(text: str | None, dims: int) -> list[np.ndarray]:
    """The hash bucket of every run of bytes in a text, an array for each length of run; dims is a power of 2."""
    data = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
    out = []
    for n in RUNS:
        if len(data) < n:
            continue
        code = np.full(len(data) - n + 1, n, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) ^ data[k : len(data) - n + 1 + k]
        code *= np.uint32(0x9E3779B1)
        out.append(code >> np.uint32(32 - int(dims).bit_length() + 1))
    return out


def features(text: str | None, dims: int) -> np.ndarray:
    """The square roots of the frequencies of the buckets, in half precision; zeros for an empty text."""
    x = np.zeros(dims, np.float32)
    for part in buckets(text, dims):
        x += np.bincount(part, minlength=dims).astype(np.float32) / len(part)
    return np.sqrt(x).astype(np.float16)


@dataclass
class OrdinalModel:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.weights)


def fit_quality(
    rated: DataFrame,
    text_col: str = "text",
    rating_col: str = "quality",
    key: tuple[str, ...] = ("doc_id",),
    max_docs: int = 6_000,
    dims: int = 4096,
    steps: int = 150,
    ridge: float = 1e-4,
    seed: int = 10,
) -> OrdinalModel:
    """The model of a bounded sample of ``max_docs`` rated rows; grades are the distinct non-null ratings, in order.

    Features are made on the executors; the driver gets a row of them for each row of the sample and takes the steps.
    Null ratings are passed over, a null text counts as empty, repeated rows count as often as they occur.
    With no rating or only one, all weights are 0 and the only grade is expected throughout.
    """
    rows = rated.filter(F.col(rating_col).isNotNull())
    sample = bounded_sample(rows, [*key, text_col], max_docs, seed)

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(x, dims).tobytes() for x in texts])

    got = sample.select(F.col(rating_col).cast("double").alias("y"), of(F.col(text_col)).alias("x")).toPandas()
    grades = sorted(set(got["y"]))
    if len(grades) < 2:
        return OrdinalModel(grades, np.zeros(dims), np.zeros(0))
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(len(got), dims).astype(np.float32)
    above = np.array([[float(y >= g) for g in grades[1:]] for y in got["y"]], np.float32)
    return OrdinalModel(grades, *_descend(x, above, steps, ridge))


def _descend(x: np.ndarray, above: np.ndarray, steps: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the summed log loss of the tails; ordered thresholds are a first one and positive steps."""
    n, k = above.shape
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(x.shape[1]), [start[0]], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, first, gaps = theta[:-k], theta[-k], np.exp(theta[len(theta) - k + 1 :])
        cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
        p = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32))[:, None] - cuts, -30, 30)))
        err = (p - above) / n
        by_cut = -err.sum(axis=0)
        tail = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate([x.T @ err.sum(axis=1).astype(np.float32) + ridge * w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-k], theta[-k] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(theta) - k + 1 :]))])


def score_quality(docs: DataFrame, model: OrdinalModel, tail_from: float, text_col: str = "text", out: str = "quality") -> DataFrame:
    """Adds ``out``, struct<expected, tail>: the expected grade and the probability of a grade of ``tail_from`` or more.

    Both are null if the model has no grade. A null text counts as empty; whole texts count, however long. Each row is read by
    itself, so repeated rows get equal results and an empty table stays empty. The columns of ``docs`` stay; if one is called
    ``out``, the new one gets an underscore more.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.grades, model.weights, model.thresholds))

    @F.pandas_udf("expected double, tail double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grades, weights, cuts = shared.value
        for texts in batches:
            dot = np.array([float(features(x, len(weights)).astype(np.float64) @ weights) for x in texts])
            tails = 1 / (1 + np.exp(-np.clip(dot[:, None] - cuts, -30, 30)))
            if grades:
                expected = grades[0] + tails @ np.diff(grades)
                k = sum(g < tail_from for g in grades)
                tail = np.ones(len(texts)) if k == 0 else np.zeros(len(texts)) if k == len(grades) else tails[:, k - 1]
            else:
                expected = tail = [None] * len(texts)
            yield pd.DataFrame({"expected": expected, "tail": tail})

    return docs.withColumn(free_name(docs, out), of(F.col(text_col)))
