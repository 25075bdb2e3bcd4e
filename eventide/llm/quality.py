"""Quality by a regularised quadratic discriminant.

Each class is a normal distribution over transformed statistics of a document, with its own
mean and a covariance shrunk towards the pooled one and towards its diagonal.  The score is
the logistic function of the difference of the two log-densities and priors; Mahalanobis
distances use Cholesky factors that are computed once.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_texts, table, written

#: Share of the pooled covariance in a class's, and of the diagonal in the result.
POOLED, DIAGONAL = 0.1, 0.05
THRESHOLD = 0.5
#: Kneecap of the difference of log-densities, so that no score is exactly 0 or 1.
MOST = 35.0

STATISTICS = [
    "size", "words", "word_size", "upper", "digits", "symbols", "stops", "spaces", "lines", "line_size",
    "distinct_words", "distinct_lines", "common_word", "symbol_words", "packed", "long_words",
]

_KIND = np.zeros(256, np.int8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in "!\"#$%&*+/:;<=>@[\\]^_`{|}~"]] = 3
_KIND[[ord(c) for c in ".,?'()-"]] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5

FEATURES = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a text, in the order of STATISTICS; finite for every text."""
    n = len(text)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=6) if n else np.zeros(6, int)
    words, lines = text.split(), text.split(b"\n")
    m = len(words)
    counted: dict[bytes, int] = {}
    for w in words:
        counted[w] = counted.get(w, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, m)
    last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    share = lambda k: math.sqrt(int(kinds[k]) / max(1, n))
    packed = len(zlib.compress(text, 1)) / max(1, n) if n else 0.0
    return [
        math.log1p(n), math.log1p(m), math.log1p(float(sizes.mean()) if m else 0.0), share(1), share(2), share(3), share(4), share(5),
        math.log1p(len(lines)), math.log1p(n / len(lines)),
        math.log1p(len(counted)) - math.log1p(m), math.log1p(len(set(lines))) - math.log1p(len(lines)),
        math.sqrt(max(counted.values(), default=0) / max(1, m)), math.sqrt(int((_KIND[last] == 3).sum()) / max(1, m)),
        math.log1p(min(packed, 4.0)), math.sqrt(int((sizes > 14).sum()) / max(1, m)),
    ]


class Discriminant:
    """Of class 0 and 1: log prior, mean and the Cholesky factor of the covariance."""

    def __init__(self, counts, sums, squares, pooled: float = POOLED, diagonal: float = DIAGONAL):
        n = np.maximum(counts, 1e-9)
        means = sums / n[:, None]
        scatter = squares - np.einsum("k,ki,kj->kij", n, means, means)
        within = scatter.sum(0) / max(1.0, counts.sum())
        self.parts = []
        for k in (0, 1):
            own = scatter[k] / max(1.0, counts[k])
            cov = (1 - pooled) * own + pooled * within
            cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-6 * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.parts.append((math.log((counts[k] + 0.5) / (counts.sum() + 1)), means[k], np.linalg.inv(factor), np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = [prior - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) - size for prior, mean, inverse, size in self.parts]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -MOST, MOST)))


def document_statistics(docs: DataFrame) -> DataFrame:
    return map_texts(docs, lambda _, ids, texts: {"doc_id": ids, "x": [statistics(t) for t in texts]}, FEATURES)


def fit(features: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Sums over all learnable labelled rows; None unless both classes occur."""
    d = len(STATISTICS)
    learn = labels.where(F.col("quality").isin(0, 1) & ~held_out(3, 1)).select("doc_id", "quality")
    pairs = features.join(learn, "doc_id")

    def partial(frames):
        total = np.zeros((2, 1 + d + d * d))
        for frame in frames:
            x, y = np.stack(frame["x"].to_numpy()), frame["quality"].to_numpy()
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate(([len(z)], z.sum(0), (z.T @ z).ravel()))
        yield pd.DataFrame({"k": np.repeat([0, 1], total.shape[1]), "i": np.tile(np.arange(total.shape[1]), 2), "v": total.ravel()})

    sums = pairs.select("x", "quality").mapInPandas(partial, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((2, 1 + d + d * d))
    total[sums["k"], sums["i"]] = sums["v"]
    if not total[:, 0].all():
        return None
    return Discriminant(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts are scored by their statistics, all of which are then 0 or nearly so.
    Without labels of both classes every score is 0.5.  Equal rows get equal scores.
    An empty table gives no rows; of the columns only doc_id and text (doc_id and quality of labels) are read, so others may have any names.
    """
    features = written(document_statistics(docs), "statistics")
    model = fit(features, labels)

    def run(frames):
        for frame in frames:
            x = np.stack(frame["x"].to_numpy()) if len(frame) else np.zeros((0, len(STATISTICS)))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": model.score(x) if model else np.full(len(x), 0.5)})

    scored = features.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
