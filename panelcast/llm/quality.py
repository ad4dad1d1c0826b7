"""Quality scores by a regularised quadratic discriminant on document statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from operator import add, eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.shared import table

FEATURES = (
    "words",
    "word_length",
    "upper",
    "marks",
    "digits",
    "distinct",
    "repeats",
    "line_length",
    "wide",
)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
#: Marks other than the full stops, commas and quotes of plain prose.
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'\"()-:;?")


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text: square roots of shares, logarithms of sizes."""
    text = text or ""
    raw = text.encode()
    words = text.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    share = lambda drop: math.sqrt((len(raw) - len(raw.translate(None, drop))) / size)
    return [
        math.log1p(len(words)),
        math.log1p(len(text) / n),
        share(_UPPER),
        share(_MARKS),
        share(_DIGITS),
        math.log1p(len(set(words))) / math.log1p(n),
        math.sqrt(sum(map(eq, words, islice(words, 1, None))) / n),
        math.log1p(len(text) / (1 + text.count("\n"))),
        math.sqrt((len(raw) - len(text)) / size),
    ]


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(statistics, na_action=None)

    return of(text)


@dataclass(frozen=True)
class ClassDensity:
    """One class: mean, inverse Cholesky factor of its covariance, log constant with the prior."""

    mean: np.ndarray
    whiten: np.ndarray
    constant: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.whiten.T
        return self.constant - 0.5 * np.einsum("ij,ij->i", z, z)


@dataclass(frozen=True)
class Discriminant:
    """Both classes; a class without training rows leaves the score at the other's side."""

    low: ClassDensity | None
    high: ClassDensity | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            side = 0.5 if self.low is self.high else float(self.high is not None)
            return np.full(len(x), side)
        gap = np.clip(self.high.log_density(x) - self.low.log_density(x), -700, 700)
        return 1 / (1 + np.exp(-gap))


def class_moments(rows: DataFrame) -> DataFrame:
    """Count, means and covariances of each label: one mergeable row a class and task."""
    k = len(FEATURES)
    x = [F.col("x")[i] for i in range(k)]
    return rows.groupBy("label").agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(c) for c in x]).alias("mean"),
        F.array(*[F.covar_pop(x[i], x[j]) for i in range(k) for j in range(i + 1)]).alias("lower"),
    )


def discriminant(moments: list, to_pooled: float = 0.1, to_spherical: float = 0.02) -> Discriminant:
    """Class covariances shrunk to the pooled one, and that sum to a multiple of the unit matrix."""
    k = len(FEATURES)
    found = {}
    for row in moments:
        s = np.zeros((k, k))
        s[np.tril_indices(k)] = row["lower"]
        found[row["label"]] = (row["n"], np.array(row["mean"]), s + np.tril(s, -1).T)
    total = sum(n for n, _, _ in found.values())
    pooled = reduce(add, (n * s for n, _, s in found.values()), np.zeros((k, k))) / max(total, 1)
    densities = {}
    for label, (n, mean, s) in found.items():
        s = (1 - to_pooled) * s + to_pooled * pooled
        s = (1 - to_spherical) * s + (to_spherical * np.trace(s) / k + 1e-6) * np.eye(k)
        factor = np.linalg.cholesky(s)
        log_det = 2 * np.log(np.diag(factor)).sum()
        densities[label] = ClassDensity(mean, np.linalg.inv(factor), math.log(n / total) - 0.5 * log_det)
    return Discriminant(densities.get(0), densities.get(1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Fit on all rows of ``docs`` that carry a label of 0 or 1; null labels are no labels.

    Statistics are taken where the texts lie, so no text is moved to its label.
    """
    marked = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label IN (0, 1)")
    rows = docs.select("doc_id", statistics_column(F.col("text")).alias("x")).join(marked, "doc_id")
    return discriminant(class_moments(rows).collect())


def score_column(model: Discriminant, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if texts.empty:
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.array([statistics(t) for t in texts])))

    return score(text)


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor, F.lit(-1))


def score_quality(docs: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """Every row with ``score`` and ``predicted``; only the text decides.

    A null text scores as an empty one. Equal texts score equally, repeated rows stay,
    an empty table stays empty.
    """
    scored = docs.withColumn("score", score_column(model, F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def train(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """The model of the queries: labels of the folds 1 to 4 of 5."""
    return fit(docs, labels.where(remainder("doc_id", 5) != 0))


def op3_quality_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, with the held-out fold marked."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_quality(docs, train(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
