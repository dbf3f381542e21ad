"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import _batch as B
from weft.llm import _stats as S
from weft.llm._shared import by_name, id_text

#: Weights of the pooled covariance and of its diagonal in each class covariance.
POOLED, DIAGONAL = 0.3, 0.1
#: Features are summed as whole numbers of 1 / SCALE: exact, so in any order the same.
SCALE = 1 << 16
#: A row is held out where crc32 of its id as text leaves this remainder.
FOLDS, HELD_OUT = 3, 1


def transformed(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rates through a logarithm that spreads small values; one row per document."""
    names, x = S.ratios(s)
    keep = [k for k, name in enumerate(names) if name.endswith("_rate")]
    rates = np.log(x[:, keep] + 0.01)
    rest = np.column_stack([x[:, names.index("log_words")], np.log1p(x[:, names.index("word_length")]), x[:, names.index("words_per_line")]])
    return np.column_stack([rates, rest])


class Discriminant:
    """log N(x; m1, S1) - log N(x; m0, S0) + log prior odds, by Cholesky factors kept once.

    Built from counts, sums and cross products of the classes (exact integers of features times
    SCALE). A class without rows takes the other's mean and covariance, so that only the prior
    odds speak.
    """

    def __init__(self, count: np.ndarray, total: np.ndarray, square: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL):
        count, total, square = (np.asarray(x, object) for x in (count, total, square))
        means, covs = [], []
        for n, s, q in zip(count, total, square):
            n = max(int(n), 1)
            means.append((s / n).astype(float) / SCALE)
            covs.append(((q * n - s[:, None] * s[None, :]) / (n * n)).astype(float) / SCALE**2)
        self.mean, cov, number = np.array(means), np.array(covs), count.astype(float)
        both = (cov * number[:, None, None]).sum(0) / max(number.sum(), 1)
        for k in (0, 1):
            if not number[k]:
                self.mean[k], cov[k] = self.mean[1 - k], both
        spread = np.diag(np.diag(both))
        cov = (1 - pooled - diagonal) * cov + pooled * both + diagonal * spread + 1e-4 * np.eye(cov.shape[1])
        self.covariance = cov
        factors = [np.linalg.cholesky(c) for c in cov]
        self.factor = [np.linalg.inv(f) for f in factors]
        self.log_det = [2 * np.log(np.diag(f)).sum() for f in factors]
        self.odds = float(np.log((number[1] + 1) / (number[0] + 1)))

    def gap(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.mean, self.factor, self.log_det)]
        return density[1] - density[0] + self.odds

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log odds between 0 and 1, even odds at 0.5.

        They are squashed by their square root, which keeps signs and order: the statistics of a
        document depend on each other more than the densities say, so these are no probabilities.
        """
        gap = self.gap(x)
        return 1 / (1 + np.exp(-np.clip(np.sign(gap) * np.sqrt(np.abs(gap)) * 2, -30, 30)))


def remainder(column):
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % FOLDS


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and the feature vector of every row; null texts have that of empty ones, repeated rows are each there."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in B.slices(batch.column(1)):
                x = transformed(S.document_stats(data, off))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["doc_id", "x"])

    return id_text(docs).mapInArrow(B.tidy(run), "doc_id bigint, x array<double>")


def fit(features: DataFrame, labels: DataFrame, *, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """Class counts, sums and cross products of all labelled rows that are not held out.

    A few hundred numbers per class reach the driver, whatever the number of rows. Null labels
    and ids do not count; a class without rows gets the other's mean and covariance.
    """
    y = labels.select(
        by_name(labels, "doc_id").cast("long").alias("i"), by_name(labels, "quality").cast("int").alias("y")
    ).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    rows = features.where(remainder(F.col("doc_id")) != HELD_OUT).join(y, F.col("doc_id") == F.col("i")).select("y", "x")

    def sums(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                y = np.asarray(part.column(0))
                x = np.rint(np.asarray(part.column(1).flatten()).reshape(len(y), -1) * SCALE).astype(np.int64)
                for k in (0, 1):
                    a = x[y == k]
                    flat = np.concatenate([[len(a)], a.sum(0), (a.T @ a).ravel()])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)],
                        names=["k", "at", "v"]
                    )

    got = rows.mapInArrow(B.tidy(sums), "k int, at int, v bigint").groupBy("k", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    d = transformed(S.document_stats(np.zeros(0, np.uint8), np.zeros(2, np.int64))).shape[1]
    flat = np.zeros((2, 1 + d + d * d), object)
    for r in got:
        flat[r["k"], r["at"]] = int(r["v"])
    return Discriminant(flat[:, 0], flat[:, 1 : 1 + d], flat[:, 1 + d :].reshape(2, d, d), pooled, diagonal)


def scored(features: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score, predicted for every row (empty texts too)."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            s = model.score(np.asarray(batch.column(1).flatten()).reshape(n, -1)) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    out = features.mapInArrow(B.tidy(run), "doc_id bigint, score double")
    return out.select("doc_id", (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
