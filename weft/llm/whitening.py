"""Whitening of embeddings by a tall-skinny QR factorisation; no covariance is formed to find the components.

Rows are centred with exact integer sums, each partition is brought to its triangular factor R block by block, factors
are merged over a tree, and the right singular vectors of the last one are the components. What reaches the
driver (sums, one R) is bounded by the dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm._batch import tidy
from weft.llm._shared import written
from weft.llm.vectors import dimensions, whole_vectors

#: Factors merged in one task of the tree.
FAN_IN = 8
#: Components that are returned.
COMPONENTS = 4
#: Low bits of an entry that are summed apart, so that sums of any number of rows stay exact.
LOW_BITS = 14


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column whose lists are all of length d."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def fit_list(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """x: each distinct vector once, written. Copies are counted out before the shuffle."""
    return written(spark, vectors.select("x").distinct(), "distinct-vectors")


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = matrix(b.column(0), d)
            n, high, low = n + len(x), high + (x >> LOW_BITS).sum(0), low + (x & (1 << LOW_BITS) - 1).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(d), pa.int32()), "n": [n] * d, "high": high, "low": low})

    parts = fit.mapInArrow(tidy(run), "at int, n long, high long, low long")
    rows = parts.groupBy("at").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).collect()  # d rows
    sums = [0] * d
    for r in rows:
        sums[r["at"]] = (r["high"] << LOW_BITS) + r["low"]
    return (rows[0]["n"] if rows else 0), sums


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, from the whole numbers n * x - S wherever these fit."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return (n * x - np.array(sums, np.int64)) / n
    whole, rest = zip(*(divmod(s, n) for s in sums))
    return (x - np.array(whole, np.int64)) - np.array([r / n for r in rest])


def triangle(fit: DataFrame, n: int, sums: list[int], d: int) -> np.ndarray:
    """R of the centred rows: by blocks in each partition, then FAN_IN to one over a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, d))
        for b in batches:
            r = np.linalg.qr(np.vstack([r, centred(matrix(b.column(0), d), n, sums)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": [r.tobytes()]})

    def merged(factors: pa.Table) -> pa.Table:  # FAN_IN of them at most
        r = np.vstack([np.frombuffer(raw).reshape(-1, d) for raw in factors["r"].to_pylist()])
        return pa.table({"part": pa.array([factors["part"][0].as_py() // FAN_IN], pa.int64()), "r": [np.linalg.qr(r, mode="r").tobytes()]})

    left = fit.rdd.getNumPartitions()
    factors = fit.mapInArrow(tidy(run), "part long, r binary")
    while left > 1:
        left = -(-left // FAN_IN)
        factors = factors.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(merged, "part long, r binary")
    rows = factors.collect()  # one, or none
    return np.frombuffer(rows[0]["r"]).reshape(-1, d) if rows else np.zeros((0, d))


@dataclass
class Whitening:
    """n and S of the fit list; unit components as columns by falling eigenvalue; the sum of all eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows whitened; NaN along a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.eigenvalues > 0, centred(x, self.n, self.sums) @ self.components / np.sqrt(self.eigenvalues), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None beyond 64 bits."""
        s, n = np.array(self.sums, object), self.n
        squares = (x * x).sum(1).astype(object)
        if max(map(abs, self.sums), default=0) * int(np.abs(x).max(initial=0)) * max(len(self.sums), 1) < 1 << 62:
            crossed = (x @ s.astype(np.int64)).astype(object)
        else:
            crossed = x.astype(object) @ s
        return [v if v < 1 << 63 else None for v in n * n * squares - 2 * n * crossed + (s * s).sum()]


def fit_whitening(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The first components of a written list of distinct vectors; an empty list has n 0 and none."""
    n, sums = exact_sums(fit, d) if d else (0, [])
    k = min(components, d)
    if not n:
        return Whitening(0, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    _, s, vt = np.linalg.svd(triangle(fit, n, sums, d))
    s = np.concatenate([s, np.zeros(d - len(s))])
    s[s <= s[0] * max(n, d) ** 0.5 * np.finfo(float).eps] = 0  # what rounding alone makes
    return Whitening(n, sums, np.ascontiguousarray(vt[:k].T), s[:k] ** 2 / n, float((s**2).sum() / n))


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained of each row and component; other columns don't pass."""
    shares = [e / model.trace if model.trace else 0.0 for e in model.eigenvalues]
    k, d = len(shares), len(model.sums)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = matrix(b.column("x"), d), b.num_rows
            if m and k:
                y = model.project(x).ravel()
                yield pa.RecordBatch.from_arrays([
                    b.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)), pa.array([v for v in model.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(y, mask=np.isnan(y)), pa.array(np.tile(shares, m))
                ], schema=schema)

    return vectors.select("vec_id", "x").mapInArrow(tidy(run), "vec_id long, component int, n long, deviation long, whitened double, explained double")


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity, over components with variance."""
    live = [c for c, e in enumerate(model.eigenvalues) if e > 0]
    d = len(model.sums)
    if not live:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = model.project(matrix(b.column(0), d))
            yield pa.RecordBatch.from_pydict({f"y{c}": y[:, c] for c in live})

    y = fit.mapInArrow(tidy(run), ", ".join(f"y{c} double" for c in live))
    pairs = [(a, b) for a in live for b in live if a <= b]
    row = y.agg(*(F.covar_pop(f"y{a}", f"y{b}") for a, b in pairs)).first()  # centred before it multiplies
    return max(abs(v - (a == b)) for v, (a, b) in zip(row, pairs))


def whiten(spark: SparkSession, df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries count as whole steps of 1/256. Rows with a null or empty vector, or a null, NaN, infinite or huge entry, are
    left out, and vectors of several lengths are an error (``whole_vectors``, ``dimensions``). The components are
    fitted on each distinct vector once and applied to every row, repeated rows and null ids too. There are as many
    components as asked, or as dimensions; along one without variance ``whitened`` is null. A ``deviation`` beyond 64 bits
    is null. No rows, no result. More columns are not read.
    """
    vectors = whole_vectors(df, id_col=id_col, vector_col=vector_col)
    fit = fit_list(spark, vectors)
    model = fit_whitening(fit, dimensions(fit), components)
    return whitened(vectors, model).withColumn("identity_error", F.lit(identity_error(fit, model)).cast("double"))
