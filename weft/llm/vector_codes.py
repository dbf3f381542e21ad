"""Product quantisation of embeddings, its codebooks fitted by Lloyd rounds that move only what changed.

The assignments of a round are a table, and so are the running sums of the entries. A part whose nearest entry is
the one of the round before sends nothing; one that moved takes itself off the old entry's sums and adds itself to the
new one's, summed up in its task first. All of it is whole numbers, so the order of the sums cannot matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm._batch import tidy
from weft.llm._shared import by_name, written
from weft.llm.vectors import whole_vectors
from weft.llm.whitening import matrix

#: Parts of a vector, entries of a part's codebook (at most 256), rounds of Lloyd's method.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Below this all sums in a squared distance are whole numbers that doubles hold.
EXACT = 1 << 22


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, length): the rows of the least ids, null ids last, equal ids by their vectors."""
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()  # no more than entries
    lengths = {len(r["x"]) for r in rows}
    if len(lengths) > 1 or any(n % parts for n in lengths):
        raise ValueError(f"vectors of {sorted(lengths)} entries do not make {parts} equal parts")
    x = np.array([r["x"] for r in rows], np.int64).reshape(len(rows), parts, max(lengths, default=0) // parts)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of rows (m, parts, length); the lower index wins a tie."""
    m, parts, _ = x.shape
    codes, errors = np.zeros((m, parts), np.uint8), np.zeros((m, parts), np.int64)
    small = max(np.abs(x).max(initial=0), np.abs(books).max(initial=0)) * x.shape[2] < EXACT
    for p in range(parts):
        a, c = x[:, p], books[p]
        if small:
            # |a - c|^2 less |a|^2, which is the same for all entries.
            near = ((c * c).sum(1).astype(float) - 2.0 * (a.astype(float) @ c.T.astype(float))).argmin(1)
        else:
            best, near = np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64)
            for k, entry in enumerate(c):
                apart = ((a - entry) ** 2).sum(1)
                near = np.where(apart < best, k, near)
                best = np.minimum(apart, best)
        codes[:, p], errors[:, p] = near, ((a - c[near]) ** 2).sum(1)
    return codes, errors


def _rows(column: pa.Array, books: np.ndarray) -> np.ndarray:
    parts, _, length = books.shape
    if len(column.flatten()) != len(column) * parts * length:
        raise ValueError(f"a vector has not {parts * length} entries")
    return matrix(column, parts * length).reshape(-1, parts, length)


def _binary(codes: np.ndarray) -> pa.Array:
    m, width = codes.shape
    offsets = np.arange(0, (m + 1) * width, width, dtype=np.int32) if m else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(codes.tobytes())])


def assign(state: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, x, before, code: every part's nearest entry now, and what it was in ``state`` (null at first)."""
    label = state.schema["label"]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), label, T.StructField("x", T.ArrayType(T.LongType())), T.StructField("before", T.BinaryType()), T.StructField("code", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = _binary(nearest(_rows(b.column("x"), books), books)[0])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), b.column("before"), code], ["vec_id", "label", "x", "before", "code"])

    return state.select("vec_id", "label", "x", "before").mapInArrow(tidy(run), schema)


def contributions(assigned: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, at, delta: plus and minus of the parts that moved, a row for each sum a task changes; at -1 counts."""
    parts, entries, length = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, length + 1), np.int64)
        for b in batches:
            x, m = _rows(b.column("x"), books), b.num_rows
            after = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(m, parts)
            fresh = np.array([v is None for v in b.column("before").to_pylist()], bool)
            before = np.frombuffer(b"".join(v or bytes(parts) for v in b.column("before").to_pylist()), np.uint8).reshape(m, parts)
            one = np.concatenate([np.ones((m, parts, 1), np.int64), x], 2)
            for p in range(parts):
                moved = fresh | (after[:, p] != before[:, p])
                np.add.at(sums[p], after[moved, p], one[moved, p])
                gone = moved & ~fresh
                np.subtract.at(sums[p], before[gone, p], one[gone, p])
        p, e, at = np.nonzero(sums)
        if len(p):
            yield pa.RecordBatch.from_pydict({"part": p.astype(np.int32), "entry": e.astype(np.int32), "at": at.astype(np.int32) - 1, "delta": sums[p, e, at]})

    moved = assigned.where("before is null or before <> code").select("x", "before", "code")
    return moved.mapInArrow(tidy(run), "part int, entry int, at int, delta long")


def fit_codebooks(spark: SparkSession, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """The codebooks after all rounds, and the state that the last one left: vec_id, label, x, before."""
    books = first_codebooks(vectors, parts, entries)
    state, running = vectors.withColumn("before", F.lit(None).cast("binary")), None
    for _ in range(rounds if books.size else 0):
        assigned = written(spark, assign(state, books), "assigned")
        moved = contributions(assigned, books)
        sums = (moved if running is None else running.unionByName(moved)).groupBy("part", "entry", "at").agg(F.sum("delta").alias("delta"))
        running = written(spark, sums, "running-sums", small=True)
        total = np.zeros((books.shape[0], books.shape[1], books.shape[2] + 1), np.int64)
        for r in running.collect():  # a codebook's size
            total[r["part"], r["entry"], r["at"] + 1] = r["delta"]
        n = total[:, :, :1]
        books = np.where(n > 0, total[:, :, 1:] // np.maximum(n, 1), books)
        state = assigned.select("vec_id", "label", "x", F.col("code").alias("before"))
    return books, state


def coded(state: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (hex), error: every row by the final codebooks."""
    label = state.schema["label"]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), label, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, errors = nearest(_rows(b.column("x"), books), books)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _binary(codes), pa.array(errors.sum(1))], ["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "x").mapInArrow(tidy(run), schema).withColumn("code", F.lower(F.hex("code")))


def compress(
    spark: SparkSession, df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row with a whole vector.

    Rows with a null or empty vector, or a null, NaN, infinite or huge entry, are left out (``whole_vectors``). Vectors of
    several lengths, or of one that ``parts`` doesn't divide, are an error. Repeated rows count as often as they
    come; rows of fewer than ``entries`` vectors make smaller codebooks; null ids are the last to start an
    entry; null labels are one label. No rows, no result. More columns are not read.
    """
    named = df.select(by_name(df, id_col).alias("vec_id"), by_name(df, vector_col).alias("embedding"), by_name(df, label_col).alias("label"))
    books, state = fit_codebooks(spark, whole_vectors(named, "label"), parts, entries, rounds)
    if not books.size:
        schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return spark.createDataFrame([], schema)
    rows = written(spark, coded(state, books), "coded")
    # A table of its own, so that both sides of the join are exchanges, whose large partitions Spark may split.
    by_label = written(spark, rows.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")), "label-errors", small=True)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("same"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
