"""Token ids as a binary store: shared zstandard dictionary, one frame per document.

A dictionary is trained on serialised id arrays; each document's ids (little-endian uint32) are
compressed as a frame of its own with it. Frames lie one behind the other in shards, in
ascending doc_id order; a shard row keeps the dictionary's hash, and for every document its id,
offset, and token count, so one short document is read without its neighbours. The store is
written by Spark's own writer (any file system Spark reaches); ``shard`` rows are

    bucket, shard, dict_sha256, doc_ids[], offsets[] (n+1), n_tokens[], frames (binary)

and ``dictionary`` holds one row: dict_sha256, dictionary bytes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import _batch as B
from weft.llm._shared import id_text, new_path
from weft.llm.word_cache import WordEncoder

END_ID = 2
DICT_BYTES = 64 << 10
#: The dictionary is fitted on at most so many whole texts, none of more bytes than this.
DICT_TEXTS, DICT_TEXT_BYTES = 400, 16 << 10
#: Where rows without an id lie among the buckets: before all ids.
NO_ID = -(1 << 63)
SHARD_BYTES = 4 << 20
BUCKET_ROWS = 50_000
LEVEL = 1

SHARD = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("dict_sha256", T.StringType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("n_tokens", T.ArrayType(T.LongType())),
    T.StructField("frames", T.BinaryType()),
])


def train_dictionary(samples: list[bytes]) -> bytes:
    """Dictionary bytes; a raw-content dictionary where there is too little to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def _bounds(rows: DataFrame, n: int) -> list[int]:
    got = rows.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(NO_ID)), F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(10_000)).alias("b")).first()["b"] if n > 1 else []
    return sorted(got or [])


def _buckets(key: np.ndarray, bounds: np.ndarray, at: int) -> np.ndarray:
    """The bucket of each id, ``at`` rows into the partition.

    An id that many rows have, or no id, is a bound more than once; its rows take turns over the buckets
    between, which changes no order of ids.
    """
    first, last = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
    turn = first + (np.arange(at, at + len(key)) % np.maximum(last - first + 1, 1))
    return np.where(last - first > 1, turn, last).astype(np.int32)


def write_store(
    spark: SparkSession, docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None,
) -> None:
    """Encode every row of docs and write the store under ``path``.

    Null texts count as empty (the end id alone); repeated rows are each stored, next to each
    other; a null doc_id sorts first; an empty table makes a store without shards. Only the
    compressed frames are shuffled: buckets are ranges of doc_id whose bounds come from the ids.
    """
    rows = id_text(docs, id_col, text_col)
    encoder = WordEncoder.get(tokenizer_path)
    fitting = rows.where(F.octet_length("text") <= DICT_TEXT_BYTES).orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = fitting.select("text").limit(DICT_TEXTS).toLocalIterator()
    dictionary = train_dictionary(encoder.encode([(r[0] or "").encode() for r in sample]))
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    # Buckets follow the number of rows, whatever the session's number of partitions.
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // BUCKET_ROWS)
    bounds = np.array(_bounds(rows, n), np.int64)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        coder, packer = WordEncoder.get(tokenizer_path), zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value))
        seen = 0
        for batch in batches:
            frames, counts = [], []
            for _, _, data, off in B.slices(batch.column(1)):
                for ids in coder.encode_slice(data, off):
                    frames.append(packer.compress(ids + end))
                    counts.append(len(ids) // 4 + 1)
            key = batch.column(0).to_pandas().astype("Int64")
            bucket = _buckets(key.fillna(NO_ID).to_numpy("int64"), bounds, seen)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), batch.column(0), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())],
                names=["bucket", "doc_id", "n_tokens", "frame"]
            )

    framed = rows.mapInArrow(B.tidy(encode), "bucket int, doc_id bigint, n_tokens bigint, frame binary")
    placed = framed.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "n_tokens", "frame")

    def pack(batches):
        shard, bucket, ids, counts, frames, size = 0, None, [], [], [], 0

        def row():
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in frames])])
            return pa.RecordBatch.from_pylist(
                [{"bucket": bucket, "shard": shard, "dict_sha256": name, "doc_ids": ids, "offsets": offsets.tolist(), "n_tokens": counts, "frames": b"".join(frames)}],
                schema=_SHARD_ARROW
            )

        for batch in batches:
            for b, i, c, f in zip(*(x.to_pylist() for x in batch.columns)):
                if frames and (b != bucket or size >= SHARD_BYTES):
                    yield row()
                    shard, ids, counts, frames, size = (0 if b != bucket else shard + 1), [], [], [], 0
                bucket = b
                ids.append(i)
                counts.append(c)
                frames.append(f)
                size += len(f)
        if frames:
            yield row()

    placed.mapInArrow(B.tidy(pack), SHARD).write.parquet(f"{path}/shards")


_SHARD_ARROW = pa.schema([
    ("bucket", pa.int32()), ("shard", pa.int32()), ("dict_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())),
    ("offsets", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("frames", pa.binary())
])


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    name, data = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(data)
    if hashlib.sha256(data).hexdigest() != name:
        raise ValueError("the store's dictionary does not match its hash")
    return name, data


def read_store(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids before the document in doc_id order), n_tokens, ids_crc32, ids (binary).

    Every frame is decompressed and checked in any case; without ``with_ids`` the ids stay behind.
    """
    name, dictionary = _dictionary(spark, path)
    shared = spark.sparkContext.broadcast(dictionary)
    shards = spark.read.schema(SHARD).parquet(f"{path}/shards")
    # One row per shard, of megabytes each: the running sum goes over buckets first, then inside each.
    totals = shards.groupBy("bucket").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("bucket").collect()
    begin, run = {}, 0
    for r in totals:
        begin[r["bucket"]] = run
        run += r["n"]
    by_shard = shards.select("bucket", "shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    from pyspark.sql import Window as W

    first = by_shard.select(
        "bucket", "shard",
        F.coalesce(F.sum("n").over(W.partitionBy("bucket").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before")
    )

    def unpack(batches):
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != name:
                    raise ValueError("a shard was written with another dictionary")
                data = row["frames"]
                ids = [opener.decompress(data[a:b]) for a, b in zip(row["offsets"], row["offsets"][1:])]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                if counts.tolist() != row["n_tokens"]:
                    raise ValueError("a frame does not hold the tokens its index tells")
                start = begin[row["bucket"]] + row["before"] + np.cumsum(counts) - counts
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(counts), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                columns += [pa.array(ids, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return shards.join(first, ["bucket", "shard"]).mapInArrow(
        B.tidy(unpack), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    )


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with this id, decompressing their frames only."""
    _, dictionary = _dictionary(spark, path)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    at = F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.get("doc_ids", i) == F.lit(doc_id))
    rows = spark.read.schema(SHARD).parquet(f"{path}/shards").where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).select(
        "frames", "offsets", F.explode(at).alias("i")
    )
    frames = rows.select(F.substring(
        "frames", (F.get("offsets", F.col("i")) + 1).cast("int"),
        (F.get("offsets", F.col("i") + 1) - F.get("offsets", F.col("i"))).cast("int")
    ).alias("f"))
    return [np.frombuffer(opener.decompress(bytes(r["f"])), "<u4").tolist() for r in frames.toLocalIterator()]


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, *, with_ids: bool = True) -> DataFrame:
    """Write a store into the shared folder and read it back."""
    path = new_path(spark, "token-store")
    write_store(spark, docs, tokenizer_path, path)
    return read_store(spark, path, with_ids=with_ids)
