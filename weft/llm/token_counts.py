"""Token counts through a digest cache.

Content and tokenizer version are named by digests. Texts whose digest is in the cache are
never encoded; of the others one text for each digest is encoded, and its count is appended to
the cache, so that a second run over the same content encodes nothing.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from weft.llm import _batch as B
from weft.llm._shared import id_text, new_path, written
from weft.llm.word_cache import WordEncoder, file_digest

CACHE = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def count_slice(tokenizer_path: str, data, off) -> list[int]:
    if tokenizer_path.endswith(".model"):
        from weft.llm.sp_codec import Codec

        codec, texts = Codec.get(tokenizer_path), list(B.doc_bytes(data, off))
        # Where the rebuilt model cuts a text otherwise than its library, the library counts.
        return [len(x) // 4 if same else len(codec.check.encode(t.decode())) for t, (x, same) in zip(texts, codec.encode(texts))]
    return [len(x) // 4 for x in WordEncoder.get(tokenizer_path).encode_slice(data, off)]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def token_counts(
    spark: SparkSession, docs: DataFrame, tokenizer_path: str, *, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens per row of docs; new digests are appended to ``cache_path``.

    Null texts count as empty (0 bytes, 0 tokens); repeated rows are each reported; other columns
    are not read. Without a cache path a new cache in the shared folder is used. The content is
    digested as it is: white space and case reach the tokenizer, so nothing may be folded.
    """
    path = cache_path or new_path(spark, "token-counts")
    version = file_digest(tokenizer_path)
    rows = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    narrow = written(spark, rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    cached = read_cache(spark, path).where(F.col("tokenizer") == version)
    # One document for each missing digest; min over a narrow pair, combined before the shuffle.
    chosen = narrow.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(cached, "digest", "left_anti")
    texts = rows.join(
        chosen.withColumnRenamed("digest", "d").withColumnRenamed("doc_id", "i"),
        (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_semi"
    )

    def encode(batches):
        for batch in batches:
            counts = []
            for _, _, data, off in B.slices(batch.column(1)):
                counts += count_slice(tokenizer_path, data, off)
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts)), batch.column(0), pa.array(counts, pa.int64())], names=CACHE.names)

    # A repeated row stands for its digest more than once: one count of it is kept.
    texts.select("digest", "text").mapInArrow(B.tidy(encode), CACHE).dropDuplicates(["digest"]).write.mode("append").parquet(path)
    # Two writers may have counted one text: the least count is taken, and written, so that the
    # join can split a digest that a large part of all rows share.
    known = written(spark, read_cache(spark, path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "known-counts")
    return narrow.join(known, "digest").select("doc_id", "n_bytes", "n_tokens")
