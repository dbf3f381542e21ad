"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weft.llm import dart_minhash, decontaminate, line_dedup, quality_rules, sp_codec
from weft.llm._shared import ensure_importable, new_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.kept_rows(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds are cut from later ones."""
    ensure_importable(spark)
    return line_dedup.deduplicated(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    ensure_importable(spark)
    return dart_minhash.one_of_each(spark, docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    ensure_importable(spark)
    return sp_codec.encode_decode(docs, str(public_tokenizers.path("piece_bpe_32k.model"))).drop("n_bytes")


STAGES = [
    ("quality rules", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks), ("SentencePiece encoding", tokens)
]

#: Boosted trees and byte-pair merges have no SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_path(spark, f"pipeline-{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
