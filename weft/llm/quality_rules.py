"""Quality rules: base rules, then gradient-boosted trees over document statistics."""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import _batch as B
from weft.llm import _stats as S
from weft.llm import gbt
from weft.llm._shared import by_name, id_text, position, written
from weft.plans.session import by_size

#: Labelled rows of a partition while the trees are fitted.
BLOCK_ROWS = 1 << 15
#: The part of good training documents (out of fold) that the threshold must keep.
KEEP_GOOD = 0.998
FOLDS = 4
#: The direction in which a feature may push the score of a document.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "same_next_rate": -1, "shout_rate": -1, "caps_word_rate": -1, "long_word_rate": -1}


class Rules:
    def __init__(self, forest: gbt.Forest, threshold: float):
        self.forest, self.threshold = forest, threshold

    def verdicts(self, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base_failed, score, kept) of documents by their statistics."""
        failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
        score = self.forest.score(S.ratios(s)[1])
        return failed, score, ~failed & (score >= self.threshold)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row of docs."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in B.slices(batch.column(1)):
                s = S.document_stats(data, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(s[k]) for k in S.COLUMNS)], names=["doc_id", *S.COLUMNS])

    return id_text(docs).mapInArrow(B.tidy(run), "doc_id bigint, " + ", ".join(f"{k} bigint" for k in S.COLUMNS))


def labelled(stats: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """y (1 for label 1, else 0), fold and statistics of every labelled row."""
    y = labels.select(by_name(labels, "doc_id").cast("long").alias("i"), by_name(labels, label).cast("int").alias("y")).where("i is not null and y is not null")
    rows = stats.join(by_size(y.groupBy("i").agg(F.max("y").alias("y"))), F.col("doc_id") == F.col("i"))
    return rows.select((F.col("y") == 1).cast("int").alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), *S.COLUMNS)


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return S.ratios({k: batch.column(k).to_numpy() for k in S.COLUMNS})[1]


def cuts_of(rows: DataFrame, n: int, features: int) -> list[np.ndarray]:
    """``gbt.cuts_of`` over a table: values are counted by key, so no task holds more than a feature's keys."""

    def counted(batches):
        for batch in batches:
            x = _features(batch)
            for j in range(features):
                key, many = np.unique(gbt.keys(x[:, j]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), j)), pa.array(key), pa.array(many)], names=["feature", "key", "many"])

    keys = rows.mapInArrow(B.tidy(counted), "feature bigint, key bigint, many bigint").groupBy("feature", "key").agg(F.sum("many").alias("many"))
    upto = keys.withColumn("upto", F.sum("many").over(Window.partitionBy("feature").orderBy("key")))
    bin_of = lambda c: F.least(F.floor(c * gbt.BINS / n), F.lit(gbt.BINS - 1))
    ends = upto.where(bin_of(F.col("upto")) > bin_of(F.col("upto") - F.col("many"))).select("feature", "key").toPandas()
    return [gbt.highest(np.sort(ends["key"][ends["feature"] == j].to_numpy(np.int64))) for j in range(features)]


class _Spread:
    """``gbt.Blocks`` as a persisted RDD."""

    def __init__(self, rdd):
        self.rdd, self.before = rdd.persist(StorageLevel.MEMORY_AND_DISK), None

    def total(self, part, add=np.add):
        out = self.rdd.map(part).treeReduce(add)
        if self.before is not None:
            self.before.unpersist()
            self.before = None
        return out

    def change(self, part):
        self.before, self.rdd = self.rdd, self.rdd.map(part).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self):
        self.rdd.unpersist()


def base_rules() -> Rules:
    """The base rules alone."""
    names, x = S.ratios({k: np.zeros(0, np.int64) for k in S.COLUMNS})
    return Rules(gbt.fit(x, np.zeros(0), [0] * len(names), trees=0), -1.0)


def train(docs: DataFrame, labels: DataFrame, *, keep_good: float = KEEP_GOOD) -> Rules:
    """Fit on every labelled document."""
    return fit(statistics(docs), labels, keep_good=keep_good)


def fit(stats: DataFrame, labels: DataFrame, *, keep_good: float = KEEP_GOOD) -> Rules:
    """Fit on every labelled row of ``statistics``; the threshold comes from the out-of-fold scores of all good ones.

    The models of all folds and the last one grow together, a sum over all rows for each level of a tree. The threshold
    is the least score of its key, so at least ``keep_good`` of the good rows reach it. Without labels of both classes
    nothing is rejected beyond the base rules.
    """
    spark = stats.sparkSession
    rows = written(spark, labelled(stats, labels, "quality"), "labelled", small=True)
    by_fold = {f: (n, ones) for f, n, ones in rows.groupBy("fold").agg(F.count("*"), F.sum("y")).collect()}
    n, ones = (sum(v[k] for v in by_fold.values()) for k in range(2))
    if not 0 < ones < n:
        return base_rules()
    names = S.ratios({k: np.zeros(0, np.int64) for k in S.COLUMNS})[0]
    cuts = cuts_of(rows, n, len(names))
    left_out = [by_fold.get(f, (0, 0)) for f in range(FOLDS)] + [(0, 0)]
    counts = [(n - a, ones - b) for a, b in left_out]
    bases = [gbt.base_value(*c) for c in counts]

    def packed(batches):
        for batch in batches:
            y, fold = (batch.column(k).to_numpy() for k in ("y", "fold"))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(gbt.block(_features(batch), y, fold, cuts, bases))])], names=["block"])

    blocks = _Spread(rows.repartition(-(-n // BLOCK_ROWS)).mapInArrow(B.tidy(packed), "block binary").rdd.map(lambda r: pickle.loads(r[0])))
    try:
        forest = gbt.boost(blocks, cuts, counts, [MONOTONE.get(k, 0) for k in names])[-1]

        def good_keys(b: gbt.Block) -> Counter:
            key, many = np.unique(gbt.keys(gbt.squashed(b.raw[b.fold, np.arange(len(b.fold))])[b.y == 1]), return_counts=True)
            return Counter(dict(zip(key.tolist(), many.tolist(), strict=True)))

        good = sorted(blocks.total(good_keys, lambda a, b: a + b).items())
    finally:
        blocks.release()
    upto = np.cumsum([many for _, many in good])
    key = good[int(np.searchsorted(upto, int((1 - keep_good) * ones), "right"))][0]
    return Rules(forest, min(0.5, float(gbt.lowest(np.array(key)))))


def judge(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, n_words, the base statistics, base_failed, score, kept for every row of docs.

    Null texts have no words and fail the base rules, as empty ones do; repeated rows are each
    reported; an empty table gives an empty table; other columns are not read.
    """
    return judged(statistics(docs), rules)


def judged(stats: DataFrame, rules: Rules) -> DataFrame:
    """``judge`` for rows of ``statistics``."""

    def run(batches):
        for batch in batches:
            failed, score, kept = rules.verdicts({k: batch.column(k).to_numpy() for k in S.COLUMNS})
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("doc_id", *S.BASE)), pa.array(failed), pa.array(score), pa.array(kept)],
                names=["doc_id", *S.BASE, "base_failed", "score", "kept"]
            )

    return stats.mapInArrow(B.tidy(run), "doc_id bigint, " + ", ".join(f"{k} bigint" for k in S.BASE) + ", base_failed boolean, score double, kept boolean")


def kept_rows(docs: DataFrame, rules: Rules, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, repeated rows each.

    Null and empty texts have no words and go, whatever their id; null ids do not matter.
    """
    at = position(docs, text_col)

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in B.slices(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(rules.verdicts(S.document_stats(data, off))[2]))

    return docs.mapInArrow(B.tidy(run), docs.schema)
