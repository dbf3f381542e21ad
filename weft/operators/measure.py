"""Statistics of repeated measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values of a group are counted, not kept one by one; beyond so many use ``accuracy``.
EXACT = None


def statistics(samples: DataFrame, by: list[str], value: Column, accuracy: int | None = EXACT) -> DataFrame:
    """by, n, least, mean, p50, p95, most of each group.

    Percentiles lie between the two nearest values in proportion. With ``accuracy`` they are
    approximate (off by n / accuracy ranks) in bounded memory. Null values do not count.
    """
    part = (lambda p: F.percentile_approx("v", F.lit(p), F.lit(accuracy))) if accuracy else (lambda p: F.percentile("v", F.lit(p)))
    rows = samples.select(*by, value.cast("double").alias("v")).where("v is not null")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.avg("v").alias("mean"), part(0.5).alias("p50"), part(0.95).alias("p95"),
        F.max("v").alias("most")
    )
