"""As-of joins: each row with the last row of another table at or before its time, by key.

Both tables are united and sorted in ranges of (key, time), so a key of very many rows spans ranges. Inside a range the
last right row is carried forward; what a range ends with, a row for each key in it, is carried over to the ranges
behind. No window is over a whole key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.plans.session import cut


def asof(left: DataFrame, right: DataFrame, key: str, time: str, ranges: int | None = None) -> DataFrame:
    """left's columns and ``found``: a struct of right's other columns and ``time``, null where no row is early enough.

    Right rows of the same key and time count as earlier than a left row; of several at one time the greatest (compared as
    a struct) is found. Rows with a null key or time find nothing and are not found; repeated left rows are each answered.
    """
    others = [c for c in right.columns if c not in (key, time)]
    row = F.struct(F.col(time).alias(time), *others)
    none = F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType)
    lefts = left.select(F.col(key).alias("_key"), F.col(time).alias("_at"), F.lit(1).alias("_side"), none.alias("_right"), F.struct(*left.columns).alias("_left"), F.rand(5).alias("_tie"))
    empty = F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType)
    rights = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).alias("_key"), F.col(time).alias("_at"), F.lit(0).alias("_side"), row.alias("_right"), empty.alias("_left"), F.rand(6).alias("_tie")
    )
    by = ["_key", "_at", "_side", "_tie"]  # the last spreads rows of one key and time
    both = lefts.unionByName(rights)
    ranged = both.repartitionByRange(*by) if ranges is None else both.repartitionByRange(ranges, *by)
    ranged = cut(ranged.withColumn("_range", F.spark_partition_id()))
    # Structs begin with the time, so the greatest one so far is the last row; sides are sorted right before left.
    seen = F.max("_right").over(W.partitionBy("_range", "_key").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow))
    inside = ranged.withColumn("_own", seen)
    ends = ranged.groupBy("_key", "_range").agg(F.max("_right").alias("_end"))
    before = ends.select("_key", "_range", F.max("_end").over(W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_before")).where("_before is not null")
    out = inside.where("_side = 1").join(before, ["_key", "_range"], "left")
    found = F.when(F.col("_key").isNotNull() & F.col("_at").isNotNull(), F.greatest("_own", "_before"))
    return out.select("_left.*", found.alias("found"))
