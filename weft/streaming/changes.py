"""Edge changes as a stream: batches coalesce to one rebuild, and event-time counts per window.

A change is (ts, op 'add' | 'remove', a_gid, b_gid).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGES = "ts timestamp, op string, a_gid string, b_gid string"


def coalesced(changes: DataFrame) -> DataFrame:
    """The last change of each unordered pair."""
    pair = changes.select("ts", "op", F.least("a_gid", "b_gid").alias("a_gid"), F.greatest("a_gid", "b_gid").alias("b_gid"))
    return pair.groupBy("a_gid", "b_gid").agg(F.max_by("op", F.struct("ts", "op")).alias("op"))


def applied(links: DataFrame, changes: DataFrame) -> DataFrame:
    """links after a batch of changes."""
    last = coalesced(changes)
    low = links.select(F.least("a_gid", "b_gid").alias("a_gid"), F.greatest("a_gid", "b_gid").alias("b_gid"))
    kept = low.join(last.select("a_gid", "b_gid"), ["a_gid", "b_gid"], "left_anti")
    return kept.unionByName(last.where("op = 'add'").select("a_gid", "b_gid"))


def on_batches(stream: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Start a query that calls ``rebuild`` once for each batch, with the batch's coalesced changes."""
    writer = stream.writeStream.foreachBatch(lambda df, n: rebuild(coalesced(df), n)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def replayed(table: DataFrame, at: str, path: str, rows: int = 1_000_000) -> DataFrame:
    """A table as a stream in order of its column ``at``, a few files of about ``rows`` rows a batch.

    A stream takes files by their modification times, which tell nothing of the times inside; more than two batches of
    files that overlap in time would leave rows out as late. So the table is written once to ``path`` in sorted ranges,
    one file for each, and the files are dated in that order.
    """
    spark, place = table.sparkSession, f"{path}/log"
    table.repartitionByRange(max(1, -(-table.count() // rows)), at).write.parquet(place)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    newest = fs.getFileStatus(folder).getModificationTime()
    for k, file in enumerate(files):
        fs.setTimes(file, newest - 1000 * (len(files) - k), -1)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 4).parquet(place)


def window_table(stream: DataFrame, path: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Run ``windowed`` over all that a stream has now; the windows' last counts, from a table under ``path``.

    Each batch adds the windows it changed, with its number, so a batch that is run twice changes
    nothing; the newest row of a window counts.
    """
    spark = stream.sparkSession
    got = windowed(stream, length, late, slide)
    schema = got.withColumn("batch", F.lit(0).cast("long")).schema

    def add(df: DataFrame, n: int) -> None:
        df.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/n={n}")

    got.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")
    return rows.groupBy("window", "op").agg(F.max_by("n", "batch").alias("n"))


def windowed(stream: DataFrame, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Changes per window and op; events later than ``late`` are left out."""
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), "op").agg(F.count(F.lit(1)).alias("n"))
