"""Links that live while they are renewed: state per pair, timers that end silent ones, sessions of nodes.

The changes of a pair in a grain of time come to its last one before any state is looked at, in a windowed
aggregation that combines before its shuffle, so a pair of very many changes is a row per grain. The processor keeps
one number for a pair, when it was last added. What it tells, a row for each beginning and end of a link, is summed by
node like any table; no node's links are ever in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOVES = "a_gid string, b_gid string, moment timestamp, change int, why string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class LinkLife(StatefulProcessor):
    """Whether a pair is linked, by its changes in order of time; silent for ``silence_ms`` is the same as removed."""

    def __init__(self, silence_ms: int) -> None:
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.added = handle.getValueState("added", "ms long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        stored = self.added.get()
        before = since = stored[0] if stored else None
        for ms, op in sorted((r["ms"], r["op"]) for r in rows):
            if since is not None and ms >= since + self.silence_ms:
                yield self._move(key, since + self.silence_ms, -1, "silent")
                since = None
            if op == "add":
                if since is None:
                    yield self._move(key, ms, 1, "add")
                since = ms
            elif since is not None:
                yield self._move(key, ms, -1, "remove")
                since = None
        if since == before:
            return
        if before is not None:
            self.handle.deleteTimer(before + self.silence_ms)
        if since is None:
            self.added.clear()
        else:
            self.added.update((since,))
            self.handle.registerTimer(since + self.silence_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.added.clear()
        yield self._move(key, expiredTimerInfo.getExpiryTimeInMs(), -1, "silent")

    def close(self) -> None:
        pass

    @staticmethod
    def _move(key: Any, ms: int, change: int, why: str) -> Row:
        return Row(a_gid=key[0], b_gid=key[1], ms=ms, change=change, why=why)


def moves(stream: DataFrame, silence_seconds: int, late: str, grain: str = "1 second") -> DataFrame:
    """A stream of MOVES: a row when a link begins (1, 'add') and when it ends (-1, 'remove' or 'silent').

    A link ends when it is removed, or once it was not added again for ``silence_seconds``. Of a pair's changes in one
    grain the last counts (of several at one instant, 'remove'), at the grain's end. A row is told once no earlier
    change can come, that is ``late`` behind the newest change; changes later than that are left out. The order and the
    batches in which the others come do not matter. Pairs have no direction. Changes without a time, an end or a known
    op are left out, as are those of a node with itself; repeated changes count once. Runs on RocksDB state only
    (``rocks``).
    """
    c = stream.select(
        F.col("ts").cast("timestamp").alias("ts"), "op", F.least("a_gid", "b_gid").alias("a_gid"), F.greatest("a_gid", "b_gid").alias("b_gid")
    ).where("ts is not null and a_gid <> b_gid and op in ('add', 'remove')").withWatermark("ts", late)
    last = c.groupBy(F.window("ts", grain), "a_gid", "b_gid").agg(F.max_by("op", F.struct("ts", "op")).alias("op"))
    last = last.select("a_gid", "b_gid", "op", F.unix_millis("window.end").alias("ms"), F.window_time("window").alias("seen"))
    told = last.groupBy("a_gid", "b_gid").transformWithState(
        LinkLife(1000 * silence_seconds), "a_gid string, b_gid string, ms long, change int, why string", "append", "eventTime"
    )
    return told.select("a_gid", "b_gid", F.timestamp_millis("ms").alias("moment"), "change", "why")


@contextmanager
def rocks(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def table_of(told: DataFrame, path: str) -> DataFrame:
    """Run a stream of appended rows over all that has come, and read all it told so far.

    ``path`` holds its checkpoint and the rows. The sink lists the files of finished batches, so a batch that is run
    again after a failure, or a stream that goes on later, tells nothing twice.
    """
    spark = told.sparkSession
    with rocks(spark):
        q = told.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], told.schema)  # nothing came yet
    return spark.read.schema(told.schema).parquet(f"{path}/rows")


def live_nodes(told: DataFrame) -> DataFrame:
    """gid, degree, last_gid, last_at of every node that ever had a link: its links now, and the last that began.

    Of several that began at one instant the greatest. A node whose links all went silent or were removed has degree 0.
    """
    ends = told.select(F.explode(F.array(F.struct(F.col("a_gid").alias("gid"), F.col("b_gid").alias("other")), F.struct(F.col("b_gid").alias("gid"), F.col("a_gid").alias("other")))).alias("e"), "moment", "change")
    began = F.when(F.col("change") == 1, F.struct("moment", "e.other"))
    per = ends.groupBy("e.gid").agg(F.sum("change").alias("degree"), F.max(began).alias("last"))
    return per.select("gid", "degree", F.col("last.other").alias("last_gid"), F.col("last.moment").alias("last_at"))


def sessions(stream: DataFrame, gap: str, late: str, grain: str = "1 second") -> DataFrame:
    """A stream of gid, began, ended, n: runs of a node's changes, with the times of their first and last, told once none can grow.

    A run ends where the next change's grain ends ``gap`` or more after the last one's. Changes are counted by node and
    grain before runs are looked for, so a node of very many changes sends a row per grain. A change of a node with
    itself counts once; changes without a time are left out, as are null ends; repeated changes all count. Changes
    more than ``late`` behind the newest are left out.
    """
    c = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array_distinct(F.array("a_gid", "b_gid"))).alias("gid"))
    c = c.where("ts is not null and gid is not null").withWatermark("ts", late)
    grains = c.groupBy(F.window("ts", grain), "gid").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))
    # Spark joins sessions that touch; grains end on whole microseconds, so one less keeps apart what lies exactly the gap apart.
    runs = grains.select("gid", "n", "began", "ended", F.window_time("window").alias("at")).groupBy(F.session_window("at", f"{gap} -1 microseconds"), "gid")
    return runs.agg(F.min("began").alias("began"), F.max("ended").alias("ended"), F.sum("n").alias("n")).select("gid", "began", "ended", "n")
