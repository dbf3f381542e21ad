"""Lineage cuts for iterative operators, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A folder of this machine stands in for it only where executors run on this machine too.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="weft-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


#: Places in the shared folder, and names of tables there, by application.
_MADE: dict[str, list[tuple[str, str | None]]] = {}
#: Spark allows no more buckets.
MOST_BUCKETS = 100_000


def shared_path(spark: SparkSession, label: str, table: str | None = None) -> str:
    """A new place in the shared folder, until ``release``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append((path, table))
    return path


def release(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder, once the results that read it are stored."""
    jvm = spark.sparkContext._jvm
    for place, table in _MADE.pop(spark.sparkContext.applicationId, []):
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The lineage ends here: the rows are written to the shared folder, once, and read back.

    As Parquet, which takes a fraction of a checkpoint's bytes where columns repeat, and which is computed once.
    """
    return stored(df)


def stored(df: DataFrame) -> DataFrame:
    """A table written to the shared folder as Parquet and read back: for what is read often, by columns."""
    path = shared_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table of at most so many rows goes to a join by broadcast.
SMALL = 100_000


def by_size(df: DataFrame) -> DataFrame:
    """A table as the side of a join: by broadcast if it has few rows.

    Spark does not know the size of rows made by the driver or of what is derived from files; by files' bytes alone
    it sends millions of short rows through the driver, and moves the large side of a join with three types.
    """
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df.hint("merge")


#: Rows of a table that one task makes distinct.
DISTINCT_ROWS = 250_000


def distinct_of(df: DataFrame, rows: int) -> DataFrame:
    """The distinct rows of a table of counted rows, by as many tasks as keep a task's memory the same at any size.

    Where few rows repeat, ``distinct`` alone fills a hash table with a whole split before the rows are moved, and another
    one after it with what the session's partitions leave to a task.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // DISTINCT_ROWS))
    return df.repartition(n, *df.columns).distinct()


def stored_buckets(df: DataFrame, by: list[str], then: list[str]) -> DataFrame:
    """A table in the shared folder, bucketed by ``by`` and sorted by that and ``then``, one file for each bucket.

    There are as many buckets as shuffle partitions, so a join on ``by`` moves its other side alone.
    """
    spark = df.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    name = f"weft_{uuid.uuid4().hex}"
    path = shared_path(spark, "buckets", name)
    df.repartition(n, *by).write.format("parquet").option("compression", "zstd").bucketBy(n, *by).sortBy(*by, *then).option("path", path).saveAsTable(name)
    return spark.table(name)


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs started inside carry the tag; ``cancel`` from another thread ends them."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> list[str]:
    """End what runs under the tag; the operations that were ended."""
    return list(spark.interruptTag(tag))
