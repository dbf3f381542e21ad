"""Session helpers shared by the operators: table access, shared storage, fresh column names."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.session import shared_dir


def ensure_importable(spark: SparkSession) -> None:
    """Ship this package to the Python workers, unless they find it as the driver does.

    Workers inherit PYTHONPATH and the working folder, not a ``sys.path`` changed by the driver.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sc = spark.sparkContext
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if getattr(sc, "_weft_shipped", False) or root in {os.path.realpath(p) for p in known if p} or "site-packages" in root:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="weft-code-"), "weft.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "weft")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._weft_shipped = True


#: Bytes of an Arrow batch; both a task's JVM side and its Python worker hold some batches.
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches follow bytes, not rows alone: texts and sets may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_importable(spark)
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Places of intermediate tables, by application.
_MADE: dict[str, list[str]] = {}


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once the results that read them are stored."""
    jvm, made = spark.sparkContext._jvm, _MADE.pop(spark.sparkContext.applicationId, [])
    for place in made:
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Shuffle partitions that share a file of a small table.
SHARED_FILE = 8


def written(spark: SparkSession, df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back (survives the loss of executors).

    A ``small`` table (keys, counts, labels: some bytes for each key) is written by fewer tasks, so
    that many partitions do not make as many tiny files.
    """
    path = new_path(spark, label)
    out = df.coalesce(max(SHARED_FILE, int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARED_FILE)) if small else df
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that clash with none of df's, case ignored."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name, n = f"__{stem}", 0
        while name.lower() in taken:
            n += 1
            name = f"__{stem}{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def by_name(df: DataFrame, name: str):
    """A column reference that survives dots and back-ticks in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def position(df: DataFrame, name: str) -> int:
    """Where a column stands, as Spark resolves names: case does not matter."""
    at = [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    return df.columns.index(name) if name in df.columns else at[0]


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; extra columns can't clash."""
    return docs.select(by_name(docs, id_col).cast("long").alias("doc_id"), by_name(docs, text_col).cast("string").alias("text"))
