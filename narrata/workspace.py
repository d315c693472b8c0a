"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading
it again: the copy survives the loss of any executor, costs no executor
memory and can be larger than the cluster's memory.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of whole texts are large: Spark's default of 10,000 in an Arrow batch would take much memory outside the heap.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_fallback: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one if driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="narrata-")
    return _fallback[app]


class Workspace:
    """A fresh folder for the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/narrata-{label}-{uuid.uuid4().hex[:12]}"
        self._next = 0
        if spark.conf.get(BATCH_ROWS, "10000") == "10000":
            spark.conf.set(BATCH_ROWS, "1000")

    def folder(self, name: str) -> str:
        self._next += 1
        return f"{self.root}/{self._next:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a reader of the written copy."""
        path = self.folder(name)
        df.write.option("compression", "zstd").parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._narrata_path = path
        return saved

    def drop(self, *saved: DataFrame) -> None:
        """Delete tables made by :meth:`save` that nothing reads any more."""
        for df in saved:
            delete(self.spark, df._narrata_path)

    def tidy(self) -> None:
        """Let Spark remove the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder was last written, in milliseconds."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).getModificationTime()
