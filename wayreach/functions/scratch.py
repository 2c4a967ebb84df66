"""Intermediate tables in the cluster's shared checkpoint folder.

Loops and multiply-used results are written once as Parquet below
``spark.checkpoint.dir`` and read back. That cuts the lineage, survives the loss
of executors, and gives the planner true sizes for the following joins.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
# Whether shuffle files go when the query that wrote them ends; else they stay until the driver's heap is collected.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Folders made for local sessions that name none, by application id.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; a throw-away one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getConf().get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="run-wayreach-")
    return _local_folders[context.applicationId]


class Scratch:
    """One run's tables below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._serial = 0
        self._paths: dict[int, str] = {}

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back."""
        path = self.path(label)
        before = self.spark.conf.get(SHUFFLES_GO)
        self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(SHUFFLES_GO, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = path
        return kept

    def replace(self, old: DataFrame, df: DataFrame, label: str = "t") -> DataFrame:
        """Keep ``df``, then remove the table ``old`` that it was computed from."""
        new = self.keep(df, label)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(old)))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return new

    def path(self, label: str) -> str:
        self._serial += 1
        return f"{self.root}/{self._serial:04d}-{label}"
