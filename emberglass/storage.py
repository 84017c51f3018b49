"""Intermediate tables in the folder that all executors share.

Long lineages are cut by writing Parquet under ``spark.checkpoint.dir``; a lost executor then costs a re-read and no
recomputation. The setting is read from the session. Only where it is unset, as in tests on a local master, a
temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='emberglass-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_roots: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def clean() -> None:
    """Deletes the tables of all calls so far. It runs when the application ends; results not yet read are lost by it."""
    while _roots:
        path, spark = _roots.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone by then
            return


class Scratch:
    """Tables of one operator call, each written once and read back from the shared folder.

    Results are read from them lazily, so they stay until the application ends, unless drop() is called before.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _roots[self.root] = spark

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = self.path(f"{name}-{self._n}")
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")  # what is written is read from there: its shuffles can go
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Deletes what save() wrote for df; call it once nothing reads df any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(self.spark, path)
