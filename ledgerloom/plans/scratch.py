"""Where intermediate tables go when an iterative plan cuts its lineage.

An iterative operator writes each round as a Parquet table in the folder that the
session names in ``spark.checkpoint.dir`` and reads it back.  The folder is shared by all
executors, so a lost executor costs a re-read and no recomputation.  Only a local session
without that setting gets a folder of its own.  A run's tables are dropped when later rounds no
longer need them, all others when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder for local sessions without one."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables of one operator run; ``drop`` frees those a later round no longer reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(root)
        files.deleteOnExit(root)

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and read it back, without its lineage."""
        path = f"{self.root}/{self.n:04d}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def cut_counting(self, df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
        """``cut``, and how many rows meet the condition, counted while they are written."""
        seen = Observation()
        out = self.cut(df.observe(seen, F.count_if(condition).alias("n")))
        return out, seen.get["n"]

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by ``cut`` that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(conf).delete(path, True)
