"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a new temporary folder if driver and tasks are one process
    (tests), else an error: other machines could not read such a folder."""
    found = spark.sparkContext.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{_KEY} names no folder that the cluster shares")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


class Scratch:
    """Tables of one run of an operator.  keep() writes a table and reads it again, which cuts its lineage and lets a
    lost executor's work be read back by others; drop() removes one that nothing needs any more.  What a result still
    reads is removed when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/verdigris-{uuid.uuid4().hex}"
        self.n = 0
        path, files = self._files(self.root)
        files.deleteOnExit(path)

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def append(self, table: DataFrame, df: DataFrame) -> DataFrame:
        """The kept table with the rows of df, of the same columns, written beside its own: one scan, however often it
        grows.  df may read the table."""
        df.select(*table.columns).write.mode("append").parquet(table._scratch_path)
        out = self.spark.read.schema(table.schema).parquet(table._scratch_path)
        out._scratch_path = table._scratch_path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path, files = self._files(df._scratch_path)
            files.delete(path, True)


def bounded(df: DataFrame, most: int) -> bool:
    """Whether a table has at most so many rows; counts no further than that."""
    return df.limit(most + 1).count() <= most
