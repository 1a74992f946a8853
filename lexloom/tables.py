"""Reading tables of a data folder and cutting lineage through tables on shared storage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: dict[str, SparkSession] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where none is set a
    local session, such as in tests, gets a new temporary folder; on a cluster that is an error, as
    executors would not see each other's files."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone, and its folder with it
            pass
    _LEFT.clear()


atexit.register(_sweep)


class Scratch:
    """Intermediate tables on shared storage. They survive the loss of executors, carry exact
    sizes for the planner and cut the lineage of iterative plans. Tables that are still needed
    lazily stay until the driver process ends; ``drop`` removes the others at once."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        _LEFT[path] = self.spark
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """The table ``name``, new or standing, with the rows of ``df`` added."""
        path = f"{self.root}/{name}"
        _LEFT[path] = self.spark
        df.write.mode("append").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = f"{self.root}/{name}"
        _delete(self.spark, path)
        _LEFT.pop(path, None)
