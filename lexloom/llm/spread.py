"""Spreading rows over the cluster before work in Python."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan in at least three tasks a core. Inputs of enough splits stay as they are; small ones
    are shuffled by ``key``, so that a file of one row group does not end up in one task. ``df`` must
    be a scan with narrow steps only: counting its splits then runs nothing."""
    return df if df.rdd.getNumPartitions() >= 12 * df.sparkSession.sparkContext.defaultParallelism else scattered(df, key)


def scattered(df: DataFrame, key: str) -> DataFrame:
    """``df`` shuffled by ``key`` into at least three tasks a core, which are not merged again."""
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


@contextmanager
def partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Joins and groupings that run inside have at least ``n`` partitions. Unlike a repartitioning by
    hand, adaptive execution may still split those of hot keys, and merge small ones."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(n, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run inside are removed when the query ends, not when the driver
    happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
