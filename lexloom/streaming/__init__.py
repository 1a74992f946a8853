"""Streams: running states and change detection over deliveries that keep arriving."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.operators.store import upsert_last

STATE_OUT = "key string, state string, n_events bigint, first_at timestamp, last_at timestamp"


def event_states(events: DataFrame) -> DataFrame:
    """Running state per key of a stream ``events (key string, at timestamp, state string)``: state
    of the latest event so far, number of events, first and last time. Rows with a null key are
    left out; of equal times the larger state counts. Keys are states of their own, so they spread
    over the cluster; a batch's events of one key arrive in Arrow chunks and are folded as they come.
    """

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last, state = held.get if held.exists else (0, None, None, None)
        for c in chunks:
            if not len(c):
                continue
            us = c["at"].to_numpy("datetime64[us]").astype("int64")
            newest = int(us.max())
            n, first = n + len(c), int(us.min()) if first is None else min(first, int(us.min()))
            if last is None or newest >= last:
                top = c["state"][us == newest].max()
                state = top if last is None or newest > last else max(state, top)
                last = newest
        held.update((n, first, last, state))
        yield pd.DataFrame({"key": [key[0]], "state": [state], "n_events": [n], "first_at": [pd.Timestamp(first, unit="us")], "last_at": [pd.Timestamp(last, unit="us")]})

    return (
        events.where("key is not null and at is not null").select("key", "at", F.coalesce("state", F.lit("")).alias("state"))
        .groupBy("key").applyInPandasWithState(fold, STATE_OUT, "n long, first long, last long, state string", "update", GroupStateTimeout.NoTimeout)
    )


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per kind and tumbling window; what is later than the watermark is dropped."""
    return events.withWatermark("at", late).groupBy(F.window("at", every), "state").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "state", "n")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[int]]:
    """Complete versions of each bucket below ``before``, oldest first. A table that is not there yet
    has none; any other fault of the storage is raised."""
    fs, root = _files(spark, path)
    out: dict[int, list[int]] = {}
    for v in fs.listStatus(root) if fs.exists(root) else []:
        name = v.getPath().getName()
        if not name.startswith("v=") or not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(v.getPath(), "_SUCCESS")):
            continue
        if before is None or int(name[2:]) < before:
            for b in fs.listStatus(v.getPath()):
                if b.getPath().getName().startswith("bucket="):
                    out.setdefault(int(b.getPath().getName()[7:]), []).append(int(name[2:]))
    return {b: sorted(vs) for b, vs in out.items()}


def _bucket_paths(path: str, versions: dict[int, list[int]]) -> list[str]:
    return [f"{path}/v={vs[-1]}/bucket={b}" for b, vs in versions.items()]


def keep_latest(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = 64):
    """Keeps the latest version of each key of a stream in a table of ``buckets`` buckets of keys.
    Every micro-batch is merged with the buckets it touches, which are written anew under its own
    number, so a batch that is run again gives the same table; other buckets stay as they are. Of a
    bucket the newest version and the one before are kept. ``current`` reads the newest."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", F.expr(f"int(pmod(xxhash64({', '.join(keys)}), {buckets}))")).persist()
        try:
            touched = {r[0] for r in batch.select("bucket").distinct().collect()}
            held = {b: vs for b, vs in _versions(spark, path, epoch).items() if b in touched}
            rows = batch
            if held:
                rows = rows.unionByName(spark.read.option("basePath", path).parquet(*_bucket_paths(path, held)).select(*batch.columns))
            upsert_last(rows, [*keys, "bucket"], [F.col(order)]).drop("seq").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={epoch}")
        finally:
            batch.unpersist()
        for b, vs in held.items():
            for old in vs[:-1]:
                fs, where = _files(spark, f"{path}/v={old}/bucket={b}")
                fs.delete(where, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, path: str) -> DataFrame:
    """Newest version of a table kept by ``keep_latest``."""
    return spark.read.option("basePath", path).parquet(*_bucket_paths(path, _versions(spark, path))).drop("v", "bucket")
