"""Record store semantics: upserts, first-wins links, the dedupe family, snapshots on disk.

Rows have no order of their own, so every operator takes the ordering columns. Keys are hash
partitioned and folded with max_by/min_by, which aggregate partially before the shuffle; only the
collision log, which needs every loser, sorts within a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNAPSHOT_FORMAT = "lexloom-corpus-1"


def _payload(df: DataFrame, keys: list[str]) -> Column:
    return F.struct(*(c for c in df.columns if c not in keys))


def upsert_last(rows: DataFrame, keys: list[str], order: list[Column], seq: str = "seq") -> DataFrame:
    """Last write of each key; ``seq`` is the order of its first write, which keeps a record's place
    when it is overwritten. Rows with equal order and key are resolved by the largest payload."""
    o = F.struct(*order)
    best = rows.withColumn("_o", o).groupBy(*keys).agg(F.max_by(_payload(rows, keys), F.struct("_o", F.to_json(_payload(rows, keys)))).alias("_p"), F.min("_o").alias(seq))
    return best.select(*keys, "_p.*", seq)


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key. Null keys are keys."""
    return rows.withColumn("_o", F.struct(*order)).groupBy(*keys).agg(F.min_by(_payload(rows, keys), "_o").alias("_p")).select(*keys, "_p.*")


def keep_longest(rows: DataFrame, keys: list[str], text: str, order: list[Column]) -> DataFrame:
    """Row of each key with the longest text, the first of equally long ones."""
    o = F.struct((-F.coalesce(F.length(text), F.lit(0))).alias("n"), *order)
    return rows.withColumn("_o", o).groupBy(*keys).agg(F.min_by(_payload(rows, keys), "_o").alias("_p")).select(*keys, "_p.*")


def collision_log(rows: DataFrame, key: str, row_id: str, written: list[Column], age: list[Column]) -> DataFrame:
    """One row for each write that meets an earlier one of its key: who is kept and who is dropped.
    The one of smaller ``age`` is kept, of equal age the earlier written."""
    w = Window.partitionBy(key).orderBy(*written)
    best = F.min(F.struct(*age, F.col("_n"), F.col(row_id).alias("_id")))
    x = rows.withColumn("_n", F.row_number().over(w))
    x = x.withColumn("_now", best.over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_was", best.over(w.rowsBetween(Window.unboundedPreceding, -1)))
    kept, was = F.col("_now._id"), F.col("_was._id")
    return x.where("_n > 1").select(key, kept.alias("kept_id"), F.when(kept == was, F.col(row_id)).otherwise(was).alias("dropped_id"))


def new_links(links: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Links that are not stored yet."""
    return links.join(existing.select(*keys).distinct(), keys, "left_anti")


def write_snapshot(path: str, tables: dict[str, DataFrame], generated_at: str, provenance: list[str] | None = None) -> None:
    """One Parquet table per collection and a manifest. Content ids are left out: they follow from
    the content hash."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.drop("cid").write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(SNAPSHOT_FORMAT, generated_at, provenance or [], sorted(tables))], "format string, generated_at string, provenance array<string>, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/_manifest_json")


def read_snapshot(spark: SparkSession, path: str, required: tuple[str, ...] = ("atoms", "links", "status")) -> dict[str, DataFrame]:
    """Tables of a snapshot; ValueError on another format or a missing collection."""
    head = spark.read.schema("format string, generated_at string, provenance array<string>, tables array<string>").json(f"{path}/_manifest_json").first()
    if head is None or head["format"] != SNAPSHOT_FORMAT:
        raise ValueError("not a snapshot of this format")
    if lacking := set(required) - set(head["tables"]):
        raise ValueError(f"the snapshot lacks {sorted(lacking)}")
    return {t: spark.read.parquet(f"{path}/{t}") for t in head["tables"]}


def visible(status: DataFrame, policies: str | None = None, known: tuple[str, ...] = (), passing_only: bool = False, default: str = "public-free") -> DataFrame:
    """Status rows by access policy: a comma-separated allow-list, of which unknown names are
    dropped; none left means no filter. A null policy is the default one."""
    allowed = [p.strip() for p in (policies or "").split(",") if p.strip() in known]
    if passing_only:
        status = status.where(F.col("quality_bar").startswith("passing"))
    return status.where(F.coalesce("access_policy", F.lit(default)).isin(allowed)) if allowed else status


def set_status(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``rows`` with the status of ``updates (key, status, reviewer, reviewed_at)``; reviewer and time
    change only where a reviewer is given, and ids that do not exist change nothing."""
    u = updates.select(F.col(key).alias("_k"), F.col("status").alias("_s"), F.col("reviewer").alias("_r"), F.col("reviewed_at").alias("_a"))
    by = F.col("_r").isNotNull()
    return rows.join(u, F.col(key) == F.col("_k"), "left").select(
        *(c for c in rows.columns if c not in ("status", "human_reviewed_by", "human_reviewed_at")), F.coalesce("_s", "status").alias("status"),
        F.when(by, F.col("_r")).otherwise(F.col("human_reviewed_by")).alias("human_reviewed_by"), F.when(by, F.col("_a")).otherwise(F.col("human_reviewed_at")).alias("human_reviewed_at"),
    )


def jobs_of(jobs: DataFrame, state: str | None = None, tenant: str | None = None) -> DataFrame:
    """Job rows of a state, of a tenant, or of both."""
    if state is not None:
        jobs = jobs.where(F.col("state") == state)
    return jobs if tenant is None else jobs.where(F.col("jurisdiction_tenant") == tenant)


def pins(writes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """A table addressed by content: of all writes of a content id the first is held. Asking for an id
    is a look-up by key, and it is pinned when there is a row."""
    return keep_first(writes, [key], order)
