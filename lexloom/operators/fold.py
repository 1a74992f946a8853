"""Folding of ordered events into a state per key, and nesting of children under parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_events(events: DataFrame, key: str, order: list[Column], state: str, last_known: list[str], start: Column, end: Column) -> DataFrame:
    """State of each key after its events in order: last state, last non-null value of each of
    ``last_known``, first event for which ``start`` holds and last for which ``end`` holds."""
    o = F.struct(*order)
    x = events.withColumn("_o", o)
    return x.groupBy(key).agg(
        F.max_by(state, "_o").alias(state), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c) for c in last_known), F.min(F.when(start, F.col("_o"))).alias("_start"), F.max(F.when(end, F.col("_o"))).alias("_end"), F.count("*").alias("n_events")
    ).select(key, state, *last_known, F.col("_start").getField(_name(events, order[0])).alias("started"), F.col("_end").getField(_name(events, order[0])).alias("ended"), "n_events")


def _name(df: DataFrame, c: Column) -> str:
    return df.select(c).columns[0]


def illegal_transitions(events: DataFrame, key: str, order: list[Column], state: str, legal: DataFrame) -> DataFrame:
    """Consecutive states of a key that ``legal (from_state, to_state)`` does not hold."""
    x = events.withColumn("from_state", F.lag(state).over(Window.partitionBy(key).orderBy(*order))).withColumnRenamed(state, "to_state").where("from_state is not null")
    return x.join(legal, ["from_state", "to_state"], "left_anti")


def nest(parents: DataFrame, key: str, **children: tuple[DataFrame, list[Column]]) -> DataFrame:
    """Parents with one array column per child table (joined on ``key``), each sorted by the given
    columns; no children give an empty array. Children are aggregated before the join."""
    out = parents
    for name, (df, order) in children.items():
        fields = [c for c in df.columns if c != key]
        held = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v")))), lambda s: s["v"]).alias(name))
        out = out.join(held, key, "left").withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType)))
    return out
