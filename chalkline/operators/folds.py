"""Ordered folds and last-n frames over a key's events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.operators.lineage import Scratch

#: Events of a key that one array holds.
EVENTS = 100_000


def ordered_fold(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], start: Column, step: Callable[[Column, Column], Column], name: str
) -> DataFrame:
    """One row for each key: ``step`` applied to the key's events in order, from ``start``, with ``n_events``.

    Steps that round are not associative, so there is no partial aggregation; a
    key's events are sorted arrays of at most EVENTS, and the fold runs on them
    in the JVM. The longest key is counted first, from the keys alone; where
    one array doesn't hold it, all keys are cut behind one shuffle, and a round
    for each further array goes on from the state before.
    """
    slim = df.select(*keys, *order, *[v for v in values if v not in order])
    event = F.struct(*order, *values)
    sorted_ = F.array_sort(F.collect_list(event)).alias("_events")
    if (slim.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= EVENTS:
        return slim.groupBy(*keys).agg(sorted_).select(*keys, F.size("_events").alias("n_events"), F.aggregate("_events", start, step).alias(name))
    scratch = Scratch(df.sparkSession, "fold")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    cut = scratch.keep(slim.withColumn("_part", F.floor(place / EVENTS).cast("int")).groupBy(*keys, "_part").agg(sorted_), "cut")
    parts = lambda p: cut.where(F.col("_part") == p).drop("_part")
    state = parts(0).select(*keys, F.size("_events").alias("n_events"), F.aggregate("_events", start, step).alias(name))
    for p in range(1, (cut.agg(F.max("_part")).first()[0] or 0) + 1):
        state = scratch.keep(state, "state")
        more = state.join(parts(p), keys, "left")
        onward = F.when(F.col("_events").isNull(), F.col(name)).otherwise(F.aggregate("_events", F.col(name), step))
        state = more.select(*keys, (F.col("n_events") + F.coalesce(F.size("_events"), F.lit(0))).alias("n_events"), onward.alias(name))
    return state


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order, numbered from 1 in ``rank``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return newest(df, keys, order, 1).drop("rank")
