"""Ranks, gaps and running groups over groups of any size: range-partitioned prefix scans.

Rows are dealt by ranges of (group, order), so a group larger than a task lies in several neighbouring parts. Inside a part
everything is local; one row for each group and part tells its border, and sums over these borders carry on from part
to part. No window runs over a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import masks
from .lineage import cut
from .skew import MOST_SENT


def dealt(df: DataFrame, by: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """``df`` with ``__part`` and ``__at``: rows in parts by ranges of (by, order), and their place in the order.

    The places are written down once, so that later steps agree about them.
    """
    keys = [F.col(c) for c in by] + order
    rows = df.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys)
    return cut(rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))


def placed(df: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's number in its group, from 1."""
    rows = dealt(df, by, order)
    borders = rows.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    borders = borders.select(*by, "__part", (before - F.col("__first") + 1).alias("__shift"))
    return _with(rows, borders, by).withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def placed_sets(df: DataFrame, names: list[str], order: list[Column], parts: int, name: str = "places") -> DataFrame:
    """``df``, whose ``inv_id`` is a set (masks), with ``name``: an array of its investigations (inv_id), by places, and of
    the row's number in each of them (place), from 1. Rows are counted for all investigations at once, in so many parts."""
    if not names:
        return df.withColumn(name, F.array().cast("array<struct<inv_id:int,place:bigint>>")).limit(0)
    rows = dealt(df, [], order, parts)
    had = [masks.has(k).cast("long") for k in range(len(names))]
    borders = rows.groupBy("__part").agg(*[F.sum(h).alias(f"__n{k}") for k, h in enumerate(had)])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    borders = cut(borders.select("__part", *[F.coalesce(F.sum(f"__n{k}").over(earlier), F.lit(0)).alias(f"__n{k}") for k in range(len(names))]))
    local = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a part is no larger than a task
    rows = rows.repartition(parts, "__part").withColumns({f"__l{k}": F.sum(h).over(local) for k, h in enumerate(had)}).join(F.broadcast(borders), "__part")
    each = [F.when(masks.has(k), F.struct(F.lit(k).alias("inv_id"), (F.col(f"__n{k}") + F.col(f"__l{k}")).alias("place"))) for k in range(len(names))]
    return rows.select(*df.columns, F.array_compact(F.array(*each)).alias(name))


def chained(df: DataFrame, by: list[str], order: list[Column], time: str, longest: int, name: str = "chain", gap: str = "gap") -> DataFrame:
    """``df`` with ``gap``, the whole seconds since the row before in its group (null for the first), and ``name``, a
    number that goes up by one wherever the gap is longer than ``longest``, from 0."""
    rows = dealt(df, by, order)
    seconds = lambda now, before: F.floor((F.unix_micros(now) - F.unix_micros(before)) / 1_000_000)
    local = Window.partitionBy(*by, "__part").orderBy("__at")  # a part is no larger than a task
    rows = rows.withColumn(gap, seconds(F.col(time), F.lag(time).over(local))).withColumn("__begins", F.coalesce((F.col(gap) > longest).cast("int"), F.lit(0)))
    rows = rows.withColumn("__local", F.sum("__begins").over(local))
    # what the first row of a part would have seen
    order_of = Window.partitionBy(*by).orderBy("__part")
    borders = rows.groupBy(*by, "__part").agg(F.min("__at").alias("__first"), F.sum("__begins").alias("__n"), F.min_by(time, "__at").alias("__from"), F.max_by(time, "__at").alias("__to"))
    borders = borders.withColumn("__gap", seconds(F.col("__from"), F.lag("__to").over(order_of))).withColumn("__begin", F.coalesce((F.col("__gap") > longest).cast("int"), F.lit(0)))
    so_far = F.sum(F.col("__n") + F.col("__begin")).over(order_of) - F.col("__n")
    borders = borders.select(*by, "__part", "__first", "__gap", so_far.alias("__shift"))
    out = _with(rows, borders, by).withColumn(gap, F.when(F.col("__at") == F.col("__first"), F.col("__gap")).otherwise(F.col(gap)))
    return out.withColumn(name, F.col("__local") + F.col("__shift")).drop("__part", "__at", "__begins", "__local", "__first", "__gap", "__shift")


def _with(rows: DataFrame, borders: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a group and part with its border; null group keys too."""
    names = {c: f"__b_{c}" for c in [*by, "__part"]}
    right = cut(borders.withColumnsRenamed(names))
    if right.count() <= MOST_SENT:  # no more than groups and parts together
        right = F.broadcast(right)
    same = rows["__part"] == right["__b___part"]
    for c in by:
        same &= rows[c].eqNullSafe(right[names[c]])
    return rows.join(right, same).drop(*names.values())
