"""Joins in which a few keys have very many rows: those are cut into pieces, and the other side is copied to each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task joins at most, unless that made more than MOST_HOT keys hot.
HOT_ROWS, MOST_HOT = 50_000, 10_000
#: Rows of ids that are sent to all tasks at most (about 100 bytes each).
MOST_SENT = 200_000


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, __pieces) of the keys with more rows than one task should join; at most MOST_HOT, None without any.

    ``rows`` is counted twice, so it should be a written table.
    """
    return _hot(rows.groupBy(*keys).count(), keys, rows.count())


def hot_of(counts: DataFrame, keys: list[str]) -> DataFrame | None:
    """The same of a written table (keys, count)."""
    return _hot(counts, keys, counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])


def _hot(counts: DataFrame, keys: list[str], rows: int) -> DataFrame | None:
    most = max(HOT_ROWS, -(-rows // MOST_HOT))
    found = counts.where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("__pieces"))
    got = found.collect()  # at most MOST_HOT
    return counts.sparkSession.createDataFrame(got, found.schema) if got else None


def split_join(many: DataFrame, few: DataFrame, keys: list[str], spread: Column, hot: DataFrame | None) -> DataFrame:
    """``many`` joined with ``few`` on ``keys``: rows of ``many`` of hot keys are dealt by a hash of ``spread``."""
    if hot is None:
        return many.join(few, keys)
    table = F.broadcast(hot)  # at most MOST_HOT rows
    left = many.join(table, keys, "left").withColumn("__piece", F.pmod(F.xxhash64(spread), F.coalesce("__pieces", F.lit(1))).cast("int")).drop("__pieces")
    right = few.join(table, keys, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1))).drop("__pieces")
    return left.join(right, [*keys, "__piece"]).drop("__piece")
