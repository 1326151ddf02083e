"""Sets of investigations as bits, 64 to a word: unions, intersections and counts without a row for each investigation.

A set is a struct of long words in ``inv_id``; an investigation is told by its place among the names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 64


def words(names: list[str]) -> list[str]:
    return [f"w{k}" for k in range(max(1, -(-len(names) // WORD)))]


def masked(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the set in place of the array of places in ``inv_id``."""
    text = ", ".join(f"'{w}', aggregate(inv_id, 0L, (s, x) -> s | IF(x div {WORD} = {k}, shiftleft(1L, x % {WORD}), 0L))" for k, w in enumerate(words(names)))
    return rows.withColumn("inv_id", F.expr(f"named_struct({text})"))


def union(names: list[str], inv_id: str = "inv_id") -> Column:
    """Aggregate: the investigations of any row."""
    return F.struct(*[F.bit_or(f"{inv_id}.{w}").alias(w) for w in words(names)]).alias("inv_id")


def common(names: list[str], a: str, b: str) -> Column:
    """The investigations of both sets."""
    return F.struct(*[F.col(f"{a}.{w}").bitwiseAND(F.col(f"{b}.{w}")).alias(w) for w in words(names)])


def without(names: list[str], a: str, b: str) -> Column:
    """The investigations of ``a`` that are not in ``b``, which may be null."""
    return F.struct(*[F.col(f"{a}.{w}").bitwiseAND(F.bitwise_not(F.coalesce(F.col(f"{b}.{w}"), F.lit(0).cast("long")))).alias(w) for w in words(names)])


def of(names: list[str], places: Iterable[int]) -> Column:
    """These investigations, by their places."""
    sets = [sum(1 << p % WORD for p in set(places) if p // WORD == k) for k in range(len(words(names)))]
    return F.struct(*[F.lit(v - (1 << WORD) if v >> (WORD - 1) else v).cast("long").alias(w) for w, v in zip(words(names), sets)])


def within(names: list[str], places: Iterable[int]) -> Column:
    """Those of the set that are among these."""
    these = of(names, places)
    return F.struct(*[F.col(f"inv_id.{w}").bitwiseAND(these[w]).alias(w) for w in words(names)])


def has(place: int) -> Column:
    """Whether the investigation at this place is in the set."""
    return F.expr(f"inv_id.w{place // WORD} & shiftleft(1L, {place % WORD}) <> 0")


def size(names: list[str]) -> Column:
    return F.expr(" + ".join(f"bit_count(inv_id.{w})" for w in words(names))).cast("long")


def places(names: list[str]) -> str:
    """Expression: the array of the places in the set."""
    marks = ", ".join(f"CASE WHEN inv_id.w{k // WORD} & shiftleft(1L, {k % WORD}) <> 0 THEN {k} END" for k in range(len(names)))
    return f"array_compact(array({marks}))" if names else "CAST(array() AS ARRAY<INT>)"


def some(names: list[str]) -> Column:
    """Whether there is any investigation in the set."""
    return F.expr(" OR ".join(f"inv_id.{w} <> 0" for w in words(names)))


def fresh(rows: DataFrame, names: list[str], key: list[str], order: list[Column]) -> DataFrame:
    """Of each key's rows in this order: the investigations that no row before had; rows without any are left out."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = [F.col(f"inv_id.{w}").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or(f"inv_id.{w}").over(before), F.lit(0).cast("long")))).alias(w) for w in words(names)]
    return rows.withColumn("inv_id", F.struct(*parts)).where(some(names))


def each(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row for each investigation of the set, by its place."""
    return rows.withColumn("inv_id", F.explode(F.expr(places(names))))


def named(rows: DataFrame, names: list[str]) -> DataFrame:
    """Places as names."""
    return rows.withColumn("inv_id", F.element_at(F.array(*map(F.lit, names)), F.col("inv_id") + 1) if names else F.lit(None).cast("string"))
