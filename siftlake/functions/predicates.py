"""Filter specifications compiled to boolean columns (FLT1 to FLT19).

Null leaves: equals, contains, in and regex are false, not_equals is true. Values are compared as text. On a list of
structs an operator holds if any text leaf of any element satisfies it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fields import field, field_sql, type_of

#: Fixed value: the pattern of dotted quads; parts up to 255, leading zeros too.
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
RFC1918 = r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def text_sql(value) -> str:
    """A value as a text literal of Spark SQL."""
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _leaf(op: str, value) -> Callable[[str], str]:
    if op == "equals":
        return lambda c: f"CAST({c} AS STRING) = {text_sql(value)}"
    if op == "not_equals":
        return lambda c: f"NOT (CAST({c} AS STRING) <=> {text_sql(value)})"
    if op == "contains":
        return lambda c: f"contains(CAST({c} AS STRING), {text_sql(value)})"
    if op == "in":
        return lambda c: f"CAST({c} AS STRING) IN ({', '.join(map(text_sql, value))})" if value else "FALSE"
    if op == "regex":
        return lambda c: f"CAST({c} AS STRING) RLIKE {text_sql(f'(?U){value}')}"
    if op == "int_equals":
        return lambda c: f"{c} = {int(value)}"
    raise ValueError(f"unknown operator {op}")


def filter_sql(df: DataFrame, spec: dict) -> str:
    """One field filter, {"field": path, operator: value}, as an expression of Spark SQL.

    Many rules make thousands of columns; as text they are built without a call for each.
    """
    (op, value), path = next((k, v) for k, v in spec.items() if k != "field"), spec["field"]
    test, kind, at = _leaf(op, value), type_of(df, path), field_sql(df, path)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        test = _leaf("equals", value) if op == "not_equals" else test
        leaves = [test(f"x.`{f.name}`") for f in kind.elementType.fields if isinstance(f.dataType, T.StringType)]
        found = f"coalesce(exists({at}, x -> {' OR '.join(leaves) or 'FALSE'}), FALSE)"
        return f"NOT {found}" if op == "not_equals" else found
    return test(at)


def all_sql(df: DataFrame, filters: list[dict]) -> str:
    return " AND ".join(f"({filter_sql(df, f)})" for f in filters) or "TRUE"


def compile_filter(df: DataFrame, spec: dict) -> Column:
    return F.expr(filter_sql(df, spec))


def compile_all(df: DataFrame, filters: list[dict]) -> Column:
    return F.expr(all_sql(df, filters))


def list_any_equals(df: DataFrame, path: str, leaf: str, value: str) -> Column:
    return F.coalesce(F.exists(field(df, path), lambda x: x[leaf] == F.lit(value)), F.lit(False))


def list_any_in(df: DataFrame, path: str, leaf: str, values: list[str]) -> Column:
    return F.coalesce(F.exists(field(df, path), lambda x: x[leaf].isin(values)), F.lit(False)) if values else F.lit(False)


def raw_sql(text: str) -> Column:
    return F.expr(text)


def is_ipv4(c: Column) -> Column:
    return F.coalesce(c.rlike(IPV4), F.lit(False))


def is_arn(c: Column) -> Column:
    return F.coalesce(c.startswith("arn:"), F.lit(False))


def is_private(c: Column) -> Column:
    return F.coalesce(c.rlike(RFC1918), F.lit(False))
