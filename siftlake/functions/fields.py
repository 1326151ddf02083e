"""Field access by dotted path: a flat column of that name first, then the nested path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def field(df: DataFrame, path: str) -> Column:
    """The column of a dotted path; null if the schema has neither form, the first non-null of both if it has both."""
    flat = F.col(f"`{path}`") if path in df.columns else None
    nested = F.col(path) if "." in path and field_type(df.schema, path) is not None else None
    if flat is not None and nested is not None:
        return F.coalesce(flat, nested)
    return flat if flat is not None else nested if nested is not None else F.lit(None).cast("string")


def field_sql(df: DataFrame, path: str) -> str:
    """The same as an expression of Spark SQL."""
    flat = f"`{path}`" if path in df.columns else None
    nested = ".".join(f"`{p}`" for p in path.split(".")) if "." in path and field_type(df.schema, path) is not None else None
    return f"coalesce({flat}, {nested})" if flat and nested else flat or nested or "CAST(NULL AS STRING)"


def type_of(df: DataFrame, path: str) -> T.DataType | None:
    return df.schema[path].dataType if path in df.columns else field_type(df.schema, path)


def first_text(df: DataFrame, *paths: str) -> Column:
    """The first non-empty text over several paths."""
    return F.coalesce(*[F.nullif(field(df, p).cast("string"), F.lit("")) for p in paths])


def objects(df: DataFrame, path: str) -> Column:
    """An array field without its null elements; empty for null."""
    return F.coalesce(F.filter(field(df, path), lambda x: x.isNotNull()), F.array())
