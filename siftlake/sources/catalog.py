"""Named sources, schema listing, profiles, guarded and templated SQL (SRC7 to SRC11)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Standard sources: name -> (table name by region, expected freshness in minutes, tags).
STANDARD = {
    "cloudtrail": ("cloud_trail_mgmt", 60, ["aws", "api"]),
    "vpc-flow": ("vpc_flow", 60, ["aws", "network"]),
    "route53": ("route53", 60, ["aws", "dns"]),
    "security-hub": ("sh_findings", 120, ["aws", "findings"]),
    "lambda-execution": ("lambda_execution", 60, ["aws", "api"]),
}
#: Names that rules use for the same sources.
ALIASES = {"route53-resolver": "route53", "vpc-flow-logs": "vpc-flow", "eks-audit": "cloudtrail", "gcp-audit": "cloudtrail"}
#: Words that an ad-hoc query must not contain.
FORBIDDEN = frozenset("insert update delete drop create alter truncate merge grant".split())


def source_table(name: str, region: str) -> str:
    base = STANDARD[ALIASES.get(name, name)][0]
    return f"lake_table_{region.replace('-', '_')}_{base}"


def sources(spark: SparkSession, region: str) -> DataFrame:
    rows = [(n, source_table(n, region), region, minutes, tags) for n, (_, minutes, tags) in STANDARD.items()]
    return spark.createDataFrame(rows, "name string, table_name string, region string, expected_freshness_minutes int, tags array<string>")


def columns(df: DataFrame) -> DataFrame:
    """Schema listing: column and type of each top-level column."""
    return df.sparkSession.createDataFrame([(n, t) for n, t in df.dtypes], "column string, type string")


def sample_per_class(events: DataFrame, n: int = 5) -> DataFrame:
    """At most ``n`` events of each class, the earliest first; each task ranks and cuts its own rows before the shuffle."""
    first = F.row_number().over(Window.partitionBy("class_uid").orderBy("time_dt", "event_uid"))
    return events.withColumn("rank", first).where(F.col("rank") <= n)


def leaves(schema: T.StructType, before: str = "") -> list[tuple[str, str]]:
    """Path and type of each leaf of a schema, those within lists of structs included (``[]``)."""
    out: list[tuple[str, str]] = []
    for f in schema.fields:
        path, kind = f"{before}{f.name}", f.dataType
        if isinstance(kind, T.StructType):
            out += leaves(kind, path + ".")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out += leaves(kind.elementType, path + "[].")
        else:
            out.append((path, kind.simpleString()))
    return out


def class_profile(events: DataFrame) -> DataFrame:
    """(class_uid, path, type, filled, events): the shape of each class, with how many of its events fill a leaf. One scan."""
    found = leaves(events.schema)

    def filled(path: str) -> Column:
        if "[]." not in path:
            return F.count(path)
        listed, leaf = path.split("[].", 1)
        return F.count_if(F.coalesce(F.exists(listed, lambda x: x[leaf].isNotNull()), F.lit(False)))

    rows = events.groupBy("class_uid").agg(F.count("*").alias("events"), *[filled(p).alias(f"leaf {k}") for k, (p, _) in enumerate(found)])
    each = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("type"), F.col(f"leaf {k}").alias("filled")) for k, (p, t) in enumerate(found)])
    return rows.select("class_uid", "events", F.explode(each).alias("x")).select("class_uid", "x.path", "x.type", "x.filled", "events")


def guarded_sql(spark: SparkSession, query: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a read-only query over views; reject one that holds a changing keyword as a word."""
    bad = FORBIDDEN.intersection(re.split(r"\s+", query.lower()))
    if bad:
        raise ValueError(f"only reading is allowed: {', '.join(sorted(bad))}")
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


def template_sql(spark: SparkSession, query: str, start, end, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """A rule's SQL text with {start_time} and {end_time}, bound as parameters."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(query.replace("{start_time}", ":start_time").replace("{end_time}", ":end_time"), args={"start_time": start, "end_time": end})
