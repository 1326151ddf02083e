"""The ``events`` table as canonical events.

``FLAT`` gives each leaf of the canonical schema as an expression that Spark SQL and DuckDB read alike; ``events``
nests the leaves into structs, ``EV`` is the same projection as a common table expression for oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OPERATIONS = "AssumeRole GetObject ListBuckets CreateAccessKey StopLogging AttachUserPolicy RunInstances DeleteBucket GetCallerIdentity PutObject ConsoleLogin Invoke".split()
_SERVICES = "sts s3 s3 iam cloudtrail iam ec2 s3 sts s3 signin lambda".split()
_CLASS = "CASE event_type WHEN 'click' THEN 6003 WHEN 'purchase' THEN 6003 WHEN 'error' THEN 3002 WHEN 'signup' THEN 3001 ELSE CASE WHEN event_id % 3 = 0 THEN 4003 ELSE 4001 END END"


def _choice(index: str, values: list[str]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


#: leaf name -> expression over the events table, then over the leaves before
FLAT = {
    "event_uid": "CAST(event_id AS {string})",
    "class_uid": f"CAST({_CLASS} AS INT)",
    "class_name": f"CASE {_CLASS} WHEN 6003 THEN 'API Activity' WHEN 3002 THEN 'Authentication' WHEN 3001 THEN 'Account Change' WHEN 4003 THEN 'DNS Activity' ELSE 'Network Activity' END",
    "time_dt": "CAST(ts AS TIMESTAMP)",
    "status": "CASE WHEN event_type = 'error' OR value > 200 THEN 'Failure' ELSE 'Success' END",
    "status_id": "CAST(CASE WHEN event_type = 'error' OR value > 200 THEN 2 ELSE 1 END AS INT)",
    "user_name": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'user_' || user_id END",
    "user_type": _choice("user_id % 3", ["IAMUser", "AssumedRole", "Root"]),
    "uid_alt": "CASE WHEN event_id % 34 = 0 THEN 'Anonymous' END",
    "src_ip": "CASE WHEN event_id % 5 = 0 THEN '203.0.113.' || (event_id % 32) ELSE '10.0.' || (user_id % 8) || '.' || (event_id % 16) END",
    "dst_ip": f"CASE WHEN {_CLASS} = 4001 THEN CASE WHEN event_id % 2 = 0 THEN '198.51.100.' || (event_id % 8) ELSE '10.1.0.' || (event_id % 8) END END",
    "dst_port": f"CAST(CASE WHEN {_CLASS} = 4001 THEN CASE event_id % 4 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 ELSE 3389 END END AS INT)",
    "operation": f"CASE WHEN {_CLASS} IN (6003, 3001, 3002) THEN {_choice('event_id % 12', _OPERATIONS)} END",
    "service": f"CASE WHEN {_CLASS} IN (6003, 3001, 3002) THEN {_choice('event_id % 12', _SERVICES)} || '.amazonaws.com' END",
    "resource_uid": f"CASE WHEN {_CLASS} = 6003 THEN 'arn:aws:s3:::bucket-' || (event_id % 7) END",
    "bytes_out": f"CASE WHEN {_CLASS} = 4001 THEN CAST(floor(value * 100000) AS BIGINT) END",
    "bytes_in": f"CASE WHEN {_CLASS} = 4001 THEN CAST(floor(value * 1000) AS BIGINT) END",
    "hostname": f"CASE WHEN {_CLASS} = 4003 THEN 'host' || (user_id % 10) || '.example.com' END",
    "rcode_id": f"CAST(CASE WHEN {_CLASS} = 4003 THEN CASE WHEN event_id % 4 = 0 THEN 3 ELSE 0 END END AS INT)",
    "query_type": f"CASE WHEN {_CLASS} = 4003 THEN CASE WHEN event_id % 2 = 0 THEN 'TXT' ELSE 'A' END END",
    "region": "CASE WHEN event_id % 9 = 0 THEN 'ap-southeast-1' ELSE 'us-west-2' END",
    "account": "'1111' || (user_id % 2)",
    "protocol": f"CASE WHEN {_CLASS} = 4001 THEN 'tcp' END",
    "source_name": f"CASE {_CLASS} WHEN 4001 THEN 'vpc-flow' WHEN 4003 THEN 'route53' ELSE 'cloudtrail' END",
}

#: canonical nested path of each leaf
PATHS = {
    "user_name": "actor.user.name", "user_type": "actor.user.type", "uid_alt": "actor.user.uid_alt", "account": "cloud.account.uid", "region": "cloud.region",
    "src_ip": "src_endpoint.ip", "dst_ip": "dst_endpoint.ip", "dst_port": "dst_endpoint.port", "operation": "api.operation", "service": "api.service.name",
    "bytes_out": "traffic.bytes_out", "bytes_in": "traffic.bytes_in", "hostname": "query.hostname", "query_type": "query.type", "protocol": "connection_info.protocol_name",
}

EV = "ev AS (SELECT " + ", ".join(f"{e.format(string='VARCHAR')} AS {n}" for n, e in FLAT.items()) + " FROM events)"

RESOURCE = "array<struct<uid:string,type:string,name:string>>"


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select(*[F.expr(e.format(string="STRING")).alias(n) for n, e in FLAT.items()])


def nest(flat: DataFrame, severity: Column | None = None) -> DataFrame:
    """Flat leaves as nested canonical events."""
    c = F.col
    return flat.select(
        "event_uid", "class_uid", "class_name", "time_dt", "status", "status_id", (F.lit(None).cast("string") if severity is None else severity).alias("severity"), F.lit(None).cast("int").alias("severity_id"), "rcode_id",
        F.struct(
            F.struct(c("user_name").alias("name"), c("user_type").alias("type"), F.lit(None).cast("string").alias("uid"), c("uid_alt"), F.lit(None).cast("string").alias("account_uid")).alias("user"),
            F.struct(F.lit(None).cast("string").alias("uid")).alias("session"),
        ).alias("actor"),
        F.struct(c("operation"), F.struct(c("service").alias("name")).alias("service")).alias("api"),
        F.struct(c("src_ip").alias("ip")).alias("src_endpoint"),
        F.struct(c("dst_ip").alias("ip"), c("dst_port").alias("port")).alias("dst_endpoint"),
        F.struct(c("region"), F.struct(c("account").alias("uid")).alias("account")).alias("cloud"),
        F.when(c("resource_uid").isNotNull(), F.array(F.struct(c("resource_uid").alias("uid"), F.lit("AWS::S3::Bucket").alias("type"), F.lit(None).cast("string").alias("name")))).cast(RESOURCE).alias("resources"),
        F.struct(c("hostname"), c("query_type").alias("type")).alias("query"),
        F.struct(c("bytes_in"), c("bytes_out")).alias("traffic"),
        F.struct(c("protocol").alias("protocol_name")).alias("connection_info"),
        "source_name",
    )


#: The leaves of findings: errors of more than 100 are told as findings of a security product.
FINDING = FLAT | {"class_uid": "2001", "class_name": "'Security Finding'", "source_name": "'security-hub'"}
FINDING_SEVERITY = "CASE WHEN value > 250 THEN 'Critical' WHEN value > 150 THEN 'High' ELSE 'Medium' END"
FINDING_EV = "fev AS (SELECT " + ", ".join(f"{e.format(string='VARCHAR')} AS {n}" for n, e in FINDING.items()) + f", {FINDING_SEVERITY} AS severity FROM events WHERE event_type = 'error' AND value > 100)"


def finding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings (class 2001) as canonical events, with their severity."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error' AND value > 100")
    flat = raw.select(*[F.expr(e.format(string="STRING")).alias(n) for n, e in FINDING.items()], F.expr(FINDING_SEVERITY).alias("told"))
    return nest(flat, F.col("told"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest(flat_events(spark, sf_dir))
