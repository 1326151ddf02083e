"""Queries of sources, predicates and detection (SRC*, FLT*, DET*)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.fields import field, first_text, objects
from ..operators import detect as D
from ..sources import catalog
from ..sources.adapter import events, FINDING_EV, finding_events, PATHS
from ..sources.schema import event_classes
from .registry import DETECT, END, EV, HITS, RULES, START, W, query, rule_sql

US = "epoch_us(time_dt) AS time_us"


def micros(c: str = "time_dt"):
    return F.unix_micros(c).alias("time_us")


@query("SRC1_event_class_scan", f"SELECT event_uid, class_uid, {US}, status FROM ev WHERE {W} AND class_uid = 6003 AND status = 'Failure' ORDER BY time_dt, event_uid LIMIT 10000")
def src1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return D.scan(ev, 6003, START, END, field(ev, "status") == "Failure", limit=50_000, strict=False).select("event_uid", "class_uid", micros(), "status")


SAMPLED = """SELECT rule_id, count(*) AS total_matches, string_agg(event_uid, ',' ORDER BY time_dt, event_uid) FILTER (k <= 100) AS sample
FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY time_dt, event_uid) AS k FROM hits) GROUP BY rule_id"""


@query("SRC2_count_and_sample", SAMPLED, (EV, HITS))
def src2(spark, sf_dir):
    return D.count_and_sample(D.hits(events(spark, sf_dir), RULES, START, END)).withColumn("sample", F.array_join("sample", ","))


@query("SRC3_authentication_scan", f"SELECT event_uid, {US}, user_name, src_ip FROM ev WHERE {W} AND class_uid = 3002 AND status = 'Failure'")
def src3(spark, sf_dir):
    return D.authentication(events(spark, sf_dir), START, END, "Failure").select("event_uid", micros(), F.col("actor.user.name").alias("user_name"), F.col("src_endpoint.ip").alias("src_ip"))


@query("SRC4_api_activity_scan", f"SELECT event_uid, {US}, operation FROM ev WHERE {W} AND class_uid = 6003 AND service = 's3.amazonaws.com' AND operation = 'GetObject'")
def src4(spark, sf_dir):
    return D.api_activity(events(spark, sf_dir), START, END, "s3.amazonaws.com", "GetObject").select("event_uid", micros(), F.col("api.operation").alias("operation"))


@query("SRC5_network_scan", f"SELECT event_uid, {US}, src_ip, dst_ip, dst_port, bytes_out FROM ev WHERE {W} AND class_uid = 4001 AND dst_ip = '10.1.0.3' AND dst_port = 3389")
def src5(spark, sf_dir):
    return D.network(events(spark, sf_dir), START, END, dst_ip="10.1.0.3", dst_port=3389).select("event_uid", micros(), F.col("src_endpoint.ip").alias("src_ip"), F.col("dst_endpoint.ip").alias("dst_ip"), F.col("dst_endpoint.port").alias("dst_port"), "traffic.bytes_out")


@query("SRC6_security_finding_scan", f"SELECT event_uid, {US} FROM ev WHERE {W} AND class_uid = 2001")
def src6(spark, sf_dir):
    return D.findings(events(spark, sf_dir), START, END).select("event_uid", micros())


@query("SRC13_findings_by_severity", f"SELECT event_uid, severity, source_name, {US} FROM fev WHERE {W} AND severity = 'High'", (FINDING_EV,))
def src13(spark, sf_dir):
    """The finding scan over all sources with findings of a security product among them."""
    both = events(spark, sf_dir).unionByName(finding_events(spark, sf_dir))
    return D.findings(both, START, END, "High").select("event_uid", "severity", "source_name", micros())


@query("SRC7_named_sources", "SELECT source_name, count(*) AS n, CASE source_name WHEN 'cloudtrail' THEN 'lake_table_us_west_2_cloud_trail_mgmt' WHEN 'vpc-flow' THEN 'lake_table_us_west_2_vpc_flow' ELSE 'lake_table_us_west_2_route53' END AS table_name FROM ev GROUP BY 1")
def src7(spark, sf_dir):
    named = catalog.sources(spark, "us-west-2").select(F.col("name").alias("source_name"), "table_name")
    return events(spark, sf_dir).groupBy("source_name").agg(F.count("*").alias("n")).join(F.broadcast(named), "source_name")


PROFILE = " UNION ALL ".join(f"SELECT class_uid, '{p}' AS path, count({n}) AS filled, count(*) AS events FROM ev GROUP BY 1" for n, p in (PATHS | {n: n for n in ("event_uid", "class_uid", "class_name", "time_dt", "status", "status_id", "rcode_id", "source_name")} | {"resource_uid": "resources[].uid"}).items())


@query("SRC14_class_profile", PROFILE)
def src14(spark, sf_dir):
    """Leaves that the adapter fills; those that it never fills are left out here."""
    rows = catalog.class_profile(events(spark, sf_dir))
    return rows.where(~F.col("path").isin("severity", "severity_id", "actor.user.uid", "actor.user.account_uid", "actor.session.uid", "resources[].type", "resources[].name")).drop("type")


@query("SRC8_schema_listing", "SELECT column_name AS \"column\", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END AS type FROM (DESCRIBE SELECT * FROM events)", ())
def src8(spark, sf_dir):
    return catalog.columns(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("SRC9_class_profile", "SELECT class_uid, event_uid, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY class_uid ORDER BY time_dt, event_uid) AS k FROM ev) WHERE k <= 5")
def src9(spark, sf_dir):
    return catalog.sample_per_class(events(spark, sf_dir).select("class_uid", "event_uid", "time_dt")).select("class_uid", "event_uid", "rank")


@query("SRC10_guarded_sql", "SELECT status, count(*) AS n FROM ev GROUP BY status")
def src10(spark, sf_dir):
    return catalog.guarded_sql(spark, "SELECT status, count(*) AS n FROM lake_events GROUP BY status", {"lake_events": events(spark, sf_dir)})


@query("SRC11_sql_template", f"SELECT user_name, count(*) AS n FROM ev WHERE {W} AND status = 'Failure' GROUP BY 1")
def src11(spark, sf_dir):
    text = "SELECT actor.user.name AS user_name, count(*) AS n FROM lake_events WHERE time_dt >= timestamp({start_time}) AND time_dt < timestamp({end_time}) AND status = 'Failure' GROUP BY 1"
    return catalog.template_sql(spark, text, START, END, {"lake_events": events(spark, sf_dir)})


RULE_LIST = "SELECT rule_id, severity, CAST(class_uid AS INT) AS class_uid, CAST(threshold AS BIGINT) AS threshold, CAST(row_limit AS BIGINT) AS row_limit, matches FROM rules LEFT JOIN (SELECT rule_id, count(*) AS matches FROM hits GROUP BY 1) USING (rule_id)"


@query("SRC12_rule_table", RULE_LIST, DETECT)
def src12(spark, sf_dir):
    counts = D.hits(events(spark, sf_dir), RULES, START, END).groupBy("rule_id").agg(F.count("*").alias("matches"))
    return D.rule_table(spark, RULES).join(counts, "rule_id", "left").select("rule_id", "severity", "class_uid", "threshold", "row_limit", "matches")


# --- predicates: each applied to all events -----------------------------------------------------------------------------


def counted(name: str, sql: str, build):
    @query(name, f"SELECT class_uid, count(*) AS n FROM ev WHERE {sql} GROUP BY 1")
    def run(spark, sf_dir):
        ev = events(spark, sf_dir)
        return ev.where(build(ev)).groupBy("class_uid").agg(F.count("*").alias("n"))


one = lambda path, op, v: lambda ev: P.compile_filter(ev, {"field": path, op: v})
counted("FLT1_equals", "CAST(dst_port AS VARCHAR) = '443'", one("dst_endpoint.port", "equals", 443))
counted("FLT2_not_equals", "user_name IS DISTINCT FROM 'user_3'", one("actor.user.name", "not_equals", "user_3"))
counted("FLT3_contains", "contains(operation, 'User')", one("api.operation", "contains", "User"))
counted("FLT4_in", "operation IN ('GetObject', 'PutObject')", one("api.operation", "in", ["GetObject", "PutObject"]))
counted("FLT5_regex", "regexp_matches(src_ip, '^203\\.0\\.113\\.[0-9]$')", one("src_endpoint.ip", "regex", r"^203\.0\.113\.[0-9]$"))
counted("FLT6_int_equals", "rcode_id = 3", one("rcode_id", "int_equals", 3))
counted("FLT7_list_any_equals", "coalesce(resource_uid = 'arn:aws:s3:::bucket-4', false)", lambda ev: P.list_any_equals(ev, "resources", "uid", "arn:aws:s3:::bucket-4"))
counted("FLT8_list_any_in", "coalesce(resource_uid IN ('arn:aws:s3:::bucket-1', 'arn:aws:s3:::bucket-2'), false)", lambda ev: P.list_any_in(ev, "resources", "uid", ["arn:aws:s3:::bucket-1", "arn:aws:s3:::bucket-2"]))
counted("FLT9_and_or", "(status = 'Failure' AND class_uid = 3002) OR region = 'ap-southeast-1'", lambda ev: P.any_of([P.all_of([field(ev, "status") == "Failure", F.col("class_uid") == 3002]), field(ev, "cloud.region") == "ap-southeast-1"]))
counted("FLT10_raw_sql", "bytes_out > 10000000", lambda ev: P.raw_sql("traffic.bytes_out > 10000000"))
counted("FLT12_all_filters", "operation = 'AssumeRole' AND user_type IS DISTINCT FROM 'AWSService'", lambda ev: P.compile_all(ev, [{"field": "api.operation", "equals": "AssumeRole"}, {"field": "actor.user.type", "not_equals": "AWSService"}]))
counted("FLT16_ipv4", "src_ip IS NOT NULL", lambda ev: P.is_ipv4(field(ev, "src_endpoint.ip")))
counted("FLT17_arn", "resource_uid LIKE 'arn:%'", lambda ev: P.is_arn(field(ev, "resources")[0]["uid"]))
counted("FLT18_private", "src_ip LIKE '10.%'", lambda ev: P.is_private(field(ev, "src_endpoint.ip")))


@query("FLT13_dotted_path", "SELECT service, count(*) AS n FROM ev GROUP BY 1")
def flt13(spark, sf_dir):
    ev = events(spark, sf_dir)
    flat = ev.withColumn("api.service.name", F.when(F.col("class_uid") == 6003, F.col("api.service.name")))
    return flat.groupBy(field(flat, "api.service.name").alias("service")).agg(F.count("*").alias("n"))


@query("FLT14_first_text", "SELECT coalesce(nullif(user_name, ''), nullif(uid_alt, '')) AS who, count(*) AS n FROM ev GROUP BY 1")
def flt14(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.groupBy(first_text(ev, "actor.user.name", "actor.user.uid_alt", "actor.session.uid").alias("who")).agg(F.count("*").alias("n"))


@query("FLT15_object_array", "SELECT resource_uid AS uid, count(*) AS n FROM ev WHERE resource_uid IS NOT NULL GROUP BY 1")
def flt15(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.select(F.explode(objects(ev, "resources")).alias("r")).groupBy(F.col("r.uid").alias("uid")).agg(F.count("*").alias("n"))


CLOUDTRAIL = [r for r in RULES if "cloudtrail" in r["data_sources"] or {"eks-audit", "gcp-audit"} & {*r["data_sources"]}]


@query("FLT19_rules_of_source", "SELECT rule_id, coalesce(n, 0) AS n FROM (VALUES " + ", ".join(f"('{r['id']}')" for r in CLOUDTRAIL) + ") r(rule_id) LEFT JOIN (SELECT rule_id, count(*) AS n FROM hits GROUP BY 1) USING (rule_id)", (EV, HITS))
def flt19(spark, sf_dir):
    rules = D.for_source(RULES, "cloudtrail")
    return D.run_all(events(spark, sf_dir), rules, START, END).select("rule_id", F.col("total_matches").alias("n"))


# --- detection ------------------------------------------------------------------------------------------------------------

MESSAGE = "CASE WHEN triggered THEN format('Detection ''{}'' triggered with {} matches (threshold: {})', name, match_count, threshold) ELSE format('Detection ''{}'' did not trigger ({} matches, threshold: {})', name, match_count, threshold) END"


@query("DET1_threshold", f"SELECT rule_id, match_count, triggered, {MESSAGE} AS message FROM results", DETECT)
def det1(spark, sf_dir):
    return D.run_all(events(spark, sf_dir), RULES, START, END).select("rule_id", "match_count", "triggered", "message")


@query("DET2_single_rule", "SELECT rule_id, total_matches, match_count, triggered FROM results WHERE rule_id = 'detect-iam-priv-esc'", DETECT)
def det2(spark, sf_dir):
    return D.run_all(events(spark, sf_dir), [r for r in RULES if r["id"] == "detect-iam-priv-esc"], START, END).select("rule_id", "total_matches", "match_count", "triggered")


RUN = f"(SELECT * FROM hits WHERE rule_id = 'detect-access-key-created' AND time_dt >= TIMESTAMP '{END}' - INTERVAL 3 DAY AND time_dt < TIMESTAMP '{END}')"


@query("DET13_single_rule_runs", f"SELECT rule_id, name, least((SELECT count(*) FROM {RUN}), row_limit) AS match_count, (SELECT count(*) FROM {RUN}) >= threshold AS triggered, '' AS error FROM rules WHERE rule_id = 'detect-access-key-created' UNION ALL SELECT 'no-such-rule', 'Unknown', 0, false, 'Rule not found: no-such-rule'", DETECT)
def det13(spark, sf_dir):
    """A rule over the three days before the end, by lookback, and a rule that is not there."""
    ev, end = events(spark, sf_dir), datetime.fromisoformat(END)
    runs = [D.run_rule(ev, RULES, r, end, lookback_minutes=3 * 24 * 60) for r in ("detect-access-key-created", "no-such-rule")]
    return runs[0].unionByName(runs[1]).select("rule_id", "name", "match_count", "triggered", F.coalesce("error", F.lit("")).alias("error"))


@query("DET3_run_all", "SELECT rule_id, severity, CAST(threshold AS BIGINT) AS threshold, total_matches, match_count, triggered FROM results", DETECT)
def det3(spark, sf_dir):
    return D.run_all(events(spark, sf_dir), RULES, START, END).select("rule_id", "severity", "threshold", "total_matches", "match_count", "triggered")


@query("DET4_sql_rule", f"SELECT 'sql-rule' AS rule_id, count(*) AS match_count, count(*) >= 25 AS triggered FROM (SELECT user_name FROM ev WHERE {W} AND status = 'Failure' GROUP BY user_name)")
def det4(spark, sf_dir):
    rows = src11(spark, sf_dir)
    return rows.agg(F.count("*").alias("match_count")).select(F.lit("sql-rule").alias("rule_id"), "match_count", (F.col("match_count") >= 25).alias("triggered"))


@query("DET6_samples", "SELECT rule_id, event_uid, k AS sample_rank FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY time_dt, event_uid) AS k FROM hits) WHERE k <= 20", (EV, HITS))
def det6(spark, sf_dir):
    found = D.hits(events(spark, sf_dir), RULES, START, END).select("rule_id", "event_uid", "time_dt")
    return D.samples(found, 20).select("rule_id", "event_uid", "sample_rank")


@query("DET7_rule_cases_on_events", "SELECT rule_id, count(*) AS n FROM hits GROUP BY 1", (EV, HITS))
def det7(spark, sf_dir):
    """The rules over events in the flat dotted-key shape that test cases use."""
    ev = events(spark, sf_dir).where(D.in_window(START, END))
    leaves = {f["field"] for r in RULES for f in r["filters"]} - {"resources"}
    flat = ev.select("class_uid", "resources", *[field(ev, p).cast("string").alias(p) for p in sorted(leaves)])
    marks = F.array_compact(F.array(*[F.when(D.rule_predicate(flat, r), F.lit(r["id"])) for r in RULES]))
    return flat.select(F.explode(marks).alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("DET8_bundled_rules", " UNION ALL ".join(f"SELECT '{r['id']}' AS rule_id, count(*) AS n FROM ev WHERE {rule_sql(r)}" for r in RULES))
def det8(spark, sf_dir):
    ev = events(spark, sf_dir)
    sums = [F.count_if(D.rule_predicate(ev, r)).alias(r["id"]) for r in RULES]
    row = ev.agg(*sums)
    return row.select(F.explode(F.array(*[F.struct(F.lit(r["id"]).alias("rule_id"), F.col(f"`{r['id']}`").alias("n")) for r in RULES])).alias("x")).select("x.rule_id", "x.n")


@query("DET9_rule_summary", "SELECT class_uid, severity, count(*) AS rules, sum(coalesce(n, 0))::BIGINT AS matches FROM (SELECT r.*, n FROM rules r LEFT JOIN (SELECT rule_id, count(*) AS n FROM hits GROUP BY 1) USING (rule_id)) GROUP BY 1, 2", DETECT)
def det9(spark, sf_dir):
    got = D.run_all(events(spark, sf_dir), RULES, START, END)
    return got.groupBy("class_uid", "severity").agg(F.count("*").alias("rules"), F.sum("total_matches").alias("matches"))


#: Detection history: one run a day of the window, of the rules over that day
HISTORY = f"""history AS (
  SELECT rule_id, severity, date_trunc('day', time_dt) AS run_day, count(*) AS match_count, count(*) >= threshold AS triggered
  FROM hits JOIN rules USING (rule_id) GROUP BY rule_id, severity, threshold, 3)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.hits(events(spark, sf_dir), RULES, START, END)
    runs = found.groupBy("rule_id", F.date_trunc("day", "time_dt").alias("run_day")).agg(F.count("*").alias("match_count"))
    return runs.join(F.broadcast(D.rule_table(spark, RULES)), "rule_id").select("rule_id", "name", "severity", "run_day", "match_count", (F.col("match_count") >= F.col("threshold")).alias("triggered"))


@query("DET10_history", "SELECT rule_id, epoch_us(run_day) AS run_us, match_count, triggered FROM history ORDER BY run_day DESC, rule_id LIMIT 500", (*DETECT, HISTORY))
def det10(spark, sf_dir):
    return history(spark, sf_dir).orderBy(F.desc("run_day"), "rule_id").limit(500).select("rule_id", F.unix_micros("run_day").alias("run_us"), "match_count", "triggered")


@query("DET11_history_filters", "SELECT severity, count(*) AS runs, count(DISTINCT rule_id) AS rules FROM history WHERE triggered AND contains(lower(rule_id), 'detect') GROUP BY 1", (*DETECT, HISTORY))
def det11(spark, sf_dir):
    rows = history(spark, sf_dir).where(F.col("triggered") & F.lower("rule_id").contains("detect"))
    return rows.groupBy("severity").agg(F.count("*").alias("runs"), F.count_distinct("rule_id").alias("rules"))


@query("DET12_run_counters", "SELECT count(*) AS rules_checked, count(*) FILTER (triggered) AS triggered, count(*) FILTER (triggered AND severity IN ('critical', 'high')) AS investigations FROM results", DETECT)
def det12(spark, sf_dir):
    got = D.run_all(events(spark, sf_dir), RULES, START, END)
    return got.agg(F.count("*").alias("rules_checked"), F.count_if("triggered").alias("triggered"), F.count_if(F.col("triggered") & F.col("severity").isin("critical", "high")).alias("investigations"))


@query("DET_grouped_threshold", "SELECT rule_id, user_name AS group_value, count(*) AS n FROM hits GROUP BY 1, 2 HAVING count(*) >= 5", (EV, HITS))
def det_grouped(spark, sf_dir):
    return D.grouped_threshold(D.hits(events(spark, sf_dir), RULES, START, END), "actor.user.name", 5)


@query("event_classes", "SELECT class_uid, count(*) AS n FROM ev GROUP BY 1")
def classes(spark, sf_dir):
    return events(spark, sf_dir).join(F.broadcast(event_classes(spark)), "class_uid").groupBy("class_uid").agg(F.count("*").alias("n"))


@query("TOP1_first_rows", "SELECT source_name, event_uid FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY time_dt, event_uid) AS k FROM ev) WHERE k <= 10")
def top1(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("source_name").orderBy("time_dt", "event_uid"))
    return events(spark, sf_dir).select("source_name", "event_uid", "time_dt").withColumn("k", rank).where("k <= 10").select("source_name", "event_uid")


@query("TOP2_newest_first", "SELECT event_uid, epoch_us(time_dt) AS time_us FROM ev ORDER BY time_dt DESC, event_uid LIMIT 50")
def top2(spark, sf_dir):
    return events(spark, sf_dir).orderBy(F.desc("time_dt"), "event_uid").limit(50).select("event_uid", micros())
