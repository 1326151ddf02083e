"""Health, alerts, playbooks, history and artifacts (AGG1, AGG5 to AGG9, ALR*, PLB*, SNK*, INV1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ["info", "low", "medium", "high", "critical"]
STALE_MINUTES, VERY_STALE_MINUTES = 120, 360


def severity_rank(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, s in enumerate(SEVERITIES) for x in (s, k)])[F.lower(c)]


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 60_000_000.0


def class_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("class_uid", "class_name").agg(F.count("*").alias("n"), F.min("time_dt").alias("earliest"), F.max("time_dt").alias("latest"))


def health(events: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """One row a source: rows, newest time, classes in the last hour, age, healthy. Sources without rows are not healthy."""
    hour = F.when((F.col("time_dt") >= as_of - F.expr("INTERVAL 1 HOUR")) & (F.col("time_dt") < as_of), F.col("class_uid"))
    seen = events.where(F.col("time_dt") < as_of).groupBy("source_name").agg(F.count("*").alias("record_count"), F.max("time_dt").alias("last_data_time"), F.count_distinct(hour).alias("recent_classes"))
    rows = F.broadcast(sources).join(seen, "source_name", "left").withColumn("record_count", F.coalesce("record_count", F.lit(0)))
    age = minutes_between(as_of, F.col("last_data_time"))
    ok = F.when(F.col("last_data_time").isNotNull(), age <= F.col("expected_freshness_minutes")).otherwise(F.col("record_count") > 0)
    return rows.withColumn("age_minutes", age).withColumn("healthy", ok).withColumn("checked_at", as_of)


def latest(rows: DataFrame, by: str, at: str) -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(by).agg(F.max_by(F.struct(*[c for c in rows.columns if c != by]), at).alias("x")).select(by, "x.*")


def append(rows: DataFrame, path: str, day: Column) -> None:
    """Add rows to a history table partitioned by day."""
    rows.withColumn("day", F.date_format(day, "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(path)


def run_rows(results: DataFrame, executed_at: Column, source: str | None, lookback_minutes: int) -> DataFrame:
    """Rows of the run history: one a rule and run, without its matches. The same run of a rule has the same run_id.

    results: rule_id, name, severity, match_count, triggered, and error where a run may have failed.
    """
    error = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    run = F.sha2(F.concat_ws("|", "rule_id", executed_at.cast("string"), F.lit(source or ""), F.lit(str(lookback_minutes))), 256)
    return results.select(
        F.substring(run, 1, 32).alias("run_id"), "rule_id", F.col("name").alias("rule_name"), "triggered", "severity", "match_count", executed_at.alias("executed_at"),
        error.alias("error"), F.lit(source).cast("string").alias("source_name"), F.lit(lookback_minutes).cast("long").alias("lookback_minutes"),
    )


def replace_investigations(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the investigations in ``rows``; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("inv_id").parquet(path)


def recent(history: DataFrame, at: str, as_of: Column, days: int = 7) -> DataFrame:
    return history.where(F.col(at) >= as_of - F.make_interval(days=F.lit(days)))


def alerts(results: DataFrame, samples: DataFrame) -> DataFrame:
    """One row a triggered rule, with at most five sample events (rule_id, event_uid, sample_rank)."""
    few = samples.where("sample_rank <= 5").groupBy("rule_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_rank", "event_uid"))), lambda x: x["event_uid"]), ",").alias("sample"))
    return results.where("triggered").join(few, "rule_id", "left").select("rule_id", "name", "severity", "match_count", "message", F.coalesce("sample", F.lit("")).alias("sample"))


def routed(rows: DataFrame) -> DataFrame:
    """Critical alerts go to two topics, others to one."""
    topics = F.when(F.col("severity") == "critical", F.array(F.lit("critical"), F.lit("general"))).otherwise(F.array(F.lit("general")))
    return rows.withColumn("topic", F.explode(topics))


def to_investigate(rows: DataFrame, investigations: DataFrame, at: str = "executed_at") -> DataFrame:
    """Critical and high alerts without an active or enriching investigation of their rule in the 24 hours before."""
    busy = investigations.where(F.col("status").isin("active", "enriching")).select(F.col("rule_id").alias("busy_rule"), "created_at")
    near = (rows["rule_id"] == F.col("busy_rule")) & (F.col("created_at") > F.col(at) - F.expr("INTERVAL 24 HOURS")) & (F.col("created_at") <= F.col(at))
    return rows.where(F.col("severity").isin("critical", "high")).join(busy, near, "left_anti")


def freshness_alerts(health_rows: DataFrame) -> DataFrame:
    age = F.col("age_minutes")
    text = F.format_string("Source '%s' data is %.0f minutes stale (threshold: 120 min)", "source_name", age)
    return health_rows.where(age > STALE_MINUTES).select(F.concat(F.lit("freshness-"), "source_name").alias("rule_id"), F.when(age > VERY_STALE_MINUTES, "high").otherwise("medium").alias("severity"), text.alias("message"))


def alert_text(rows: DataFrame) -> DataFrame:
    subject = F.substring(F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "name"), 1, 100)
    return rows.select("rule_id", subject.alias("subject"), F.concat_ws("\n", "message", F.concat(F.lit("Rule: "), "rule_id"), F.concat(F.lit("Matches: "), "match_count")).alias("body"))


def finding_records(rows: DataFrame, product: str = "siftlake") -> DataFrame:
    return rows.select(F.concat(F.lit(product), F.lit("/"), "rule_id").alias("id"), F.upper("severity").alias("severity_label"), F.col("name").alias("title"), F.lit(product).alias("product"), "match_count")


def matching_playbooks(results: DataFrame, playbooks: DataFrame) -> DataFrame:
    """(rule, playbook) pairs whose trigger holds. Empty lists in a trigger hold for all; playbooks are a small table."""
    any_of = lambda wanted, has: (F.size(wanted) == 0) | F.arrays_overlap(wanted, has)
    p = F.broadcast(playbooks.where("enabled").withColumnRenamed("name", "playbook_name"))
    holds = (severity_rank(results["severity"]) >= severity_rank(F.col("min_severity"))) & ((F.size("rule_ids") == 0) | F.array_contains("rule_ids", results["rule_id"])) & any_of(F.col("playbook_tags"), results["tags"]) & any_of(F.col("techniques"), results["mitre"])
    return results.where("triggered").join(p, holds)


def planned_actions(matched: DataFrame, at: Column, *keep: str) -> DataFrame:
    """Dry run at a time: one row an action, and its playbook's status. ``keep``: columns of ``matched`` to keep."""
    office = F.dayofweek(at).between(2, 6) & (F.hour(at) >= 9) & (F.hour(at) < 18)
    rows = matched.select("rule_id", "playbook_id", *keep, office.alias("__office"), F.posexplode("actions").alias("place", "a"))
    state = F.when(F.col("a.approval") == "auto", "pending").when((F.col("a.approval") == "business_hours") & F.col("__office"), "pending").otherwise("awaiting_approval")
    rows = rows.select("rule_id", "playbook_id", *keep, "place", F.col("a.name").alias("action"), state.alias("status"))
    waits = F.bool_or(F.col("status") == "awaiting_approval").over(Window.partitionBy("rule_id", "playbook_id"))
    return rows.withColumn("playbook_status", F.when(waits, "awaiting_approval").otherwise("running"))
