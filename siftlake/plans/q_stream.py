"""Queries of the streaming jobs (STR*), over the events table written as a stream of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.adapter import EV, events
from ..streaming import windows as S
from .q_enrich import CASE_RULES, CASES, M, TASK_EVENTS, window
from .q_ops import shared
from .registry import END, HITS, RULES, query

LISTED = ", ".join(f"'{c}'" for c in CASES)
LEAST = "CASE rule_id " + " ".join(f"WHEN '{r['id']}' THEN {r['threshold']}" for r in CASE_RULES) + " END"


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The window's events as files in time order, one for each stretch of it."""
    path, rows = shared(spark, "stream"), window(spark, sf_dir)
    rows.repartitionByRange(4, "time_dt").sortWithinPartitions("time_dt").write.parquet(path)
    return S.stream(spark.read.parquet(path), path, files=4), shared(spark, "stream-state")


@query("STR1_tumbling_detection", f"SELECT rule_id, epoch_us(time_bucket(INTERVAL 60 MINUTE, time_dt)) AS start_us, count(*) AS match_count, count(*) >= {LEAST} AS triggered FROM hits WHERE rule_id IN ({LISTED}) GROUP BY 1, 2", (EV, HITS))
def str1(spark, sf_dir):
    source, state = files(spark, sf_dir)
    got = S.run(S.windowed_detection(source, CASE_RULES), f"s{uuid.uuid4().hex}", "complete", state)
    return got.select("rule_id", F.unix_micros("start").alias("start_us"), "match_count", "triggered")


@query("STR2_sliding_detection", f"SELECT rule_id, epoch_us(time_bucket(INTERVAL 15 MINUTE, time_dt) - k * INTERVAL 15 MINUTE) AS start_us, count(*) AS match_count FROM hits, range(4) r(k) WHERE rule_id IN ({LISTED}) GROUP BY 1, 2", (EV, HITS))
def str2(spark, sf_dir):
    source, state = files(spark, sf_dir)
    got = S.run(S.windowed_detection(source, CASE_RULES, slide="15 minutes"), f"s{uuid.uuid4().hex}", "complete", state)
    return got.select("rule_id", F.unix_micros("start").alias("start_us"), "match_count")


SESSIONS = """SELECT entity, epoch_us(min(time_dt)) AS start_us, epoch_us(max(time_dt)) AS end_us, count(*) AS events FROM (
  SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY time_dt, event_uid ROWS UNBOUNDED PRECEDING) AS c FROM (
    SELECT src_ip AS entity, time_dt, event_uid, coalesce(CAST(floor((epoch_us(time_dt) - epoch_us(lag(time_dt) OVER (PARTITION BY src_ip ORDER BY time_dt, event_uid))) / 1000000) > 300 AS INT), 0) AS b FROM m)) GROUP BY entity, c"""


@query("STR3_sessions", SESSIONS, (EV, HITS, M))
def str3(spark, sf_dir):
    """Sessions of matched events by source address, in batch mode of the same job (late rows come in file order)."""
    from .q_enrich import matches

    rows = matches(spark, sf_dir).withColumn("src_ip", F.col("src_endpoint.ip"))
    got = S.sessions(rows, "src_ip")
    return got.select("entity", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@query("STR4_freshness_monitor", "SELECT source_name, epoch_us(max(time_dt)) AS last_us FROM ev WHERE time_dt >= TIMESTAMP '2024-01-03' AND time_dt < TIMESTAMP '2024-01-24' GROUP BY 1")
def str4(spark, sf_dir):
    source, state = files(spark, sf_dir)
    out = shared(spark, "freshness")
    S.freshness_monitor(source, lambda rows, n: rows.write.mode("append").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("source_name").agg(F.unix_micros(F.max("last_data_time")).alias("last_us"))


@query("STR5_first_investigations", f"SELECT rule_id, count(*) AS n FROM (SELECT DISTINCT rule_id FROM hits WHERE rule_id IN ({LISTED})) GROUP BY 1", (EV, HITS))
def str5(spark, sf_dir):
    """The rules of the three cases that open an investigation, each once: its first. STR7 has all that they open."""
    return daily(spark, sf_dir, CASE_RULES).select("rule_id").distinct().groupBy("rule_id").agg(F.count("*").alias("n"))


def daily(spark: SparkSession, sf_dir: str, rules: list[dict]) -> DataFrame:
    """Investigations that the window's events open, fed in several batches and up to ten minutes out of order."""
    path, rows = shared(spark, "stream"), window(spark, sf_dir)
    # a heartbeat after the window's end moves the watermark past its last event
    beat = events(spark, sf_dir).limit(1).withColumn("time_dt", F.lit(END).cast("timestamp") + F.expr("INTERVAL 1 DAY")).withColumn("class_uid", F.lit(-1).cast(rows.schema["class_uid"].dataType))
    arrival = F.unix_micros("time_dt") + F.pmod(F.xxhash64("event_uid"), F.lit(600_000_000))
    rows.unionByName(beat).withColumn("arrival", arrival).repartitionByRange(12, "arrival").drop("arrival").write.parquet(path)
    S.in_order(spark, path)
    source = S.stream(spark.read.parquet(path), path, files=2)
    return S.run_to_files(S.daily_investigations(source, rules), shared(spark, "opened"), shared(spark, "stream-state"))


DAILY = """SELECT rule_id, epoch_us(opened) AS opened_us FROM (WITH RECURSIVE t AS MATERIALIZED (SELECT DISTINCT rule_id, time_dt FROM hits), o AS (
  SELECT rule_id, min(time_dt) AS opened FROM t GROUP BY 1
  UNION ALL SELECT o.rule_id, min(t.time_dt) FROM o JOIN t ON t.rule_id = o.rule_id AND t.time_dt >= o.opened + INTERVAL 24 HOUR GROUP BY o.rule_id) SELECT * FROM o)"""


@query("STR7_daily_investigations", DAILY, (EV, HITS))
def str7(spark, sf_dir):
    """All investigations of all rules: one a rule within 24 hours of event time."""
    return daily(spark, sf_dir, RULES).select("rule_id", F.unix_micros("opened_at").alias("opened_us"))


EVERY = "CASE rule_id " + " ".join(f"WHEN '{r['id']}' THEN {r['threshold']}" for r in RULES) + " END"


#: Batches in which the events that are not late arrive.
BATCHES = 6


def closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all rules in append mode, each written once the watermark has closed it; several batches.

    Events arrive up to ten minutes out of order; those of one region arrive when all others have, and are dropped and
    counted. A batch's rows are late by the watermark that the batches before it have reached, and that one takes effect
    a batch after its rows: so two heartbeats come between, and files have times in the order of their arrival.

    A batch reads as many files as its events need tasks, and each heartbeat has as many: the late events then begin two
    batches after the first heartbeat, also where an arrival's stretch has no events and so no file.
    """
    path, rows = shared(spark, "stream"), window(spark, sf_dir)
    files = max(1, -(-spark.read.parquet(f"{sf_dir}/events.parquet").count() // (BATCHES * TASK_EVENTS)))  # told by the files' footers
    empty = lambda c: F.lit(None).cast(rows.schema[c].dataType)
    # an event of no rule after the window's end moves the watermark past the last window
    beat = rows.limit(1).withColumns({"time_dt": F.lit(END).cast("timestamp") + F.expr("INTERVAL 9 DAYS"), "class_uid": F.lit(6003), "api": empty("api"), "actor": empty("actor"), "resources": empty("resources"), "cloud": empty("cloud")})
    beats = spark.range(0, files, 1, files).join(F.broadcast(beat)).drop("id")  # one file each
    late = F.col("cloud.region") == "ap-southeast-1"
    arrival = F.unix_micros("time_dt") + F.pmod(F.xxhash64("event_uid"), F.lit(600_000_000))
    on_time = rows.where(~late).withColumn("arrival", arrival).repartitionByRange(BATCHES * files, "arrival").drop("arrival")
    path = S.waves(path, [on_time, beats, beats, rows.where(late).repartition(files, "event_uid")])
    source = S.stream(spark.read.parquet(path), path, files=files)
    return S.run_to_files(S.windowed_detection(source, RULES), shared(spark, "windows"), shared(spark, "stream-state"))


@query("STR8_closed_windows", f"SELECT rule_id, epoch_us(time_bucket(INTERVAL 60 MINUTE, time_dt)) AS start_us, count(*) AS match_count, count(*) >= {EVERY} AS triggered FROM hits WHERE region <> 'ap-southeast-1' GROUP BY 1, 2", (EV, HITS))
def str8(spark, sf_dir):
    """What the stream writes is what a batch job gives for the events that were not late."""
    return closed_windows(spark, sf_dir).select("rule_id", F.unix_micros("start").alias("start_us"), "match_count", "triggered")


@query("STR6_late_rows", f"SELECT count(*) AS windows, sum(n)::BIGINT AS matches FROM (SELECT rule_id, time_bucket(INTERVAL 60 MINUTE, time_dt) AS w, count(*) AS n FROM hits WHERE rule_id IN ({LISTED}) GROUP BY 1, 2)", (EV, HITS))
def str6(spark, sf_dir):
    """All of the window in one batch: nothing is late, so the stream's totals are those of the batch."""
    source, state = files(spark, sf_dir)
    got = S.run(S.windowed_detection(source, CASE_RULES), f"s{uuid.uuid4().hex}", "update", state)
    last = F.row_number().over(Window.partitionBy("rule_id", "start").orderBy(F.desc("match_count")))
    return got.withColumn("k", last).where("k = 1").agg(F.count("*").alias("windows"), F.sum("match_count").alias("matches"))
