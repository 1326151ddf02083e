"""Queries of the long-running streams (STR9 to STR13): several batches, out of order, each against its batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapter import EV
from ..streaming import live as L
from ..streaming import windows as S
from .q_enrich import EVW, window
from .q_ops import shared
from .q_stream import EVERY
from .registry import END, HITS, RULES, query


def arrivals(spark: SparkSession, sf_dir: str, late=None, files: int = 5) -> DataFrame:
    """The window's events as a stream of one file a batch, up to ten minutes out of order; then two heartbeats of an
    event of no class and address, which move the watermark past the window; then the events that ``late`` picks."""
    rows = window(spark, sf_dir)
    arrival = F.unix_micros("time_dt") + F.pmod(F.xxhash64("event_uid"), F.lit(600_000_000))
    empty = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("api", "actor", "resources", "cloud", "src_endpoint", "dst_endpoint", "query", "traffic")}
    beat = rows.limit(1).withColumns(empty | {"time_dt": F.lit(END).cast("timestamp") + F.expr("INTERVAL 1 DAY"), "class_uid": F.lit(-1).cast(rows.schema["class_uid"].dataType), "source_name": F.lit("heartbeat")}).coalesce(1)
    on_time = rows if late is None else rows.where(~late)
    frames = [on_time.withColumn("arrival", arrival).repartitionByRange(files, "arrival").drop("arrival")]
    frames += [beat, beat] if late is None else [rows.where(late).repartition(2, "event_uid")]
    path = S.waves(shared(spark, "live"), frames)
    return S.stream(spark.read.parquet(path), path, files=1)


SESSIONS = """SELECT entity, epoch_us(min(time_dt)) AS start_us, epoch_us(max(time_dt)) AS end_us, count(*) AS events FROM (
  SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY time_dt, event_uid ROWS UNBOUNDED PRECEDING) AS c FROM (
    SELECT src_ip AS entity, time_dt, event_uid, coalesce(CAST(floor((epoch_us(time_dt) - epoch_us(lag(time_dt) OVER (PARTITION BY src_ip ORDER BY time_dt, event_uid))) / 1000000) > 300 AS INT), 0) AS b FROM evw WHERE src_ip IS NOT NULL)) GROUP BY entity, c"""


@query("STR9_streamed_sessions", SESSIONS, (EV, EVW))
def str9(spark, sf_dir):
    """Sessions by source address in append mode: each is written once, whatever batches its events came in."""
    source = arrivals(spark, sf_dir).withColumn("src_ip", F.col("src_endpoint.ip"))
    got = S.run_to_files(L.streamed_sessions(source, "src_ip"), shared(spark, "sessions"), shared(spark, "live-state"))
    return got.select("entity", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


LATE = "region = 'ap-southeast-1' AND time_dt < (SELECT max(time_dt) FROM evw WHERE region <> 'ap-southeast-1') - INTERVAL 15 MINUTE"


@query("STR10_late_rows_apart", f"SELECT event_uid, source_name, {LATE} AS is_late FROM evw", (EV, EVW))
def str10(spark, sf_dir):
    """Every event of the window, in the table of kept rows or in that of late ones: those of one region come last."""
    path = shared(spark, "late-rows")
    L.run_by_batch(arrivals(spark, sf_dir, late=F.col("cloud.region") == "ap-southeast-1"), L.split_late(spark, path), shared(spark, "live-state"))
    of = lambda name: spark.read.parquet(f"{path}/{name}").select("event_uid", "source_name", F.lit(name == "late").alias("is_late"))
    return of("kept").unionByName(of("late"))


SILENT = """SELECT source_name, severity, us AS last_us, us + minutes::BIGINT * 60000000 AS stale_us
FROM (SELECT source_name, epoch_us(time_dt) AS us, lead(epoch_us(time_dt)) OVER (PARTITION BY source_name ORDER BY time_dt) AS next_us FROM evw), (VALUES ('medium', 120), ('high', 360)) l(severity, minutes)
WHERE next_us IS NULL OR next_us > us + minutes::BIGINT * 60000000"""


@query("STR11_silent_sources", SILENT, (EV, EVW))
def str11(spark, sf_dir):
    """Freshness by timers: every silence of a source that reaches a threshold, told without a row of it."""
    with L.rocksdb(spark):
        got = S.run_to_files(L.freshness_alerts(arrivals(spark, sf_dir)), shared(spark, "silent"), shared(spark, "live-state"))
    return got.select("source_name", "severity", "last_us", "stale_us")


BY_MINUTE = """SELECT rule_id, us AS opened_us FROM (WITH RECURSIVE t AS MATERIALIZED (SELECT rule_id, epoch_us(time_dt) // 60000000 AS m, min(epoch_us(time_dt)) AS us FROM hits GROUP BY 1, 2), o AS (
  SELECT rule_id, min(m) AS m FROM t GROUP BY 1
  UNION ALL SELECT o.rule_id, min(t.m) FROM o JOIN t ON t.rule_id = o.rule_id AND t.m >= o.m + 1440 GROUP BY o.rule_id) SELECT rule_id, m FROM o)
JOIN (SELECT rule_id, epoch_us(time_dt) // 60000000 AS m, min(epoch_us(time_dt)) AS us FROM hits GROUP BY 1, 2) USING (rule_id, m)"""


@query("STR12_investigations_by_minute", BY_MINUTE, (EV, HITS))
def str12(spark, sf_dir):
    """Investigations of all rules, one within 24 hours by the minute, from state in RocksDB."""
    with L.rocksdb(spark):
        return S.run_to_files(L.investigations_by_minute(arrivals(spark, sf_dir), RULES), shared(spark, "opened"), shared(spark, "live-state")).select("rule_id", "opened_us")


@query("STR13_windows_exactly_once", f"SELECT rule_id, epoch_us(time_bucket(INTERVAL 15 MINUTE, time_dt) - k * INTERVAL 15 MINUTE) AS start_us, count(*) AS match_count, count(*) >= {EVERY} AS triggered FROM hits, range(4) r(k) GROUP BY 1, 2, rule_id", (EV, HITS))
def str13(spark, sf_dir):
    """Sliding windows of all rules, written by batch number, so that a batch that is run again replaces itself."""
    path = shared(spark, "windows")
    L.run_by_batch(S.windowed_detection(arrivals(spark, sf_dir), RULES, slide="15 minutes"), L.by_batch(path), shared(spark, "live-state"))
    return spark.read.parquet(path).select("rule_id", F.unix_micros("start").alias("start_us"), "match_count", "triggered")
