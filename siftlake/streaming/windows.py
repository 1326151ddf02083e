"""Structured Streaming jobs from the batch semantics (STR1 to STR6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.detect import rule_marks

LATE = "15 minutes"
#: Sessions: a gap of more than 300 whole seconds ends one; Spark merges gaps equal to the session gap.
SESSION_GAP = "300 seconds 999999 microseconds"


def stream(events: DataFrame, path: str, files: int = 1) -> DataFrame:
    """A stream over the files of a folder, with the schema of ``events``."""
    return events.sparkSession.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


def rule_hits(events: DataFrame, rules: list[dict]) -> DataFrame:
    """One row for each event and rule. All events move the watermark: the marks read the time, so no filter on them is
    pushed in front of it."""
    marks = F.when(F.col("time_dt").isNotNull(), rule_marks(events, rules))
    return events.select("time_dt", "event_uid", F.explode(marks).alias("rule_id"))


def windowed_detection(events: DataFrame, rules: list[dict], size: str = "60 minutes", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Matches of each rule in tumbling or sliding windows, with the rule's threshold applied to each window."""
    window = F.window("time_dt", size, slide) if slide else F.window("time_dt", size)
    rows = rule_hits(events.withWatermark("time_dt", late), rules).groupBy(window.alias("w"), "rule_id").agg(F.count("*").alias("match_count"))
    least = F.create_map(*[F.lit(x) for r in rules for x in (r["id"], r["threshold"])])
    return rows.select("rule_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "match_count", (F.col("match_count") >= least[F.col("rule_id")]).alias("triggered"))


def sessions(events: DataFrame, entity: str, late: str = LATE) -> DataFrame:
    """Temporal clusters of an entity's events as session windows."""
    rows = events.withWatermark("time_dt", late).where(F.col(entity).isNotNull())
    got = rows.groupBy(F.session_window("time_dt", SESSION_GAP).alias("w"), F.col(entity).alias("entity")).agg(F.count("*").alias("events"), F.min("time_dt").alias("start"), F.max("time_dt").alias("end"))
    return got.select("entity", "start", "end", "events")


def freshness_monitor(events: DataFrame, seen: Callable[[DataFrame, int], None]):
    """Newest time of each source in every batch, handed to ``seen``; a writer to start."""

    def batch(rows: DataFrame, n: int) -> None:
        seen(rows.groupBy("source_name").agg(F.max("time_dt").alias("last_data_time"), F.count("*").alias("n")), n)

    return events.writeStream.foreachBatch(batch)


def daily_investigations(events: DataFrame, rules: list[dict], hours: int = 24, late: str = LATE) -> DataFrame:
    """(rule_id, opened_at): a match opens an investigation unless the rule opened one less than ``hours`` before, in event time.

    Matches wait in the rule's state until the watermark has passed them, so that neither the order of arrival within
    ``late`` nor the cut into batches matters; matches within the hours of an opened investigation do not wait.
    """
    found = rule_marks(events, rules)
    # all events move the watermark: a filter that does not read the time would be pushed in front of it
    marks = F.when(F.col("time_dt").isNotNull(), found)
    rows = events.withWatermark("time_dt", late).select(F.explode(marks).alias("rule_id"), "time_dt", F.unix_micros("time_dt").alias("us"))
    span = hours * 3_600_000_000

    def opened(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        mark, times = state.getCurrentWatermarkMs() * 1000, set(waiting)
        for part in parts:
            times.update(int(t) for t in part["us"] if last is None or t >= last + span)
        out, later = [], []
        for t in sorted(times):
            if last is not None and t < last + span:
                continue
            if t > mark:
                later.append(t)
            else:
                out.append(t)
                last = t
        state.update((last, later))
        if later:
            # at its end the timeout's millisecond has wholly passed
            state.setTimeoutTimestamp(max(later[0] // 1000 + 1, mark // 1000 + 1))
        if out:
            yield pd.DataFrame({"rule_id": [key[0]] * len(out), "us": out})

    got = rows.groupBy("rule_id").applyInPandasWithState(opened, "rule_id string, us long", "last long, waiting array<long>", "append", "EventTimeTimeout")
    return got.select("rule_id", F.timestamp_micros("us").alias("opened_at"))


def in_order(spark: SparkSession, path: str) -> None:
    """Give the files of a written folder, or of its sub-folders, times in the order of their names: the order in which a
    stream reads them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = [*fs.listStatus(at)]
    listed += [x for d in listed if d.isDirectory() for x in fs.listStatus(d.getPath())]
    found = sorted((str(x.getPath()), x) for x in listed if x.getPath().getName().startswith("part-"))
    first = min((x.getModificationTime() for _, x in found), default=0) - 1000 * len(found)
    for k, (_, x) in enumerate(found):
        fs.setTimes(x.getPath(), first + 1000 * k, -1)


def waves(path: str, frames: list[DataFrame]) -> str:
    """Write frames that arrive one after the other, in their own order of files; the path from which to stream them."""
    for k, rows in enumerate(frames):
        rows.write.parquet(f"{path}/wave-{k:03d}")
    in_order(frames[0].sparkSession, path)
    return f"{path}/wave-*"


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an appending stream over all that is there into Parquet files; ``late_rows`` counts the rows dropped as late."""
    spark = df.sparkSession
    query = df.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])
    return spark.read.schema(df.schema).parquet(path).withColumn("late_rows", F.lit(late))


def run(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there and give the result table."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])
    return df.sparkSession.table(name).withColumn("late_rows", F.lit(late))
