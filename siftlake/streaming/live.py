"""Long-running streams: sessions, late rows, freshness timers, investigations a day, sinks that repeat without doubling.

All of them give the same rows however the input is cut into batches, as long as rows come within ``late`` of the
newest time seen before; later ones go to ``split_late``'s own table, or are dropped and counted by Spark. A run that is
killed goes on from its checkpoint folder. Processors with state need the RocksDB state store; ``rocksdb`` sets it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.detect import rule_marks
from .windows import LATE, SESSION_GAP

MINUTE = 60_000_000
#: Minutes without data after which a source is stale, by the severity told (fixed values).
STALE = {"medium": 120, "high": 360}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that processors need, for the streams that are started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def timed(value) -> object:
    """A column that reads the time, so that a filter on it stays behind the watermark and all rows move that."""
    return F.when(F.col("time_dt").isNotNull(), value)


def streamed_sessions(events: DataFrame, entity: str, late: str = LATE) -> DataFrame:
    """Sessions of an entity, each written once when the watermark has passed its gap; batches merge into them."""
    rows = events.withWatermark("time_dt", late).withColumn("__entity", timed(F.col(entity))).where("__entity IS NOT NULL")
    got = rows.groupBy(F.session_window("time_dt", SESSION_GAP).alias("w"), F.col("__entity").alias("entity")).agg(F.count("*").alias("events"), F.min("time_dt").alias("start"), F.max("time_dt").alias("end"))
    return got.select("entity", "start", "end", "events")


# --- sinks ------------------------------------------------------------------------------------------------------------------


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink with a folder a batch: a batch that is run again replaces its own rows."""

    def put(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={n:08d}")

    return put


def run_by_batch(df: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over all that is there; what fails goes on from ``checkpoint`` in the next call, with the batch that failed."""
    query = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def split_late(spark: SparkSession, path: str, late: str = LATE, by: str | None = None, time: str = "time_dt") -> Callable[[DataFrame, int], None]:
    """A sink that parts late rows from the others: tables ``path``/kept and ``path``/late, a folder a batch.

    A row is late if it is older than the newest time of all batches before, less ``late``; with ``by``, of those of its
    own source, so that a slow source is not late for a fast one. Late rows carry the mark that they missed. The newest
    times after each batch are kept in ``path``/marks (a row a source), and a batch that is run again reads those of its
    predecessor, not its own. Rows without a time are late.
    """
    key = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    kind = "__key string, newest timestamp"

    def put(rows: DataFrame, n: int) -> None:
        rows = rows.withColumn("__key", key)
        before = spark.read.schema(kind).parquet(f"{path}/marks/batch={n - 1:08d}") if n else spark.createDataFrame([], kind)
        marked = rows.join(before.withColumnRenamed("newest", "__newest"), "__key", "left").withColumn("missed_mark", F.col("__newest") - F.expr(f"INTERVAL {late}"))
        is_late = F.col(time).isNull() | F.coalesce(F.col(time) < F.col("missed_mark"), F.lit(False))
        marked = marked.drop("__newest", "__key")
        marked.where(~is_late).drop("missed_mark").write.mode("overwrite").parquet(f"{path}/kept/batch={n:08d}")
        marked.where(is_late).write.mode("overwrite").parquet(f"{path}/late/batch={n:08d}")
        newest = rows.groupBy("__key").agg(F.max(time).alias("newest")).unionByName(before).groupBy("__key").agg(F.max("newest").alias("newest"))
        newest.where("newest IS NOT NULL").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={n:08d}")

    return put


# --- processors ---------------------------------------------------------------------------------------------------------------


def reduced(rows: DataFrame, key: str) -> DataFrame:
    """(key, minute, first_us, last_us): rows (key, us) of each minute as one, in every task: what goes to the state no
    longer grows with the rows of a busy key, but with minutes and tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        for batch in batches:
            minute = pa.compute.floor(pa.compute.divide(batch["us"].cast(pa.float64()), float(MINUTE))).cast(pa.int64())
            got = pa.table({"k": batch[key], "m": minute, "us": batch["us"]}).group_by(["k", "m"]).aggregate([("us", "min"), ("us", "max")])
            for k, m, a, b in zip(*(got[c].to_pylist() for c in ("k", "m", "us_min", "us_max")), strict=True):
                had = held.get((k, m))
                held[k, m] = [a, b] if had is None else [min(a, had[0]), max(b, had[1])]
        rows = [(k, m, a, b) for (k, m), (a, b) in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], [key, "minute", "first_us", "last_us"])

    got = rows.mapInArrow(run, f"`{key}` string, minute long, first_us long, last_us long")
    # the newest time of each row moves the watermark as its rows did; rows of a minute are told by their newest
    return got.withColumn("time_dt", F.timestamp_micros("last_us"))


class Minutes(StatefulProcessor):
    """Keeps, of each key, the minutes that the watermark has not passed yet, and hands them on in order when it has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # state expires by timers: in event time there is no other time to live
        self.waiting = handle.getMapState("waiting", "minute long", "first_us long, last_us long")
        self.known = handle.getValueState("known", "told string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            had = self.waiting.getValue((r["minute"],)) if self.waiting.containsKey((r["minute"],)) else None
            first, last = (r["first_us"], r["last_us"]) if had is None else (min(had[0], r["first_us"]), max(had[1], r["last_us"]))
            self.waiting.updateValue((r["minute"],), (first, last))
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def _advance(self, key: str, mark: int) -> Iterator[Row]:
        known = json.loads(self.known.get()[0]) if self.known.exists() else None
        minutes = sorted((k[0], v[0], v[1]) for k, v in self.waiting.iterator())
        for minute, first, last in [x for x in minutes if (x[0] + 1) * MINUTE <= mark]:
            self.waiting.removeKey((minute,))
            known, out = self.passed(key, known, minute, first, last)
            yield from out
        left = [x for x in minutes if (x[0] + 1) * MINUTE > mark]
        known, out, wake = self.silent(key, known, left[0][1] if left else None, mark)
        yield from out
        if known is not None:
            self.known.update((json.dumps(known),))
        elif self.known.exists():
            self.known.clear()
        wanted = [(m + 1) * MINUTE for m, _, _ in left[:1]] + ([wake] if wake is not None else [])
        at = {max(-(-w // 1000), mark // 1000 + 1) for w in wanted}
        for t in list(self.handle.listTimers()):
            if t not in at:
                self.handle.deleteTimer(t)
        for t in at:
            self.handle.registerTimer(t)

    def passed(self, key: str, known, minute: int, first: int, last: int) -> tuple[object, list[Row]]:
        raise NotImplementedError

    def silent(self, key: str, known, next_us: int | None, mark: int) -> tuple[object, list[Row], int | None]:
        """After all minutes that have passed: what the silence since then tells, and when to look again."""
        return known, [], None


class Freshness(Minutes):
    """One row for each stretch without data of a source that reaches a threshold, when the watermark does; the timer
    fires without any row of the source. known: [newest time, thresholds told since]."""

    def __init__(self, minutes: dict[str, int]):
        self.levels = sorted((m * MINUTE, name) for name, m in minutes.items())

    def _stale(self, key: str, known, until: int) -> list[Row]:
        out = []
        for size, name in self.levels:
            if known[0] + size < until and name not in known[1]:
                known[1].append(name)
                out.append(Row(source_name=key, severity=name, last_us=known[0], stale_us=known[0] + size))
        return out

    def passed(self, key, known, minute, first, last):
        out = self._stale(key, known, first) if known else []
        return [last, []], out

    def silent(self, key, known, next_us, mark):
        if known is None:
            return known, [], None
        out = self._stale(key, known, min(mark, next_us if next_us is not None else mark))
        open_levels = [known[0] + size for size, name in self.levels if name not in known[1]]
        return known, out, open_levels[0] + 1 if open_levels else None


def freshness_alerts(events: DataFrame, minutes: dict[str, int] = STALE, late: str = LATE) -> DataFrame:
    """(source_name, severity, last_us, stale_us): sources that were silent for longer than a threshold.

    Event time: a source is stale once the newest data of all sources is ``late`` past its threshold. Gaps inside a
    minute don't count, so a source's state is the newest time and the minutes of the last ``late``.
    """
    rows = events.where("source_name IS NOT NULL AND time_dt IS NOT NULL").select("source_name", F.unix_micros("time_dt").alias("us"))
    keyed = reduced(rows, "source_name").withWatermark("time_dt", late)
    return keyed.groupBy("source_name").transformWithState(Freshness(minutes), "source_name string, severity string, last_us long, stale_us long", "Append", "EventTime")


class Investigations(Minutes):
    """One row when a rule's match opens an investigation. known: minute of the last one, forgotten when the watermark
    is past its hours, as any later match opens another."""

    def __init__(self, hours: int):
        self.minutes = hours * 60

    def passed(self, key, known, minute, first, last):
        if known is not None and minute < known + self.minutes:
            return known, []
        return minute, [Row(rule_id=key, opened_us=first)]

    def silent(self, key, known, next_us, mark):
        if known is None or mark >= (known + self.minutes) * MINUTE:
            return None, [], None
        return known, [], (known + self.minutes) * MINUTE


def investigations_by_minute(events: DataFrame, rules: list[dict], hours: int = 24, late: str = LATE) -> DataFrame:
    """(rule_id, opened_us): a match opens an investigation unless the rule opened one in less than ``hours`` * 60
    minutes before, minute against minute. Matches are reduced to minutes before they reach the rule's state.

    Events that match no rule move the watermark too: they go on as rows of the rule null, a minute in a task.
    """
    marks = F.when(F.col("time_dt").isNotNull(), F.array_append(rule_marks(events, rules), F.lit("")))
    rows = events.select(F.explode(F.coalesce(marks, F.when(F.col("time_dt").isNotNull(), F.array(F.lit(""))))).alias("rule_id"), F.unix_micros("time_dt").alias("us"))
    keyed = reduced(rows, "rule_id").withWatermark("time_dt", late).where(timed(F.col("rule_id")) != "")
    return keyed.groupBy("rule_id").transformWithState(Investigations(hours), "rule_id string, opened_us long", "Append", "EventTime")


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows of state after each batch, from the query's progress."""
    return [sum(int(op["numRowsTotal"]) for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
