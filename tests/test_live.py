"""Long-running streams on small inputs: any cut into batches, killed runs, rows that are late, state that stays small."""

import random

import pytest
from pyspark.sql import functions as F

from siftlake.streaming import live as L
from siftlake.streaming import windows as S

RULE = {"id": "r", "class_uid": 1, "event_class": "x", "filters": [], "threshold": 2}
KIND = "event_uid string, class_uid int, source_name string, time_dt timestamp"


def source(spark, path, batches):
    """batches: lists of (uid, class, source, minute)."""
    rows = lambda b: spark.createDataFrame([(u, c, s, m) for u, c, s, m in b], "event_uid string, class_uid int, source_name string, m double").select("event_uid", "class_uid", "source_name", F.timestamp_micros((F.lit(1_700_000_000 // 60 * 60_000_000) + F.round(F.col("m") * 60_000_000)).cast("long")).alias("time_dt")).coalesce(1)
    at = S.waves(f"file://{path}", [rows(b) for b in batches])
    return S.stream(spark.read.parquet(at), at, files=1)


def made(seed, n):
    rng = random.Random(seed)
    rows = [(f"e{k}", rng.choice([1, 1, 2]), rng.choice("ab"), round(rng.random() * 3000, 2)) for k in range(n)]
    rows.sort(key=lambda r: r[3] + rng.random() * 10)
    cuts = sorted(rng.sample(range(1, n), 3))
    beat = [("beat", 2, "beat", 9000.0)]
    return rows, [rows[a:b] for a, b in zip([0, *cuts], [*cuts, n])] + [beat, beat]


@pytest.mark.parametrize("seed", [1, 2])
def test_processors_do_not_depend_on_batches(spark, tmp_path, seed):
    rows, batches = made(seed, 90)
    minutes = sorted({int(r[3]) for r in rows if r[1] == 1})
    want, last = [], None
    for m in minutes:
        if last is None or m >= last + 1440:
            want.append(m)
            last = m
    silent = set()
    for s in "ab":
        times = sorted(r[3] for r in rows if r[2] == s)
        for t, after in zip(times, [*times[1:], 1e9]):
            silent |= {(s, name, round(t, 2)) for name, size in L.STALE.items() if after > t + size}
    with L.rocksdb(spark):
        df = L.investigations_by_minute(source(spark, tmp_path / "in", batches), [RULE])
        query = df.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        stale = S.run_to_files(L.freshness_alerts(source(spark, tmp_path / "in2", batches)), f"file://{tmp_path}/stale", f"file://{tmp_path}/state2").collect()
    base = 1_700_000_000 // 60
    assert sorted(r.opened_us // 60_000_000 - base for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == want
    assert L.state_rows(query)[-1] <= 4  # a rule's last opening and what waits, however many matches came
    got = {(r.source_name, r.severity, round(r.last_us / 60_000_000 - base, 2)) for r in stale}
    assert got == silent and len(stale) == len(got) and all(r.stale_us - r.last_us == L.STALE[r.severity] * 60_000_000 for r in stale)


def test_killed_run_goes_on_without_doubling(spark, tmp_path):
    _, batches = made(5, 80)

    def windows(k):
        return S.windowed_detection(source(spark, tmp_path / f"in{k}", batches), [RULE])

    L.run_by_batch(windows(0), L.by_batch(f"file://{tmp_path}/whole"), f"file://{tmp_path}/s0")
    put, df = L.by_batch(f"file://{tmp_path}/broken"), windows(1)

    def dies(rows, n):
        put(rows, n)
        if n == 3:
            raise RuntimeError("killed after its rows were written")

    with pytest.raises(Exception, match="killed"):
        L.run_by_batch(df, dies, f"file://{tmp_path}/s1")
    L.run_by_batch(df, put, f"file://{tmp_path}/s1")
    of = lambda name: sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/{name}").collect())
    assert of("broken") == of("whole") and len(of("whole")) > 5


@pytest.mark.parametrize("by", [None, "source_name"])
def test_kept_and_late_rows_are_the_input(spark, tmp_path, by):
    batches = [[("a", 1, "x", 0.0), ("b", 1, "x", 100.0), ("c", 1, "y", 10.0)], [("d", 1, "x", 84.0), ("e", 1, "y", 20.0), ("f", 1, "x", 86.0)], [("g", 1, "z", 1.0), ("h", 1, "y", 4.0), ("i", 1, "x", 300.0)], [("j", 1, "x", 300.0)]]
    df, path = source(spark, tmp_path / "in", batches), f"file://{tmp_path}/out"
    put = L.split_late(spark, path, by=by)

    def twice(rows, n):
        put(rows, n)
        put(rows, n)  # a batch that is run again leaves the same

    L.run_by_batch(df, twice, f"file://{tmp_path}/state")
    kept, late = ({r.event_uid for r in spark.read.parquet(f"{path}/{x}").collect()} for x in ("kept", "late"))
    assert kept | late == set("abcdefghij") and not kept & late and spark.read.parquet(f"{path}/kept").count() == len(kept)
    assert late == ({"d", "e", "g", "h"} if by is None else {"d", "h"})


def test_sessions_merge_across_batches(spark, tmp_path):
    _, batches = made(9, 120)
    df = source(spark, tmp_path / "in", batches)
    got = S.run_to_files(L.streamed_sessions(df, "source_name"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    want = S.sessions(spark.read.parquet(f"file://{tmp_path}/in/wave-*"), "source_name").where("entity <> 'beat'")
    assert sorted(tuple(r) for r in got.drop("late_rows").collect()) == sorted(tuple(r) for r in want.collect())
