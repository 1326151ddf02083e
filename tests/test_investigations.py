"""Investigations of all triggered rules, and daily investigations as a stream."""

import os

import pytest
from pyspark.sql import functions as F

from siftlake.plans.all import QUERIES
from test_oracle import SF, duck, test_query as compare  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_every_triggered_rule_is_investigated(spark, duck):  # noqa: F811
    triggered = {r.rule_id for r in QUERIES["DET3_run_all"](spark, SF).where("triggered").collect()}
    assert triggered - {"detect-cloudtrail-tampering", "detect-port-scan", "detect-nxdomain-spike"}
    assert {r.inv_id for r in QUERIES["INV3_all_investigations"](spark, SF).collect()} == triggered
    assert {r.inv_id for r in QUERIES["INV2_scores_and_paths"](spark, SF).collect()} == triggered
    compare(spark, duck, "INV3_all_investigations")


def test_daily_investigations(spark, duck):  # noqa: F811
    compare(spark, duck, "STR7_daily_investigations")
    got = [r.rule_id for r in QUERIES["STR7_daily_investigations"](spark, SF).collect()]
    assert len(got) > len(set(got))  # a later day opens another


@pytest.mark.parametrize("files", [1, 2, 5])
def test_daily_investigations_by_batch(spark, tmp_path, files):
    from siftlake.streaming import windows as S

    # hours of arrival: out of order within 15 minutes; the sixth file is late by a day; the last moves the watermark
    arrivals = [[0.0, 1.0], [24.1, 24.0], [23.9, 30.0], [48.1, 47.95], [72.0], [30.5], [200.0]]
    for k, hours in enumerate(arrivals):
        rows = [(f"e{k}-{h}", h) for h in hours]
        df = spark.createDataFrame(rows, "event_uid string, h double")
        df.selectExpr("event_uid", "CASE WHEN h < 100 THEN 1 ELSE 2 END AS class_uid", "timestamp_micros(CAST(round((1000 + h) * 3600) AS BIGINT) * 1000000) AS time_dt").coalesce(1).write.parquet(f"file://{tmp_path}/w{k}")
    (tmp_path / "in").mkdir()
    for k in range(len(arrivals)):
        next((tmp_path / f"w{k}").glob("part-*.parquet")).rename(tmp_path / "in" / f"part-{k:05d}.parquet")
    S.in_order(spark, f"file://{tmp_path}/in")
    rule = {"id": "r", "class_uid": 1, "event_class": "x", "filters": []}
    source = S.stream(spark.read.parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/in", files)
    got = S.run_to_files(S.daily_investigations(source, [rule]), f"file://{tmp_path}/out", f"file://{tmp_path}/state").collect()
    assert sorted(round(r.opened_at.timestamp() / 3600 - 1000, 2) for r in got) == [0.0, 24.0, 48.1]
    assert files > 1 or {r.late_rows for r in got} == {1}


def test_late_rows_are_dropped_and_counted(spark):
    from siftlake.plans import q_stream

    got = q_stream.closed_windows(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and got.first().late_rows > 0
