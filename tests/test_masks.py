"""Investigations counted by sets: the same as one investigation at a time, without a row for each of them."""

import os

import pytest
from pyspark.sql import functions as F

from siftlake.operators import graph as G
from siftlake.operators import masks, timeline
from siftlake.plans import q_enrich as Q
from siftlake.plans import q_ops
from test_oracle import SF

here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows_of(df):
    return sorted((repr(r) for r in df.collect()))


def test_sets_of_more_than_one_word(spark):
    names = [f"i{k}" for k in range(130)]
    sets = spark.createDataFrame([("a", 1, [0, 63, 64, 129]), ("a", 2, [63, 65, 128]), ("a", 3, [0, 64]), ("b", 1, [])], "id string, at int, inv_id array<int>")
    rows = masks.masked(sets, names)
    told = lambda df: sorted((r.id, r.at, r.inv_id) for r in masks.each(df, names).collect())
    assert told(rows) == sorted([("a", 1, k) for k in (0, 63, 64, 129)] + [("a", 2, k) for k in (63, 65, 128)] + [("a", 3, k) for k in (0, 64)])
    assert told(masks.fresh(rows, names, ["id"], [F.col("at")])) == sorted([("a", 1, k) for k in (0, 63, 64, 129)] + [("a", 2, k) for k in (65, 128)])
    whole = rows.groupBy("id").agg(masks.union(names), F.lit(0).alias("at"))
    assert told(whole) == [("a", 0, k) for k in (0, 63, 64, 65, 128, 129)]
    assert {r.inv_id for r in masks.named(masks.each(whole, names), names).collect()} == {names[k] for k in (0, 63, 64, 65, 128, 129)}


def test_cluster_counts_are_those_of_the_clusters(spark):
    # gaps of 300.999999, 301, 300 and 302 seconds, before and after 1970, and an investigation of one moment
    times = [("i", t) for t in (-700_000_000, -399_000_001, -98_000_001, 0, 300_999_999, 601_999_999, 901_999_999, 1_203_999_999)] + [("j", 5)]
    rows = spark.createDataFrame(times, "inv_id string, us long").select("inv_id", F.timestamp_micros("us").alias("ts"), F.col("us").cast("string").alias("id"))
    want = timeline.with_clusters(rows).groupBy("inv_id").agg(F.count_distinct("cluster").alias("n"))
    assert rows_of(timeline.cluster_counts(timeline.spans(rows, "inv_id"))) == rows_of(want)


@here
@pytest.mark.parametrize("whole", [False, True])
def test_counts_by_sets_are_those_of_each_investigation(spark, whole):
    nodes, edges = Q.graph(spark, SF, whole)
    lines = timeline.moments(nodes, edges)
    parts = {"nodes": nodes, "edges": edges, "timeline": lines, "clusters": timeline.with_clusters(lines).select("inv_id", "cluster").distinct(), "events": Q.leaves(spark, SF, whole)}
    got = q_ops.artifact_counts(spark, SF, whole).select("inv_id", "n", "artifact")
    assert rows_of(got) == rows_of(q_ops.counted(parts).select("inv_id", "n", "artifact"))
    for limit in (1, 200):
        want = Q.cross_rows(spark, SF, whole, "cloudtrail", limit).groupBy("inv_id").agg(F.count("*").alias("n"))
        assert rows_of(Q.cross_counts(spark, SF, whole, "cloudtrail", limit)) == rows_of(want)


@here
def test_elements_are_not_copied_for_each_investigation(spark):
    nodes, edges = Q.graph(spark, SF, True)
    names = [r["id"] for r in Q.cases(spark, SF, True)]
    rows = G.element_sets(Q.set_leaves(spark, SF, True), names)
    assert masks.each(rows, names).count() == nodes.count() - len(names) + edges.count() > 3 * rows.count()


@here
@pytest.mark.parametrize("most", [200_000, 0])
def test_patterns_by_sets_are_those_of_the_graph(spark, monkeypatch, most):
    from siftlake.operators import patterns

    monkeypatch.setattr(patterns, "MOST_SENT", most)
    want = patterns.detect(*Q.graph(spark, SF, True))
    assert rows_of(Q.found_patterns(spark, SF, True).select(want.columns)) == rows_of(want)


def test_the_earliest_label_of_an_id_is_told_for_each_investigation(spark):
    ev = spark.createDataFrame([(1, "a", "b:c", [0, 1]), (2, "a:b", "c", [0, 2]), (2, "a", "b:c", [2])], "at int, account string, user string, inv_id array<int>")
    blank = {c: F.lit(None).cast("string") for c in ("src_ip", "dst_ip", "api_id", "api_label", "host", "user_type", "status")}
    rows = ev.select("inv_id", F.timestamp_seconds("at").alias("ts"), (10 - F.monotonically_increasing_id()).cast("string").alias("event_uid"), F.lit(True).alias("is_match"), F.lit(6003).alias("class_uid"), F.concat(F.lit("Principal:"), "account", F.lit(":"), "user").alias("principal_id"), "user", "account", F.array().cast("array<struct<id:string,label:string,type:string>>").alias("resources"), *[v.alias(k) for k, v in blank.items()])
    names = ["i", "j", "k"]
    got = masks.each(G.label_sets(rows, names), names)
    nodes = G.merge_nodes(G.node_contributions(rows.withColumn("inv_id", F.explode("inv_id")), events=False, told=False))
    assert sorted((r.inv_id, r.label) for r in got.collect()) == sorted((r.inv_id, r.label) for r in nodes.collect())


@here
def test_descriptions_look_up_the_ends_of_flows_alone(spark, monkeypatch):
    nodes, edges = Q.graph(spark, SF)
    want, real, looked = timeline.edge_events(edges, nodes).select("inv_id", "id", "description"), timeline.with_labels, []
    monkeypatch.setattr(timeline, "with_labels", lambda e, n: looked.append(e) or real(e, n))
    from siftlake.plans.all import QUERIES

    got = QUERIES["TML10_edge_descriptions"](spark, SF)
    assert rows_of(got) == rows_of(want)
    assert 0 < looked[0].count() == edges.where("edge_type = 'COMMUNICATED_WITH'").count() < edges.count()
