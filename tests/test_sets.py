"""Graphs built by sets of investigations: the same as one investigation at a time, in tasks of bounded size."""

import os

import pytest
from pyspark.sql import functions as F

from siftlake.operators import attack
from siftlake.operators import graph as G
from siftlake.plans import q_enrich as Q
from test_oracle import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows_of(df):
    return sorted((repr(r) for r in df.collect()))


def test_sets_give_the_graph_of_each_investigation(spark):
    nodes, edges = Q.graph(spark, SF)
    want_nodes, want_edges = G.from_leaves(Q.leaves(spark, SF), Q.results(spark, SF))
    assert rows_of(nodes.select(sorted(nodes.columns))) == rows_of(want_nodes.select(sorted(nodes.columns)))
    assert rows_of(edges.select(sorted(edges.columns))) == rows_of(want_edges.select(sorted(edges.columns)))


def test_an_event_is_kept_once_for_all_investigations(spark):
    events = Q.window(spark, SF).count()
    assert Q.set_leaves(spark, SF, True).count() <= 2 * events < Q.leaves(spark, SF, True).count()


def test_tasks_hold_a_bounded_number_of_events(spark, monkeypatch):
    monkeypatch.setattr(Q, "TASK_EVENTS", 100)
    parts = Q.dealt_events(spark, SF).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 200


def test_many_identifiers_are_joined_with_the_same_result(spark, monkeypatch):
    from siftlake.operators import enrich

    want = rows_of(Q.event_sets(spark, SF).select("event_uid", "found", "enriching"))
    monkeypatch.setattr(enrich, "MOST_SENT", 0)
    assert rows_of(Q.event_sets(spark, SF).select("event_uid", "found", "enriching")) == want


def test_reachable_stops_when_all_is_reached(spark):
    seeds = spark.createDataFrame([("i", "f")], "inv_id string, finding_id string")
    edges = spark.createDataFrame([("i", f"e{k}", a, b) for k, (a, b) in enumerate([("f", "a"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "g")])], "inv_id string, id string, source_id string, target_id string")
    assert {r.node for r in attack.reachable(seeds, edges).collect()} == set("fabcde")
    assert {r.node for r in attack.reachable(seeds, edges.where("id < 'e2'")).collect()} == set("fab")


def test_small_frontiers_are_sent_and_all_nodes_end_the_search(spark, monkeypatch):
    rows = [("i", "e0", "f", "a"), ("i", "e1", "a", "b"), ("i", "e2", "c", "b"), ("j", "e3", "g", "h"), ("k", "e4", "x", "y")]
    edges = spark.createDataFrame(rows, "inv_id string, id string, source_id string, target_id string")
    seeds = spark.createDataFrame([("i", "f"), ("j", "g"), ("k", "lone"), ("l", "none")], "inv_id string, finding_id string")
    want = {("i", n) for n in "fabc"} | {("j", "g"), ("j", "h"), ("k", "lone"), ("l", "none")}
    joined, real, hops = [], attack.split_join, []
    cut = attack.cut
    monkeypatch.setattr(attack, "cut", lambda df: hops.append(df) or cut(df))
    monkeypatch.setattr(attack, "split_join", lambda *x: joined.append(x) or real(*x))
    assert {(r.inv_id, r.node) for r in attack.reachable(seeds, edges).collect()} == want and not joined
    assert len(hops) == 3 + 3  # steps, degrees and seeds, then three hops: no fourth finds out that there is nothing new
    monkeypatch.setattr(attack, "MOST_SENT", 0)
    assert {(r.inv_id, r.node) for r in attack.reachable(seeds, edges).collect()} == want and joined
