"""Attack steps by sets of investigations: the same as one investigation at a time, without a row for each of them."""

import os

import pytest
from pyspark.sql import functions as F

from siftlake.operators import anomaly, attack, masks, patterns, prefix
from siftlake.operators import graph as G
from siftlake.plans import q_analytics as A
from siftlake.plans import q_enrich as Q
from siftlake.plans import q_ops
from siftlake.plans.all import QUERIES
from test_oracle import SF, duck, test_query as compare  # noqa: F401

here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows_of(df):
    return sorted((repr(r) for r in df.collect()))


def test_places_are_counted_for_sets_of_more_than_one_word(spark):
    names = [f"i{k}" for k in range(66)]
    rows = masks.masked(spark.range(300).selectExpr("id", "transform(filter(sequence(0, 65), k -> (id + k) % 7 < 2), k -> CAST(k AS INT)) AS inv_id"), names)
    got = prefix.placed_sets(rows, names, [F.col("id").desc()], 5).select("id", F.inline("places"))
    want, count = set(), [0] * 66
    for i in reversed(range(300)):
        for k in range(66):
            if (i + k) % 7 < 2:
                count[k] += 1
                want.add((i, k, count[k]))
    assert {tuple(r) for r in got.collect()} == want
    assert prefix.placed_sets(rows, [], [F.col("id")], 5).count() == 0


def test_sets_within_others(spark):
    names = [f"i{k}" for k in range(130)]
    rows = masks.masked(spark.createDataFrame([(0, [0, 63, 64, 129]), (1, [5])], "id int, inv_id array<int>"), names)
    got = masks.each(rows.withColumn("inv_id", masks.within(names, [63, 129, 7])), names)
    assert sorted((r.id, r.inv_id) for r in got.collect()) == [(0, 63), (0, 129)]
    assert [r.n for r in rows.select("id", masks.size(names).alias("n")).orderBy("id").collect()] == [4, 1]
    both = rows.withColumn("b", masks.of(names, [0, 64])).withColumn("inv_id", masks.without(names, "inv_id", "b"))
    assert sorted((r.id, r.inv_id) for r in masks.each(both, names).collect()) == [(0, 63), (0, 129), (1, 5)]


@here
@pytest.mark.parametrize("whole", [False, True])
def test_edges_by_sets_are_those_of_the_graph(spark, whole):
    names = [r["id"] for r in Q.cases(spark, SF, whole)]
    columns = ["inv_id", "edge_type", "source_id", "target_id", "first_seen", "last_seen", "event_count", "bytes_in", "bytes_out"]
    sets = Q.edge_sets(spark, SF, whole)
    got = masks.named(masks.each(sets, names), names)
    for end in ("source_id", "target_id"):
        got = got.withColumn(end, F.when(F.col(end) == G.FINDING, Q.finding_of()).otherwise(F.col(end)))
    want = Q.graph(spark, SF, whole)[1].select(columns)
    assert rows_of(got.select(columns)) == rows_of(want)
    assert not whole or 3 * sets.count() < want.count()


@here
@pytest.mark.parametrize("most", [200_000, 0])
def test_steps_by_sets_are_those_of_the_graph(spark, monkeypatch, most):
    names = [r["id"] for r in Q.cases(spark, SF, True)]
    want = attack.steps(A.findings(spark, SF, True), *Q.graph(spark, SF, True))[0]
    monkeypatch.setattr(G, "MOST_SENT", most)
    inside = A.inside(spark, SF, True)
    got = attack.steps_of_sets(inside, names, 3)
    columns = ["inv_id", "step", "edge_id", "edge_type", "source_id", "target_id", "ts", "own_phase", "phase", "action", "narrative", "actor", "target", "target_type", "event_count"]
    assert rows_of(got.select(columns)) == rows_of(want.select(columns))
    assert 3 * inside.count() < want.count()


def edge(names, a, b, at, *invs, kind="CALLED_API"):
    return (kind, a, b, at, at, 1, None, None, list(invs))


def test_sets_reach_as_far_as_each_investigation(spark):
    names, f = ["i", "j", "k"], G.FINDING
    rows = [edge(names, f, "a", 1, 0, 1), edge(names, "b", "a", 2, 0), edge(names, "b", "a", 3, 1), edge(names, "b", "c", 2, 0), edge(names, "c", "d", 2, 0, 1), edge(names, "d", "e", 2, 0), edge(names, "e", "g", 2, 0), edge(names, "x", "y", 1, 2)]
    sets = masks.masked(spark.createDataFrame(rows, "edge_type string, source_id string, target_id string, first_seen int, last_seen int, event_count long, bytes_in long, bytes_out long, inv_id array<int>"), names).localCheckpoint()
    got = {(r.inv_id, r.node) for r in masks.each(attack.reachable_sets(sets, names), names).collect()}
    assert got == {(0, n) for n in [f, *"abcde"]} | {(1, n) for n in [f, *"ab"]} | {(2, f)}
    assert {(r.inv_id, r.node) for r in masks.each(attack.reachable_sets(sets, names, 2), names).collect()} == {(0, n) for n in [f, *"ab"]} | {(1, n) for n in [f, *"ab"]} | {(2, f)}


@here
def test_all_steps_equal_their_sql_and_keep_no_row_for_each_investigation(spark, duck, monkeypatch):  # noqa: F811
    def no(*_, **__):
        raise AssertionError("a row for each investigation")

    monkeypatch.setattr(attack, "steps", no)
    compare(spark, duck, "INV5_all_steps")
    assert QUERIES["INV5_all_steps"](spark, SF).count() > 0


def test_scores_are_counted_from_sizes(spark):
    counts = {("i", "user"): [1, 1, 2, 3, 50, 50, 7], ("i", "ip"): [4, 4, 4, 4, 4, 9, 9], ("j", "user"): [5], ("j", "ip"): [6, 6], ("j", "service"): [1, 2, 3, 100]}
    rows = spark.createDataFrame([(i, k, f"{k}{n}", c) for (i, k), cs in counts.items() for n, c in enumerate(cs)], "inv_id string, kind string, entity string, event_count long")
    sizes = rows.groupBy("inv_id", "kind", "event_count").agg(F.count("*").alias("entities"))
    for threshold in (0.5, 2.0):
        want = anomaly.scores(rows, "inv_id", threshold=threshold).groupBy("inv_id").agg(F.count("*").alias("n"))
        assert rows_of(anomaly.scored(sizes, "inv_id", threshold=threshold)) == rows_of(want) != []


@here
@pytest.mark.parametrize("whole", [False, True])
def test_entities_are_counted_from_what_is_kept(spark, whole):
    want = Q.entity_counts(spark, SF, whole).groupBy("inv_id", "kind", "event_count").agg(F.count("*").alias("entities"))
    got = Q.entity_sizes(spark, SF, whole)
    assert rows_of(got.select(want.columns)) == rows_of(want)


@here
@pytest.mark.parametrize("whole", [False, True])
def test_paths_by_sets_are_those_of_the_narratives(spark, whole):
    names, told = [r["id"] for r in Q.cases(spark, SF, whole)], A.mitre(spark, SF, whole)
    got = attack.paths_of_sets(A.inside(spark, SF, whole), names, told)
    assert rows_of(got) == rows_of(A.stories(spark, SF, whole).select(got.columns))


@here
def test_patterns_of_labelled_edges(spark):
    names, edges = [r["id"] for r in Q.cases(spark, SF, True)], A.labelled(spark, SF, True).localCheckpoint()
    want = Q.found_patterns(spark, SF, True)
    assert rows_of(patterns.detect_labelled(edges, names).select(want.columns)) == rows_of(want)
    counted = patterns.detect_labelled(edges, names, told=False)
    assert counted.where("members IS NOT NULL").count() == 0
    assert rows_of(counted.select(want.columns[:-1])) == rows_of(want.select(want.columns[:-1]))


@here
def test_scores_and_paths_keep_no_row_for_each_investigation(spark, monkeypatch):
    odd = anomaly.scores(Q.entity_counts(spark, SF, True), "inv_id").groupBy("inv_id").agg(F.count("*").alias("anomalies"))
    shapes = Q.found_patterns(spark, SF, True).groupBy("inv_id").agg(F.count("*").alias("patterns"))
    want = rows_of(A.stories(spark, SF, True).select("inv_id", "steps", "phases", "impact").join(odd, "inv_id", "left").join(shapes, "inv_id", "left").na.fill(0))

    def no(*_, **__):
        raise AssertionError("a row for each investigation")

    for where, name in ((attack, "steps"), (attack, "narratives"), (q_ops, "graph"), (A, "graph"), (Q, "entity_counts")):
        monkeypatch.setattr(where, name, no)
    Q.release(spark)
    assert rows_of(QUERIES["INV2_scores_and_paths"](spark, SF)) == want != []
