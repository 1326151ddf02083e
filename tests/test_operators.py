"""Predicates, rules and invariants on small fixtures."""

import json
import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.functions import predicates as P
from siftlake.functions.fields import field, first_text
from siftlake.operators import anomaly, attack, detect, enrich, graph, ops, patterns, timeline
from siftlake.sources.catalog import guarded_sql
from siftlake.sources.schema import CLASS_UID

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

NESTED = "class_uid int, status string, n int, actor struct<user:struct<name:string>>, resources array<struct<uid:string,type:string>>"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "ok", 5, (("root",),), [("arn:a", "t")]), (2, None, None, ((None,),), None), (3, "AttachPolicy", 7, (("alice",),), [])], NESTED)


def ids(df, test):
    return sorted(r.class_uid for r in df.where(test).collect())


@pytest.mark.parametrize(
    "spec,want",
    [
        ({"field": "actor.user.name", "not_equals": "root"}, [2, 3]), ({"field": "actor.user.name", "equals": "root"}, [1]), ({"field": "status", "contains": "Policy"}, [3]), ({"field": "status", "in": []}, []),
        ({"field": "n", "equals": "5"}, [1]), ({"field": "n", "int_equals": 7}, [3]), ({"field": "resources", "contains": "arn"}, [1]), ({"field": "missing.field", "equals": "x"}, []), ({"field": "missing.field", "not_equals": "x"}, [1, 2, 3]),
        ({"field": "resources", "not_equals": "arn:a"}, [2, 3]), ({"field": "status", "regex": "^A.*y$"}, [3]),
    ],
)
def test_predicates(rows, spec, want):
    assert ids(rows, P.compile_filter(rows, spec)) == want


def test_empty_trees_and_lists(rows):
    assert ids(rows, P.all_of([])) == [1, 2, 3] and ids(rows, P.any_of([])) == []
    assert ids(rows, P.list_any_equals(rows, "resources", "uid", "arn:a")) == [1]
    assert ids(rows, P.list_any_in(rows, "resources", "uid", [])) == []


def test_flat_column_goes_before_nested(spark):
    df = spark.createDataFrame([("flat", ("nested",)), (None, ("nested",))], "`a.b` string, a struct<b:string>")
    assert [r[0] for r in df.select(field(df, "a.b")).collect()] == ["flat", "nested"]
    assert [r[0] for r in df.select(first_text(df, "x.y", "a.b")).collect()] == ["flat", "nested"]


def test_addresses(spark):
    data = ["10.0.0.1", "172.15.0.1", "172.16.0.1", "172.31.9.9", "172.32.0.1", "192.168.1.1", "8.8.8.8", "256.1.1.1", None]
    got = spark.createDataFrame([(x,) for x in data], "ip string").select(P.is_private(F.col("ip")).alias("p"), P.is_ipv4(F.col("ip")).alias("v")).collect()
    assert [r.p for r in got] == [True, False, True, True, False, True, False, False, False]
    assert [r.v for r in got] == [True] * 7 + [False, False]


def test_guard(spark):
    with pytest.raises(ValueError):
        guarded_sql(spark, "drop table x")
    assert guarded_sql(spark, "select 1 as updated").first()[0] == 1


def test_rule_files(tmp_path):
    good = {"id": "a", "severity": "low", "event_class": "authentication", "threshold": 1, "limit": 5, "mitre": [], "data_sources": [], "filters": []}
    (tmp_path / "1.json").write_text(json.dumps(good))
    (tmp_path / "2.json").write_text(json.dumps([good | {"threshold": 9}, good | {"id": "b"}]))
    (tmp_path / "3.json").write_text(json.dumps([good | {"id": "c"}, {"id": "broken"}]))
    found = detect.load_rules(*sorted(tmp_path.iterdir()))
    assert [(r["id"], r["threshold"]) for r in found] == [("a", 9), ("b", 1)]
    assert len(detect.load_rules()) == 55 and len(CLASS_UID) == 39


def test_bundled_rules_pass_the_cases_that_come_with_them(spark):
    cases = detect.bundled_cases()
    assert len(cases) == 84 and len({c["rule_id"] for c in cases}) == 31
    got = detect.self_test(spark, cases, detect.load_rules()).collect()
    assert len(got) == 84 and [(r.rule_id, r.name) for r in got if not r.passed] == []
    wrong = [c | {"expected": c["expected"] | {"triggered": not c["expected"]["triggered"]}} for c in cases[:10]]
    assert not any(r.passed for r in detect.self_test(spark, wrong, detect.load_rules()).collect())


def test_bundled_rules_pass_their_cases(spark):
    rules = [r for r in detect.load_rules() if r["threshold"] <= 50]
    got = detect.self_test(spark, detect.cases_of(rules), rules)
    assert got.where("NOT passed").count() == 0 and got.count() == 2 * len(rules)


def test_zero_threshold_triggers_on_nothing(spark):
    rules = [{"id": "z", "name": "Z", "severity": "low", "class_uid": 1, "event_class": "x", "threshold": 0, "limit": 5, "filters": [], "enabled": True, "mitre": [], "data_sources": [], "tags": []}]
    got = detect.evaluate(spark.createDataFrame([], "rule_id string, total_matches long"), detect.rule_table(spark, rules)).first()
    assert got.triggered and got.match_count == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(background=st.lists(st.integers(1, 5), min_size=3, max_size=19), peak=st.integers(50, 10_000))
def test_outlier_is_found(spark, background, peak):
    data = [("user", f"u{k}", n) for k, n in enumerate(background)] + [("user", "peak", peak)]
    got = [r.entity for r in anomaly.scores(spark.createDataFrame(data, "kind string, entity string, event_count long")).collect()]
    assert "peak" in got


def test_no_scores_without_spread(spark):
    df = spark.createDataFrame([("user", "a", 5), ("user", "b", 5), ("ip", "x", 9)], "kind string, entity string, event_count long")
    assert anomaly.scores(df).count() == 0


def test_cluster_gap(spark):
    at = [0, 300, 601, 901.999, 1202.9995]
    df = spark.createDataFrame([("i", str(k), float(t)) for k, t in enumerate(at)], "inv_id string, id string, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    got = [r.cluster for r in timeline.with_clusters(df).orderBy("ts").collect()]
    assert got == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("text,want", [("arn:aws:iam::1:role/team/Admin", "Resource:role:team/Admin"), ("arn:aws:s3:::bucket", "Resource:s3:bucket"), ("i-123", "Resource:unknown:i-123"), ("arn:bad", None), ("", None)])
def test_resources(spark, text, want):
    df = spark.createDataFrame([(text, None)], "u string, t string")
    assert df.select(graph.resource_parts(F.col("u"), F.col("t"))["id"]).first()[0] == want


@pytest.mark.parametrize("op,want", [("CreateAccessKey", "Persistence"), ("google.iam.v1.IAMPolicy.SetIamPolicy", "PrivilegeEscalation"), ("google.logging.v2.X.DeleteThing", "DefenseEvasion"), ("Nothing", "Unknown")])
def test_phases(spark, op, want):
    assert spark.range(1).select(attack.operation_phase(F.lit(op))).first()[0] == want


def test_human_bytes(spark):
    df = spark.createDataFrame([(5,), (1_500,), (25_300_000,), (3_000_000_000,)], "n long")
    assert [r[0] for r in df.select(timeline.human_bytes(F.col("n"))).collect()] == ["5 B", "1.5 KB", "25.3 MB", "3.0 GB"]


def test_one_scan_for_all_rules(spark):
    from siftlake.plans.all import QUERIES

    plan = QUERIES["DET3_run_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan


def small_graph(spark, calls, access=()):
    """Principals that call APIs, and APIs that access resources."""
    names = {x for a, b in [*calls, *access] for x in (a, b)}
    kind = lambda x: "Principal" if x.startswith("P") else "APIOperation" if ":" in x else "Resource"
    nodes = spark.createDataFrame([("i", n, kind(n), n) for n in sorted(names)], "inv_id string, id string, node_type string, label string")
    edges = spark.createDataFrame([("i", k, a, b) for k, rows in (("CALLED_API", calls), ("ACCESSED_RESOURCE", access)) for a, b in rows], "inv_id string, edge_type string, source_id string, target_id string")
    return nodes, edges


def test_service_bridges(spark):
    """Only who alone uses two services together is a bridge; pairs used by two principals count for none."""
    nodes, edges = small_graph(spark, [("P1", "s3:Get"), ("P1", "iam:List"), ("P2", "s3:Get"), ("P2", "ec2:Run"), ("P3", "s3:Put"), ("P3", "ec2:Run"), ("P1", "sts:Who")])
    got = [(r.entity, r.n, round(r.severity, 3), r.members) for r in patterns.service_bridge(edges, nodes).collect()]
    assert got == [("P1", 3, 0.8, "iam, s3, sts")]
    assert patterns.service_bridge(edges.limit(0), nodes).count() == 0


def test_resource_convergence(spark):
    nodes, edges = small_graph(spark, [(f"P{k}", "s3:Get") for k in range(4)] + [("P9", "s3:Put")], [("s3:Get", "bucket"), ("s3:Put", "bucket"), ("s3:Put", "other")])
    got = [(r.entity, r.n, r.members) for r in patterns.resource_convergence(edges, nodes).collect()]
    assert got == [("bucket", 5, "P0, P1, P2, P3, P9")]


def test_freshness_alerts(spark):
    rows = spark.createDataFrame([("a", 119.0), ("b", 121.0), ("c", 360.0), ("d", 361.0), ("e", None)], "source_name string, age_minutes double")
    assert [(r.rule_id, r.severity) for r in ops.freshness_alerts(rows).orderBy("rule_id").collect()] == [("freshness-b", "medium"), ("freshness-c", "medium"), ("freshness-d", "high")]
    assert "121 minutes stale" in ops.freshness_alerts(rows).where("rule_id = 'freshness-b'").first().message


def test_scan_limits(spark):
    with pytest.raises(ValueError):
        detect.scan(spark.range(1), None, "2024-01-01", "2024-01-02", limit=50_000, strict=True)


def test_enrichment_keys(spark):
    """Each identifier finds events of its classes only, and each event once for an investigation."""
    row = "event_uid string, class_uid int, actor struct<user:struct<name:string>>, src_endpoint struct<ip:string>, dst_endpoint struct<ip:string>, query struct<hostname:string>, resources array<struct<uid:string,type:string,name:string>>"
    ev = spark.createDataFrame(
        [("a", 6003, (("u",),), ("1.2.3.4",), None, None, [("arn:aws:s3:::b", None, None)] * 2), ("b", 4001, None, ("9.9.9.9",), ("1.2.3.4",), None, None), ("c", 4003, (("u",),), ("1.2.3.4",), None, ("h",), None), ("d", 3001, (("u",),), ("1.2.3.4",), None, None, None), ("e", 1, (("u",),), ("1.2.3.4",), None, ("h",), None)],
        row,
    )
    ids = spark.createDataFrame([("i", "user", "u"), ("i", "src_ip", "1.2.3.4"), ("i", "resource", "arn:aws:s3:::b"), ("j", "domain", "h"), ("j", "resource", "not an arn"), ("j", "dst_ip", "1.2.3.4"), ("k", "service", "s3")], "inv_id string, kind string, value string")
    got = sorted((r.inv_id, r.event_uid) for r in enrich.enrich_all(ev, ids).collect())
    assert got == [("i", "a"), ("i", "b"), ("i", "d"), ("j", "a"), ("j", "b"), ("j", "c")]
    assert enrich.enrich_all(ev.limit(0), ids).count() == 0 == enrich.enrich_all(ev, ids.limit(0)).count()


def test_trust_policies_and_role_context(spark):
    docs = ['{"Statement":[{"Principal":"*"},{"Principal":{"AWS":["arn:a","arn:b"],"Service":"ec2.amazonaws.com"}},{"Effect":"Deny"}]}', "%7B%22Statement%22%3A%5B%7B%22Principal%22%3A%7B%22Federated%22%3A%22idp%22%7D%7D%5D%7D", "not json", None]
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, d string").select("k", enrich.trust_principals(F.col("d")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == [["*", "arn:a", "arn:b", "ec2.amazonaws.com"], ["idp"], None, None]
    nodes = spark.createDataFrame([("i", "Principal", "Admin"), ("i", "Resource", "team/Admin"), ("i", "Principal", "assumed-role/Admin/me"), ("i", "Principal", "other"), ("i", "Event", "Admin")], "inv_id string, node_type string, label string")
    roles = spark.createDataFrame([("Admin", ["arn:aws:iam::aws:policy/AdministratorAccess"], ["inline-1"], docs[0])], "name string, policies array<string>, inline_policies array<string>, trust_policy string")
    got = enrich.role_context(nodes, roles).collect()
    assert sorted(r.label for r in got) == ["Admin", "assumed-role/Admin/me", "team/Admin"]
    assert all(r.is_admin and r.inline_policies == ["inline-1"] and "*" in r.trusted for r in got)


def test_single_rule_errors(spark):
    import datetime

    end = datetime.datetime(2024, 1, 2)
    rules = [r | {"filters": [{"field": "api.operation", "equals": "x"}]} for r in detect.load_rules()[:1]]
    row = detect.run_rule(spark.range(1), rules, rules[0]["id"], end).first()
    assert not row.triggered and row.error and row.window_start == end - datetime.timedelta(minutes=60)
    assert detect.run_rule(spark.range(1), rules, "none", end).first().error == "Rule not found: none"


def test_one_decimal_is_correctly_rounded(spark):
    """As C and most languages print it: ties to even, by the number's exact binary value."""
    rng = random.Random(3)
    values = [12_250_000, 12_350_000, 1_150_000, 1_050_000, 999_950_000, 1_000_000, 1_949_999, 1_950_000] + [rng.randrange(1_000_000, 10**9) // 50_000 * 50_000 for _ in range(3000)] + [rng.randrange(1_000_000, 10**9) for _ in range(1000)]
    got = spark.createDataFrame([(v,) for v in values], "n long").select("n", timeline.human_bytes(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in got} == {v: f"{v / 1e6:.1f} MB" for v in values}


def test_prefix_scans_over_groups_in_several_parts(spark):
    from pyspark.sql import Window

    from siftlake.operators import prefix

    # else such small parts are put together
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(4)
    rows = [("hot", rng.randrange(10**6), k) for k in range(3000)] + [(f"g{k % 50}", rng.randrange(10**6), k) for k in range(300)] + [(None, 5, 1), (None, 900, 2)]
    df = spark.createDataFrame(rows, "g string, s long, id long").withColumn("ts", F.timestamp_seconds("s")).repartition(5)
    w = Window.partitionBy("g").orderBy("ts", "id")
    placed = prefix.placed(df, ["g"], [F.col("ts"), F.col("id")])
    assert placed.exceptAll(df.withColumn("place", F.row_number().over(w).cast("long")).select(placed.columns)).count() == 0 and placed.count() == len(rows)
    got = prefix.chained(df, ["g"], [F.col("ts"), F.col("id")], "ts", 600)
    gap = F.col("s") - F.lag("s").over(w)
    want = df.withColumn("gap", gap).withColumn("chain", F.sum(F.coalesce((F.col("gap") > 600).cast("int"), F.lit(0))).over(w))
    assert got.select("g", "id", "gap", "chain").exceptAll(want.select("g", "id", "gap", "chain")).count() == 0 and got.count() == len(rows)
    parts = prefix.dealt(df, ["g"], [F.col("ts"), F.col("id")]).where("g = 'hot'").select("__part").distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1  # the large group lies in several


def test_reachable_from_a_hub(spark, monkeypatch):
    from siftlake.operators import attack, skew

    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    edges = spark.createDataFrame([("i", "f", "hub")] + [("i", "hub", f"n{k}") for k in range(400)] + [("i", "n7", "far"), ("j", "f", "other")], "inv_id string, source_id string, target_id string").withColumn("id", F.monotonically_increasing_id())
    seeds = spark.createDataFrame([("i", "f"), ("j", "f")], "inv_id string, finding_id string")
    two = {(r.inv_id, r.node) for r in attack.reachable(seeds, edges, 2).collect()}
    assert two == {("i", "f"), ("i", "hub"), ("j", "f"), ("j", "other")} | {("i", f"n{k}") for k in range(400)}
    assert attack.reachable(seeds, edges, 3).count() == len(two) + 1 == attack.reachable(seeds, edges, 50).count()
    assert skew.hot_keys(edges.select("inv_id", F.col("source_id").alias("node")), ["node"]).collect()[0]["__pieces"] == 8


def test_enrichment_by_many_identifiers_finds_the_same(spark, monkeypatch):
    from siftlake.operators import enrich, skew
    from siftlake.plans import q_enrich

    ev, ids = q_enrich.window(spark, SF), q_enrich.ids_of(spark, SF)
    sent = {(r.inv_id, r.event_uid) for r in enrich.enrich_all(ev, ids).collect()}
    monkeypatch.setattr(enrich, "MOST_SENT", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    assert {(r.inv_id, r.event_uid) for r in enrich.enrich_all(ev, ids).collect()} == sent and sent


def test_addresses_with_leading_zeros(spark):
    from siftlake.functions.predicates import is_ipv4

    rows = [("1.2.3.4", True), ("001.002.003.004", True), ("255.255.255.255", True), ("256.1.1.1", False), ("1.2.3", False), ("0199.1.1.1", False), (None, False)]
    assert [r.ok for r in spark.createDataFrame(rows, "ip string, want boolean").select(is_ipv4(F.col("ip")).alias("ok")).collect()] == [w for _, w in rows]


def test_rules_as_rows_of_a_table(spark):
    from siftlake.operators import ruleindex

    kind = "event_uid string, class_uid int, time_dt timestamp_ntz, `api.operation` string, status string, n int, resources array<struct<uid:string,type:string>>"
    at = "2024-01-02 00:00:00"
    rows = [("1", 1, "A", "ok", 5, [("u1", "t"), ("u2", None)]), ("2", 1, "B", None, None, None), ("3", 1, None, "bad", 7, [("u2", "u2")]), ("4", 2, "A", "ok", 5, []), ("5", 1, "xA", "ok", 50, [("u1", "u2")])]
    ev = spark.createDataFrame([(u, c, o, s, n, r) for u, c, o, s, n, r in rows], kind.replace("time_dt timestamp_ntz, ", "")).withColumn("time_dt", F.lit(at).cast("timestamp"))
    filters = [
        [], [{"field": "api.operation", "equals": "A"}], [{"field": "api.operation", "in": ["A", "B", "A"]}, {"field": "status", "not_equals": "ok"}], [{"field": "status", "not_equals": "ok"}], [{"field": "n", "equals": 5}],
        [{"field": "resources", "equals": "u2"}], [{"field": "resources", "in": ["u1", "u2"]}], [{"field": "resources", "not_equals": "u2"}], [{"field": "api.operation", "contains": "A"}], [{"field": "n", "regex": "^5"}, {"field": "resources", "contains": "1"}],
        [{"field": "missing", "not_equals": "x"}], [{"field": "missing", "equals": "x"}], [{"field": "resources", "in": ["u1", "u2"]}, {"field": "api.operation", "in": ["xA"]}], [{"field": "status", "in": []}],
    ]
    rules = [{"id": f"r{k}-{c}", "class_uid": c, "filters": f} for k, f in enumerate(filters) for c in (1, 2)]
    pairs = lambda df: sorted((r.event_uid, r.rule_id) for r in df.select("event_uid", "rule_id").collect())
    want = pairs(detect.hits(ev, rules, "2024-01-01", "2024-01-03"))
    got = ruleindex.indexed_hits(ev, rules, "2024-01-01", "2024-01-03")
    assert pairs(got) == want and len(want) > 20 and got.columns == [*ev.columns, "rule_id"]
    assert ruleindex.indexed_hits(ev, [], "2024-01-01", "2024-01-03").count() == 0


def test_rule_files_as_yaml(tmp_path):
    pytest.importorskip("yaml")
    one = "id: detect-one\nname: One\nseverity: high\nevent_class: api_activity\nthreshold: 2\nlimit: 10\nmitre_attack: [T1046]\nfilters:\n  - field: api.operation\n    in: [A, B]\n"
    (tmp_path / "a.yaml").write_text(one + "---\n- id: detect-two\n  event_class: dns_activity\n  threshold: 1\n  limit: 5\n  filters: []\n")
    (tmp_path / "bad.yml").write_text("id: [unclosed")
    (tmp_path / "worse.yml").write_text("just text")
    (tmp_path / "b.json").write_text(json.dumps({"id": "detect-one", "event_class": "api_activity", "threshold": 3, "limit": 5, "filters": []}))
    got = {r["id"]: r for r in detect.load_rules(tmp_path / "a.yaml", tmp_path / "bad.yml", tmp_path / "worse.yml")}
    assert set(got) == {"detect-one", "detect-two"} and got["detect-one"]["mitre"] == ["T1046"] and got["detect-one"]["filters"][0]["in"] == ["A", "B"]
    assert {r["id"]: r["threshold"] for r in detect.load_rules(tmp_path / "a.yaml", tmp_path / "b.json")} == {"detect-one": 3, "detect-two": 1}
