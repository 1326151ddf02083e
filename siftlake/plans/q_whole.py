"""Graphs, timelines, steps and plans compared whole: all edge and node types, flows, office hours, roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attack, enrich, ops, ruleindex, timeline
from ..operators import detect as D
from ..sources.adapter import EV, events
from .q_analytics import ATK, LABELLED, PAT, TOLD, inside, step_rows
from .q_enrich import EVW, GRAPH, WHOLE, addresses, cases, edges_of, event_parts, found_patterns, graph, inventory, window
from .q_ops import PLAYS, playbooks
from .registry import DETECT, END, HITS, RULES, START, query


def bytes_sql(b: str) -> str:
    """Human bytes with one decimal."""
    unit = lambda size, name: f"WHEN {b} >= {size} THEN printf('%.1f {name}', ({b})::DOUBLE / {size})"
    return f"CASE {unit(10**9, 'GB')} {unit(10**6, 'MB')} {unit(10**3, 'KB')} ELSE {b} || ' B' END"


def flow_sql(src: str, dst: str, ports: str, b_in: str, b_out: str) -> str:
    """The sentence in this text."""
    b_in, b_out = f"coalesce({b_in}, 0)", f"coalesce({b_out}, 0)"
    return f"{src} || ' communicated with ' || {dst} || coalesce(' on tcp/' || {ports}, '') || CASE WHEN {b_in} > 0 OR {b_out} > 0 THEN ' — ' || {bytes_sql(b_out)} || ' outbound, ' || {bytes_sql(b_in)} || ' inbound' ELSE '' END"


edges_of("GRF21_all_edge_types", "true")

PORTS = "np AS (SELECT inv_id, edge_type, source_id, target_id, string_agg(port::VARCHAR, ',' ORDER BY port) AS numeric_ports FROM (SELECT DISTINCT inv_id, edge_type, source_id, target_id, port FROM edge_c WHERE port IS NOT NULL) GROUP BY ALL)"


@query("TML10_edge_descriptions", f"""SELECT inv_id, 'edge:' || id AS id, CASE WHEN bytes_in IS NOT NULL OR bytes_out IS NOT NULL THEN {flow_sql('source_label', 'target_label', 'numeric_ports', 'bytes_in', 'bytes_out')}
  WHEN event_count > 1 THEN 'Occurred ' || event_count || ' times' ELSE '' END AS description
FROM le LEFT JOIN np USING (inv_id, edge_type, source_id, target_id) WHERE edge_type <> 'TRIGGERED_BY'""", (*GRAPH, LABELLED, PORTS))  # fmt: skip
def tml10(spark, sf_dir):
    return timeline.edge_descriptions(graph(spark, sf_dir)[1], addresses(spark, sf_dir))


@query("TML11_flow_narratives", f"SELECT event_uid, {flow_sql('src_ip', 'dst_ip', 'dst_port::VARCHAR', 'bytes_in', 'bytes_out')} AS narrative FROM evw WHERE class_uid = 4001", (EV, EVW))
def tml11(spark, sf_dir):
    at = {"class_uid": "class_uid", "src_endpoint_ip": "src_endpoint.ip", "dst_endpoint_ip": "dst_endpoint.ip", "bytes_in": "traffic.bytes_in", "bytes_out": "traffic.bytes_out", "dst_port": "dst_endpoint.port", "protocol_name": "connection_info.protocol_name"}
    text = timeline.narrative(lambda k: F.col(at[k]).cast("string") if k in at else F.lit(None).cast("string"))
    return window(spark, sf_dir).where("class_uid = 4001").select("event_uid", text.alias("narrative"))


PRINCIPALS = "pr AS (SELECT inv_id, principal_id AS id, arg_min(user_type, (time_dt, event_uid)) AS user_type, arg_min(account, (time_dt, event_uid)) AS account FROM g WHERE principal_id IS NOT NULL GROUP BY 1, 2)"


@query("TML12_node_descriptions", """SELECT n.inv_id, n.id, concat_ws(' | ', CASE node_type WHEN 'Principal' THEN 'Type: ' || user_type || ' | Account: ' || account
    WHEN 'IPAddress' THEN CASE WHEN n.id LIKE 'IPAddress:10.%' THEN 'Internal IP' ELSE 'External IP' END
    WHEN 'Resource' THEN 'Type: ' || CASE WHEN starts_with(n.id, 'Resource:domain:') THEN 'domain' ELSE 's3' END WHEN 'SecurityFinding' THEN 'Severity: ' || severity END,
  CASE WHEN event_count > 1 THEN 'Event count: ' || event_count END) AS description
FROM nodes n LEFT JOIN pr USING (inv_id, id) LEFT JOIN rules ON rule_id = n.inv_id WHERE node_type <> 'Event'""", (*GRAPH, PRINCIPALS))  # fmt: skip
def tml12(spark, sf_dir):
    nodes = graph(spark, sf_dir)[0].where("node_type <> 'Event'")
    return nodes.select("inv_id", "id", timeline.node_description(nodes).alias("description"))


@query("ATK12_all_steps", "SELECT inv_id, id AS edge_id, edge_type, phase, line AS narrative, CASE WHEN source_type = 'Principal' THEN source_label END AS actor FROM told", (*ATK, TOLD))
def atk12(spark, sf_dir):
    return step_rows(spark, sf_dir).select("inv_id", "edge_id", "edge_type", "phase", "narrative", "actor")


@query("ATK13_steps_by_phase", "SELECT inv_id, phase, count(*) AS steps, min(step) AS first_step, count(DISTINCT source_id) AS sources FROM pl GROUP BY 1, 2", ATK)
def atk13(spark, sf_dir):
    return step_rows(spark, sf_dir).groupBy("inv_id", "phase").agg(F.count("*").alias("steps"), F.min("step").alias("first_step"), F.count_distinct("source_id").alias("sources"))


@query("ENR22_role_context", "SELECT inv_id, label, c_custkey % 10 = 0 AS is_admin, CASE WHEN c_custkey % 4 = 0 THEN 'ec2.amazonaws.com' ELSE 'arn:aws:iam::1111:root' END AS trusted FROM nodes JOIN customer ON label = 'user_' || c_custkey WHERE node_type IN ('Principal', 'Resource') AND c_custkey % 3 > 0", GRAPH)
def enr22(spark, sf_dir):
    """Principals that are roles of the inventory, with the role's admin flag and trusted principals."""
    roles = inventory(spark, sf_dir).where("mfa_devices > 0").withColumn("inline_policies", F.array().cast("array<string>"))
    return enrich.role_context(graph(spark, sf_dir)[0], roles).select("inv_id", "label", "is_admin", F.array_join("trusted", ",").alias("trusted"))


@query("PLB4_action_plan_by_hour", """SELECT rule_id, playbook_id, action, hour, CASE WHEN approval = 'auto' OR approval = 'business_hours' AND hour BETWEEN 9 AND 17 THEN 'pending' ELSE 'awaiting_approval' END AS status
FROM (SELECT rule_id, hour(max(time_dt)) AS hour FROM hits GROUP BY 1) JOIN plays USING (rule_id) JOIN (VALUES ('evasion', 'notify', 'auto'), ('evasion', 'restore logging', 'business_hours'), ('evasion', 'disable key', 'manual'), ('any-medium', 'notify', 'auto'), ('one-rule', 'review', 'business_hours')) a(playbook_id, action, approval) USING (playbook_id)""", (*DETECT, PLAYS))  # fmt: skip
def plb4(spark, sf_dir):
    """Actions as planned on a Wednesday at the hour of the rule's last match: in office hours some need no approval."""
    last = D.hits(events(spark, sf_dir), RULES, START, END).groupBy("rule_id").agg(F.hour(F.max("time_dt")).cast("long").alias("hour"))
    matched = ops.matching_playbooks(D.run_all(events(spark, sf_dir), RULES, START, END), playbooks(spark)).join(last, "rule_id")
    at = F.lit("2024-01-24 00:00:00").cast("timestamp") + F.make_interval(hours=F.col("hour").cast("int"))
    return ops.planned_actions(matched, at, "hour").select("rule_id", "playbook_id", "action", "hour", "status")


@query("DET15_indexed_rules", "SELECT rule_id, count(*) AS n, min(event_uid) AS first_uid FROM hits GROUP BY 1", (EV, HITS))
def det15(spark, sf_dir):
    """All rules as rows of a table that events look up."""
    return ruleindex.indexed_hits(events(spark, sf_dir), RULES, START, END).groupBy("rule_id").agg(F.count("*").alias("n"), F.min("event_uid").alias("first_uid"))


# --- investigations of every triggered rule, row by row ---------------------------------------------------------------------


def every(ctes: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(WHOLE.get(c, c) for c in ctes)


@query("INV4_all_patterns", "SELECT inv_id, pattern, entity, n, round(severity::DOUBLE, 6) AS severity, members FROM pat", every(PAT))
def inv4(spark, sf_dir):
    return found_patterns(spark, sf_dir, True).withColumn("severity", F.round("severity", 6))


@query("INV5_all_steps", "SELECT inv_id, step, id AS edge_id, phase, line AS narrative FROM told", every((*ATK, TOLD)))
def inv5(spark, sf_dir):
    return attack.steps_of_sets(inside(spark, sf_dir, True), [r["id"] for r in cases(spark, sf_dir, True)], event_parts(spark, sf_dir)).select("inv_id", "step", "edge_id", "phase", "narrative")


@query("INV6_all_elements", """SELECT inv_id, id, node_type AS type, label, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, event_count FROM nodes
UNION ALL SELECT inv_id, id, edge_type, source_id || ' -> ' || target_id, epoch_us(first_seen), epoch_us(last_seen), event_count FROM edges""", every(GRAPH))  # fmt: skip
def inv6(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir, True)
    columns = ["inv_id", "id", "type", "label", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "event_count"]
    linked = edges.withColumn("type", F.col("edge_type")).withColumn("label", F.concat("source_id", F.lit(" -> "), "target_id"))
    return nodes.withColumn("type", F.col("node_type")).select(*columns).unionByName(linked.select(*columns))
