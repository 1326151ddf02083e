"""Queries of timelines, patterns, attack paths and anomalies (TML*, PAT*, ATK*, AGG2 to AGG4, AGG10 to AGG13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import anomaly, attack, patterns, timeline
from ..operators import detect as D
from ..sources.adapter import EV
from .q_detect import HISTORY, history
from .q_enrich import EVW, GRAPH, cases, edge_sets, found_patterns, graph, kept, label_sets, results, window
from .registry import DETECT, RULES, query

COUNTS = "counts AS (SELECT 'user' AS kind, user_name AS entity, count(*) AS event_count FROM evw WHERE user_name IS NOT NULL GROUP BY 2 UNION ALL SELECT 'ip', src_ip, count(*) FROM evw WHERE src_ip IS NOT NULL GROUP BY 2 UNION ALL SELECT 'service', service, count(*) FROM evw WHERE service IS NOT NULL GROUP BY 2)"
SCORES = """z AS (SELECT kind, entity, event_count, median, mad, 0.6745 * (event_count - median) / CASE WHEN mad > 0 THEN mad ELSE mean_off END AS z_score
  FROM (SELECT *, median(off) OVER (PARTITION BY kind) AS mad, avg(off) OVER (PARTITION BY kind) AS mean_off, count(*) OVER (PARTITION BY kind) AS k
        FROM (SELECT *, abs(event_count - median) AS off FROM (SELECT *, median(event_count) OVER (PARTITION BY kind) AS median FROM counts)))
  WHERE k >= 2 AND CASE WHEN mad > 0 THEN mad ELSE mean_off END > 0)"""


@query("AGG2_entity_counts", "SELECT * FROM counts", (EV, EVW, COUNTS))
def agg2(spark, sf_dir):
    return anomaly.entity_counts(window(spark, sf_dir))


@query("AGG3_anomaly_scores", "SELECT kind, entity, event_count, median, mad, round(z_score, 6) AS z_score FROM z WHERE z_score >= 1.0", (EV, EVW, COUNTS, SCORES))
def agg3(spark, sf_dir):
    got = anomaly.scores(anomaly.entity_counts(window(spark, sf_dir)), threshold=1.0)
    return got.withColumn("z_score", F.round("z_score", 6))


@query("AGG4_anomaly_metadata", "SELECT kind, count(*) AS n, round(max(z_score), 2) AS top FROM z WHERE z_score >= 0.5 GROUP BY 1", (EV, EVW, COUNTS, SCORES))
def agg4(spark, sf_dir):
    return anomaly.scores(anomaly.entity_counts(window(spark, sf_dir)), threshold=0.5).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.max("z_score"), 2).alias("top"))


# --- timelines ------------------------------------------------------------------------------------------------------------

#: The sentences in this text.
TITLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in timeline.NODE_TITLES.items())
LABELLED = """le AS (SELECT e.*, coalesce(s.label, e.source_id) AS source_label, coalesce(t.label, e.target_id) AS target_label, s.node_type AS source_type, t.node_type AS target_type
  FROM edges e LEFT JOIN nodes s ON s.inv_id = e.inv_id AND s.id = e.source_id LEFT JOIN nodes t ON t.inv_id = e.inv_id AND t.id = e.target_id)"""
TIMELINE = f"""tl AS (
  SELECT inv_id, 'node:' || id AS id, first_seen AS ts, CASE node_type {TITLES} END || ': ' || label AS title, id AS entity_id,
    CASE WHEN node_type = 'SecurityFinding' THEN CASE WHEN severity IN ('critical', 'high') THEN 'suspicious' ELSE 'important' END ELSE 'unreviewed' END AS tag
  FROM nodes LEFT JOIN rules ON inv_id = rule_id
  UNION ALL SELECT inv_id, 'edge:' || id, first_seen, edge_type || ': ' || source_label || ' -> ' || target_label, id, 'unreviewed' FROM le WHERE edge_type <> 'TRIGGERED_BY')"""
CLUSTERED = """cl AS (SELECT *, sum(b) OVER (PARTITION BY inv_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster
  FROM (SELECT *, coalesce(CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY inv_id ORDER BY ts, id))) / 1000000) > 300 AS INT), 0) AS b FROM tl))"""
TL = (*GRAPH, LABELLED, TIMELINE, CLUSTERED)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.extract(*graph(spark, sf_dir))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.moments(*graph(spark, sf_dir))


@query("TML1_node_events", "SELECT inv_id, id, epoch_us(ts) AS ts_us, title, tag FROM tl WHERE starts_with(id, 'node:')", TL)
def tml1(spark, sf_dir):
    return timeline.node_events(graph(spark, sf_dir)[0]).select("inv_id", "id", F.unix_micros("ts").alias("ts_us"), "title", "tag")


@query("TML2_edge_events", "SELECT inv_id, id, epoch_us(ts) AS ts_us, title FROM tl WHERE starts_with(id, 'edge:')", TL)
def tml2(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return timeline.edge_events(edges, nodes).select("inv_id", "id", F.unix_micros("ts").alias("ts_us"), "title")


@query("TML3_clusters", """SELECT inv_id, cluster, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS events, any_value(dominant) AS dominant,
  CAST(floor((epoch_us(min(ts)) - lag(epoch_us(max(ts))) OVER (PARTITION BY inv_id ORDER BY cluster)) / 1000000) AS BIGINT) AS gap_seconds
FROM cl JOIN (SELECT inv_id, cluster, arg_min(entity_id, (-n, entity_id)) AS dominant FROM (SELECT inv_id, cluster, entity_id, count(*) AS n FROM cl GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (inv_id, cluster)
GROUP BY inv_id, cluster""", TL)  # fmt: skip
def tml3(spark, sf_dir):
    got = timeline.clusters(moments(spark, sf_dir))
    return got.select("inv_id", "cluster", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events", "dominant", "gap_seconds")


@query("TML4_tagging", "SELECT inv_id, CASE WHEN starts_with(title, 'CALLED_API') THEN 'persistence' ELSE tag END AS tag, count(*) AS n FROM tl GROUP BY 1, 2", TL)
def tml4(spark, sf_dir):
    rows = lines(spark, sf_dir)
    tags = rows.where(F.col("title").startswith("CALLED_API")).select("inv_id", "id", F.lit("persistence").alias("tag"), F.lit("checked").alias("notes"))
    return timeline.tagged(rows, tags).groupBy("inv_id", "tag").agg(F.count("*").alias("n"))


@query("TML5_suspicious", "SELECT inv_id, id FROM tl WHERE tag = 'suspicious'", TL)
def tml5(spark, sf_dir):
    return timeline.suspicious(moments(spark, sf_dir)).select("inv_id", "id")


#: The sentences in this text.
NARRATIVE = """CASE WHEN class_uid = 3002 THEN 'User ''' || coalesce(user_name, 'unknown') || ''' (' || user_type || ') authenticated to ' || service || ' from ' || src_ip || '. Status: ' || status || '.'
  WHEN class_uid IN (6003, 3001) THEN 'User ''' || coalesce(user_name, 'unknown') || ''' called ' || service || ':' || operation || coalesce(' targeting ' || resource_uid, '') || '.'
  WHEN class_uid = 4003 THEN 'Internal host ' || src_ip || ' resolved ' || hostname END || coalesce(' ' || context, '')"""
CONTEXTS = "contexts(operation, context) AS (VALUES " + ", ".join(f"('{op}', '{text}')" for text, ops in timeline.CONTEXT.items() for op in ops) + ")"


@query("TML6_narratives", f"SELECT event_uid, {NARRATIVE} AS narrative FROM evw LEFT JOIN contexts USING (operation) WHERE class_uid <> 4001", (EV, EVW, CONTEXTS))
def tml6(spark, sf_dir):
    ev = window(spark, sf_dir).where("class_uid <> 4001")
    at = {"class_uid": "class_uid", "actor_user_name": "actor.user.name", "actor_user_type": "actor.user.type", "api_operation": "api.operation", "api_service_name": "api.service.name", "src_endpoint_ip": "src_endpoint.ip", "dst_endpoint_ip": "dst_endpoint.ip", "status": "status", "query_hostname": "query.hostname", "protocol_name": "connection_info.protocol_name", "bytes_in": "traffic.bytes_in", "bytes_out": "traffic.bytes_out", "dst_port": "dst_endpoint.port"}
    text = timeline.narrative(lambda k: F.get(F.col("resources"), 0)["uid"] if k == "resource_id" else F.col(at[k]).cast("string"))
    return ev.select("event_uid", text.alias("narrative"))


@query("TML7_node_descriptions", "SELECT inv_id, id, CASE WHEN id LIKE 'IPAddress:10.%' THEN 'Internal IP' ELSE 'External IP' END || CASE WHEN event_count > 1 THEN ' | Event count: ' || event_count ELSE '' END AS description FROM nodes WHERE node_type = 'IPAddress'", GRAPH)
def tml7(spark, sf_dir):
    nodes = graph(spark, sf_dir)[0].where("node_type = 'IPAddress'")
    return nodes.select("inv_id", "id", timeline.node_description(nodes).alias("description"))


@query("TML8_human_bytes", "SELECT CASE WHEN bytes_out >= 1000000000 THEN 'GB' WHEN bytes_out >= 1000000 THEN 'MB' WHEN bytes_out >= 1000 THEN 'KB' ELSE 'B' END AS unit, count(*) AS n FROM evw WHERE bytes_out IS NOT NULL GROUP BY 1", (EV, EVW))
def tml8(spark, sf_dir):
    text = timeline.human_bytes(F.col("traffic.bytes_out"))
    return window(spark, sf_dir).where("traffic.bytes_out IS NOT NULL").groupBy(F.substring_index(text, " ", -1).alias("unit")).agg(F.count("*").alias("n"))


@query("TML9_chronology", "SELECT inv_id, id, row_number() OVER (PARTITION BY inv_id ORDER BY ts, id) AS place FROM tl", TL)
def tml9(spark, sf_dir):
    return timeline.in_order(moments(spark, sf_dir)).select("inv_id", "id", "place")


@query("AGG12_timeline_summary", "SELECT inv_id, count(*) AS total, count(*) FILTER (tag = 'unreviewed') AS unreviewed, count(*) FILTER (tag = 'suspicious') AS suspicious, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS duration_seconds FROM tl GROUP BY 1", TL)
def agg12(spark, sf_dir):
    return timeline.summary(moments(spark, sf_dir)).select("inv_id", "total", "unreviewed", "suspicious", "duration_seconds")


# --- patterns -------------------------------------------------------------------------------------------------------------

SERVICES = "ps AS (SELECT DISTINCT inv_id, source_id, source_label AS principal, split_part(target_label, ':', 1) AS service FROM le WHERE edge_type = 'CALLED_API' AND source_type = 'Principal')"
PATTERNS = """pat AS (
  SELECT inv_id, 'privilege_fanout' AS pattern, min(principal) AS entity, count(DISTINCT service) AS n, least(0.9, 0.4 + 0.5 * (count(DISTINCT service) - 5) / 5) AS severity, string_agg(DISTINCT service, ', ' ORDER BY service) AS members
  FROM ps GROUP BY inv_id, source_id HAVING count(DISTINCT service) >= 5
  UNION ALL SELECT a.inv_id, 'resource_convergence', min(a.target_label), count(DISTINCT c.source_label), least(0.9, 0.5 + 0.3 * (count(DISTINCT c.source_label) - 3) / 3), string_agg(DISTINCT c.source_label, ', ' ORDER BY c.source_label)
  FROM le a JOIN le c ON a.inv_id = c.inv_id AND a.source_id = c.target_id WHERE a.edge_type = 'ACCESSED_RESOURCE' AND c.edge_type = 'CALLED_API' AND c.source_type = 'Principal' GROUP BY a.inv_id, a.target_id HAVING count(DISTINCT c.source_label) >= 3
  UNION ALL SELECT inv_id, 'multi_source_auth', entity, n, CASE WHEN span < 3600000000 THEN least(0.5 + 0.1 * least(n - 3, 4) + 0.2, 0.95) ELSE least(0.5 + 0.1 * least(n - 3, 4), 0.85) END, members FROM (
    SELECT inv_id, min(source_label) AS entity, count(DISTINCT target_label) FILTER (target_label NOT LIKE '10.%') AS n, epoch_us(max(last_seen)) - epoch_us(min(first_seen)) AS span, string_agg(DISTINCT target_label, ', ' ORDER BY target_label) FILTER (target_label NOT LIKE '10.%') AS members
    FROM le WHERE edge_type = 'AUTHENTICATED_FROM' AND source_type = 'Principal' GROUP BY inv_id, source_id) WHERE n >= 3
  UNION ALL SELECT inv_id, 'service_bridge', entity, n, least(0.85, 0.5 + 0.1 * n), members FROM (
    SELECT inv_id, source_id, min(principal) AS entity, count(DISTINCT (a, b)) AS n, string_agg(DISTINCT s, ', ' ORDER BY s) AS members FROM (
      SELECT inv_id, source_id, principal, a, b, unnest([a, b]) AS s FROM (SELECT x.inv_id, min(x.source_id) AS source_id, min(x.principal) AS principal, x.service AS a, y.service AS b FROM ps x JOIN ps y ON x.inv_id = y.inv_id AND x.source_id = y.source_id AND x.service < y.service GROUP BY x.inv_id, x.service, y.service HAVING count(*) = 1)) GROUP BY inv_id, source_id))"""
PAT = (*GRAPH, LABELLED, SERVICES, PATTERNS)


def pattern(name: str, kind: str | None):
    @query(name, "SELECT inv_id, pattern, entity, n, round(severity::DOUBLE, 6) AS severity, members FROM pat" + (f" WHERE pattern = '{kind}'" if kind else ""), PAT)
    def run(spark, sf_dir):
        if kind:
            nodes, edges = graph(spark, sf_dir)
        rows = getattr(patterns, kind)(edges, nodes) if kind else found_patterns(spark, sf_dir).orderBy(F.desc("severity"))
        return rows.withColumn("severity", F.round("severity", 6))


for _name, _kind in (("PAT1_privilege_fanout", "privilege_fanout"), ("PAT2_resource_convergence", "resource_convergence"), ("PAT3_multi_source_auth", "multi_source_auth"), ("PAT4_service_bridge", "service_bridge"), ("PAT5_all_patterns", None)):
    pattern(_name, _kind)


# --- attack paths ---------------------------------------------------------------------------------------------------------

BOTH = "bw AS (SELECT inv_id, source_id AS node, target_id AS other FROM edges UNION SELECT inv_id, target_id, source_id FROM edges)"
HOP = ["h0 AS (SELECT inv_id, id AS finding_id, id AS node FROM nodes WHERE node_type = 'SecurityFinding')"] + [f"h{k} AS (SELECT inv_id, finding_id, node FROM h{k - 1} UNION SELECT h.inv_id, finding_id, other FROM h{k - 1} h JOIN bw ON bw.inv_id = h.inv_id AND bw.node = h.node)" for k in range(1, 6)]


def values(name: str, table: dict[str, list[str]]) -> str:
    return f"{name}(key, phase) AS (VALUES " + ", ".join(f"('{k}', '{p}')" for p, keys in table.items() for k in keys) + ")"


OPS, TECH = values("ops", attack.PHASES["aws_operation"]), values("tech", attack.PHASES["technique"])
ORD = "ord(phase, o) AS (VALUES " + ", ".join(f"('{p}', {k})" for k, p in enumerate(attack.ORDER)) + ")"
MITRE = "mp AS (SELECT inv_id, arg_min(tech.phase, k) AS mitre_phase FROM (SELECT rule_id AS inv_id, unnest(string_split(mitre, ',')) AS t, generate_subscripts(string_split(mitre, ','), 1) AS k FROM rules) JOIN tech ON tech.key = split_part(t, '.', 1) GROUP BY 1)"
CALL = " ".join(f"WHEN '{p}' THEN ' — {t}'" for p, t in attack.CALL_TEXT.items())
#: The sentences in this text.
STEPS = f"""st AS (SELECT *, CASE edge_type WHEN 'CALLED_API' THEN source_label || ' called ' || target_label || coalesce(CASE own {CALL} END, '') || '.'
    WHEN 'AUTHENTICATED_FROM' THEN source_label || ' authenticated from ' || target_label || CASE WHEN event_count > 1 THEN ' (' || event_count || ' times).' ELSE '.' END
    WHEN 'ACCESSED_RESOURCE' THEN source_label || ' accessed resource ' || target_label || '.' END AS narrative,
    CASE WHEN own = 'Unknown' THEN coalesce(mitre_phase, 'Unknown') ELSE own END AS phase FROM (
  SELECT le.*, h.finding_id, CASE edge_type WHEN 'AUTHENTICATED_FROM' THEN CASE WHEN event_count > 10 THEN 'CredentialAccess' ELSE 'InitialAccess' END
    WHEN 'CALLED_API' THEN coalesce(oc.phase, 'Unknown') WHEN 'ACCESSED_RESOURCE' THEN coalesce(oa.phase, 'Collection') WHEN 'RESOLVED_TO' THEN 'Discovery' WHEN 'ORIGINATED_FROM' THEN 'InitialAccess'
    WHEN 'COMMUNICATED_WITH' THEN CASE WHEN source_label LIKE '10.%' AND target_label NOT LIKE '10.%' AND bytes_out > 10000000 THEN 'Exfiltration' WHEN source_label LIKE '10.%' AND target_label LIKE '10.%' THEN 'LateralMovement'
      WHEN source_label NOT LIKE '10.%' AND target_label LIKE '10.%' AND bytes_in > 0 THEN 'InitialAccess' ELSE 'Unknown' END END AS own, mitre_phase
  FROM le JOIN h5 h ON h.inv_id = le.inv_id AND h.node = le.source_id JOIN h5 h2 ON h2.inv_id = le.inv_id AND h2.node = le.target_id AND h2.finding_id = h.finding_id
  LEFT JOIN ops oc ON oc.key = split_part(target_label, ':', 2) LEFT JOIN ops oa ON oa.key = split_part(source_label, ':', 2) LEFT JOIN mp ON mp.inv_id = le.inv_id
  WHERE edge_type NOT IN ('TRIGGERED_BY', 'RELATED_TO')))"""
PLACED = "pl AS (SELECT st.*, row_number() OVER (PARTITION BY inv_id, finding_id ORDER BY first_seen, o, id) AS step FROM st JOIN ord USING (phase))"
ATK = (*GRAPH, LABELLED, BOTH, *HOP, OPS, TECH, ORD, MITRE, STEPS, PLACED)


def findings(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return results(spark, sf_dir, whole).select("inv_id", "finding_id", "name", "severity", "mitre")


def step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "steps", lambda: attack.steps(findings(spark, sf_dir), *graph(spark, sf_dir))[0])


def mitre(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """inv_id, mitre of each case."""
    return D.rule_table(spark, cases(spark, sf_dir, whole)).select(F.col("rule_id").alias("inv_id"), "mitre")


def labelled(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Edges of the cases by sets of investigations, with labels and what is reached."""
    return attack.labelled_sets(edge_sets(spark, sf_dir, whole), label_sets(spark, sf_dir, whole), [r["id"] for r in cases(spark, sf_dir, whole)])


def inside(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Steps of the cases' attack paths by sets of investigations, not yet placed."""
    return attack.inside_sets(labelled(spark, sf_dir, whole), [r["id"] for r in cases(spark, sf_dir, whole)], mitre(spark, sf_dir, whole))


def stories(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return kept(spark, sf_dir, f"stories of {'all' if whole else 'cases'}", lambda: attack.narratives(findings(spark, sf_dir, whole), *graph(spark, sf_dir, whole)))


@query("ATK1_reachable", "SELECT inv_id, node FROM h5", ATK)
def atk1(spark, sf_dir):
    return attack.reachable(findings(spark, sf_dir), graph(spark, sf_dir)[1]).select("inv_id", "node")


@query("ATK2_technique_phase", "SELECT rule_id, t AS technique, coalesce(phase, 'Unknown') AS phase FROM (SELECT rule_id, unnest(string_split(mitre, ',')) AS t FROM rules JOIN (SELECT DISTINCT rule_id FROM hits) USING (rule_id)) LEFT JOIN tech ON key = split_part(t, '.', 1) WHERE t <> ''", (*DETECT, TECH))
def atk2(spark, sf_dir):
    from ..operators import detect as D
    from ..sources.adapter import events
    from .registry import END, START

    hit = D.hits(events(spark, sf_dir), RULES, START, END).select("rule_id").distinct()
    rows = D.rule_table(spark, RULES).join(hit, "rule_id").select("rule_id", F.explode("mitre").alias("technique"))
    return rows.withColumn("phase", attack.technique_phase(F.col("technique")))


@query("ATK3_operation_phase", "SELECT operation, coalesce(phase, 'Unknown') AS phase, count(*) AS n FROM ev LEFT JOIN ops ON key = operation WHERE operation IS NOT NULL GROUP BY 1, 2", (EV, OPS))
def atk3(spark, sf_dir):
    from ..sources.adapter import events

    return events(spark, sf_dir).where("api.operation IS NOT NULL").groupBy(F.col("api.operation").alias("operation")).agg(F.count("*").alias("n")).withColumn("phase", attack.operation_phase(F.col("operation")))


@query("ATK4_steps", "SELECT inv_id, id AS edge_id, phase, narrative, CASE WHEN source_type = 'Principal' THEN source_label END AS actor FROM st WHERE edge_type IN ('CALLED_API', 'AUTHENTICATED_FROM', 'ACCESSED_RESOURCE')", ATK)
def atk4(spark, sf_dir):
    return step_rows(spark, sf_dir).where("edge_type IN ('CALLED_API', 'AUTHENTICATED_FROM', 'ACCESSED_RESOURCE')").select("inv_id", "edge_id", "phase", "narrative", "actor")


@query("ATK5_flow_phases", "SELECT inv_id, id AS edge_id, own AS phase FROM st WHERE edge_type = 'COMMUNICATED_WITH'", ATK)
def atk5(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return attack.classify(edges.where("edge_type = 'COMMUNICATED_WITH'"), nodes).select("inv_id", "edge_id", "phase")


@query("ATK6_inherited_phase", "SELECT inv_id, own AS before, phase, count(*) AS n FROM st GROUP BY 1, 2, 3", ATK)
def atk6(spark, sf_dir):
    return step_rows(spark, sf_dir).groupBy("inv_id", F.col("own_phase").alias("before"), "phase").agg(F.count("*").alias("n"))


@query("ATK7_step_order", "SELECT inv_id, step, id AS edge_id, phase FROM pl", ATK)
def atk7(spark, sf_dir):
    return step_rows(spark, sf_dir).select("inv_id", "step", "edge_id", "phase")


@query("ATK8_entry_point", "SELECT inv_id, arg_min(target_label, step) AS entry_point FROM pl WHERE edge_type = 'AUTHENTICATED_FROM' GROUP BY 1", ATK)
def atk8(spark, sf_dir):
    return stories(spark, sf_dir).where("entry_point IS NOT NULL").select("inv_id", "entry_point")


IMPACT = "concat_ws('. ', " + ", ".join(f"CASE WHEN bool_or(phase = '{p}') THEN '{s}' END" for p, s in attack.CONCERNS.items()) + ")"


@query("ATK9_impact", f"SELECT inv_id, CASE WHEN {IMPACT} = '' THEN '{attack.NO_CONCERN}' ELSE {IMPACT} || '.' END AS impact FROM pl GROUP BY 1", ATK)
def atk9(spark, sf_dir):
    return stories(spark, sf_dir).select("inv_id", "impact")


BYTES = "CASE WHEN b >= 1000000000 THEN printf('%.1f GB', b / 1000000000) WHEN b >= 1000000 THEN printf('%.1f MB', b / 1000000) WHEN b >= 1000 THEN printf('%.1f KB', b / 1000) ELSE b || ' B' END"
#: The sentences in this text.
TOLD = f"""told AS (SELECT *, CASE edge_type WHEN 'COMMUNICATED_WITH' THEN source_label || ' communicated with ' || target_label
    || CASE own WHEN 'Exfiltration' THEN ' — ' || (SELECT {BYTES} FROM (SELECT coalesce(bytes_out, 0)::DOUBLE AS b)) || ' outbound to external host' WHEN 'InitialAccess' THEN ' — inbound from external' ELSE '' END || '.'
    WHEN 'RESOLVED_TO' THEN source_label || ' resolved ' || target_label || '.' WHEN 'ORIGINATED_FROM' THEN 'Event originated from ' || target_label || '.' ELSE narrative END AS line FROM pl)"""
#: The sentences in this text.
SUMMARY = """SELECT inv_id, 'Detection ''' || name || ''' triggered an investigation' || coalesce(' originating from ' || entry, '') || coalesce(' involving ' || actors, '') || '.'
  || CASE WHEN n > 1 THEN ' The attack path spans ' || n || ' kill chain phases: ' || spans || '.' ELSE '' END || coalesce(' Key concerns: ' || points, '') AS summary
FROM (SELECT DISTINCT inv_id FROM pl) JOIN (SELECT rule_id AS inv_id, name FROM rules) USING (inv_id)
LEFT JOIN (SELECT inv_id, arg_min(target_label, step) AS entry FROM pl WHERE edge_type = 'AUTHENTICATED_FROM' AND target_type = 'IPAddress' GROUP BY 1) USING (inv_id)
LEFT JOIN (SELECT inv_id, string_agg(actor, ', ' ORDER BY k) AS actors FROM (SELECT inv_id, source_label AS actor, min(step) AS k FROM pl WHERE source_type = 'Principal' GROUP BY 1, 2) GROUP BY 1) USING (inv_id)
LEFT JOIN (SELECT inv_id, count(*) AS n, string_agg(phase, ' → ' ORDER BY k) AS spans FROM (
  SELECT DISTINCT inv_id, mitre_phase AS phase, 0 AS k FROM pl WHERE mitre_phase IS NOT NULL
  UNION ALL SELECT inv_id, phase, min(step) FROM pl WHERE phase <> 'Unknown' AND phase IS DISTINCT FROM mitre_phase GROUP BY 1, 2) GROUP BY 1) USING (inv_id)
LEFT JOIN (SELECT inv_id, string_agg(line, ' ' ORDER BY step) AS points FROM (SELECT *, row_number() OVER (PARTITION BY inv_id ORDER BY step) AS r FROM told
  WHERE phase IN ('DefenseEvasion', 'Exfiltration', 'Impact', 'Persistence') AND line IS NOT NULL) WHERE r <= 3 GROUP BY 1) USING (inv_id)"""


@query("ATK10_summary", SUMMARY, (*ATK, TOLD))
def atk10(spark, sf_dir):
    return stories(spark, sf_dir).select("inv_id", "summary")


@query("ATK11_narratives", """SELECT inv_id, steps, node_count, edge_count, severity, actors FROM (SELECT inv_id, count(*) AS steps FROM pl GROUP BY 1)
JOIN (SELECT inv_id, count(*) AS node_count FROM h5 GROUP BY 1) USING (inv_id)
JOIN (SELECT e.inv_id, count(*) AS edge_count FROM edges e JOIN h5 a ON a.inv_id = e.inv_id AND a.node = e.source_id JOIN h5 b ON b.inv_id = e.inv_id AND b.node = e.target_id GROUP BY 1) USING (inv_id)
JOIN (SELECT inv_id, string_agg(actor, ',' ORDER BY k) AS actors FROM (SELECT inv_id, source_label AS actor, min(step) AS k FROM pl WHERE source_type = 'Principal' GROUP BY 1, 2) GROUP BY 1) USING (inv_id)
JOIN rules ON rule_id = inv_id""", ATK)  # fmt: skip
def atk11(spark, sf_dir):
    return stories(spark, sf_dir).select("inv_id", "steps", "node_count", "edge_count", "severity", "actors")


# --- reports --------------------------------------------------------------------------------------------------------------


@query("AGG10_entity_summary", "SELECT inv_id, node_type, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT label)), 1, 5), ',') AS examples FROM nodes GROUP BY 1, 2", GRAPH)
def agg10(spark, sf_dir):
    nodes, _ = graph(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("inv_id", "node_type").orderBy("label"))
    first = nodes.where("label IS NOT NULL").select("inv_id", "node_type", "label").distinct().withColumn("k", rank).where("k <= 5").groupBy("inv_id", "node_type").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("examples"))
    return nodes.groupBy("inv_id", "node_type").agg(F.count("*").alias("n")).join(first, ["inv_id", "node_type"], "left")


@query("AGG11_detection_report", "SELECT severity, count(*) AS rules, count(*) FILTER (triggered) AS triggered, sum(match_count)::BIGINT AS matches FROM results GROUP BY 1", DETECT)
def agg11(spark, sf_dir):
    from ..operators import detect as D
    from ..sources.adapter import events
    from .registry import END, START

    got = D.run_all(events(spark, sf_dir), RULES, START, END)
    return got.groupBy("severity").agg(F.count("*").alias("rules"), F.count_if("triggered").alias("triggered"), F.sum("match_count").alias("matches"))


@query("AGG13_mitre_coverage", "SELECT phase, count(DISTINCT t) AS techniques, count(DISTINCT rule_id) AS rules, count(DISTINCT run_day) AS days FROM (SELECT rule_id, run_day, unnest(string_split(mitre, ',')) AS t FROM history JOIN rules USING (rule_id)) JOIN tech ON key = split_part(t, '.', 1) GROUP BY 1", (*DETECT, HISTORY, TECH))
def agg13(spark, sf_dir):
    from ..operators import detect as D

    rows = history(spark, sf_dir).join(D.rule_table(spark, RULES).select("rule_id", F.explode("mitre").alias("t")), "rule_id")
    rows = rows.withColumn("phase", attack.technique_phase(F.col("t"))).where("phase <> 'Unknown'")
    return rows.groupBy("phase").agg(F.count_distinct("t").alias("techniques"), F.count_distinct("rule_id").alias("rules"), F.count_distinct("run_day").alias("days"))
