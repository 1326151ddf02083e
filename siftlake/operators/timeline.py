"""Timelines of graphs: events, clusters, tags, narratives (TML1 to TML9, AGG12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import chained, placed

#: Titles of node types.
NODE_TITLES = {"Principal": "User/Role activity", "IPAddress": "Network activity", "Resource": "Resource access", "APIOperation": "API call", "SecurityFinding": "Security alert", "Event": "Security event"}
#: Tags of timeline events that count as suspicious.
SUSPICIOUS = ["suspicious", "attack_phase", "initial_access", "persistence", "privilege_escalation", "lateral_movement", "data_exfiltration", "impact"]
#: Sentences that follow sensitive operations.
CONTEXT = {
    "This created new programmatic credentials.": ["CreateAccessKey"],
    "This removed multi-factor authentication protection.": ["DeactivateMFADevice", "DeleteVirtualMFADevice"],
    "This disabled audit logging — potential anti-forensics.": ["StopLogging", "DeleteTrail", "PutEventSelectors"],
    "This assumed a different identity with potentially different permissions.": ["AssumeRole", "AssumeRoleWithSAML", "AssumeRoleWithWebIdentity"],
    "This modified access controls on the S3 bucket.": ["PutBucketPolicy", "PutBucketAcl"],
    "This opened network access — check for overly permissive rules.": ["AuthorizeSecurityGroupIngress", "AuthorizeSecurityGroupEgress"],
    "This launched new compute resources.": ["RunInstances"],
    "This created a new IAM identity.": ["CreateUser", "CreateLoginProfile"],
    "This modified IAM permissions.": ["AttachUserPolicy", "AttachRolePolicy", "PutUserPolicy", "PutRolePolicy"],
}
GAP_SECONDS = 300


def lookup(values: dict[str, str], key: Column) -> Column:
    """A small table as a literal map; null for other keys."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def one_decimal(x: Column) -> Column:
    """A positive number with one decimal, correctly rounded, ties to even: what the number is in binary decides, not the
    shortest text for it. 20 x - (2 k + 1) tells on which side of the middle x lies, and is exact in this order."""
    k = F.floor(x * 10)
    side = (x * 16 - (2 * k + 1)) + x * 4
    tenths = k + F.when((side > 0) | ((side == 0) & (k % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def human_bytes(n: Column) -> Column:
    def unit(size: int, name: str) -> Column:
        return F.concat(one_decimal(n / F.lit(float(size))), F.lit(f" {name}"))

    return F.when(n >= 1_000_000_000, unit(1_000_000_000, "GB")).when(n >= 1_000_000, unit(1_000_000, "MB")).when(n >= 1_000, unit(1_000, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def narrative(p) -> Column:
    """Description by event class; ``p(name)`` gives a property as a text column, null where it is missing."""
    or_ = lambda name, text: F.coalesce(p(name), F.lit(text))
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    opt = lambda before, value, after="": F.coalesce(F.concat(F.lit(before), value, F.lit(after)), F.lit(""))
    full = F.nullif(p("api_service_name"), F.lit(""))
    login = said("User '", or_("actor_user_name", "unknown"), "' (", or_("actor_user_type", "unknown"), ") authenticated to ", or_("api_service_name", "AWS"), opt(" from ", p("src_endpoint_ip")), ". Status: ", or_("status", "unknown"), ".")
    call = said("User '", or_("actor_user_name", "unknown"), "' called ", opt("", full, ":"), or_("api_operation", "unknown"), opt(" targeting ", p("resource_id")), ".")
    b_in, b_out = (F.coalesce(p(n).cast("long"), F.lit(0)) for n in ("bytes_in", "bytes_out"))
    ports = opt(" on ", F.concat(or_("protocol_name", "TCP"), F.lit("/"), F.nullif(p("dst_port"), F.lit(""))))
    traffic = F.when((b_in > 0) | (b_out > 0), said(" — ", human_bytes(b_out), " outbound, ", human_bytes(b_in), " inbound")).otherwise("")
    flow = said(or_("src_endpoint_ip", "unknown"), " communicated with ", or_("dst_endpoint_ip", "unknown"), ports, traffic)
    dns = said("Internal host ", or_("src_endpoint_ip", "unknown host"), " resolved ", or_("query_hostname", "unknown domain"))
    parts = F.concat_ws(" | ", F.concat(F.lit("User: "), p("actor_user_name")), F.concat(F.lit("Operation: "), opt("", full, ":"), p("api_operation")), F.concat(F.lit("Source: "), p("src_endpoint_ip")), F.concat(F.lit("Status: "), p("status")))
    uid = p("class_uid").cast("int")
    text = F.when(uid == 3002, login).when(uid.isin(6003, 3001), call).when(uid == 4001, flow).when(uid == 4003, dns).otherwise(F.when(parts == "", "Security event observed.").otherwise(parts))
    context = lookup({op: sentence for sentence, ops in CONTEXT.items() for op in ops}, p("api_operation"))
    return F.concat(text, F.coalesce(F.concat(F.lit(" "), context), F.lit("")))


def node_description(nodes: DataFrame) -> Column:
    p = lambda k: F.col("properties")[k]
    kind = F.col("node_type")
    of = lambda t, c: F.when(kind == t, c)
    return F.concat_ws(
        " | ", of("Principal", F.concat(F.lit("Type: "), p("user_type"))), of("Principal", F.concat(F.lit("Account: "), p("account_id"))),
        of("IPAddress", F.when(p("is_internal") == "true", "Internal IP").when(p("is_internal") == "false", "External IP")),
        of("APIOperation", F.concat(F.lit("Success: "), p("success_count"))), of("APIOperation", F.concat(F.lit("Failures: "), p("failure_count"))),
        of("Resource", F.concat(F.lit("Type: "), p("resource_type"))), of("Resource", F.concat(F.lit("Region: "), p("region"))), of("SecurityFinding", F.concat(F.lit("Severity: "), p("severity"))),
        F.when(F.col("event_count") > 1, F.concat(F.lit("Event count: "), F.col("event_count"))),
    )


def node_events(nodes: DataFrame) -> DataFrame:
    p = lambda k: F.col("properties")[k]
    ts = F.coalesce("first_seen", "last_seen")
    alarm = F.when(F.lower(F.coalesce(p("severity"), F.lit(""))).isin("critical", "high"), "suspicious").otherwise("important")
    return nodes.where(ts.isNotNull()).select(
        "inv_id", F.concat(F.lit("node:"), F.col("id")).alias("id"), ts.alias("ts"), F.concat(F.coalesce(lookup(NODE_TITLES, F.col("node_type")), F.lit("Activity")), F.lit(": "), F.col("label")).alias("title"),
        F.when(p("class_uid").isNotNull(), narrative(p)).otherwise(node_description(nodes)).alias("description"), F.col("node_type").alias("entity_type"), F.col("id").alias("entity_id"),
        F.coalesce(p("api_operation"), F.lit("")).alias("operation"), F.when(F.col("node_type") == "SecurityFinding", alarm).otherwise("unreviewed").alias("tag"),
    )


def with_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the labels and types of both ends; an unknown end is called by its id."""
    for end in ("source", "target"):
        side = nodes.select("inv_id", F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label"), F.col("node_type").alias(f"{end}_type"))
        edges = edges.join(side, ["inv_id", f"{end}_id"], "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", f"{end}_id"))
    return edges


def told_edges(edges: DataFrame) -> DataFrame:
    return edges.where("edge_type <> 'TRIGGERED_BY' AND coalesce(first_seen, last_seen) IS NOT NULL")


#: Edges that are told as a flow between their labelled ends.
IS_FLOW = "bytes_in IS NOT NULL OR bytes_out IS NOT NULL"


def flow_text() -> Column:
    ports = F.array_join(F.transform("dst_ports", lambda x: x.cast("string")), ",")
    values = {"class_uid": F.lit("4001"), "src_endpoint_ip": F.col("source_label"), "dst_endpoint_ip": F.col("target_label"), "protocol_name": F.col("protocol"), "bytes_in": F.col("bytes_in"), "bytes_out": F.col("bytes_out"), "dst_port": ports}
    return narrative(lambda k: values[k].cast("string") if k in values else F.lit(None).cast("string"))


def times_text() -> Column:
    return F.when(F.col("event_count") > 1, F.concat(F.lit("Occurred "), F.col("event_count"), F.lit(" times"))).otherwise("")


def edge_events(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    e = with_labels(told_edges(edges), nodes)
    text = F.when(F.expr(IS_FLOW), flow_text()).otherwise(times_text())
    return e.select(
        "inv_id", F.concat(F.lit("edge:"), F.col("id")).alias("id"), F.coalesce("first_seen", "last_seen").alias("ts"), F.concat(F.col("edge_type"), F.lit(": "), F.col("source_label"), F.lit(" -> "), F.col("target_label")).alias("title"),
        text.alias("description"), F.lit("relationship").alias("entity_type"), F.col("id").alias("entity_id"), F.col("edge_type").alias("operation"), F.lit("unreviewed").alias("tag"),
    )


def edge_descriptions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(inv_id, id, description) of edge_events(): only flows tell labels, so only they look them up. ``nodes``: those of
    flows' ends at least."""
    e = told_edges(edges)
    told = lambda rows, text: rows.select("inv_id", F.concat(F.lit("edge:"), F.col("id")).alias("id"), text.alias("description"))
    return told(with_labels(e.where(IS_FLOW), nodes), flow_text()).unionByName(told(e.where(f"NOT ({IS_FLOW})"), times_text()))


def extract(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return node_events(nodes).unionByName(edge_events(edges, nodes))


def moments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """extract() without what is told of an event: no labels are looked up."""
    kept = ["inv_id", "id", "ts", "entity_id", "operation", "tag"]
    e = edges.where("edge_type <> 'TRIGGERED_BY' AND coalesce(first_seen, last_seen) IS NOT NULL")
    e = e.select("inv_id", F.concat(F.lit("edge:"), F.col("id")).alias("id"), F.coalesce("first_seen", "last_seen").alias("ts"), F.col("id").alias("entity_id"), F.col("edge_type").alias("operation"), F.lit("unreviewed").alias("tag"))
    return node_events(nodes).select(*kept).unionByName(e)


def with_clusters(timeline: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Each event with the number of its cluster: a new one begins after a gap of more than ``gap`` whole seconds."""
    return chained(timeline, ["inv_id"], [F.col("ts"), F.col("id")], "ts", gap, "cluster", "gap_seconds")


def clusters(timeline: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """One row a cluster: start, end, events, dominant entity (ties: first by name), seconds since the cluster before."""
    rows = with_clusters(timeline, gap)
    sizes = rows.groupBy("inv_id", "cluster", "entity_id").agg(F.count("*").alias("n"))
    top = sizes.groupBy("inv_id", "cluster").agg(F.min_by("entity_id", F.struct(-F.col("n"), F.col("entity_id"))).alias("dominant"))
    # the one longer gap of a cluster is the one it began with
    began = F.max(F.when(F.col("gap_seconds") > gap, F.col("gap_seconds"))).alias("gap_seconds")
    return rows.groupBy("inv_id", "cluster").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("events"), began).join(top, ["inv_id", "cluster"])


def spans(moments: DataFrame, *by: str, gap: int = GAP_SECONDS) -> DataFrame:
    """(by..., slot, n, first, last): moments (by..., ts) counted in slots of time in which no gap ends a cluster."""
    us = F.unix_micros("ts")
    slot = us - F.pmod(us, F.lit((gap + 1) * 1_000_000))
    return moments.groupBy(*by, slot.alias("slot")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def cluster_counts(slots: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """(inv_id, n): the number of clusters that with_clusters() finds, from spans(): only gaps between slots can end one,
    and an investigation has one row in five minutes at most, whatever it holds."""
    rows = slots.where("slot IS NOT NULL").groupBy("inv_id", "slot").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    before = F.lag("last").over(Window.partitionBy("inv_id").orderBy("slot"))
    begins = F.floor((F.unix_micros("first") - F.unix_micros(before)) / 1_000_000) > gap
    return rows.select("inv_id", F.coalesce(begins, F.lit(False)).alias("begins")).groupBy("inv_id").agg((F.count_if("begins") + 1).alias("n"))


def in_order(timeline: DataFrame) -> DataFrame:
    """Each event with its place in its investigation's chronological order."""
    return placed(timeline, ["inv_id"], [F.col("ts"), F.col("id")])


def tagged(timeline: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags and notes of analysts (inv_id, id, tag, notes) over the automatic ones."""
    new = tags.select("inv_id", "id", F.col("tag").alias("new_tag"), "notes")
    return timeline.join(new, ["inv_id", "id"], "left").withColumn("tag", F.coalesce("new_tag", "tag")).withColumn("notes", F.coalesce("notes", F.lit(""))).drop("new_tag")


def suspicious(timeline: DataFrame) -> DataFrame:
    return timeline.where(F.col("tag").isin(SUSPICIOUS))


def summary(timeline: DataFrame) -> DataFrame:
    rows = timeline.groupBy("inv_id").agg(F.count("*").alias("total"), F.count_if(F.col("tag") == "unreviewed").alias("unreviewed"), F.count_if(F.col("tag").isin(SUSPICIOUS)).alias("suspicious"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return rows.withColumn("duration_seconds", F.floor((F.unix_micros("last") - F.unix_micros("first")) / 1_000_000))
