"""Entity graphs as node and edge tables, many investigations at once (GRF1 to GRF19).

Every event contributes nodes and edges, one for each role it plays; contributions are exploded once and merged by one
aggregation each. Partial aggregation in the tasks keeps a busy principal or address from sending many rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field, first_text, objects
from ..functions.predicates import is_private
from . import masks
from .lineage import cut
from .skew import MOST_SENT, hot_of, split_join

SUCCESS = ("success", "succeeded", "ok")
#: Stands for the finding of an investigation in rows of several; every other id is longer than its kind.
FINDING = "Finding:"


def short(c: Column) -> Column:
    return F.when(F.char_length(c) > 30, F.concat(F.substring(c, 1, 30), F.lit("..."))).otherwise(c)


def resource_parts(uid: Column, kind: Column) -> Column:
    """id, label and type of a resource: an ARN's last part is cut at its first slash, others keep their type."""
    parts = F.split(uid, ":", 6)
    last = F.get(parts, 5)
    slash = F.instr(last, "/")
    arn = uid.startswith("arn:") & (F.size(parts) == 6)
    rtype = F.when(arn, F.when(slash > 0, F.substring_index(last, "/", 1)).otherwise(F.get(parts, 2))).otherwise(F.coalesce(kind, F.lit("unknown")))
    name = F.when(arn, F.when(slash > 0, F.substr(last, slash + 1)).otherwise(last)).otherwise(uid)
    valid = arn | ~uid.startswith("arn:")
    return F.when(valid & (uid != ""), F.struct(F.concat(F.lit("Resource:"), rtype, F.lit(":"), name).alias("id"), short(name).alias("label"), rtype.alias("type")))


def event_leaves(rows: DataFrame, *keep: str) -> DataFrame:
    """The fields of events that graphs are made of, and the columns ``keep``. rows: events with inv_id, finding_id, is_match."""
    user = first_text(rows, "actor.user.name", "user_name", "actor.user.uid_alt", "actor.session.uid")
    account = first_text(rows, "actor.user.account_uid", "cloud.account.uid", "accountid")
    service = F.regexp_replace(first_text(rows, "api.service.name", "service"), r"\.amazonaws\.com$", "")
    operation = first_text(rows, "api.operation", "operation")
    src, dst, host = first_text(rows, "src_endpoint.ip"), first_text(rows, "dst_endpoint.ip"), first_text(rows, "query.hostname")
    status = F.coalesce(field(rows, "status"), F.lit("unknown"))
    resources = F.filter(F.transform(objects(rows, "resources"), lambda r: resource_parts(r["uid"], r["type"])), lambda x: x.isNotNull())
    return rows.select(
        *keep, "inv_id", "finding_id", "is_match", "event_uid", F.col("time_dt").alias("ts"), "class_uid", "class_name",
        F.when(user.isNotNull(), F.concat(F.lit("Principal:"), F.coalesce(F.concat(account, F.lit(":")), F.lit("")), user)).alias("principal_id"),
        user.alias("user"), field(rows, "actor.user.type").alias("user_type"), account.alias("account"), src.alias("src_ip"), dst.alias("dst_ip"),
        F.when(operation.isNotNull() & service.isNotNull(), F.concat(F.lit("APIOperation:"), service, F.lit(":"), operation)).alias("api_id"),
        F.concat(service, F.lit(":"), operation).alias("api_label"), operation.alias("operation"), field(rows, "api.service.name").alias("service"), field(rows, "status").alias("status"),
        resources.alias("resources"), F.get(objects(rows, "resources"), 0)["uid"].alias("resource_uid"), host.alias("host"), field(rows, "dst_endpoint.port").alias("port"),
        field(rows, "connection_info.protocol_name").alias("protocol"), field(rows, "traffic.bytes_in").alias("bytes_in"), field(rows, "traffic.bytes_out").alias("bytes_out"), field(rows, "cloud.region").alias("region"),
        F.concat_ws(":", F.lit("Event"), F.col("class_uid"), F.coalesce(operation, F.lit("")), status, F.coalesce(src, F.lit(""))).alias("event_id"),
        F.when(operation.isNull(), F.col("class_name")).when(status == "unknown", operation).otherwise(F.concat(operation, F.lit(" ("), status, F.lit(")"))).alias("event_label"),
    )


def _props(**values: Column) -> Column:
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def node_contributions(leaves: DataFrame, events: bool = True, told: bool = True) -> DataFrame:
    """``told``: with properties, which are null otherwise."""
    c = F.col
    props = _props if told else lambda **_: F.lit(None).cast("map<string,string>")

    def node(kind: str, id_: Column, label: Column, props: Column) -> Column:
        return F.struct(id_.alias("id"), F.lit(kind).alias("node_type"), label.alias("label"), props.alias("properties"))

    def address(ip: Column) -> Column:
        return node("IPAddress", F.concat(F.lit("IPAddress:"), ip), ip, props(is_internal=is_private(ip)))

    flat = props(
        class_uid=c("class_uid"), actor_user_name=c("user"), actor_user_type=c("user_type"), api_operation=c("operation"), api_service_name=c("service"), src_endpoint_ip=c("src_ip"),
        dst_endpoint_ip=c("dst_ip"), bytes_in=c("bytes_in"), bytes_out=c("bytes_out"), status=c("status"), query_hostname=c("host"), resource_id=c("resource_uid"), protocol_name=c("protocol"),
    )
    same = c("src_ip") == c("dst_ip")
    single = [
        node("Principal", c("principal_id"), c("user"), props(user_type=c("user_type"), account_id=c("account"))), address(c("src_ip")),
        address(F.when(~c("is_match") & ~F.coalesce(same, F.lit(False)), c("dst_ip"))), node("APIOperation", c("api_id"), c("api_label"), props(last_status=c("status"))),
        node("Resource", F.when(~c("is_match") & (c("class_uid") == 4003), F.concat(F.lit("Resource:domain:"), c("host"))), c("host"), props(resource_type=F.lit("domain"))),
    ]
    if events:
        single.append(node("Event", c("event_id"), c("event_label"), flat))
    listed = F.transform("resources", lambda r: node("Resource", r["id"], r["label"], F.map_from_entries(F.array(F.struct(F.lit("resource_type"), r["type"]))) if told else props()))
    rows = leaves.select("inv_id", "ts", "event_uid", F.explode(F.concat(F.array(*single), listed)).alias("n"))
    return rows.select("inv_id", "ts", "event_uid", "n.*").where("id IS NOT NULL")


def finding_nodes(results: DataFrame) -> DataFrame:
    """results: inv_id, finding_id, name, severity, mitre, tags, executed_at, match_count."""
    props = _props(severity=F.col("severity"), mitre_attack=F.array_join("mitre", ","), tags=F.array_join("tags", ","))
    return results.select("inv_id", F.col("finding_id").alias("id"), F.lit("SecurityFinding").alias("node_type"), F.col("name").alias("label"), props.alias("properties"), F.col("executed_at").alias("first_seen"), F.col("executed_at").alias("last_seen"), F.col("match_count").alias("event_count"))


def finding_id(rule: Column, at: Column) -> Column:
    return F.concat(F.lit("Finding:"), rule, F.lit(":"), F.date_format(at, "yyyyMMddHHmmss"))


def merge_nodes(contributions: DataFrame) -> DataFrame:
    """Earliest contribution gives label and properties; times widen, counts add."""
    return _merged_nodes(_node_parts(contributions)).drop("event_uid")


def _node_parts(contributions: DataFrame) -> DataFrame:
    return contributions.select("inv_id", "id", "node_type", "label", "properties", "event_uid", F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.lit(1).cast("long").alias("event_count"))


def _merged_nodes(parts: DataFrame) -> DataFrame:
    """Parts of nodes merged; the result is made of parts again."""
    rows = parts.groupBy("inv_id", "id").agg(
        F.min("node_type").alias("node_type"), F.min_by(F.struct("label", "properties", "event_uid"), F.struct("first_seen", "event_uid")).alias("__first"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("event_count").alias("event_count"),
    )
    return rows.select("inv_id", "id", "node_type", "__first.label", "__first.properties", "first_seen", "last_seen", "event_count", "__first.event_uid")


def edge_contributions(leaves: DataFrame, events: bool = True, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``kinds``: only edges of these types are made."""
    c = F.col
    wanted = lambda kind, made: [made] if kinds is None or kind in kinds else []
    ip = lambda x: F.concat(F.lit("IPAddress:"), x)
    src, dst, flow, dns = ip(c("src_ip")), ip(c("dst_ip")), c("class_uid") == 4001, c("class_uid") == 4003
    long, text = F.lit(None).cast("long"), F.lit(None).cast("string")

    def edge(kind: str, a: Column, b: Column, when: Column | None = None, of_flow: bool = False) -> Column:
        ok = F.lit(True) if when is None else when
        return F.struct(
            F.lit(kind).alias("edge_type"), F.when(ok, a).alias("source_id"), F.when(ok, b).alias("target_id"), (c("port") if of_flow else F.lit(None).cast("int")).alias("port"), (c("protocol") if of_flow else text).alias("protocol"),
            (c("bytes_in") if of_flow else long).alias("bytes_in"), (c("bytes_out") if of_flow else long).alias("bytes_out"),
        )

    match = c("is_match")
    apart = ~match & (c("src_ip") != c("dst_ip"))
    single = [
        ("RELATED_TO", c("principal_id"), c("finding_id"), match), ("AUTHENTICATED_FROM", c("principal_id"), src), ("CALLED_API", c("principal_id"), c("api_id")),
        ("COMMUNICATED_WITH", src, dst, apart & flow, True), ("RESOLVED_TO", src, F.concat(F.lit("Resource:domain:"), c("host")), ~match & dns), ("RELATED_TO", src, dst, apart & ~flow & ~dns),
    ]
    if events:
        single += [("TRIGGERED_BY", c("finding_id"), c("event_id"), match), ("ORIGINATED_FROM", c("event_id"), src)]
    access = wanted("ACCESSED_RESOURCE", F.transform("resources", lambda r: edge("ACCESSED_RESOURCE", c("api_id"), r["id"])))
    related = wanted("RELATED_TO", F.transform("resources", lambda r: edge("RELATED_TO", r["id"], c("finding_id"), match)))
    made = [edge(*x) for x in single if kinds is None or x[0] in kinds]
    rows = leaves.select("inv_id", "ts", "event_uid", F.explode(F.concat(*([F.array(*made)] if made else []), *access, *related)).alias("e"))
    return rows.select("inv_id", "ts", "event_uid", "e.*").where("source_id IS NOT NULL AND target_id IS NOT NULL")


def merge_edges(contributions: DataFrame) -> DataFrame:
    """One row an edge: counts and bytes add, ports collect, weight is log2 of all bytes where there are any."""
    rows = contributions.groupBy("inv_id", "edge_type", "source_id", "target_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("event_count"), F.array_sort(F.collect_set("port")).alias("dst_ports"),
        F.min_by("protocol", F.struct("ts", "event_uid")).alias("protocol"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"),
    )
    return with_id(rows)


def edge_id() -> Column:
    return F.concat(F.col("edge_type"), F.lit(":"), F.col("source_id"), F.lit("->"), F.col("target_id"))


def with_id(rows: DataFrame) -> DataFrame:
    total = F.coalesce("bytes_in", F.lit(0)) + F.coalesce("bytes_out", F.lit(0))
    return rows.withColumn("id", edge_id()).withColumn("weight", F.when(total > 0, F.log2(total.cast("double"))).otherwise(F.lit(1.0)))


def build(rows: DataFrame, results: DataFrame, events: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of events (with inv_id, finding_id, is_match) and their findings."""
    return from_leaves(event_leaves(rows), results, events)


def from_leaves(leaves: DataFrame, results: DataFrame, events: bool = True) -> tuple[DataFrame, DataFrame]:
    """The same of event_leaves(), which both sides read: keep it, so that they read the events once."""
    nodes = merge_nodes(node_contributions(leaves, events)).unionByName(finding_nodes(results))
    return nodes, merge_edges(edge_contributions(leaves, events))


def named(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row for each investigation of the array in ``inv_id``, places in ``names``, with its name."""
    return masks.named(rows.withColumn("inv_id", F.explode("inv_id")), names)


def from_sets(leaves: DataFrame, results: DataFrame, names: list[str], finding: Column, events: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of event_leaves() in which ``inv_id`` is an array: the places in ``names`` of all investigations
    that have the row. ``finding_id`` is FINDING there, and becomes ``finding``, an expression over the inv_id.

    An element is merged for each set of investigations first, and the few rows that are left of it are then brought
    together by the element alone, so that dealing them out to the investigations needs no shuffle.
    """

    def dealt(rows: DataFrame, *key: str) -> DataFrame:
        return named(rows.repartition(*key) if key else rows, names)

    nodes = _merged_nodes(dealt(_merged_nodes(_node_parts(node_contributions(leaves, events))), "id")).drop("event_uid")
    key = ["inv_id", "edge_type", "source_id", "target_id"]

    def merged(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("event_count").alias("event_count"))

    # all but flows have counts and times alone, which hash tables hold in place
    flow = F.col("edge_type") == "COMMUNICATED_WITH"
    parts = edge_contributions(leaves, events).where(~flow).select(*key, F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.lit(1).cast("long").alias("event_count"))
    plain = merged(dealt(merged(parts), *key[1:]))
    for end in ("source_id", "target_id"):
        plain = plain.withColumn(end, F.when(F.col(end) == FINDING, finding).otherwise(F.col(end)))
    flows = merge_edges(dealt(edge_contributions(leaves.where("class_uid = 4001 AND NOT is_match"), events).where(flow)))
    none = {c: F.lit(None).cast(flows.schema[c].dataType) for c in ("protocol", "bytes_in", "bytes_out")}
    plain = with_id(plain.withColumns({"dst_ports": F.array().cast(flows.schema["dst_ports"].dataType), **none}))
    return nodes.unionByName(finding_nodes(results)), plain.select(flows.columns).unionByName(flows)


def element_sets(leaves: DataFrame, names: list[str], events: bool = True) -> DataFrame:
    """(inv_id, kind, source, target, first_seen): every node (kind ``node``, no target) and edge (its type) but findings,
    once for each time at which investigations first have it, with the set (masks) of those.

    leaves as in from_sets(). The rows' sets are disjoint for an element, so counts over them are those of its investigations.
    """
    leaves, key = masks.masked(leaves, names), ["kind", "source", "target"]
    nodes = node_contributions(leaves, events, told=False).select("inv_id", F.lit("node").alias("kind"), F.col("id").alias("source"), F.lit("").alias("target"), "ts")
    edges = edge_contributions(leaves, events).select("inv_id", F.col("edge_type").alias("kind"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), "ts")
    rows = nodes.unionByName(edges).groupBy("inv_id", *key).agg(F.min("ts").alias("first_seen"))
    return masks.fresh(rows, names, key, [F.col("first_seen").asc_nulls_last()])


def edge_sets(leaves: DataFrame, names: list[str], parts: int) -> DataFrame:
    """(inv_id, edge_type, source_id, target_id, first_seen, last_seen, event_count, bytes_in, bytes_out): every edge of
    from_sets() once for all investigations (masks) in which these values are the same. The sets of an edge are disjoint.

    What an edge is made of comes together by the edge alone, in so many ``parts``. Of one or two sets the edges follow at
    once; more are dealt out, merged and put together again by values, all in the same task.
    """
    key, values = ["edge_type", "source_id", "target_id"], ["first_seen", "last_seen", "event_count", "bytes_in", "bytes_out"]
    c = F.col

    def merged(rows: DataFrame, *by: str, **more: Column) -> DataFrame:
        told = [F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")] + [F.sum(v).alias(v) for v in values[2:]]
        return rows.groupBy(*by).agg(*told, *[x.alias(name) for name, x in more.items()])

    rows = edge_contributions(masks.masked(leaves, names))
    rows = rows.select("inv_id", *key, c("ts").alias("first_seen"), c("ts").alias("last_seen"), F.lit(1).cast("long").alias("event_count"), "bytes_in", "bytes_out")
    rows = merged(rows, "inv_id", *key).repartition(parts, *key).groupBy(*key).agg(F.collect_list(F.struct("inv_id", *values)).alias("sets"))
    rows = rows.select(*key, F.size("sets").alias("n"), "sets", F.get("sets", 0).alias("a"), F.get("sets", 1).alias("b"))
    either = lambda v: F.coalesce(c(f"a.{v}") + c(f"b.{v}"), c(f"a.{v}"), c(f"b.{v}"))
    both = F.struct(masks.common(names, "a.inv_id", "b.inv_id").alias("inv_id"), F.least("a.first_seen", "b.first_seen").alias("first_seen"), F.greatest("a.last_seen", "b.last_seen").alias("last_seen"), *[either(v).alias(v) for v in values[2:]])
    alone = [F.struct(masks.without(names, f"{x}.inv_id", f"{y}.inv_id").alias("inv_id"), *[c(f"{x}.{v}").alias(v) for v in values]) for x, y in ("ab", "ba")]
    rows = rows.select(*key, "n", F.posexplode(F.when(c("n") == 2, F.array(*alone, both)).otherwise(c("sets"))).alias("at", "set")).select(*key, "n", "at", "set.*").where(masks.some(names))
    # places from 0; below are sets that are told already
    rows = rows.withColumn("place", F.explode(F.expr(f"CASE WHEN n <= 2 THEN array(-1 - at) ELSE {masks.places(names)} END")))
    rows = merged(rows, *key, "place", inv_id=masks.union(names))
    one = [F.expr(f"CASE WHEN place < 0 THEN inv_id.{w} WHEN place div {masks.WORD} = {k} THEN shiftleft(1L, place % {masks.WORD}) ELSE 0L END").alias(w) for k, w in enumerate(masks.words(names))]
    return rows.withColumn("inv_id", F.struct(*one)).groupBy(*key, *values).agg(masks.union(names)).select("inv_id", *key, *values)


def meeting(edges: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame, DataFrame, str], DataFrame]]:
    """The ends of a written table of edge sets (end, node, inv_id, count), and how its rows meet what is known of nodes."""
    ends = F.array(*[F.struct(F.lit(e).alias("end"), F.col(f"{e}_id").alias("node")) for e in ("source", "target")])
    ends = cut(edges.select("inv_id", F.explode(ends).alias("e")).select("inv_id", "e.*").groupBy("end", "node").agg(masks.union(names), F.count("*").alias("count")))
    hubs = {e: hot_of(ends.where(F.col("end") == e).select(F.col("node").alias(f"{e}_id"), "count"), [f"{e}_id"]) for e in ("source", "target")}

    def met(rows: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
        """``rows`` with the columns of ``nodes`` (node, inv_id, ...), named after the end, in the investigations of both. Few
        nodes are sent to all tasks; for more, rows of hubs are cut into pieces."""
        key, other = f"{end}_id", "target_id" if end == "source" else "source_id"
        few = nodes.join(ends.where(F.col("end") == end).select("node"), "node", "left_semi")
        few = cut(few.select(F.col("node").alias(key), F.col("inv_id").alias("__few"), *[F.col(c).alias(f"{end}_{c}") for c in nodes.columns if c not in ("node", "inv_id")]))
        rows = rows.join(F.broadcast(few), key) if few.count() <= MOST_SENT else split_join(rows, few, [key], F.col(other), hubs[end])
        return rows.withColumn("inv_id", masks.common(names, "inv_id", "__few")).drop("__few").where(masks.some(names))

    return ends, met


def label_sets(leaves: DataFrame, names: list[str], kind: str | None = None) -> DataFrame:
    """(id, node_type, label, inv_id): labels of nodes but events and findings with the set (masks) of the investigations in
    which it is the node's: that of the earliest contribution there. leaves as in from_sets(); ``kind``: of that type alone."""
    key = ["id", "node_type"]
    rows = node_contributions(masks.masked(leaves, names), events=False, told=False)
    rows = rows.where(F.col("node_type") == kind) if kind else rows
    labels = cut(rows.groupBy(*key, "label").agg(masks.union(names)))
    # only where an id has several labels do times tell whose they are
    several = cut(labels.groupBy(*key).count().where("count > 1").select(*key))
    if several.isEmpty():
        return labels
    parts = rows.join(several, key).groupBy("inv_id", *key, "label").agg(F.min(F.struct("ts", "event_uid")).alias("first"))
    told = masks.fresh(parts, names, key, [F.col("first")]).groupBy(*key, "label").agg(masks.union(names))
    return labels.join(several, key, "left_anti").unionByName(told.select(labels.columns))


def both_ways(edges: DataFrame) -> DataFrame:
    """(inv_id, node, other, edge_id, direction): every edge from both of its ends."""
    out = edges.select("inv_id", F.col("source_id").alias("node"), F.col("target_id").alias("other"), F.col("id").alias("edge_id"), F.lit("out").alias("direction"))
    back = edges.select("inv_id", F.col("target_id").alias("node"), F.col("source_id").alias("other"), F.col("id").alias("edge_id"), F.lit("in").alias("direction"))
    return out.unionByName(back)


def neighbours(edges: DataFrame, of: DataFrame, direction: str = "both") -> DataFrame:
    """Neighbours and incident edges of nodes (inv_id, node)."""
    rows = both_ways(edges)
    rows = rows if direction == "both" else rows.where(F.col("direction") == direction)
    return rows.join(of, ["inv_id", "node"])


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(inv_id, part, type, n): counts of nodes and edges by type."""
    return nodes.groupBy("inv_id", F.lit("node").alias("part"), F.col("node_type").alias("type")).agg(F.count("*").alias("n")).unionByName(edges.groupBy("inv_id", F.lit("edge").alias("part"), F.col("edge_type").alias("type")).agg(F.count("*").alias("n")))


def without_events(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without Event nodes and the edges that touch them."""
    gone = nodes.where("node_type = 'Event'").select("inv_id", F.col("id").alias("gone"))
    for end in ("source_id", "target_id"):
        edges = edges.join(gone, (edges["inv_id"] == gone["inv_id"]) & (edges[end] == gone["gone"]), "left_anti")
    return nodes.where("node_type <> 'Event'"), edges


def parse_time(text: Column) -> Column:
    """ISO with zone, ``YYYY-MM-DD HH:MM:SS.f`` or epoch seconds; null otherwise."""
    seconds = F.when(text.rlike(r"^[0-9]{9,11}$"), F.timestamp_seconds(F.when(text.rlike(r"^[0-9]{9,11}$"), text).cast("long")))
    return F.coalesce(seconds, F.try_to_timestamp(text))


def api_status(leaves: DataFrame) -> DataFrame:
    """Successes and failures of each operation."""
    ok = F.lower("status").isin(*SUCCESS)
    return leaves.where("api_id IS NOT NULL AND status IS NOT NULL").groupBy("inv_id", "api_id").agg(F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("failure_count"))


def elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Export: one row for each node and edge, with its data as JSON."""
    n = nodes.select("inv_id", F.lit("nodes").alias("group"), "id", F.col("node_type").alias("type"), F.to_json(F.struct("id", "label", "event_count", "properties")).alias("data"))
    e = edges.select("inv_id", F.lit("edges").alias("group"), "id", F.col("edge_type").alias("type"), F.to_json(F.struct("id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "event_count")).alias("data"))
    return n.unionByName(e)
