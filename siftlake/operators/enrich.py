"""Identifiers and enrichment joins (ENR1 to ENR21).

Lookups take an identifier table (inv_id, value) and give the events that carry one of its values, each event once for
an investigation. Sides are broadcast by Spark where statistics allow; nothing here forces it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import field, first_text, objects
from ..functions.predicates import is_arn, is_ipv4
from .lineage import cut
from .skew import hot_keys, split_join

USER_CLASSES = (6003, 3002, 3001)
#: Identifiers that are sent to all tasks at most (about 100 bytes each).
MOST_SENT = 200_000


def identifiers(matches: DataFrame, inv: str = "inv_id") -> DataFrame:
    """(inv_id, kind, value): users, source and destination addresses, operations, services, resources and domains."""
    single = {
        "user": first_text(matches, "actor.user.name", "user_name", "actor.user.uid_alt"), "src_ip": first_text(matches, "src_endpoint.ip"), "dst_ip": first_text(matches, "dst_endpoint.ip"),
        "operation": first_text(matches, "api.operation"), "service": first_text(matches, "api.service.name"), "domain": first_text(matches, "query.hostname"),
    }
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in single.items()])
    listed = F.transform(objects(matches, "resources"), lambda r: F.struct(F.lit("resource").alias("kind"), r["uid"].alias("value")))
    rows = matches.select(F.col(inv).alias("inv_id"), F.explode(F.concat(kinds, listed)).alias("x"))
    return rows.select("inv_id", "x.kind", "x.value").where("value IS NOT NULL AND value <> ''").distinct()


def of_kind(ids: DataFrame, *kinds: str) -> DataFrame:
    return ids.where(F.col("kind").isin(*kinds)).select("inv_id", "value").distinct()


def once(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates(["inv_id", "event_uid"])


def capped(rows: DataFrame, limit: int | None, *by: str) -> DataFrame:
    """The first ``limit`` rows of each group in time order; all of them without a limit."""
    if limit is None:
        return rows
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("time_dt", "event_uid"))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")


def _lookup(events: DataFrame, ids: DataFrame, key: Column, where: Column, limit: int | None = None) -> DataFrame:
    rows = events.where(where & key.isNotNull()).withColumn("value", key).join(ids, "value")
    return once(capped(rows, limit, "inv_id", "value", "class_uid")).drop("value")


def by_user(events: DataFrame, ids: DataFrame, classes: tuple[int, ...] = USER_CLASSES, limit: int | None = None) -> DataFrame:
    return _lookup(events, ids, field(events, "actor.user.name"), F.col("class_uid").isin(*classes), limit)


def by_ip(events: DataFrame, ids: DataFrame, direction: str = "both", limit: int | None = None) -> DataFrame:
    """Flows by source or destination, calls and logins by source. Two equality joins, not one with OR."""
    ids = ids.where(is_ipv4(F.col("value")))
    flow = F.col("class_uid") == 4001
    src, dst = field(events, "src_endpoint.ip"), field(events, "dst_endpoint.ip")
    source = (F.col("class_uid") == 3002) | ((flow | (F.col("class_uid") == 6003)) if direction in ("source", "both") else F.lit(False))
    rows = _lookup(events, ids, src, source, limit)
    return once(rows.unionByName(_lookup(events, ids, dst, flow, limit))) if direction in ("dest", "both") else rows


def by_service(events: DataFrame, ids: DataFrame, operations: list[str] | None = None, limit: int | None = None) -> DataFrame:
    where = F.col("class_uid") == 6003
    return _lookup(events, ids, field(events, "api.service.name"), where if not operations else where & field(events, "api.operation").isin(operations), limit)


def by_operation(events: DataFrame, ids: DataFrame, service: str | None = None, limit: int | None = None) -> DataFrame:
    where = F.col("class_uid") == 6003
    return _lookup(events, ids, field(events, "api.operation"), where if service is None else where & (field(events, "api.service.name") == service), limit)


def authentication_chain(events: DataFrame, user: str) -> DataFrame:
    return events.where((F.col("class_uid") == 3002) & (field(events, "actor.user.name") == user)).orderBy("time_dt", "event_uid")


def by_resource(events: DataFrame, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """Calls on a resource: resources exploded once, joined by equality, each event once."""
    rows = events.where(F.col("class_uid") == 6003).withColumn("value", F.explode(F.array_distinct(F.transform(objects(events, "resources"), lambda r: r["uid"]))))
    return once(capped(rows.join(ids.where(is_arn(F.col("value"))), "value"), limit, "inv_id", "value")).drop("value")


def by_domain(events: DataFrame, ids: DataFrame, limit: int | None = None) -> DataFrame:
    return _lookup(events, ids.where("value <> ''"), field(events, "query.hostname"), F.col("class_uid") == 4003, limit)


def related_principals(events: DataFrame, ips: DataFrame) -> DataFrame:
    """(inv_id, value, user): who logged in or called from an address."""
    user, src = field(events, "actor.user.name"), field(events, "src_endpoint.ip")
    rows = events.where(F.col("class_uid").isin(3002, 6003) & user.isNotNull()).select(src.alias("value"), user.alias("user")).distinct()
    return rows.join(ips.where(is_ipv4(F.col("value"))), "value").select("inv_id", "value", "user").distinct()


def lateral_movement(events: DataFrame, seeds: DataFrame, most_resources: int | None = None) -> DataFrame:
    """Three hops from seed addresses: seed_ip, users, services, resources, other_users (sorted, comma-joined).

    Address -> users (logins and calls); users -> services and resources (calls); the resources, or the first
    ``most_resources`` by name -> other users who called on them, without the users of the first hop.
    """
    user, src = field(events, "actor.user.name"), field(events, "src_endpoint.ip")
    # who did what from where, once: small next to the events, and all that the hops read
    done = cut(events.where(F.col("class_uid").isin(3002, 6003) & user.isNotNull()).select("class_uid", src.alias("src"), user.alias("user"), field(events, "api.service.name").alias("service"), F.explode_outer(F.transform(objects(events, "resources"), lambda r: r["uid"])).alias("arn")).distinct())
    hop1 = cut(done.select(F.col("src").alias("seed_ip"), "user").distinct().join(seeds.where(is_ipv4(F.col("seed_ip"))).distinct(), "seed_ip"))
    calls = done.where("class_uid = 6003").select("user", "service", "arn").distinct()
    hop2 = cut(hop1.join(calls, "user").select("seed_ip", "service", "arn").distinct())
    order = F.row_number().over(Window.partitionBy("seed_ip").orderBy("arn"))
    arns = hop2.where(is_arn(F.col("arn"))).select("seed_ip", "arn").distinct()
    if most_resources is not None:
        arns = arns.withColumn("k", order).where(F.col("k") <= most_resources).drop("k")
    others = arns.join(calls.select("arn", "user").distinct(), "arn").select("seed_ip", "user").distinct().join(hop1, ["seed_ip", "user"], "left_anti")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = hop1.groupBy("seed_ip").agg(joined("user").alias("users"))
    out = out.join(hop2.groupBy("seed_ip").agg(joined("service").alias("services"), joined("arn").alias("resources")), "seed_ip", "left")
    return out.join(others.groupBy("seed_ip").agg(joined("user").alias("other_users")), "seed_ip", "left").na.fill("")


def enrich_all(events: DataFrame, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """All four kinds of identifiers in one job, each event once for an investigation.

    Without a limit: identifiers of up to MOST_SENT are sent to all tasks, which look up in one read of the events those
    that carry any; only what is found is shuffled, to be made distinct. More identifiers are joined with the events'
    keys alone, those of busy values in pieces, and a second read brings in the events.
    """
    if limit is None:
        asked = cut(wanted(ids))
        if asked.count() <= MOST_SENT:
            return once(keyed(events, "*").join(F.broadcast(asked), ["kind", "value"]).drop("kind", "value"))
        rows = cut(keyed(events, "event_uid"))
        found = split_join(rows, asked, ["kind", "value"], F.col("event_uid"), hot_keys(rows, ["kind", "value"]))
        return found.select("inv_id", "event_uid").distinct().join(events, "event_uid")
    parts = [by_user(events, of_kind(ids, "user"), limit=limit), by_ip(events, of_kind(ids, "src_ip", "dst_ip"), limit=limit), by_resource(events, of_kind(ids, "resource"), limit), by_domain(events, of_kind(ids, "domain"), limit)]
    return once(reduce(lambda a, b: a.unionByName(b), parts))


def enriched_sets(events: DataFrame, ids: DataFrame, found: str) -> DataFrame:
    """``events`` with ``found``: the sorted array of the investigations whose identifiers the event carries, or null.

    ids: (inv_id, kind, value). Identifiers come together by value first, so one row of each meets the events. Events
    should be dealt by event_uid, by which they are read, looked up and put together again without another shuffle.
    """
    asked = cut(wanted(ids).groupBy("kind", "value").agg(F.collect_set("inv_id").alias("__invs")))
    rows = keyed(events, "event_uid")
    if asked.count() <= MOST_SENT:
        rows = rows.join(F.broadcast(asked), ["kind", "value"])
    else:
        rows = cut(rows)
        rows = split_join(rows, asked, ["kind", "value"], F.col("event_uid"), hot_keys(rows, ["kind", "value"]))
    sets = rows.groupBy("event_uid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__invs")))).alias(found))
    return events.join(sets, "event_uid", "left")


def keyed(events: DataFrame, *columns: str) -> DataFrame:
    """``columns`` with (kind, value): the identifiers by which enrichment finds an event, by the event's class."""
    of = F.col("class_uid")
    single = [
        F.when(of.isin(*USER_CLASSES), F.struct(F.lit("user").alias("kind"), field(events, "actor.user.name").alias("value"))),
        F.when(of.isin(4001, 6003, 3002), F.struct(F.lit("ip").alias("kind"), field(events, "src_endpoint.ip").alias("value"))),
        F.when(of == 4001, F.struct(F.lit("ip").alias("kind"), field(events, "dst_endpoint.ip").alias("value"))),
        F.when(of == 4003, F.struct(F.lit("domain").alias("kind"), field(events, "query.hostname").alias("value"))),
    ]
    listed = F.when(of == 6003, F.transform(objects(events, "resources"), lambda r: F.struct(F.lit("resource").alias("kind"), r["uid"].alias("value"))))
    whole = F.concat(F.array_compact(F.array(*single)), F.coalesce(listed, F.array().cast("array<struct<kind:string,value:string>>")))
    rows = events.select(*columns, F.explode(F.array_distinct(whole)).alias("__x"))
    return rows.withColumns({"kind": F.col("__x.kind"), "value": F.col("__x.value")}).drop("__x").where("value IS NOT NULL")


def looked_up(events: DataFrame) -> DataFrame:
    return keyed(events, "event_uid")


def wanted(ids: DataFrame) -> DataFrame:
    """(inv_id, kind, value) as enrichment looks them up."""
    kind = F.when(F.col("kind").isin("src_ip", "dst_ip"), F.when(is_ipv4(F.col("value")), "ip")).when(F.col("kind") == "resource", F.when(is_arn(F.col("value")), "resource")).when(F.col("kind").isin("user", "domain"), F.col("kind"))
    return ids.where(F.col("value") != "").select("inv_id", kind.alias("kind"), "value").where("kind IS NOT NULL").distinct()


def cross_source(events: DataFrame, ids: DataFrame, primary: str, limit: int | None = None) -> DataFrame:
    """The same identifiers against all other sources; with ``limit``, its first events of each source for an investigation."""
    return capped(enrich_all(events.where(F.col("source_name") != primary), ids), limit, "inv_id", "source_name")


def contributing_sources(rows: DataFrame) -> DataFrame:
    return rows.groupBy("inv_id").agg(F.array_join(F.array_sort(F.collect_set("source_name")), ",").alias("sources"), F.count("*").alias("events"))


def from_identifiers(events: DataFrame, users: list[str], ips: list[str], inv_id: str = "adhoc") -> DataFrame:
    """Investigate given users and addresses without a detection: at most 100 of each."""
    if len(users) > 100 or len(ips) > 100:
        raise ValueError("at most 100 users and 100 addresses")
    rows = [(inv_id, "user", u) for u in users] + [(inv_id, "src_ip", i) for i in ips]
    return enrich_all(events, events.sparkSession.createDataFrame(rows, "inv_id string, kind string, value string"))


def graph_identifiers(nodes: DataFrame) -> DataFrame:
    """Identifiers to enrich an existing graph again: its principals and addresses."""
    kind = F.when(F.col("node_type") == "Principal", "user").when(F.col("node_type") == "IPAddress", "src_ip")
    return nodes.select("inv_id", kind.alias("kind"), F.col("label").alias("value")).where("kind IS NOT NULL").distinct()


def role_name(arn: Column) -> Column:
    """``...:role/path/Name`` -> Name."""
    return F.when(arn.contains(":role/"), F.element_at(F.split(arn, "/"), -1))


def trust_principals(policy: Column) -> Column:
    """All principals of a trust policy's JSON text: a text, or the texts and lists of an object of any kinds."""
    statements = F.from_json(F.url_decode(policy), "struct<Statement:array<struct<Principal:string>>>")["Statement"]
    listed = lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))
    of = lambda p: F.when(p.startswith("{"), F.flatten(F.transform(F.map_values(F.from_json(p, "map<string,string>")), listed))).otherwise(F.array(p))
    found = F.filter(F.flatten(F.transform(F.filter(F.transform(statements, lambda s: s["Principal"]), lambda p: p.isNotNull()), of)), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(found))


def principal_context(nodes: DataFrame, inventory: DataFrame) -> DataFrame:
    """Principal nodes with what the inventory knows: policies, admin flag, MFA devices, trusted principals.

    inventory: name, policies array<string>, mfa_devices int, trust_policy string (JSON).
    """
    admin = F.exists("policies", lambda p: p.contains("AdministratorAccess"))
    known = inventory.select(F.col("name").alias("label"), "policies", "mfa_devices", F.coalesce(admin, F.lit(False)).alias("is_admin"), trust_principals(F.col("trust_policy")).alias("trusted"))
    return nodes.where("node_type = 'Principal'").join(known, "label", "left")


def role_context(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """Principal and Resource nodes that are roles, with what the inventory knows of the role.

    A node is a role if its label is, or ends with, a role's name (``role/path/Name`` and assumed sessions
    ``assumed-role/Name/session`` included). roles: name, policies, inline_policies array<string>, trust_policy string.
    """
    parts = F.split("label", "/")
    name = F.when(F.col("label").contains("assumed-role/"), F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))
    admin = F.exists("policies", lambda p: p.contains("AdministratorAccess"))
    known = roles.select(F.col("name").alias("role"), "policies", "inline_policies", F.coalesce(admin, F.lit(False)).alias("is_admin"), trust_principals(F.col("trust_policy")).alias("trusted"))
    return nodes.where("node_type IN ('Principal', 'Resource')").withColumn("role", name).join(known, "role")


def lookup_stats(events: DataFrame, ids: DataFrame) -> DataFrame:
    """(inv_id, queries_executed, queries_with_results): kinds of identifiers looked up, and those that found an event."""
    kind = F.when(F.col("kind").isin("src_ip", "dst_ip"), "ip").when(F.col("kind").isin("user", "domain", "resource"), F.col("kind"))
    asked = ids.select("inv_id", kind.alias("kind"), "value").where("kind IS NOT NULL").distinct()
    found = looked_up(events).select("kind", "value").distinct().join(asked, ["kind", "value"]).select("inv_id", "kind").distinct()
    rows = asked.select("inv_id", "kind").distinct().join(found.withColumn("found", F.lit(True)), ["inv_id", "kind"], "left")
    return rows.groupBy("inv_id").agg(F.count("*").alias("queries_executed"), F.count("found").alias("queries_with_results"))


def concat(frames: list[DataFrame]) -> DataFrame:
    """Diagonal: columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
