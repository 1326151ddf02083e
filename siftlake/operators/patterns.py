"""Structural patterns of graphs (PAT1 to PAT5). Output: inv_id, pattern, entity, n, severity, members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_private
from . import graph, masks
from .lineage import cut
from .skew import MOST_SENT, hot_keys, split_join
from .timeline import with_labels


def _row(rows: DataFrame, pattern: str, severity: Column) -> DataFrame:
    return rows.select("inv_id", F.lit(pattern).alias("pattern"), "entity", F.col("n").cast("long").alias("n"), severity.cast("double").alias("severity"), F.array_join(F.array_sort("members"), ", ").alias("members"))


def _of(edges: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    return with_labels(edges.where(F.col("edge_type") == kind), nodes)


def principal_services(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = _of(edges, nodes, "CALLED_API").where("source_type = 'Principal'")
    return rows.select("inv_id", "source_id", F.col("source_label").alias("principal"), F.split("target_label", ":")[0].alias("service")).distinct()


def gathered(pairs: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """(keys, n, members) of the keys with at least so many distinct values: pairs are made distinct and counted first,
    and only those of keys with enough are collected."""
    pairs = cut(pairs.select(*keys, value).where(F.col(value).isNotNull()).distinct())
    enough = pairs.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return pairs.join(enough, keys).groupBy(*keys, "n").agg(F.collect_list(value).alias("members"))


def _named(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(label).alias("entity"))


def privilege_fanout(edges: DataFrame, nodes: DataFrame, least: int = 5) -> DataFrame:
    used, keys = principal_services(edges, nodes), ["inv_id", "source_id"]
    rows = gathered(used, keys, "service", least).join(_named(used, keys, "principal"), keys)
    return _row(rows, "privilege_fanout", F.least(F.lit(0.9), 0.4 + 0.5 * (F.col("n") - least) / 5))


def resource_convergence(edges: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """A join of distinct (resource, operation) with distinct (operation, principal): no principal is copied twice to a
    resource for one operation, and none is collected for resources with fewer than ``least``."""
    access, keys = _of(edges, nodes, "ACCESSED_RESOURCE").select("inv_id", F.col("source_id").alias("api"), "target_id", "target_label"), ["inv_id", "target_id"]
    calls = cut(_of(edges, nodes, "CALLED_API").where("source_type = 'Principal'").select("inv_id", F.col("target_id").alias("api"), F.col("source_label").alias("principal")).distinct())
    pairs = split_join(calls, access.select("inv_id", "api", "target_id").distinct(), ["inv_id", "api"], F.col("principal"), hot_keys(calls, ["inv_id", "api"]))
    rows = gathered(pairs, keys, "principal", least).join(_named(access, keys, "target_label"), keys)
    return _row(rows, "resource_convergence", F.least(F.lit(0.9), 0.5 + 0.3 * (F.col("n") - least) / least))


def multi_source_auth(edges: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """External addresses of a principal; the span is that of all its logins, internal ones too."""
    logins, keys = _of(edges, nodes, "AUTHENTICATED_FROM").where("source_type = 'Principal'"), ["inv_id", "source_id"]
    spans = logins.groupBy(*keys).agg(F.min("source_label").alias("entity"), (F.unix_micros(F.max("last_seen")) - F.unix_micros(F.min("first_seen"))).alias("span"))
    rows = gathered(logins.where(~is_private(F.col("target_label"))), keys, "target_label", least).join(spans, keys)
    base = 0.5 + 0.1 * F.least(F.col("n") - least, F.lit(4))
    return _row(rows, "multi_source_auth", F.when(F.col("span") < 3_600_000_000, F.least(base + 0.2, F.lit(0.95))).otherwise(F.least(base, F.lit(0.85))))


def service_bridge(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Principals that alone use two services together."""
    used = principal_services(edges, nodes)
    pairs = used.select("inv_id", "source_id", "principal", F.col("service").alias("a")).join(used.select("inv_id", "source_id", F.col("service").alias("b")), ["inv_id", "source_id"]).where("a < b")
    alone = pairs.groupBy("inv_id", "a", "b").agg(F.count("*").alias("users"), F.min("source_id").alias("source_id"), F.min("principal").alias("principal")).where("users = 1")
    rows = alone.groupBy("inv_id", "source_id").agg(F.min("principal").alias("entity"), F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_list(F.array("a", "b")))).alias("members"))
    return _row(rows, "service_bridge", F.least(F.lit(0.85), 0.5 + 0.1 * F.col("n")))


def detect(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All patterns; sort by severity descending for display."""
    return reduce(lambda a, b: a.unionByName(b), [f(edges, nodes) for f in (privilege_fanout, resource_convergence, multi_source_auth, service_bridge)])


# --- by sets of investigations ----------------------------------------------------------------------------------------------


def _met(many: DataFrame, few: DataFrame, key: str, spread: str, names: list[str]) -> DataFrame:
    """``many`` joined with ``few`` on ``key``, with the investigations of both sides; those of ``few`` are in ``__few``."""
    few = cut(few.join(many.select(key).distinct(), key, "left_semi"))
    if few.count() <= MOST_SENT:
        rows = many.join(F.broadcast(few), key)
    else:
        many = cut(many)
        rows = split_join(many, few, [key], F.col(spread), hot_keys(many, [key]))
    return rows.withColumn("inv_id", masks.common(names, "inv_id", "__few")).drop("__few").where(masks.some(names))


def _gathered(pairs: DataFrame, key: str, label: str, value: str, least: int, names: list[str], told: bool) -> DataFrame:
    """(inv_id, key, entity, n, members), by places: values are collected once for each set of investigations that have
    them, and these lists are then dealt out. If not ``told``, values are counted alone, and members are null."""
    pairs = pairs.where(F.col(value).isNotNull()).groupBy(key, label, value).agg(masks.union(names))
    if not told:
        sizes = masks.each(pairs.groupBy("inv_id", key, label).agg(F.count("*").alias("n")), names)
        rows = sizes.groupBy("inv_id", key).agg(F.min(label).alias("entity"), F.sum("n").alias("n")).where(F.col("n") >= least)
        return rows.withColumn("members", F.lit(None).cast("array<string>"))
    blocks = pairs.groupBy("inv_id", key, label).agg(F.collect_list(value).alias("part"))
    rows = masks.each(blocks, names).groupBy("inv_id", key).agg(F.min(label).alias("entity"), F.flatten(F.collect_list("part")).alias("members"))
    return rows.withColumn("n", F.size("members")).where(F.col("n") >= least)


def detect_sets(leaves: DataFrame, names: list[str]) -> DataFrame:
    """detect() of graph.from_sets(leaves, ..., names) without that graph: pairs are joined and made distinct once for all
    investigations that have them."""
    masked, kinds = masks.masked(leaves, names), ("CALLED_API", "ACCESSED_RESOURCE", "AUTHENTICATED_FROM")
    labels = graph.label_sets(leaves, names)
    edges = graph.edge_contributions(masked, kinds=kinds).groupBy("edge_type", "source_id", "target_id").agg(masks.union(names))
    for end, other in (("target", "source"), ("source", "target")):
        side = labels.select(F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label"), F.col("node_type").alias(f"{end}_type"), F.col("inv_id").alias("__few"))
        edges = _met(cut(edges), side, f"{end}_id", f"{other}_id", names)
    times = graph.edge_contributions(masked, kinds=kinds[2:]).groupBy("inv_id", "source_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return _of_sets(cut(edges), times, names)


def detect_labelled(edges: DataFrame, names: list[str], told: bool = True) -> DataFrame:
    """The same of a written table of attack.labelled_sets(). If not ``told``, no members are collected (null)."""
    times = edges.where("edge_type = 'AUTHENTICATED_FROM'").groupBy("inv_id", "source_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return _of_sets(edges, times, names, told)


def _of_sets(edges: DataFrame, times: DataFrame, names: list[str], told: bool = True) -> DataFrame:
    """edges: edges by sets with labels of both ends; an edge may have several rows. times: first and last login of principals."""
    calls = edges.where("edge_type = 'CALLED_API' AND source_type = 'Principal'")
    row = lambda rows, pattern, severity: _row(masks.named(rows, names), pattern, severity)

    used = cut(calls.groupBy("source_id", F.col("source_label").alias("principal"), F.split("target_label", ":")[0].alias("service")).agg(masks.union(names)))
    fanout = row(_gathered(used, "source_id", "principal", "service", 5, names, told), "privilege_fanout", F.least(F.lit(0.9), 0.4 + 0.5 * (F.col("n") - 5) / 5))

    access = edges.where("edge_type = 'ACCESSED_RESOURCE'").select(F.col("source_id").alias("api"), "target_id", "target_label", F.col("inv_id").alias("__few"))
    users = calls.groupBy(F.col("target_id").alias("api"), F.col("source_label").alias("principal")).agg(masks.union(names))
    pairs = _met(cut(users), access, "api", "principal", names)
    convergence = row(_gathered(pairs, "target_id", "target_label", "principal", 3, names, told), "resource_convergence", F.least(F.lit(0.9), 0.5 + 0.3 * (F.col("n") - 3) / 3))

    logins = edges.where("edge_type = 'AUTHENTICATED_FROM' AND source_type = 'Principal'")
    spans = masks.each(times, names).groupBy("inv_id", "source_id").agg((F.unix_micros(F.max("last_seen")) - F.unix_micros(F.min("first_seen"))).alias("span"))
    rows = _gathered(logins.where(~is_private(F.col("target_label"))), "source_id", "source_label", "target_label", 3, names, told).join(spans, ["inv_id", "source_id"])
    base = 0.5 + 0.1 * F.least(F.col("n") - 3, F.lit(4))
    sources = row(rows, "multi_source_auth", F.when(F.col("span") < 3_600_000_000, F.least(base + 0.2, F.lit(0.95))).otherwise(F.least(base, F.lit(0.85))))

    both = used.withColumnRenamed("service", "a").join(used.select("source_id", F.col("service").alias("b"), F.col("inv_id").alias("__b")), "source_id").where("a < b")
    both = both.withColumn("inv_id", masks.common(names, "inv_id", "__b")).where(masks.some(names))
    both = both.groupBy("inv_id", "a", "b").agg(F.count("*").alias("users"), F.min("source_id").alias("source_id"), F.min("principal").alias("principal"))
    alone = masks.each(both, names).groupBy("inv_id", "a", "b").agg(F.sum("users").alias("users"), F.min("source_id").alias("source_id"), F.min("principal").alias("principal")).where("users = 1")
    rows = alone.groupBy("inv_id", "source_id").agg(F.min("principal").alias("entity"), F.count("*").alias("n"), (F.array_distinct(F.flatten(F.collect_list(F.array("a", "b")))) if told else F.lit(None).cast("array<string>")).alias("members"))
    bridge = row(rows, "service_bridge", F.least(F.lit(0.85), 0.5 + 0.1 * F.col("n")))
    return reduce(lambda a, b: a.unionByName(b), [fanout, convergence, sources, bridge])
