"""Attack paths: reachable subgraphs, phases, steps and narratives (ATK1 to ATK11)."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_private
from . import graph, masks
from .graph import both_ways
from .lineage import cut
from .prefix import placed, placed_sets
from .skew import MOST_SENT, hot_of, split_join
from .timeline import human_bytes, lookup, with_labels

#: Phases of techniques and operations.
PHASES = json.loads(Path(__file__).with_name("phases.json").read_text(encoding="utf-8"))
#: Phases in kill-chain order.
ORDER = "Reconnaissance InitialAccess Execution Persistence PrivilegeEscalation DefenseEvasion CredentialAccess Discovery LateralMovement Collection Exfiltration Impact Unknown".split()
#: How a call's phase is told.
CALL_TEXT = {
    "Persistence": "establishing persistence", "PrivilegeEscalation": "escalating privileges", "DefenseEvasion": "evading detection", "CredentialAccess": "obtaining new credentials",
    "Discovery": "enumerating the environment", "Collection": "collecting data", "Execution": "executing code", "Exfiltration": "moving data out", "Impact": "modifying or destroying resources",
}
#: Concerns by phase, in the order in which they are told.
CONCERNS = {
    "DefenseEvasion": "Audit logging may have been tampered with", "Persistence": "Attacker may have established persistent access (new credentials/users)",
    "PrivilegeEscalation": "Privileges were escalated — blast radius may exceed initial access scope", "Exfiltration": "Data was transferred to external destinations",
    "Impact": "Resources were modified or destroyed", "Collection": "Sensitive data was accessed",
}
NO_CONCERN = "No high-risk activity patterns detected beyond the initial finding."
#: Links of findings and triggers.
NO_STEPS = ("TRIGGERED_BY", "RELATED_TO")
EXFILTRATION_BYTES, MANY_LOGINS, HOPS = 10_000_000, 10, 5


def _inverted(name: str) -> dict[str, str]:
    return {key: phase for phase, keys in PHASES[name].items() for key in keys}


def technique_phase(technique: Column) -> Column:
    return F.coalesce(lookup(_inverted("technique"), F.split(technique, r"\.")[0]), F.lit("Unknown"))


def operation_phase(operation: Column) -> Column:
    method = F.element_at(F.split(operation, r"\."), -1)
    google = operation.contains("google.") & operation.contains(".")
    fallback = F.when(operation.contains("logging.") & method.startswith("Delete"), "DefenseEvasion").when(operation.contains("iam.") & method.startswith("Set"), "PrivilegeEscalation").otherwise("Unknown")
    return F.when(google, F.coalesce(lookup(_inverted("gcp_method"), method), fallback)).otherwise(F.coalesce(lookup(_inverted("aws_operation"), operation), F.lit("Unknown")))


def reachable(seeds: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """(inv_id, finding_id, node): nodes within ``hops`` undirected steps of each finding.

    One join a hop; each frontier leaves out what was reached before, and a hop ends the search of findings that reach
    nothing new, as does having all nodes. A frontier of up to MOST_SENT is sent to all tasks, so the steps are not
    shuffled; of larger ones, steps of nodes with very many are cut into pieces, each of which gets the frontier's row of
    the node. Hops are cut by checkpoints, so plans stay small.
    """
    key = ["inv_id", "node"]
    steps = cut(both_ways(edges).select(*key, "other").distinct())
    degrees = cut(steps.groupBy(*key).count())
    hubs = hot_of(degrees, key)
    seen = cut(seeds.select("inv_id", "finding_id", F.col("finding_id").alias("node")).distinct())
    # findings without an edge reach nothing; the others are done once they have all nodes of their investigation
    linked = seen.join(degrees, key).select("inv_id").join(degrees.groupBy("inv_id").agg(F.count("*").alias("nodes")), "inv_id")
    left = linked.agg(F.coalesce(F.sum(F.col("nodes") - 1), F.lit(0))).first()[0]
    frontier, n = seen, seen.count()
    for _ in range(hops):
        if not n or not left:
            break
        found = steps.join(F.broadcast(frontier), key) if n <= MOST_SENT else split_join(steps, frontier, key, F.col("other"), hubs)
        found = found.select("inv_id", "finding_id", F.col("other").alias("node")).distinct()
        frontier = cut(found.join(seen, ["inv_id", "finding_id", "node"], "left_anti"))
        n = frontier.count()
        left -= n
        seen = seen.unionByName(frontier)
    return seen


def flow_phase(src: Column, dst: Column, b_in: Column, b_out: Column) -> Column:
    inside, to_inside = is_private(src), is_private(dst)
    return F.when(inside & ~to_inside & (b_out > EXFILTRATION_BYTES), "Exfiltration").when(inside & to_inside, "LateralMovement").when(~inside & to_inside & (b_in > 0), "InitialAccess").otherwise("Unknown")


def classify(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges as steps: phase, action, narrative, actor, target; findings' and triggers' links are left out."""
    return as_steps(with_labels(edges.where(~F.col("edge_type").isin(*NO_STEPS)), nodes))


def called_phase(label: Column) -> Column:
    """The phase of the operation that has this label."""
    return operation_phase(F.coalesce(F.get(F.split(label, ":"), 1), label))


def as_steps(e: DataFrame, *keep: str) -> DataFrame:
    """Edges with labels and types of both ends as steps, with the columns ``keep`` of theirs. Ends may have their
    called_phase() with them."""
    s, t, kind = F.col("source_label"), F.col("target_label"), F.col("edge_type")
    b_in, b_out = F.coalesce("bytes_in", F.lit(0)), F.coalesce("bytes_out", F.lit(0))
    access, called = (F.col(f"{end}_called") if f"{end}_called" in e.columns else called_phase(label) for end, label in (("source", s), ("target", t)))
    flow = flow_phase(s, t, b_in, b_out)
    said = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    per = {
        "AUTHENTICATED_FROM": (F.when(F.col("event_count") > MANY_LOGINS, "CredentialAccess").otherwise("InitialAccess"), said("Authenticated from ", t), F.when(F.col("event_count") > 1, said(s, " authenticated from ", t, " (", F.col("event_count").cast("string"), " times).")).otherwise(said(s, " authenticated from ", t, "."))),
        "CALLED_API": (called, said("Called ", t), said(s, " called ", t, F.coalesce(F.concat(F.lit(" — "), lookup(CALL_TEXT, called)), F.lit("")), ".")),
        "ACCESSED_RESOURCE": (F.when(access == "Unknown", "Collection").otherwise(access), said("Accessed ", t), said(s, " accessed resource ", t, ".")),
        "COMMUNICATED_WITH": (flow, said("Network flow to ", t), said(s, " communicated with ", t, F.when(flow == "Exfiltration", said(" — ", human_bytes(b_out), " outbound to external host")).when(flow == "InitialAccess", " — inbound from external").otherwise(""), ".")),
        "RESOLVED_TO": (F.lit("Discovery"), said("DNS resolution to ", t), said(s, " resolved ", t, ".")),
        "ORIGINATED_FROM": (F.lit("InitialAccess"), said("Activity from ", t), said("Event originated from ", t, ".")),
        "PERFORMED_BY": (F.lit("Unknown"), said("Performed by ", t), said("Action performed by ", t, ".")),
        "TARGETED": (F.lit("Unknown"), said("Targeted ", t), said(s, " targeted ", t, ".")),
    }

    def choose(k: int) -> Column:
        out = F.lit(None).cast("string")
        for name, parts in per.items():
            out = F.when(kind == name, parts[k]).otherwise(out)
        return out

    return e.select(
        *keep, "inv_id", F.col("id").alias("edge_id"), "edge_type", "source_id", "target_id", F.col("first_seen").alias("ts"), choose(0).alias("phase"), choose(1).alias("action"), choose(2).alias("narrative"),
        F.when(F.col("source_type") == "Principal", s).alias("actor"), F.when(F.col("target_type").isin("Resource", "IPAddress", "APIOperation"), t).alias("target"), "target_type", "event_count",
    )


def first_known_phase(mitre: Column) -> Column:
    return F.get(F.filter(F.transform(mitre, technique_phase), lambda p: p != "Unknown"), 0)


def ordinal(phase: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, p in enumerate(ORDER) for x in (p, k)])[phase]


def steps(findings: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordered steps of each finding, node and edge counts). findings: inv_id, finding_id, mitre. ``own_phase`` is a step's
    phase before the finding's is inherited.

    One row of each reached node tells its label, so one join for each end both labels an edge and finds it inside.
    """
    seen, key = reachable(findings, edges), ["inv_id", "finding_id"]
    labels = nodes.select("inv_id", F.col("id").alias("node"), F.col("label").alias("node_label"), "node_type")
    known = cut(seen.join(labels, ["inv_id", "node"], "left").withColumn("node_label", F.coalesce("node_label", "node")))

    def end(name: str, *columns: str) -> DataFrame:
        return known.select(*key, F.col("node").alias(f"{name}_id"), *[F.col(f"node_{c}").alias(f"{name}_{c}") for c in columns])

    def inside(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.join(end("source", *columns), ["inv_id", "source_id"]).join(end("target", *columns), [*key, "target_id"])

    linking, own = F.col("edge_type").isin(*NO_STEPS), findings.select(*key, first_known_phase(F.col("mitre")).alias("mitre_phase"))
    rows = edges.where(~linking).select("inv_id", "id", "edge_type", "source_id", "target_id", "first_seen", "bytes_in", "bytes_out", "event_count")
    rows = as_steps(inside(rows, "label", "type"), "finding_id").join(own, key).withColumn("own_phase", F.col("phase"))
    rows = rows.withColumn("phase", F.when(F.col("phase") == "Unknown", F.coalesce("mitre_phase", "phase")).otherwise(F.col("phase")))
    rows = placed(rows, key, [F.col("ts"), ordinal(F.col("phase")), F.col("edge_id")], "step")
    of = rows.select(*key).unionByName(inside(edges.where(linking).select("inv_id", "source_id", "target_id")).select(*key))
    counts = seen.groupBy(*key).agg(F.count("*").alias("node_count")).join(of.groupBy(*key).agg(F.count("*").alias("edge_count")), key, "left")
    return rows, counts


def _in_order(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Distinct values of each finding in order of first appearance."""
    first = rows.where(F.col(value).isNotNull()).groupBy("inv_id", "finding_id", value).agg(F.min("step").alias("at"))
    return first.groupBy("inv_id", "finding_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias(name))


def _impact() -> Column:
    return F.when(F.col("concerns") == "", NO_CONCERN).otherwise(F.concat("concerns", F.lit(".")))


def narratives(findings: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each finding that has a step. findings: inv_id, finding_id, name, severity, mitre."""
    rows, counts = steps(findings, nodes, edges)
    key = ["inv_id", "finding_id"]
    phases = _in_order(rows.withColumn("phase", F.when(F.col("phase") != "Unknown", F.col("phase"))), "phase", "phases")
    actors = _in_order(rows, "actor", "actors")
    login = (F.col("edge_type") == "AUTHENTICATED_FROM") & (F.col("target_type") == "IPAddress")
    worry = F.col("phase").isin("DefenseEvasion", "Exfiltration", "Impact", "Persistence")
    # the first three of each finding, ranked with a limit in each task
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("step"))
    told = rows.where(worry & F.col("narrative").isNotNull()).select(*key, "step", "narrative").withColumn("k", rank).where("k <= 3").groupBy(*key).agg(F.array_agg(F.struct("step", "narrative")).alias("told"))
    base = rows.groupBy(*key).agg(
        F.count("*").alias("steps"), F.max("mitre_phase").alias("mitre_phase"), F.min_by("target", F.when(login, F.col("step"))).alias("entry_point"),
        F.concat_ws(". ", *[F.when(F.bool_or(F.col("phase") == p), s) for p, s in CONCERNS.items()]).alias("concerns"),
    )
    out = base.join(told, key, "left").join(phases, key, "left").join(actors, key, "left").join(counts, key).join(findings.select(*key, "name", "severity"), key)
    found = F.coalesce("phases", F.array().cast("array<string>"))
    found = F.when(F.col("mitre_phase").isNull(), found).otherwise(F.concat(F.array("mitre_phase"), F.filter(found, lambda p: p != F.col("mitre_phase"))))
    out = out.withColumn("phases", found)
    key_points = F.coalesce(F.array_join(F.transform(F.array_sort("told"), lambda x: x["narrative"]), " "), F.lit(""))
    summary = F.concat(
        F.lit("Detection '"), "name", F.lit("' triggered an investigation"), F.coalesce(F.concat(F.lit(" originating from "), "entry_point"), F.lit("")),
        F.coalesce(F.concat(F.lit(" involving "), F.array_join("actors", ", ")), F.lit("")), F.lit("."),
        F.when(F.size("phases") > 1, F.concat(F.lit(" The attack path spans "), F.size("phases").cast("string"), F.lit(" kill chain phases: "), F.array_join("phases", " → "), F.lit("."))).otherwise(""),
        F.when(key_points != "", F.concat(F.lit(" Key concerns: "), key_points)).otherwise(""),
    )
    return out.select(*key, "name", "severity", "steps", "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), F.array_join("phases", ",").alias("phases"), F.array_join("actors", ",").alias("actors"), "entry_point", _impact().alias("impact"), summary.alias("summary"))


# --- by sets of investigations ----------------------------------------------------------------------------------------------


def reachable_sets(edges: DataFrame, names: list[str], hops: int = HOPS) -> DataFrame:
    """(node, inv_id): nodes within ``hops`` undirected steps of the findings, with the set (masks) of the investigations in
    which they are; graph.FINDING stands for the finding of each. edges: a written table of graph.edge_sets()."""
    return _reached(edges, names, hops, *graph.meeting(edges, names))


def _reached(edges: DataFrame, names: list[str], hops: int, ends: DataFrame, met: Callable[[DataFrame, DataFrame, str], DataFrame]) -> DataFrame:
    """As reachable(), with one row for a node and all investigations that reach it in the same hop."""
    size = lambda rows: rows.agg(F.coalesce(F.sum(masks.size(names)), F.lit(0))).first()[0]
    whole = lambda rows: rows.groupBy("node").agg(masks.union(names))
    left, pairs = size(whole(ends.where(F.col("node") != graph.FINDING))), edges.select("inv_id", "source_id", "target_id")
    seen = frontier = cut(edges.sparkSession.range(1).select(F.lit(graph.FINDING).alias("node"), masks.of(names, range(len(names))).alias("inv_id")))
    for _ in range(hops):
        n = left and size(frontier)
        if not n:
            break
        found = [met(pairs, frontier, a).select(F.col(f"{b}_id").alias("node"), "inv_id") for a, b in (("source", "target"), ("target", "source"))]
        now = whole(found[0].unionByName(found[1])).join(whole(seen).withColumnRenamed("inv_id", "__seen"), "node", "left")
        frontier = cut(now.withColumn("inv_id", masks.without(names, "inv_id", "__seen")).drop("__seen").where(masks.some(names)))
        left -= size(frontier)
        seen = seen.unionByName(frontier)
    return whole(seen)


def _mitre_phases(mitre: DataFrame) -> dict[str, str | None]:
    """inv_id -> phase of the finding's techniques; one row for each rule."""
    return {r["inv_id"]: r["phase"] for r in mitre.select("inv_id", first_known_phase(F.col("mitre")).alias("phase")).collect()}


def labelled_sets(edges: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """Edge sets but those of NO_STEPS with label, type and called_phase() of both ends, and ``source_near`` and
    ``target_near``: the investigations (masks) whose finding reaches the end, null without any.

    edges: a written table of graph.edge_sets(); labels: graph.label_sets().
    """
    ends, met = graph.meeting(edges, names)
    told = labels.select(F.col("id").alias("node"), "label", F.col("node_type").alias("type"), F.col("inv_id").alias("__told"))
    near = _reached(edges, names, HOPS, ends, met).withColumnRenamed("inv_id", "near")
    # without a label are findings and events alone, which no step tells
    known = ends.groupBy("node").agg(masks.union(names)).join(told, "node", "left").join(near, "node", "left")
    known = known.withColumn("inv_id", F.when(F.col("__told").isNull(), F.col("inv_id")).otherwise(masks.common(names, "inv_id", "__told"))).drop("__told")
    known = cut(known.withColumn("label", F.coalesce("label", "node")).withColumn("called", F.when(F.col("type") == "APIOperation", called_phase(F.col("label")))))
    return met(met(edges.where(~F.col("edge_type").isin(*NO_STEPS)), known, "source"), known, "target")


def inside_sets(labelled: DataFrame, names: list[str], mitre: DataFrame) -> DataFrame:
    """Those of labelled_sets() inside of what the findings reach, with ``own_phase`` and ``phase``: a row for all
    investigations (masks) in which these are the same. mitre: inv_id, mitre."""
    rows = labelled.withColumn("inv_id", masks.common(names, "inv_id", "source_near")).withColumn("inv_id", masks.common(names, "inv_id", "target_near")).where(masks.some(names))
    kept = ["first_seen", "source_label", "target_label", "source_type", "source_called", "target_called", "bytes_in", "bytes_out"]
    rows = as_steps(graph.with_id(rows), *kept).select(*kept, "inv_id", "edge_type", "source_id", "target_id", "target_type", "event_count", F.col("phase").alias("own_phase"))
    # a step without a phase of its own has that of the finding, so its set falls into those of the findings' phases
    phases = _mitre_phases(mitre)
    of = {p: [k for k, n in enumerate(names) if (phases.get(n) or "Unknown") == p] for p in {"Unknown", *filter(None, phases.values())}}
    split = F.array(*[F.struct(F.lit(p).alias("phase"), masks.within(names, places).alias("inv_id")) for p, places in sorted(of.items())])
    rows = rows.withColumn("__of", F.explode(F.when(F.col("own_phase") == "Unknown", split).otherwise(F.array(F.struct(F.col("own_phase").alias("phase"), "inv_id")))))
    return rows.withColumns({"phase": F.col("__of.phase"), "inv_id": F.col("__of.inv_id")}).drop("__of").where(masks.some(names))


def steps_of_sets(inside: DataFrame, names: list[str], parts: int) -> DataFrame:
    """The ordered steps of steps(), without their findings, of inside_sets(); placed in so many parts."""
    rows = placed_sets(inside, names, [F.col("first_seen"), ordinal(F.col("phase")), graph.edge_id()], parts).withColumnRenamed("phase", "__phase")
    rows = as_steps(graph.with_id(rows), "__phase", "own_phase", "places").drop("inv_id", "phase")  # told once for all investigations
    rows = rows.withColumn("__in", F.explode("places")).withColumns({"inv_id": F.col("__in.inv_id"), "step": F.col("__in.place")}).drop("__in", "places")
    return masks.named(rows.withColumnRenamed("__phase", "phase"), names)


def paths_of_sets(inside: DataFrame, names: list[str], mitre: DataFrame) -> DataFrame:
    """(inv_id, steps, phases, impact) of narratives(), of inside_sets(): steps are counted by phase, so none is placed. A
    phase comes where its first step does, which its time and then the phase itself decide."""
    rows = inside.groupBy("inv_id", "phase").agg(F.count("*").alias("n"), F.min("first_seen").alias("at"))
    rows = masks.named(masks.each(rows, names), names).groupBy("inv_id", "phase").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    known = F.col("phase") != "Unknown"
    out = rows.groupBy("inv_id").agg(
        F.sum("n").alias("steps"), F.collect_list(F.when(known, F.struct("at", ordinal(F.col("phase")).alias("o"), "phase"))).alias("found"),
        F.concat_ws(". ", *[F.when(F.bool_or(F.col("phase") == p), s) for p, s in CONCERNS.items()]).alias("concerns"),
    )
    out = out.join(mitre.select("inv_id", first_known_phase(F.col("mitre")).alias("mitre_phase")), "inv_id")
    found = F.transform(F.array_sort("found"), lambda x: x["phase"])
    phases = F.when(F.col("mitre_phase").isNull(), found).otherwise(F.concat(F.array("mitre_phase"), F.filter(found, lambda p: p != F.col("mitre_phase"))))
    return out.select("inv_id", "steps", F.array_join(phases, ",").alias("phases"), _impact().alias("impact"))
