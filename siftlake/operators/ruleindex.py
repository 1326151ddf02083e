"""Thousands of rules in one scan: rules are rows of a table, not parts of the plan.

Each rule is filed under one text that its matches must have: a value of the equality filter on the path for which the
rules of its class name most texts, else only its class.
An event asks the table, by a hash join, for the rules under its own texts; what is left of a rule's filters is then
tested on these candidates alone, by one expression that reads paths, operators and values from the row. So the plan is
as large for a thousand rules as for one, and an event costs as much as it has candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import field, type_of
from .detect import in_window

TABLE = "__class int, __path int, __text string, __candidates array<struct<rule_id:string,filters:array<struct<path:int,op:string,texts:array<string>>>>>"
#: Rows of the table that are sent to all tasks at most (about 200 bytes each); beyond, it is joined like any other.
MOST_SENT = 200_000


def _parts(spec: dict) -> tuple[str, str, list[str]]:
    op, value = next((k, v) for k, v in spec.items() if k != "field")
    if op not in ("equals", "not_equals", "contains", "in", "regex"):
        raise ValueError(f"unknown operator {op}")
    return spec["field"], {"equals": "in"}.get(op, op), [str(v) for v in value] if op == "in" else [str(value)]


def texts_of(events: DataFrame, path: str) -> Column:
    """The texts of a path: one of a scalar, all text leaves of a list of structs."""
    kind = type_of(events, path)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        leaves = [f.name for f in kind.elementType.fields if isinstance(f.dataType, T.StringType)]
        return F.coalesce(F.flatten(F.transform(F.filter(field(events, path), lambda x: x.isNotNull()), lambda x: F.array(*[x[n] for n in leaves]))), F.array().cast("array<string>"))
    return F.array(field(events, path).cast("string"))


def table_of(events: DataFrame, rules: list[dict]) -> tuple[DataFrame, list[str], list[int]]:
    """(the table of candidates, paths by number, numbers of those that rules are filed under)."""
    paths: dict[str, int] = {}
    filed: dict[tuple, list] = {}
    named: dict[tuple, set] = {}
    for r in rules:
        for p, op, texts in map(_parts, r["filters"]):
            named.setdefault((r["class_uid"], p), set()).update(texts if op == "in" else ())
    for r in rules:
        filters = [(paths.setdefault(p, len(paths)), op, texts) for p, op, texts in map(_parts, r["filters"])]
        equal = [k for k, (_, op, _) in enumerate(filters) if op == "in"]
        anchor = max(equal, key=lambda k: len(named[r["class_uid"], r["filters"][k]["field"]]), default=None)
        rest = [f for k, f in enumerate(filters) if k != anchor]
        keys = [(-1, None)] if anchor is None else [(filters[anchor][0], text) for text in dict.fromkeys(filters[anchor][2])]
        for path, text in keys:
            filed.setdefault((r["class_uid"], path, text), []).append((r["id"], rest))
    rows = [(c, p, "" if t is None else t, found) for (c, p, t), found in filed.items()]
    return events.sparkSession.createDataFrame(rows, TABLE), [*paths], sorted({p for _, p, _ in filed if p >= 0})


def indexed_hits(events: DataFrame, rules: list[dict], start, end) -> DataFrame:
    """The rows of detect.hits(): one for each event and rule that it matches, with the events' columns."""
    table, paths, anchors = table_of(events, rules)

    def keys(k: int) -> Column:
        texts = F.array_distinct(F.filter(texts_of(events, paths[k]), lambda t: t.isNotNull()))
        return F.transform(texts, lambda t: F.struct(F.lit(k).alias("path"), t.alias("text")))

    asked = F.concat(F.array(F.struct(F.lit(-1).alias("path"), F.lit("").alias("text"))), *map(keys, anchors))
    rows = events.where(in_window(start, end) & F.col("class_uid").isin(sorted({r["class_uid"] for r in rules})))
    rows = rows.select("*", F.explode(asked).alias("__k")).select("*", F.col("class_uid").cast("int").alias("__class"), F.col("__k.path").alias("__path"), F.col("__k.text").alias("__text")).drop("__k")
    small = len(rules) <= MOST_SENT and sum(len(f) for f in (r["filters"] for r in rules)) <= MOST_SENT
    found = rows.join(F.broadcast(table) if small else table, ["__class", "__path", "__text"])
    values = F.array(*[texts_of(events, p) for p in paths]) if paths else F.array().cast("array<array<string>>")

    def holds(f: Column) -> Column:
        has = lambda test: F.coalesce(F.exists(F.get("__values", f["path"]), test), F.lit(False))
        text = f["texts"][0]
        equal = has(lambda t: F.array_contains(f["texts"], t))
        return F.when(f["op"] == "in", equal).when(f["op"] == "not_equals", ~equal).when(f["op"] == "contains", has(lambda t: F.contains(t, text))).otherwise(has(lambda t: F.regexp_like(t, F.concat(F.lit("(?U)"), text))))

    found = found.withColumn("__values", values).withColumn("rule_id", F.explode(F.transform(F.filter("__candidates", lambda c: F.forall(c["filters"], holds)), lambda c: c["rule_id"])))
    # an event with a list finds a rule under several texts of its own
    return found.dropDuplicates(["event_uid", "rule_id"]).drop("__class", "__path", "__text", "__candidates", "__values") if _lists(events, paths, anchors) else found.drop("__class", "__path", "__text", "__candidates", "__values")


def _lists(events: DataFrame, paths: list[str], anchors: list[int]) -> bool:
    return any(isinstance(type_of(events, paths[k]), T.ArrayType) for k in anchors)
