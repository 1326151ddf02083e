"""Registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.detect import load_rules
from ..sources.adapter import EV, PATHS
from ..sources.schema import CLASS_UID

#: The window of all registered queries, and the time they are asked.
START, END, AS_OF = "2024-01-03 00:00:00", "2024-01-24 00:00:00", "2024-01-24 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = (EV,)):
    """Register a query; ``sql`` is its body after the common table expressions."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return put


W = f"time_dt >= TIMESTAMP '{START}' AND time_dt < TIMESTAMP '{END}'"


def leaf_sql(path: str) -> str:
    """Oracle expression of a canonical path over the flat projection; NULL where the driver tables have none."""
    flat = {p: n for n, p in PATHS.items()} | {"status": "status", "status_id": "status_id", "rcode_id": "rcode_id", "resources": "resource_uid"}
    return flat.get(path, "NULL")


def rule_sql(rule: dict) -> str:
    tests = [f"class_uid = {CLASS_UID[rule['event_class']]}"]
    for f in rule["filters"]:
        (op, v), c = next((k, v) for k, v in f.items() if k != "field"), f"CAST({leaf_sql(f['field'])} AS VARCHAR)"
        if f["field"] == "resources":
            listed = [c, f"CASE WHEN {c} IS NOT NULL THEN 'AWS::S3::Bucket' END"]
        else:
            listed = [c]
        one = {
            "equals": lambda c, v=v: f"{c} = '{v}'", "not_equals": lambda c, v=v: f"{c} IS DISTINCT FROM '{v}'", "contains": lambda c, v=v: f"contains({c}, '{v}')",
            "in": lambda c, v=v: f"{c} IN ({', '.join(repr(x) for x in v)})", "regex": lambda c, v=v: f"regexp_matches({c}, '{v}')",
        }[op]
        tests.append("(" + " OR ".join(f"coalesce({one(x)}, false)" for x in listed) + ")")
    return " AND ".join(tests)


RULES = load_rules()
HITS = "hits AS (" + " UNION ALL ".join(f"SELECT '{r['id']}' AS rule_id, * FROM ev WHERE {W} AND {rule_sql(r)}" for r in RULES) + ")"
RULE_ROWS = "rules(rule_id, name, severity, class_uid, threshold, row_limit, mitre) AS (VALUES " + ", ".join(f"('{r['id']}', '{r['name']}', '{r['severity']}', {r['class_uid']}, {r['threshold']}, {r['limit']}, '{','.join(r['mitre'])}')" for r in RULES) + ")"
RESULTS = """results AS (
  SELECT r.*, coalesce(n, 0) AS total_matches, least(coalesce(n, 0), least(row_limit, 10000)) AS match_count,
         least(coalesce(n, 0), least(row_limit, 10000)) >= threshold AS triggered
  FROM rules r LEFT JOIN (SELECT rule_id, count(*) AS n FROM hits GROUP BY 1) USING (rule_id))"""
DETECT = (EV, HITS, RULE_ROWS, RESULTS)
