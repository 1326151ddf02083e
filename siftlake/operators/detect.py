"""Detection: scans, and all rules in one scan (SRC1 to SRC6, SRC12, DET1 to DET12)."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from pathlib import Path

try:  # rule files may be YAML where the package is there
    import yaml
except ImportError:
    yaml = None
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import field, field_sql
from ..functions.predicates import all_of, all_sql, any_of, compile_all, is_ipv4, text_sql
from ..sources.catalog import ALIASES
from ..sources.schema import CLASS_UID
from .lineage import cut

MOST_ROWS, SAMPLE = 10_000, 100


def _read(path: Path) -> list[dict]:
    """The rule of a file, or its list of rules: YAML by its suffix (several documents too), else JSON."""
    text = path.read_text(encoding="utf-8")
    if path.suffix not in (".yaml", ".yml"):
        found = json.loads(text)
    elif yaml is None:
        raise ImportError("rules as YAML need the yaml package")
    else:
        try:
            found = [y for x in yaml.safe_load_all(text) if x is not None for y in (x if isinstance(x, list) else [x])]
        except yaml.YAMLError as e:
            raise ValueError(str(e)) from e
    return found if isinstance(found, list) else [found]


def load_rules(*paths: str | Path) -> list[dict]:
    """Rule specifications of files, each a rule or a list of rules, JSON or YAML; without ``paths`` the bundled ones
    (fixed values). A bad rule drops its file, a later duplicate id wins. Techniques are ``mitre`` or ``mitre_attack``."""
    found: dict[str, dict] = {}
    for path in paths or [Path(__file__).with_name("rules.json")]:
        try:
            specs = [{**s, "mitre": s.get("mitre", s.get("mitre_attack", []))} for s in _read(Path(path))]
            checked = [{"name": s["id"].replace("detect-", "").replace("-", " ").capitalize(), "enabled": True, "severity": "medium", "tags": [], "group_by": [], "data_sources": [], **s, "class_uid": CLASS_UID[s["event_class"]], "threshold": int(s.get("threshold", 1)), "limit": int(s.get("limit", 1000))} for s in specs]
        except (AttributeError, KeyError, TypeError, ValueError):
            continue
        found |= {s["id"]: s for s in checked}
    return [*found.values()]


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    rows = [(r["id"], r["name"], r["severity"], r["class_uid"], r["event_class"], r["threshold"], r["limit"], len(r["filters"]), r["enabled"], r["mitre"], r["data_sources"], r["tags"]) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, name string, severity string, class_uid int, event_class string, threshold long, row_limit long, filter_count int, enabled boolean, mitre array<string>, data_sources array<string>, tags array<string>")


def in_window(start: datetime | str, end: datetime | str, time: str = "time_dt") -> Column:
    """Half-open: start included, end not."""
    return (F.col(time) >= F.lit(str(start)).cast("timestamp")) & (F.col(time) < F.lit(str(end)).cast("timestamp"))


def scan(events: DataFrame, class_uid: int | None, start, end, where: Column | None = None, limit: int | None = None, strict: bool = True) -> DataFrame:
    """Events of a class in a time window that satisfy a predicate; all of them, or the first ``limit``.

    A limit above MOST_ROWS is an error, or, if not ``strict``, MOST_ROWS is taken, as the search interface does.
    """
    if strict and limit is not None and limit > MOST_ROWS:
        raise ValueError(f"at most {MOST_ROWS} rows, or None for all")
    rows = events.where(in_window(start, end))
    if class_uid is not None:
        rows = rows.where(F.col("class_uid") == class_uid)
    if where is not None:
        rows = rows.where(where)
    return rows if limit is None else rows.orderBy("time_dt", "event_uid").limit(min(limit, MOST_ROWS))


def authentication(events: DataFrame, start, end, status: str | None = None) -> DataFrame:
    return scan(events, 3002, start, end, None if status is None else field(events, "status") == status)


def api_activity(events: DataFrame, start, end, service: str | None = None, operation: str | None = None) -> DataFrame:
    tests = [field(events, p) == v for p, v in (("api.service.name", service), ("api.operation", operation)) if v is not None]
    return scan(events, 6003, start, end, all_of(tests))


def network(events: DataFrame, start, end, src_ip: str | None = None, dst_ip: str | None = None, dst_port: int | None = None) -> DataFrame:
    tests = [(field(events, p) == v) & is_ipv4(F.lit(v)) for p, v in (("src_endpoint.ip", src_ip), ("dst_endpoint.ip", dst_ip)) if v is not None]
    return scan(events, 4001, start, end, all_of(tests + ([field(events, "dst_endpoint.port") == F.lit(dst_port)] if dst_port is not None else [])))


def findings(events: DataFrame, start, end, severity: str | None = None) -> DataFrame:
    return scan(events, 2001, start, end, None if severity is None else field(events, "severity") == severity)


def rule_predicate(events: DataFrame, rule: dict) -> Column:
    return F.expr(f"class_uid = {rule['class_uid']} AND {all_sql(events, rule['filters'])}")


def rule_marks(events: DataFrame, rules: list[dict]) -> Column:
    """The ids of the rules that an event matches; only the rules of its class are tested. Null for other classes."""
    of: dict[int, list[str]] = {}
    for r in rules:
        of.setdefault(r["class_uid"], []).append(f"CASE WHEN {all_sql(events, r['filters'])} THEN {text_sql(r['id'])} END")
    branches = " ".join(f"WHEN {c} THEN array({', '.join(marks)})" for c, marks in of.items())
    return F.expr(f"array_compact(CASE class_uid {branches} END)") if of else F.array().cast("array<string>")


def coarse(events: DataFrame, rules: list[dict], start, end) -> Column:
    """A filter that every match passes and that reaches the file scan: window, classes in use, operations in use."""
    test = in_window(start, end) & F.col("class_uid").isin(sorted({r["class_uid"] for r in rules}))
    operations = [next((f["in"] if "in" in f else [f["equals"]] for f in r["filters"] if f["field"] == "api.operation" and ("in" in f or "equals" in f)), None) for r in rules]
    if rules and None not in operations:
        test &= F.expr(f"{field_sql(events, 'api.operation')} IN ({', '.join(map(text_sql, sorted({x for xs in operations for x in xs})))})")
    return test


def hits(events: DataFrame, rules: list[dict], start, end) -> DataFrame:
    """One row for each event and rule that it matches, from one scan of the events, with the events' columns."""
    return events.where(coarse(events, rules, start, end)).withColumn("rule_id", F.explode(rule_marks(events, rules)))


def evaluate(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """Threshold evaluation of (rule_id, total_matches) for all rules, those without a match included."""
    rows = F.broadcast(rules).join(counts, "rule_id", "left").withColumn("total_matches", F.coalesce("total_matches", F.lit(0).cast("long")))
    rows = rows.withColumn("match_count", F.least("total_matches", F.least("row_limit", F.lit(MOST_ROWS).cast("long")))).withColumn("triggered", F.col("total_matches") >= F.col("threshold"))
    said = F.when(F.col("triggered"), F.format_string("Detection '%s' triggered with %d matches (threshold: %d)", "name", "match_count", "threshold"))
    return rows.withColumn("message", said.otherwise(F.format_string("Detection '%s' did not trigger (%d matches, threshold: %d)", "name", "match_count", "threshold")))


def run_all(events: DataFrame, rules: list[dict], start, end) -> DataFrame:
    """Every rule over the window in one scan and one shuffle of partial counts."""
    counts = hits(events, rules, start, end).groupBy("rule_id").agg(F.count("*").alias("total_matches"))
    return evaluate(counts, rule_table(events.sparkSession, rules))


def run_rule(events: DataFrame, rules: list[dict], rule_id: str, end: datetime, start: datetime | None = None, lookback_minutes: int = 60) -> DataFrame:
    """One rule over a window, by default the ``lookback_minutes`` before ``end``: its result, or a row that tells the error.

    A rule that is unknown, or whose predicate cannot be resolved on these events, does not trigger and says why.
    """
    begin = start or end - timedelta(minutes=lookback_minutes)
    rule = next((r for r in rules if r["id"] == rule_id), None)
    error = f"Rule not found: {rule_id}"
    if rule is not None:
        try:
            rows = run_all(events, [rule], begin, end).select("rule_id", "name", "severity", "match_count", "triggered", "message", F.lit(None).cast("string").alias("error"))
        except AnalysisException as e:
            error = e.getMessage().splitlines()[0]
    if rule is None or error != f"Rule not found: {rule_id}":
        told = (rule_id, rule["name"] if rule else "Unknown", rule["severity"] if rule else "info", 0, False, "", error)
        rows = events.sparkSession.createDataFrame([told], "rule_id string, name string, severity string, match_count long, triggered boolean, message string, error string")
    return rows.withColumns({"window_start": F.lit(begin), "window_end": F.lit(end)})


def for_source(rules: list[dict], source: str | None) -> list[dict]:
    """Enabled rules of a source; rules without sources hold for any."""
    return [r for r in rules if r["enabled"] and (source is None or not r["data_sources"] or source in r["data_sources"] or source in [ALIASES.get(s, s) for s in r["data_sources"]])]


def samples(found: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The first ``n`` hits of each rule in time order."""
    order = F.row_number().over(Window.partitionBy("rule_id").orderBy("time_dt", "event_uid"))
    return found.withColumn("sample_rank", order).where(F.col("sample_rank") <= n)


def count_and_sample(found: DataFrame, n: int = SAMPLE) -> DataFrame:
    """rule_id, total_matches, and the ids of the first ``n`` hits, from one scan of the events.

    The hits' rules, times and ids are kept once and read twice: counted by partial sums, and cut to ``n`` a rule in each
    task before they are shuffled.
    """
    found = cut(found.select("rule_id", "time_dt", "event_uid"))
    first = samples(found, n).groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_rank", "event_uid"))), lambda x: x["event_uid"]).alias("sample"))
    return found.groupBy("rule_id").agg(F.count("*").alias("total_matches")).join(first, "rule_id")


def grouped_threshold(found: DataFrame, by: str, threshold: int) -> DataFrame:
    """Extension: groups of a field's values whose hits reach the threshold."""
    return found.groupBy("rule_id", field(found, by).alias("group_value")).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


def self_test(spark: SparkSession, cases: list[dict], rules: list[dict]) -> DataFrame:
    """Embedded test cases: flat events -> filters -> threshold -> expected outcome, one row a case."""
    by_id, out = {r["id"]: r for r in rules}, []
    columns = sorted({f["field"] for r in rules for f in r["filters"]} | {k for c in cases for e in c["events"] for k in e})
    rows = [(n, c["rule_id"], k, *[None if e.get(x) is None else str(e[x]) for x in columns]) for n, c in enumerate(cases) for k, e in enumerate(c["events"])]
    flat = spark.createDataFrame(rows, "n int, rule_id string, k int, " + ", ".join(f"`{c}` string" for c in columns))
    match = any_of([(F.col("rule_id") == i) & compile_all(flat, by_id[i]["filters"]) for i in {c["rule_id"] for c in cases}])
    counts = flat.where(match).groupBy("n").agg(F.count("*").alias("match_count"))
    for n, c in enumerate(cases):
        want = c["expected"]
        out.append((n, c["rule_id"], c["name"], want["triggered"], want.get("match_count"), want.get("threshold_override", by_id[c["rule_id"]]["threshold"])))
    told = spark.createDataFrame(out, "n int, rule_id string, name string, expected boolean, expected_count long, threshold long")
    got = told.join(counts, "n", "left").withColumn("match_count", F.coalesce("match_count", F.lit(0).cast("long")))
    ok = ((F.col("match_count") >= F.col("threshold")) == F.col("expected")) & (F.col("expected_count").isNull() | (F.col("expected_count") == F.col("match_count")))
    return got.select("rule_id", "name", "match_count", "threshold", "expected", ok.alias("passed"))


def bundled_cases() -> list[dict]:
    """The test cases that come with the bundled rules (rule, name, events, expected outcome)."""
    return json.loads(Path(__file__).with_name("rule_cases.json").read_text(encoding="utf-8"))


def cases_of(rules: list[dict]) -> list[dict]:
    """Two cases a rule made from its own predicate: threshold many matching events, and as many that miss one filter."""
    out = []
    for r in rules:
        hit: dict[str, str] = {}
        for f in r["filters"]:
            op, v = next((k, v) for k, v in f.items() if k != "field")
            hit[f["field"]] = {"equals": v, "in": v[0], "contains": f"x{v}y", "not_equals": f"not {v}", "regex": "1234567890"}[op]
        first = r["filters"][0]
        miss = hit | {first["field"]: "something else"}
        n = max(1, r["threshold"])
        out.append({"rule_id": r["id"], "name": "match", "events": [hit] * n, "expected": {"triggered": True, "match_count": n}})
        out.append({"rule_id": r["id"], "name": "miss", "events": [miss] * n, "expected": {"triggered": r["threshold"] == 0}})
    return out
