"""K-d tree shards (operator 10).

A node of the tree holds a number of shards. It is split across the metadata dimension in which its rows lie widest
(relative to the whole table), at the weighted quantile that gives each side its part of the shards; a leaf holds one.
With ``target_bytes`` the number of shards is the total over the target, so that leaves reach the target size.

Quantiles are found by all executors together: each pass sums the sizes of a node's rows by ``BINS`` intervals, keeps
the interval that holds the quantile, and goes on inside it. Rows that share a coordinate are told apart by a hash of
their text, then by their id, so a value, a source or a group of copies that holds a third of all rows is cut like any
other, and copies mostly stay together. All nodes of a level are handled in the same pass. The driver sees a few
numbers for each node.

Null texts weigh one byte; null metadata is a value of its own (0 after hashing). Rows with the same id and text count
one by one. A text that weighs more than a shard has one to itself, and its neighbours fill the others. Columns of other
names are left out. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import no_null, stored, table

BINS = 4096
#: A quantile is near enough once its interval holds this part of the node, or one row.
NEAR = 1 / 8192
#: Rows that are numbered together within a shard.
SLOT_ROWS = 50_000


def coordinate(df: DataFrame, name: str) -> Column:
    """A metadata column as a long: numbers as they are, other values by a hash."""
    kind = df.schema[name].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))
    return F.coalesce(F.crc32(F.col(name).cast("string")), F.lit(0).cast("long"))


def kd_shards(df: DataFrame, dims: list[str], n_shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot of each row. ``size``: UTF-8 bytes of the text plus 1."""
    body = no_null(text)
    rows = stored(
        df.select(
            F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(body), 2).alias("h"), F.coalesce(F.xxhash64(F.col(key)), F.lit(0)).alias("i"),
            F.array((F.octet_length(body) + 1).cast("long"), *[coordinate(df, c) for c in dims]).alias("x"),
        ).withColumn("i", F.shiftrightunsigned("i", 2)),
        "shard-rows",
    )
    n_dims = 1 + len(dims)
    whole = rows.agg(F.sum("size").alias("w"), *[f(F.col("x")[k]).alias(f"{n}{k}") for k in range(n_dims) for n, f in (("a", F.min), ("b", F.max))]).first()
    if whole["w"] is None:
        n_shards = 1
    elif n_shards is None:
        n_shards = max(1, -(-whole["w"] // target_bytes))
    spread = [max(1, (whole[f"b{k}"] or 0) - (whole[f"a{k}"] or 0)) for k in range(n_dims)]
    nodes = {0: n_shards}  # first shard of a node -> its number of shards
    rows = rows.withColumn("shard", F.lit(0))
    while any(n > 1 for n in nodes.values()):
        cuts = _cuts(rows, nodes, spread)
        if not cuts:
            break
        table_of = rows.sparkSession.createDataFrame(cuts, "shard int, dim int, v long, vh long, vi long, right int")  # one row a node
        point = F.struct(F.element_at("x", F.col("dim") + 1), F.col("h"), F.col("i"))
        right = F.col("right").isNotNull() & (point >= F.struct("v", "vh", "vi"))
        rows = rows.join(F.broadcast(table_of), "shard", "left").select("size", key, "text_crc32", "h", "i", "x", F.when(right, F.col("right")).otherwise(F.col("shard")).alias("shard"))
        nodes = {s: n for node, n in nodes.items() for s, n in ([(node, n // 2), (node + n // 2, n - n // 2)] if n > 1 else [(node, n)])}
    return _slots(stored(rows.select(key, "size", "text_crc32", "shard", "i"), "sharded"), key)


def _cuts(rows: DataFrame, nodes: dict[int, int], spread: list[int]) -> list[tuple]:
    """(node, dimension, cut point, first shard of the right side) of each node with more than one shard."""
    spark = rows.sparkSession
    rows = rows.where(F.col("shard").isin([s for s, n in nodes.items() if n > 1]) if len(nodes) < 200 else F.lit(True))
    seen = rows.groupBy("shard").agg(F.sum("size").alias("w"), *[f(F.col("x")[k]).alias(f"{n}{k}") for k in range(len(spread)) for n, f in (("a", F.min), ("b", F.max))]).collect()  # one row a node
    state = {}
    for r in seen:
        if (n := nodes[r["shard"]]) > 1:
            dim = max(range(len(spread)), key=lambda k: ((r[f"b{k}"] - r[f"a{k}"]) / spread[k], -k))
            state[r["shard"]] = {"dim": dim, "part": 0, "fix": [0, 0], "lo": r[f"a{dim}"], "hi": r[f"b{dim}"], "left": r["w"] * (n // 2) / n, "near": r["w"] * NEAR, "cut": None}
    while any(s["cut"] is None for s in state.values()):
        todo = [(k, s["dim"], s["part"], *s["fix"], s["lo"], max(1, -(-(s["hi"] - s["lo"] + 1) // BINS)), s["hi"], float(s["left"])) for k, s in state.items() if s["cut"] is None]
        plan = spark.createDataFrame(todo, "shard int, dim int, part int, f0 long, f1 long, lo long, step long, hi long, goal double")
        at = rows.join(F.broadcast(plan), "shard")  # one row a node
        v = F.element_at("x", F.col("dim") + 1)
        c = F.when(F.col("part") == 0, v).when(F.col("part") == 1, F.col("h")).otherwise(F.col("i"))
        at = at.where(((F.col("part") == 0) | (v == F.col("f0"))) & ((F.col("part") < 2) | (F.col("h") == F.col("f1")))).withColumn("c", c).where(F.col("c").between(F.col("lo"), F.col("hi")))
        bins = at.groupBy("shard", "goal", F.expr("(c - lo) div step").alias("bin")).agg(F.sum("size").alias("w"), F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("n"))
        upto = F.sum("w").over(Window.partitionBy("shard").orderBy("bin"))  # at most BINS rows a node
        picked = bins.withColumn("upto", upto).where("upto >= goal").groupBy("shard").agg(F.min_by(F.struct("w", "a", "b", "n", "upto"), "bin").alias("p")).collect()
        for r in picked:
            s, p = state[r["shard"]], r["p"]
            before = p["upto"] - p["w"]
            if p["w"] <= s["near"] or p["n"] == 1 or (p["a"] == p["b"] and s["part"] == 2):
                s["cut"] = (*s["fix"][: s["part"]], p["a"] if s["left"] - before < p["upto"] - s["left"] else p["b"] + 1, *[-1] * (2 - s["part"]))
            elif p["a"] == p["b"]:
                s["fix"][s["part"]] = p["a"]
                s |= {"part": s["part"] + 1, "lo": 0, "hi": (1 << 62) - 1, "left": s["left"] - before}
            else:
                s |= {"lo": p["a"], "hi": p["b"], "left": s["left"] - before}
    return [(k, s["dim"], *s["cut"], k + nodes[k] // 2) for k, s in state.items()]


def _slots(rows: DataFrame, key: str) -> DataFrame:
    """Gapless numbers within each shard: counts of small buckets first, then numbers inside each bucket."""
    buckets = max(1, -(-rows.count() // SLOT_ROWS))
    rows = rows.withColumn("bucket", (F.col("i") % buckets).cast("int"))
    sizes = rows.groupBy("shard", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("shard", "bucket", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("i", key, "text_crc32"))
    return rows.withColumn("place", place).join(offsets, ["shard", "bucket"]).select(key, "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kd_shards(table(spark, sf_dir, "documents"), ["n_chars", "lang", "source", "doc_id"], n_shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
