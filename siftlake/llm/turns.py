"""Prefix trie of conversations (operator 13): what conversations with equal beginnings share.

A turn is the 128-bit fingerprint of its role and text with the text's bytes; texts go no further than the scan. Equal
turn sequences are one row with the number of conversations and the smallest of them, counted before the shuffle, so a
conversation that is copied any number of times is one row, and rows are dealt by ranges of whole sequences (``shards``).
A shard numbers its turns, fills a padded matrix of turn numbers (blocks of ``COLUMNS``, deeper blocks only for the rows
that reach them) and orders the rows by numpy lexsort. Changes from row to row, OR-accumulated along the columns, mark
where nodes start; reduceat sums each depth's nodes over the rows between the marks, from the deepest depth up.

Only nodes on the path of a shard's first or last row can go on in a neighbour. They leave the shard as parts without
what other such nodes add. Parts with the same prefix are summed; in the order of the shards a node's open descendants
are those that are new between its first and last place, so prefix sums over two rows a shard (places) and over the depth
of a place give whole subtrees. Children of such nodes get their parent's number by a join on (place, depth).

The hash of the conversations that end at a node needs their numbers in ascending order, whatever their count. They are
dealt by ranges of conv_id, each task joins those of one sequence into texts of up to ``TEXT`` bytes, and one stream for
each sequence reads these texts in order; it holds one at a time. SHA-256 is serial, so a sequence that a third of all
conversations share is hashed by one task, from some ten bytes a conversation.

Rows without a conv_id belong to none; a null turn comes first; null roles and texts are empty; rows of one conversation
that have the same turn are ordered by their fingerprint, repeated ones stay. The turns of a conversation come together
in one row (24 bytes each, whatever the length of the texts). Columns of other names are left out. An empty table gives
no rows, not even the root, which has no member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import no_null, stored, table, worker_state

#: Turns that a shard should have, columns of a block of the matrix, bytes of a text of joined numbers, bytes of such
#: texts that a task holds.
SHARD_TURNS, COLUMNS, TEXT, TEXTS_HELD = 1 << 20, 32, 1 << 18, 1 << 25
NO_ONE = hashlib.sha256(b"").hexdigest()

SEQUENCE = "array<struct<hi:bigint,lo:bigint,size:bigint>>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, place long, prefix string, parent_prefix string, parent_place long, last_size long"


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, t): the turns of each conversation in order, as (hi, lo, size)."""
    mark = F.sha2(F.concat(F.octet_length(no_null(role)).cast("string"), F.lit(":"), no_null(role), no_null(text)), 256)
    half = lambda k: F.conv(F.substring("mark", k, 16), 16, -10).cast("long")
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), mark.alias("mark"), F.octet_length(no_null(text)).cast("long").alias("size"))
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("told"), "turn", half(1).alias("hi"), half(17).alias("lo"), "size"))).alias("t"))
    return whole.select("conv", F.transform("t", lambda x: F.struct(x["hi"].alias("hi"), x["lo"].alias("lo"), x["size"].alias("size"))).alias("t"))


def rebuilt(rows: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Each conversation with the first ``head`` turns (at most ``most``) of conversation ``base`` in place of its own
    first ``head``; without any if there is no such conversation."""
    own = rows.select("conv", "t", base.cast("long").alias("base"), head.cast("int").alias("h"))
    heads = rows.select(F.col("conv").alias("base"), F.slice("t", 1, most).alias("first"))
    got = own.join(heads, "base", "left")
    start = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.array().cast(SEQUENCE))
    rest = F.slice("t", F.col("h") + 1, F.greatest(F.size("t") - F.col("h"), F.lit(0)))
    return got.select("conv", F.concat(start, rest).alias("t"))


def ends(rows: DataFrame) -> DataFrame:
    """(mark, ends_sha256): for the conversations (mark, conv) of each mark, the hash of their numbers, ascending."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("ends",))
        held: dict[str, list[str]] = {}
        firsts: dict[str, int] = {}
        sizes: dict[str, int] = {}
        total = 0

        def batch_of(marks: list[str]) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), pa.array([firsts[m] for m in marks], pa.int64()), pa.array([",".join(held[m]) for m in marks], pa.string())], ["mark", "first", "convs"])
            for m in marks:
                del held[m], firsts[m], sizes[m]
            return out

        for batch in batches:  # in ascending order of conv
            for mark, conv in zip(batch["mark"].to_pylist(), batch["conv"].to_pylist(), strict=True):
                held.setdefault(mark, []).append(str(conv))
                firsts.setdefault(mark, conv)
                sizes[mark] = sizes.get(mark, 100) + len(held[mark][-1]) + 1
                total += len(held[mark][-1]) + 60
                if sizes[mark] >= TEXT:
                    total -= sizes[mark]
                    yield batch_of([mark])
            if total >= TEXTS_HELD:
                yield batch_of(list(held))
                total = 0
        if held:
            yield batch_of(list(held))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("ends",))
        mark, state = None, None
        for batch in batches:  # in order of (mark, first)
            marks, hashes = [], []
            for m, convs in zip(batch["mark"].to_pylist(), batch["convs"].to_pylist(), strict=True):
                if m == mark:
                    state.update(b",")
                else:
                    if mark is not None:
                        marks.append(mark)
                        hashes.append(state.hexdigest())
                    mark, state = m, hashlib.sha256()
                state.update(convs.encode())
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), pa.array(hashes, pa.string())], ["mark", "ends_sha256"])
        if mark is not None:
            yield pa.RecordBatch.from_arrays([pa.array([mark]), pa.array([state.hexdigest()])], ["mark", "ends_sha256"])

    texts = rows.repartitionByRange("conv").sortWithinPartitions("conv").select("mark", "conv").mapInArrow(joined, "mark string, first long, convs string")
    return texts.repartition("mark").sortWithinPartitions("mark", "first").mapInArrow(hashed, "mark string, ends_sha256 string")


class Shard:
    """Distinct sequences, in ascending order after ``__init__``: ``length``, ``flat`` turn numbers with ``at``, where
    each begins, ``change``: the first column (from 1) in which a row differs from the one before."""

    def __init__(self, offsets: np.ndarray, hi: np.ndarray, lo: np.ndarray):
        n = len(offsets) - 1
        # numbers follow the order of (hi, lo), so they sort as the shards are dealt; 0 is padding
        by = np.lexsort((lo, hi))
        new = np.ones(len(by), bool)
        new[1:] = (hi[by][1:] != hi[by][:-1]) | (lo[by][1:] != lo[by][:-1])
        self.flat = np.empty(len(by), np.int64)
        self.flat[by] = np.cumsum(new)
        self.at, self.length = offsets[:-1].copy(), np.diff(offsets)
        self.order = np.arange(n)
        self._sort()
        self.at, self.length = self.at[self.order], self.length[self.order]
        self.change = self._changes()

    def block(self, rows: np.ndarray, first: int, width: int) -> np.ndarray:
        """Columns first to first + width of the padded matrix."""
        at = self.at[rows, None] + np.arange(first, first + width)
        real = np.arange(first, first + width) < self.length[rows, None]
        out = np.zeros(at.shape, np.int64)
        out[real] = self.flat[at[real]]
        return out

    def _sort(self) -> None:
        """Block by block: only rows that are equal so far and reach the block are ordered by it."""
        group = np.zeros(len(self.order), np.int64)
        for k in range(0, int(self.length.max(initial=0)), COLUMNS):
            live = np.flatnonzero(self.length[self.order] >= k)
            rows, mine = self.order[live], group[live]
            cols = self.block(rows, k, min(COLUMNS, int(self.length.max()) - k))
            by = np.lexsort((*cols.T[::-1], mine))
            self.order[live] = rows[by]
            cols, mine = cols[by], mine[by]
            new = np.ones(len(by), bool)
            new[1:] = (mine[1:] != mine[:-1]) | (cols[1:] != cols[:-1]).any(axis=1)
            group[live] = np.cumsum(new)

    def _changes(self) -> np.ndarray:
        out = np.ones(len(self.at), np.int64)
        same = np.arange(1, len(self.at))  # rows that equal the one before in all columns so far
        for k in range(0, int(self.length.max(initial=0)) + 1, COLUMNS):
            if not len(same):
                break
            width = min(COLUMNS, int(self.length.max()) + 1 - k)
            marks = np.logical_or.accumulate(self.block(same, k, width) != self.block(same - 1, k, width), axis=1)
            out[same] = k + 1 + (~marks).sum(axis=1)
            same = same[~marks[:, -1]]
        return out

    def starts(self, depth: int, rows: np.ndarray) -> np.ndarray:
        """Places in ``rows`` (those that reach ``depth``) where a node of that depth starts."""
        out = self.change[rows] <= depth
        out[0] = True
        return np.flatnonzero(out)


def nodes(offsets: np.ndarray, hi: np.ndarray, lo: np.ndarray, size: np.ndarray, n_convs: np.ndarray, least: np.ndarray, ended: list[str], place: int) -> Iterator[pa.RecordBatch]:
    """Rows of NODE for a shard of distinct sequences, its first and last path as parts (with ``place`` and prefix)."""
    shard = Shard(offsets, hi, lo)
    n, length, change = len(n_convs), shard.length, shard.change
    count, smallest, order = n_convs[shard.order], least[shard.order], shard.order
    deepest, last = int(length.max()), n - 1
    prefixes = {row: _prefixes(offsets, hi, lo, int(order[row]), int(length[row])) for row in {0, last}}
    # a row whose sequence the next one doesn't go on from ends at a leaf; what open nodes are is told later
    leaf = np.ones(n, np.int64)
    leaf[:-1] = change[1:] <= length[:-1]
    leaf[[0, last]] = 0
    saved = np.zeros(n, np.int64)
    child = np.zeros(n, np.int64)  # of the depth below: 1 where a closed node starts
    reach = [0] * (deepest + 2)
    by_length = np.argsort(-length, kind="stable")
    reach_of = -np.sort(-length)
    for d in range(deepest + 1):
        reach[d] = int(np.searchsorted(-reach_of, -d, "right"))
    inner: tuple | None = None  # of the depth below, whose parents are found at this depth
    for depth in range(deepest, -1, -1):
        rows = np.sort(by_length[: reach[depth]])
        starts = shard.starts(depth, rows)
        top = rows[starts]
        total, first = np.add.reduceat(count[rows], starts), np.minimum.reduceat(smallest[rows], starts)
        is_open = np.zeros(len(top), bool)
        is_open[0] |= rows[0] == 0
        is_open[-1] |= rows[-1] == last
        text = size[shard.at[top] + depth - 1] if depth else np.zeros(len(top), np.int64)
        saved[top[~is_open]] += ((total - 1) * text)[~is_open]
        sums = [np.add.reduceat(x[rows], starts) for x in (child, leaf, saved)]
        ends_here = [ended[order[k]] if length[k] == depth else NO_ONE for k in top.tolist()]
        if inner is not None:
            yield _rows(inner, np.searchsorted(rows[starts], inner[0], "right") - 1, first, is_open, top, prefixes, place, last)
        inner = (top, depth, first, total, sums, ends_here, is_open, text)
        child[:] = 0
        child[top[~is_open]] = 1
    yield _rows(inner, None, None, None, None, prefixes, place, last)


def _prefixes(offsets: np.ndarray, hi: np.ndarray, lo: np.ndarray, row: int, length: int) -> list[str]:
    """Fingerprint of each beginning of a sequence."""
    data = np.stack([hi[offsets[row] : offsets[row] + length], lo[offsets[row] : offsets[row] + length]], axis=1).astype("<i8").tobytes()
    state = hashlib.sha256()
    out = [state.hexdigest()]
    for k in range(length):
        state.update(data[16 * k : 16 * k + 16])
        out.append(state.hexdigest())
    return out


def _rows(inner: tuple, parent: np.ndarray | None, first: np.ndarray | None, parent_open: np.ndarray | None, parent_top: np.ndarray | None, prefixes: dict[int, list[str]], place: int, last: int) -> pa.RecordBatch:
    """Nodes of one depth. Open ones get their place (twice the shard for the first path, one more for the last), and
    one on both paths a second, empty part; children of open nodes the place of their parent."""
    top, depth, least, total, sums, ended, is_open, text = inner
    n = len(top)
    up = np.full(n, -1, np.int64)  # place of an open parent
    known = np.zeros(n, bool)
    parents = np.zeros(n, np.int64)
    if parent is not None:
        known = ~parent_open[parent]
        parents = first[parent]
        up = np.where(known, -1, np.where(parent_top[parent] == 0, 2 * place, 2 * place + 1))
    out = {
        "conv_id": pa.array(least), "depth": pa.array(np.full(n, depth, np.int64)), "parent_conv_id": pa.array(parents, mask=~known), "n_convs": pa.array(total),
        "n_children": pa.array(sums[0]), "n_leaves": pa.array(sums[1]), "saved_tokens": pa.array(sums[2]), "ends_sha256": pa.array(ended, pa.string()),
    }
    at, prefix, above = [None] * n, [None] * n, [None] * n
    twice = None
    for k in np.flatnonzero(is_open).tolist():
        row = 0 if top[k] == 0 else last
        at[k], prefix[k], above[k] = 2 * place + (row != 0), prefixes[row][depth], prefixes[row][depth - 1] if depth else None
        if row == 0 and k == n - 1 and len(prefixes[last]) > depth and prefixes[last][depth] == prefixes[0][depth]:
            twice = k
    out |= {"place": pa.array(at, pa.int64()), "prefix": pa.array(prefix, pa.string()), "parent_prefix": pa.array(above, pa.string()), "parent_place": pa.array(up, mask=up < 0), "last_size": pa.array(text)}
    batch = pa.RecordBatch.from_pydict(out)
    if twice is not None:
        zero = {name: [None if name in ("conv_id", "parent_conv_id", "parent_place") else 0 if name in ("n_convs", "n_children", "n_leaves", "saved_tokens") else batch[name][twice].as_py()] for name in out}
        more = pa.RecordBatch.from_pydict(zero | {"place": [2 * place + 1], "ends_sha256": [NO_ONE]}, schema=batch.schema)
        batch = pa.Table.from_batches([batch, more]).combine_chunks().to_batches()[0]
    return batch


def _in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state(("shard",))
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    got = pa.Table.from_batches(parts).combine_chunks()
    listed = got["t"].chunk(0) if got["t"].num_chunks else got["t"]
    turns = listed.flatten()
    offsets = np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    hi, lo, size = (turns.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    yield from nodes(offsets, hi, lo, size, got["n"].to_numpy(), got["least"].to_numpy(), got["ends_sha256"].to_pylist(), TaskContext.get().partitionId())


def trie(rows: DataFrame) -> DataFrame:
    """rows (conv, t) with one row a conversation. One row a node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    rows = stored(rows, "turn-sequences")
    # two hashes with different seeds name a sequence among the ends
    mark = F.concat_ws("-", F.lpad(F.hex(F.xxhash64("t")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), F.col("t"))), 16, "0"), F.size("t"))
    hashes = ends(rows.select(mark.alias("mark"), "conv"))
    distinct = rows.groupBy("t").agg(F.count("*").alias("n"), F.min("conv").alias("least")).withColumn("mark", mark)
    whole = stored(distinct.join(hashes, "mark").select("t", "n", "least", "ends_sha256"), "turn-classes")
    turns = whole.agg(F.sum(F.size("t") + 1)).first()[0] or 0
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    got = stored(whole.repartitionByRange(shards, "t").mapInArrow(_in_shards, NODE), "turn-nodes")
    closed = got.where("place IS NULL")

    parts = got.where("place IS NOT NULL")
    merged = parts.groupBy("depth", "prefix").agg(
        F.min("place").alias("from"), F.max("place").alias("to"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved"), F.max("last_size").alias("last_size"), F.max("parent_prefix").alias("parent_prefix"), F.coalesce(F.max(F.when(F.col("ends_sha256") != NO_ONE, F.col("ends_sha256"))), F.lit(NO_ONE)).alias("ends_sha256"),
    )
    merged = stored(merged, "open-nodes")
    below = merged.groupBy(F.col("parent_prefix").alias("prefix")).agg(F.count("*").alias("more"))
    own = merged.join(below, "prefix", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).select(
        "*", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"), ((F.col("n_convs") - 1) * F.col("last_size")).alias("own")
    )
    up = Window.partitionBy("from").orderBy(F.desc("depth"))
    deep = stored(own.select("*", F.sum("leaf").over(up).alias("leaves"), F.sum("own").over(up).alias("owns")), "open-sums")
    # one row a place, two places a shard
    places = deep.groupBy(F.col("from").alias("place")).agg(F.sum("leaf").alias("l"), F.sum("own").alias("s"))
    so_far = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(Window.orderBy("place")).alias(c)
    places = stored(parts.select("place").distinct().join(places, "place", "left").select("place", so_far("l"), so_far("s")), "places")
    at = lambda side, n: places.select(F.col("place").alias(side), F.col("l").alias(f"l{n}"), F.col("s").alias(f"s{n}"))
    named = deep.select(F.col("prefix").alias("parent_prefix"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    opened = deep.join(at("from", 1), "from").join(at("to", 2), "to").join(named, "parent_prefix", "left").withColumns(
        {"n_leaves": F.expr("n_leaves + leaves + l2 - l1"), "saved_tokens": F.expr("saved + owns + s2 - s1")}
    )
    of_place = parts.join(deep.select("prefix", F.col("conv_id").alias("up")), "prefix").select(F.col("place").alias("parent_place"), (F.col("depth") + 1).alias("depth"), "up")
    hanging = closed.where("parent_place IS NOT NULL").join(of_place, ["parent_place", "depth"]).withColumn("parent_conv_id", F.col("up"))
    return closed.where("parent_place IS NULL").select(*columns).unionByName(hanging.select(*columns)).unionByName(opened.select(*columns))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c begins with the first crc32(c) % 9 turns of conversation c - c % 5."""
    rows = stored(sequences(table(spark, sf_dir, "conversations")), "turns")
    c = F.col("conv")
    return trie(rebuilt(rows, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, most=8))


OP13_SQL = """
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]),
    lambda v, b: list_reduce(list_prepend(xor(v, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda u, z: xor(u >> 1, (u & 1) * 3988292384)))) % 9 AS h
  FROM (SELECT DISTINCT c FROM own)),
turns AS (
  SELECT convs.c, 0 AS side, p, role, text FROM convs JOIN own ON own.c = base AND p <= h
  UNION ALL SELECT c, 1, p, role, text FROM convs JOIN own USING (c) WHERE p > h),
built AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY side, p) AS d, md5(strlen(role) || ':' || role || text) AS mark FROM turns),
paths AS (
  SELECT c, d, string_agg(mark, '') OVER (PARTITION BY c ORDER BY d) AS node, strlen(text) AS size FROM built
  UNION ALL SELECT c, 0, '', 0 FROM convs),
nodes AS (SELECT node, d AS depth, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size FROM paths GROUP BY ALL),
family AS (SELECT n.*, p.conv_id AS parent_conv_id, p.node AS parent FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = left(n.node, 32 * (n.depth::INT - 1)) AND n.depth > 0),
children AS (SELECT parent AS node, count(*) AS n_children FROM family WHERE parent IS NOT NULL GROUP BY 1),
below AS (SELECT DISTINCT a.node, b.node AS inner_node FROM paths a JOIN paths b ON a.c = b.c AND a.d <= b.d),
sums AS (
  SELECT below.node, sum((n_convs - 1) * size)::BIGINT AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves
  FROM below JOIN nodes ON nodes.node = inner_node LEFT JOIN children k ON k.node = inner_node GROUP BY 1),
lasts AS (SELECT c, arg_max(node, d) AS node FROM paths GROUP BY 1),
ended AS (SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256 FROM lasts GROUP BY 1)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM family JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN ended USING (node)
"""
