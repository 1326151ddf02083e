"""Exact duplicates with two Bloom passes (operator 4).

Pass one sets a bit for each row's fingerprint in a filter and, where all of its bits were set before, in a second one:
the second holds every fingerprint that occurs twice or more, and a few by chance. Pass two tests each row against the
second filter. Rows that miss it are certainly unique and pass straight through; only the others are shuffled and
compared by their full digest.

The filter is cut into segments, each built by one task from the bit positions that every input partition has already
merged for itself, so a text that fills a third of all rows sends each segment one position from each partition. Its
size follows the row count (``BITS_PER_ROW``). The second filter goes to all tasks in pieces of at most
``BROADCAST_BYTES``: with more than one piece, the rows are written by the piece that tests them (no shuffle), and each
piece's rows are read again with that piece alone.

Null text counts as empty, and empty texts are equal texts like others. Of equal texts the row with the most code points
stays, then the smallest key; rows that tie in both (repeated rows) count one by one, share their keep_id and stay or go
together. Null keys sort last. A key that has several texts is decided text by text. A text that fills a third of all
rows is joined with its verdict in pieces. Texts of any length are digested in the JVM. An empty table gives no rows.
Columns of other names are kept by ``keep_first``, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, no_null, split_join, squeezed, stored, table, worker_state

BITS_PER_ROW, HASHES, SEGMENT_BITS = 16, 3, 1 << 16
#: The largest piece of the second filter that is broadcast.
BROADCAST_BYTES = 64 << 20


def positions(prints: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each 64-bit fingerprint, and its HASHES bit positions there."""
    x = prints.astype(np.uint64)
    segment = (x >> np.uint64(40)) % np.uint64(segments)
    a, b = x & np.uint64(SEGMENT_BITS - 1), (x >> np.uint64(16)) & np.uint64(SEGMENT_BITS - 1) | np.uint64(1)
    at = np.stack([(a + np.uint64(k) * b) & np.uint64(SEGMENT_BITS - 1) for k in range(HASHES)], 1)
    return segment.astype(np.int64), at.astype(np.uint16)


def _marks(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """Each partition's distinct fingerprints by segment, and which of them it holds twice."""
    worker_state(("bloom",))
    for chunk in _gathered(batches):
        prints, counts = np.unique(chunk, return_counts=True)
        segment = positions(prints, segments)[0]
        order = np.argsort(segment, kind="stable")
        cuts = np.flatnonzero(np.diff(segment[order], prepend=-1))
        bounds = [*cuts.tolist(), len(order)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(segment[order][cuts].astype(np.int64)),
                pa.array([prints[order[a:b]].astype("<u8").tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                pa.array([(counts[order[a:b]] > 1).astype(np.uint8).tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
            ],
            ["segment", "prints", "twice"],
        )


def _gathered(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        n += len(held[-1])
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _segment_filter(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second filter of one segment."""
    seen, again, name = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool), None
    for batch in parts:
        for segment, prints, twice in zip(*(batch[c].to_pylist() for c in ("segment", "prints", "twice")), strict=True):
            name = segment
            at = positions(np.frombuffer(prints, "<u8"), 1)[1]
            # part by part: a print is known if all its bits were set by the parts before
            hit = seen[at].all(axis=1) | (np.frombuffer(twice, np.uint8) > 0)
            again[at[hit].ravel()] = True
            seen[at.ravel()] = True
            # two different prints of one part never need each other
    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([np.packbits(again).tobytes()], pa.binary())], ["segment", "bits"])


def repeated_filter(prints: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Second Bloom filter of a one-column DataFrame of 64-bit fingerprints: (segment, bits), and the segment count."""
    segments = max(1, -(-rows * BITS_PER_ROW // SEGMENT_BITS))
    marks = prints.mapInArrow(lambda it: _marks(it, segments), "segment long, prints binary, twice binary")
    return marks.groupBy("segment").applyInArrow(_segment_filter, "segment long, bits binary"), segments


def _test(bits: np.ndarray, segment: np.ndarray, at: np.ndarray) -> np.ndarray:
    base = segment[:, None] * SEGMENT_BITS + at
    return ((bits[base >> 3] >> (7 - (base & 7)).astype(np.uint8)) & 1).all(axis=1)


def with_print(rows: DataFrame, digest: str, n: int, names: tuple[str, str]) -> DataFrame:
    """``rows`` with the fingerprint of a digest column and the piece of a filter for ``n`` rows that tests it."""
    segments, a_piece = max(1, -(-n * BITS_PER_ROW // SEGMENT_BITS)), max(1, BROADCAST_BYTES * 8 // SEGMENT_BITS)
    number, piece = names
    # the segment that positions() takes: the fingerprint's upper 24 bits modulo the number of segments
    rows = rows.withColumn(number, F.xxhash64(digest))
    return rows.withColumn(piece, F.floor(F.shiftrightunsigned(number, 40) % F.lit(segments) / a_piece).cast("int"))


def split_repeated(rows: DataFrame, filters: DataFrame, n: int, names: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """The rows of with_print() in two: those that no other row has the fingerprint of, and the rest."""
    spark, (number, piece) = rows.sparkSession, names
    flag = f"tested {number}"
    segments, a_piece = max(1, -(-n * BITS_PER_ROW // SEGMENT_BITS)), max(1, BROADCAST_BYTES * 8 // SEGMENT_BITS)
    pieces = -(-segments // a_piece)
    if pieces == 1:
        parts = [(0, rows)]
    else:
        path = new_path(spark, "by-piece")
        rows.write.partitionBy(piece).parquet(path)
        again = spark.read.schema(rows.schema).parquet(path)
        parts = [(p, again.where(F.col(piece) == p)) for p in range(pieces)]
    unique, some = [], []
    for p, part in parts:
        first, stop = p * a_piece, min(segments, (p + 1) * a_piece)
        bits = np.zeros((stop - first, SEGMENT_BITS // 8), np.uint8)
        for row in filters.where(F.col("segment").between(first, stop - 1)).toLocalIterator():
            bits[row.segment - first] = np.frombuffer(row.bits, np.uint8)
        sent = spark.sparkContext.broadcast(bits.ravel())  # at most BROADCAST_BYTES

        @F.pandas_udf("boolean")
        def maybe(col, sent=sent, first=first):
            segment, at = positions(col.to_numpy().view(np.uint64), segments)
            return pd.Series(_test(sent.value, segment - first, at.astype(np.int64)))

        tested = part.withColumn(flag, maybe(number))
        if pieces > 1:  # one piece of the filter at a time
            tested = stored(tested, "tested")
            sent.destroy()
        unique.append(tested.where(~F.col(flag)).drop(flag, number, piece))
        some.append(tested.where(F.col(flag)).drop(flag, number, piece))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(unique), union(some)


def digest(text: str) -> Column:
    return F.sha2(squeezed(no_null(text)), 256)


#: Names of the columns that hold a row's fingerprint and the piece of the filter that tests it.
LIGHT = ("print", "piece")


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: key, keep_id, group_size, kept, text_sha256."""
    light = stored(df.select(F.col(key), F.char_length(no_null(text)).alias("n"), digest(text).alias("text_sha256")), "digests")
    unique, some = _split(light)
    unique = unique.select(key, F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return unique.unionByName(_verdicts(some, key))


def _split(light: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = light.count()
    rows = with_print(light, "text_sha256", n, LIGHT)
    return split_repeated(rows, stored(repeated_filter(rows.select(LIGHT[0]), n)[0], "bloom"), n, LIGHT)


def _verdicts(some: DataFrame, key: str) -> DataFrame:
    some = stored(some, "maybe-repeated")
    # most code points, then smallest key; partial sums in each task first, so that a hot text sends few rows
    first = F.min_by(F.col(key), F.struct(-F.col("n"), F.col(key).isNull(), F.col(key)))
    groups = some.groupBy("text_sha256").agg(first.alias("keep_id"), F.count("*").alias("group_size"))
    again = split_join(some, groups, "text_sha256", F.col(key))
    return again.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with their columns. Unique ones pass straight through; rows with a null key stay.

    Rows go if their key and text together were dropped, so a key with several texts loses only the repeated ones.
    """
    light = stored(df.select(F.col(key), F.char_length(no_null(text)).alias("n"), digest(text).alias("text_sha256")), "digests")
    n = light.count()
    prints = with_print(light, "text_sha256", n, LIGHT)
    filters = stored(repeated_filter(prints.select(LIGHT[0]), n)[0], "bloom")
    verdicts = _verdicts(split_repeated(prints, filters, n, LIGHT)[1], key)
    dropped = stored(verdicts.where(~F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias("dropped_key"), F.col("text_sha256").alias("dropped_sha")).distinct(), "dropped")
    names = [f"{c} of {key} and {text}" for c in ("digest", "print", "piece")]  # names that no table has
    whole = with_print(df.withColumn(names[0], digest(text)), names[0], n, (names[1], names[2]))
    unique, some = split_repeated(whole, filters, n, (names[1], names[2]))
    kept = some.join(dropped, (some[key] == dropped["dropped_key"]) & (some[names[0]] == dropped["dropped_sha"]), "left_anti")
    return unique.unionByName(kept).select(*df.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
