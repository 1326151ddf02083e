"""Benchmark passages in training documents (operator 9).

Texts are cut into words: A-Z lower-cased, runs of digits, letters a-z and all characters from U+0080 on. A window is
``WINDOW`` consecutive words of a benchmark item; an item with fewer words is one window, an item without words none.
Documents are scanned once, whatever the benchmark's size. Up to ``BLOCK_BYTES`` of benchmark text, the windows' words
and hashes go to all tasks; a task turns each document into word numbers, looks up the hash of each run of known words,
and compares every hit word by word. Beyond, a bit set of the windows' hashes goes to all tasks (``FILTER_BITS`` at
most); windows of documents that it lets through are joined with the benchmark's windows by their words, hot ones in
pieces, and give the same spans and items.

Null and empty texts have no words and no hits; texts of any length are read whole. Repeated rows and ties are handled
row by row, whatever their keys. Items with the same text all count. Null item ids are left out of the list of items,
but their windows hit. An empty table gives no rows, an empty benchmark no hits. Columns of other names are left out by
``find`` and kept by ``drop_contaminated`` and ``remove_spans``, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_list, no_null, sliced, split_join, stored, table, worker_state

WINDOW = 10
#: Benchmark text whose windows go to all tasks; with them at most about 60 times as much in a task's memory.
BLOCK_BYTES = 4 << 20
#: Bits of the set of window hashes, at most: 64 MB.
FILTER_BITS = 1 << 29
#: Lower-cases A-Z and turns every byte that is not in a word into a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPANS = "array<struct<start:long,stop:long>>"
#: A row's own id, since keys may be repeated or null.
ROW = "row of this scan"


def words_of(text: bytes) -> list[bytes]:
    # split(b" ") and not split(): bytes from 0x80 on are never white space here
    return text.translate(WORD_BYTES).split()


class Windows:
    """Hash set of a block's windows, by length, with exact rows to verify hits."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocab: dict[bytes, int] = {}
        rows: dict[int, dict[tuple[int, ...], set]] = {}
        for item, text in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text))
            n = min(window, len(ids))
            for k in range(len(ids) - n + 1 if n else 0):
                rows.setdefault(n, {}).setdefault(ids[k : k + n], set()).add(item)
        self.by_length = []
        for n, found in sorted(rows.items()):
            table, seed = np.array([*found], np.int64), 1
            while True:
                factors = np.random.default_rng(seed).integers(1, 1 << 62, n, dtype=np.int64).astype(np.uint64) | np.uint64(1)
                hashes = (table.astype(np.uint64) * factors).sum(1, dtype=np.uint64)
                order = np.argsort(hashes)
                if len(np.unique(hashes)) == len(hashes):
                    break
                seed += 1
            self.by_length.append((n, factors, hashes[order], table[order], [sorted(x for x in s if x is not None) for s in np.array([*found.values()], object)[order]]))

    def ids(self, text: bytes) -> list[int]:
        get = self.vocab.get
        return [get(w, 0) for w in words_of(text)]

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """For each window length: the length, positions of verified hits, their windows and the windows' items."""
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, factors, hashes, rows, items in self.by_length:
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            for part in (at[k : k + 65536] for k in range(0, len(at), 65536)):
                seen = ids[part[:, None] + np.arange(n)]
                value = (seen.astype(np.uint64) * factors).sum(1, dtype=np.uint64)
                where = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
                ok = hashes[where] == value
                ok[ok] = (rows[where[ok]] == seen[ok]).all(1)
                if ok.any():
                    yield n, part[ok], where[ok], items


#: Names of what a scan adds to a row.
FOUND = ("n_words", "spans", "items")


def columns_of(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def scan(df: DataFrame, windows: Windows, keep: list[str], text: str, names: tuple[str, str, str] = FOUND) -> DataFrame:
    """``keep`` and: number of words, spans (of words that are hit; merged, in order), items (sorted as strings)."""
    sent = df.sparkSession.sparkContext.broadcast(windows)  # built from at most BLOCK_BYTES of text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("leaks",))
        found = sent.value
        for batch in sliced(batches, text):
            texts = bytes_list(batch[text])
            ids, bounds = [], [0]
            for t in texts:
                ids += found.ids(t)
                ids.append(0)  # no window spans two documents
                bounds.append(len(ids))
            ends = np.array(bounds)
            hit, items = np.zeros(len(ids) + 1, np.int64), {}
            for n, at, where, owners in found.hits(np.array(ids, np.int64)):
                np.add.at(hit, at, 1)
                np.add.at(hit, at + n, -1)
                for doc, w in {*zip((np.searchsorted(ends, at, "right") - 1).tolist(), where.tolist(), strict=True)}:
                    items.setdefault(doc, set()).update(owners[w])
            inside = (np.cumsum(hit) > 0).astype(np.int8)
            spans = []
            for k in range(len(texts)):
                mine = []
                if k in items or inside[bounds[k] : bounds[k + 1]].any():
                    edge = np.flatnonzero(np.diff(inside[bounds[k] : bounds[k + 1]], prepend=0, append=0)).tolist()
                    mine = [{"start": a, "stop": b} for a, b in zip(edge[::2], edge[1::2])]
                spans.append(mine)
            out = [pa.array([b - a - 1 for a, b in zip(bounds, bounds[1:])], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([sorted(items.get(k, ())) for k in range(len(texts))], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), *out], [*keep, *names])

    kinds = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("long", SPANS, "array<string>"), strict=True))
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, f"{columns_of(df, keep)}, {kinds}")


def without(text: bytes, spans: list[dict]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in re.finditer(rb"[0-9a-z\x80-\xff]+", text.translate(WORD_BYTES))]
    out, at = [], 0
    for s in spans:
        out.append(text[at : places[s["start"]][0]])
        at = places[s["stop"] - 1][1]
    return b"".join([*out, text[at:]]).decode()


_FACTORS = np.random.default_rng(20240301).integers(1, 1 << 62, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def window_numbers(words: list[bytes], n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _FACTORS[k % 64]
        out ^= out >> np.uint64(29)
    return out * np.uint64(0x9E3779B97F4A7C15)


def bit_places(numbers: np.ndarray, bits: int) -> np.ndarray:
    """Two bits for each hash, in a set of ``bits`` bits, a power of two."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return np.stack([numbers >> shift, (numbers * np.uint64(0xD6E8FEB86659FD93)) >> shift]).astype(np.int64)


class LargeBenchmark:
    """Windows of a benchmark of any size: a table of them, and a set of bits that tells which words may be one."""

    def __init__(self, bench: DataFrame, item: str, text: str, window: int):
        spark = bench.sparkSession

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_state(("leaks",))
            for batch in sliced(batches, "text"):
                for name, body in zip(batch["item"].to_pylist(), bytes_list(batch["text"]), strict=True):
                    words = words_of(body)
                    n = min(window, len(words))
                    numbers = window_numbers(words, n) if n else []
                    runs = [b" ".join(words[k : k + n]).decode() for k in range(len(numbers))]
                    yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(np.array(numbers, np.uint64).view(np.int64)), pa.array([n] * len(runs), pa.int32()), pa.array([name] * len(runs), pa.string())], ["words", "number", "n", "item"])

        plain = bench.select(F.col(item).cast("string").alias("item"), no_null(text).alias("text"))
        rows = stored(plain.mapInArrow(cut, "words string, number long, n int, item string"), "windows")
        #: one row for each window: its words and the items that have it
        self.windows = stored(rows.groupBy("words").agg(F.collect_set("item").alias("names"), F.first("number").alias("number"), F.first("n").alias("n")), "distinct-windows")
        self.lengths = sorted(r["n"] for r in self.windows.select("n").distinct().collect())  # at most ``window``
        wanted = 64 * max(1 << 10, self.windows.count())
        self.bits = bits = min(FILTER_BITS, 1 << (wanted - 1).bit_length())
        segment = 1 << 16

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(bit_places(batch["number"].to_numpy(zero_copy_only=False).view(np.uint64), bits))
                yield pa.RecordBatch.from_arrays([pa.array(at // segment), pa.array((at % segment).astype(np.int32))], ["segment", "place"])

        def packed(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = np.zeros(segment, bool)
            for part in parts:
                mine[part["place"].to_numpy(zero_copy_only=False)] = True
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(mine, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

        made = self.windows.select("number").mapInArrow(places, "segment long, place int").groupBy("segment").applyInArrow(packed, "segment long, bits binary")
        whole = np.zeros((max(1, bits // segment), segment // 8), np.uint8)
        for row in made.toLocalIterator():
            whole[row.segment] = np.frombuffer(row.bits, np.uint8)
        self.sent = spark.sparkContext.broadcast(whole.ravel())  # at most FILTER_BITS / 8 bytes

    def candidates(self, df: DataFrame, keep: list[str], text: str) -> DataFrame:
        """``keep``, ROW, number of words, and those runs of words that may be a window. Written once."""
        sent, lengths, bits = self.sent, self.lengths, self.bits
        kind = pa.list_(pa.struct([("at", pa.int64()), ("stop", pa.int64()), ("words", pa.string())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_state(("leaks",))
            for batch in sliced(batches, text):
                counts, seen = [], []
                for body in bytes_list(batch[text]):
                    words, mine = words_of(body), []
                    for n in lengths:
                        at = bit_places(window_numbers(words, n), bits)
                        for k in np.flatnonzero((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(0)).tolist():
                            mine.append({"at": k, "stop": k + n, "words": b" ".join(words[k : k + n]).decode()})
                    counts.append(len(words))
                    seen.append(mine)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*keep, ROW)), pa.array(counts, pa.int64()), pa.array(seen, kind)], [*keep, ROW, "n_words", "seen"])

        kinds = columns_of(df, keep) + ", " if keep else ""
        return stored(df.select(*dict.fromkeys([*keep, ROW, text])).mapInArrow(run, f"{kinds}`{ROW}` long, n_words long, seen array<struct<at:long,stop:long,words:string>>"), "candidates")

    def found(self, seen: DataFrame) -> DataFrame:
        """ROW, spans and items of the rows with a hit."""
        runs = stored(seen.where(F.size("seen") > 0).select(ROW, F.explode("seen").alias("s")).select(ROW, "s.at", "s.stop", "s.words"), "runs")
        hits = stored(split_join(runs, self.windows.select("words", "names"), "words", F.col(ROW)).select(ROW, "at", "stop", "names"), "hits")
        order = Window.partitionBy(ROW).orderBy("at", "stop")  # the hits of one text
        before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
        parts = hits.select(ROW, "at", "stop").distinct().withColumn("new", F.when(before >= F.col("at"), 0).otherwise(1)).withColumn("part", F.sum("new").over(order))
        spans = parts.groupBy(ROW, "part").agg(F.min("at").alias("start"), F.max("stop").alias("stop")).groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
        names = hits.select(ROW, F.explode_outer("names").alias("name")).groupBy(ROW).agg(F.array_sort(F.collect_set("name")).alias("items"))
        return stored(spans.join(names, ROW), "found")


def small(bench: DataFrame, item: str, text: str, window: int) -> Windows | None:
    """The windows of a benchmark that is small enough for every task, else none."""
    sized = bench.select(F.col(item).cast("string").alias("item"), no_null(text).alias("text"))
    total = sized.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    return Windows([(r["item"], r["text"].encode()) for r in sized.collect()], window) if total <= BLOCK_BYTES else None


def numbered(df: DataFrame) -> DataFrame:
    """The rows with ids of their own, since keys may be repeated or null."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def find(df: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, n_words, spans, items of each row."""
    windows = small(bench, item, item_text, window)
    if windows is not None:
        return scan(df, windows, [key], text)
    large = LargeBenchmark(bench, item, item_text, window)
    seen = large.candidates(numbered(df.select(key, text)), [key], text)
    rows = seen.select(ROW, key, "n_words").join(large.found(seen), ROW, "left")
    return rows.select(key, "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def with_spans(df: DataFrame, bench: DataFrame, text: str, item: str, item_text: str) -> tuple[DataFrame, str]:
    """All columns of ``df`` and the spans that are hit (null or empty: none), under a name that no column has."""
    windows, names = small(bench, item, item_text, WINDOW), tuple(f"{n} of {text}" for n in FOUND)
    if windows is not None:
        return scan(df, windows, df.columns, text, names), names[1]
    large = LargeBenchmark(bench, item, item_text, WINDOW)
    rows = stored(numbered(df), "numbered")  # written, so that both reads see the same row ids
    return rows.join(large.found(large.candidates(rows, [], text)).select(ROW, F.col("spans").alias(names[1])), ROW, "left"), names[1]


def drop_contaminated(df: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df`` without a hit, with their columns, whatever their keys."""
    rows, spans = with_spans(df, bench, text, item, item_text)
    return rows.where(F.coalesce(F.size(spans), F.lit(0)) <= 0).select(*df.columns)


def remove_spans(df: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """All rows of ``df``, with hit words cut out of the text: all spans, found on the text as it was."""
    rows, spans = with_spans(df, bench, text, item, item_text)
    cut = F.udf(lambda t, found: without(t.encode(), found) if found else t, "string")
    return rows.withColumn(text, cut(text, F.col(spans))).select(*df.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
