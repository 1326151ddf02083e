"""Phrase collocations (operator 12) by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into words. In
numpy, a prefix polynomial over the bytes of a block gives the hash of every word in it by one subtraction, and a second
prefix polynomial over the word hashes that of every run of n words; language and n are mixed in. A phrase can only be
frequent if both phrases one word shorter in it are, so the levels n = 1, 2, ... each read the texts once and send on the
fingerprints of runs whose two parts were found frequent: with their count, a pointer to an occurrence (the document's
doc_id, or a hash of its text), and the sum of 32 bits of a fingerprint by polynomials of other bases. They are summed in
the task and again before the shuffle. Fingerprints that collide can only add up to more, so no frequent phrase is lost.

What is frequent goes to the tasks as bit sets, built by tasks and kept in files of one MB: up to ``KEPT_BITS`` a worker
holds the whole set; beyond, it reads the files in turn for each block of runs. A bit that is set by chance only lets a
run through that is counted for nothing.

Frequent phrases alone become strings, each once: the documents that pointers name are read again. The string's own check
times the count has to be the sum over all occurrences, else different runs have the same fingerprint. Those are counted
once more, by string: in each block, all occurrences of a fingerprint are compared with one of them (words byte by byte,
runs word by word) and parted. Scores, cuts and containment are joins of the frequent phrases. The first ``keep`` of a
language are found by a group limit before the shuffle.

Null texts are empty, a null language is ``und``. Rows that repeat count each. Texts of any
length are read whole, in blocks that end at the end of a piece; a piece longer than a block (``SLAB``) is taken whole, so
a task's memory grows with the longest piece, not with the text. Columns of other names are left out. Without candidates
(empty tables too) there are no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, no_null, stored, table, worker_state

#: Bytes of text in a block, runs that a task holds before it counts them, bytes of text that are verified together.
SLAB, RUNS_HELD, TEXT_HELD = 1 << 20, 1 << 21, 1 << 24
#: Bits of a file of a bit set, bits for each entry, bits that a worker keeps.
PIECE_BITS, BITS_EACH, KEPT_BITS = 23, 16, 1 << 30
#: Phrases with their counts that a task holds before it passes them on, rows of a batch.
PHRASES_HELD, ROWS = 400_000, 100_000

#: Bases of the fingerprints of words and runs, and of their checks.
WORD_BASE, RUN_BASE, WORD_CHECK, RUN_CHECK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK, END = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = END


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Polynomial:
    """Hashes of ranges of a sequence from its prefix sums of value * base ** place, modulo 2 ** 64."""

    def __init__(self, base: int):
        self.base, self.power, self.inverse = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        def powers(x: int) -> np.ndarray:
            out = np.full(n, x, np.uint64)
            out[0] = 1
            return np.cumprod(out)

        self.power, self.inverse = powers(self.base), powers(pow(self.base, -1, 1 << 64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(values) >= len(self.power):
            self._grow(len(values) + 1 + len(values) // 4)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (prefix[stop] - prefix[first]) * self.inverse[first]


class Block:
    """Words of some texts: places, hashes, piece and text of each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, salts: np.ndarray, docs: np.ndarray, langs: list[str], tools: list[Polynomial]):
        self.low, kind = LOWER[data], KIND[data]
        inside = kind == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[starts] = edge[-1] = True
        before = np.empty(len(data), bool)
        before[:1], before[1:] = False, inside[:-1]
        self.first = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:], after[:-1] = False, inside[1:]
        self.stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.text = np.searchsorted(starts, self.first, "right") - 1
        self.piece = np.cumsum(kind == END, dtype=np.int64)[self.first] + self.text
        self.docs, self.langs = docs, langs
        values = self.low.astype(np.uint64)
        self.runs, self.run_checks = tools[2:]
        self.hash, self.check = (mixed(tool.ranges(tool.prefix(values), self.first, self.stop) + (self.stop - self.first).astype(np.uint64)) for tool in tools[:2])
        self.salt = salts[self.text]

    def __len__(self) -> int:
        return len(self.first)

    def _runs(self, tool: Polynomial, values: np.ndarray, n: int) -> np.ndarray:
        at = np.arange(max(0, len(self) - n + 1))
        return mixed(tool.ranges(tool.prefix(values), at, at + n) ^ (self.salt[: len(at)] + np.uint64(n)))

    def fingerprints(self, n: int) -> np.ndarray:
        """Of the run of n words that begins at each word, as far as there are n."""
        return self._runs(self.runs, self.hash, n)

    def checks(self, n: int) -> np.ndarray:
        return self._runs(self.run_checks, self.check, n) >> np.uint64(32)

    def whole(self, n: int) -> np.ndarray:
        """Which of these runs lie in one piece."""
        m = max(0, len(self) - n + 1)
        return self.piece[:m] == self.piece[n - 1 : n - 1 + m]

    def word_ids(self) -> np.ndarray:
        """A number for each word, equal only for equal words: hashes that agree are compared byte by byte."""
        _, rep, ids = np.unique(self.hash, return_index=True, return_inverse=True)
        mine, size = rep[ids], self.stop - self.first
        same = size == size[mine]
        if same.all():
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            same = np.array_equal(self.low[at + np.repeat(self.first, size)], self.low[at + np.repeat(self.first[mine], size)])
        if np.all(same):
            return mine
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(self.low[a:b].tobytes(), k) for k, (a, b) in enumerate(zip(self.first, self.stop))])

    def word(self, k: int) -> str:
        return self.low[self.first[k] : self.stop[k]].tobytes().decode("utf-8", "replace")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of about SLAB bytes from rows (doc, lang, text)."""
    tools = worker_state(("phrases",), lambda: [Polynomial(base) for base in (WORD_BASE, WORD_CHECK, RUN_BASE, RUN_CHECK)])
    salts: dict[str, int] = {}
    for batch in batches:
        column = batch["text"].cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        langs = batch["lang"].to_pylist()
        salt = np.array([salts.setdefault(x, int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")) for x in langs], np.uint64)
        docs = batch["doc"].to_numpy()
        a = 0
        while a < len(langs):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLAB, "right")) - 1)
            if b > a + 1 or offsets[b] - offsets[a] <= SLAB:
                if offsets[b] > offsets[a]:
                    yield Block(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], salt[a:b], docs[a:b], langs[a:b], tools)
            else:
                at, end = int(offsets[a]), int(offsets[b])
                while at < end:
                    cut = _cut(data, at, end)
                    yield Block(data[at:cut], np.zeros(1, np.int64), salt[a:b], docs[a:b], langs[a:b], tools)
                    at = cut
            a = b


def _cut(data: np.ndarray, at: int, end: int) -> int:
    """The last end of a piece within SLAB bytes, else the first one after them."""
    if end - at <= SLAB:
        return end
    ends = np.flatnonzero(KIND[data[at : at + SLAB]] == END)
    if len(ends):
        return at + int(ends[-1]) + 1
    for k in range(at + SLAB, end, SLAB):
        ends = np.flatnonzero(KIND[data[k : min(end, k + SLAB)]] == END)
        if len(ends):
            return k + int(ends[0]) + 1
    return end


class BitSet:
    """Fingerprints as two bits each, of the same file, in files of the shared folder; may contain more than was put in,
    never less."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits
        self.piece_bits = min(bits, PIECE_BITS)

    @staticmethod
    def of(found: DataFrame, column: str = "fp") -> BitSet:
        """``found`` is a stored table."""
        spark = found.sparkSession
        bits = max(16, (found.count() * BITS_EACH - 1).bit_length())
        out = BitSet(new_path(spark, "frequent"), bits)
        folder, piece_bits = out.folder, out.piece_bits

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import uuid

            from pyarrow import fs

            worker_state(("bits",))
            store, root = fs.FileSystem.from_uri(folder)
            held, number = None, -1

            def close() -> None:
                if held is not None:
                    store.create_dir(root)
                    own = f"{root}/.{uuid.uuid4().hex}"
                    with store.open_output_stream(own) as sink:
                        sink.write(np.packbits(held, bitorder="little").tobytes())
                    store.move(own, f"{root}/{number:08d}.bits")

            for batch in batches:
                fps = batch[column].to_numpy().view(np.uint64)
                pieces = (fps >> np.uint64(64 - bits) >> np.uint64(piece_bits)).astype(np.int64)
                for p in np.unique(pieces):  # rows come sorted by piece
                    if p != number:
                        close()
                        held, number = np.zeros(1 << piece_bits, bool), int(p)
                    for place in out.places(fps[pieces == p]):
                        held[(place & np.uint64((1 << piece_bits) - 1)).astype(np.int64)] = True
            close()
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["n"])

        piece = F.shiftrightunsigned(column, 64 - bits + piece_bits) if bits > piece_bits else F.lit(0)
        rows = found.select(column, piece.alias("piece")).repartition("piece").sortWithinPartitions("piece").select(column)
        rows.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
        return out

    def _read(self, first: int, stop: int) -> np.ndarray:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        size = (1 << self.piece_bits) // 8
        out = np.zeros((stop - first) * size, np.uint8)
        names = [f"{root}/{k:08d}.bits" for k in range(first, stop)]
        for k, info in enumerate(store.get_file_info(names)):
            if info.type == fs.FileType.File:
                with store.open_input_stream(names[k]) as source:
                    out[k * size : (k + 1) * size] = np.frombuffer(source.read(), np.uint8)
        return out

    def places(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two bits of the same file, by the upper and by the lower bits of a fingerprint."""
        first, inside = fps >> np.uint64(64 - self.bits), np.uint64((1 << self.piece_bits) - 1)
        return first, first & ~inside | fps & inside

    def has(self, fps: np.ndarray) -> np.ndarray:
        def bit(data: np.ndarray, at: np.ndarray) -> np.ndarray:
            return data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1

        one, two = self.places(fps)
        whole, step = 1 << self.bits - self.piece_bits, max(1, KEPT_BITS >> self.piece_bits)
        if whole <= step:
            if getattr(self, "_all", None) is None:
                self._all = self._read(0, whole)
            out = bit(self._all, one)
            out[out] = bit(self._all, two[out])
            return out
        out = np.zeros(len(fps), bool)
        for k in range(0, whole, step):
            lo, hi = k << self.piece_bits, min(whole, k + step) << self.piece_bits
            some = np.flatnonzero((one >= lo) & (one < hi))
            if len(some):
                data = self._read(k, min(whole, k + step))
                out[some] = bit(data, one[some] - np.uint64(lo)) & bit(data, two[some] - np.uint64(lo))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_all"}


def frequent_runs(rows: DataFrame, n: int, least: int, shorter: BitSet | None) -> DataFrame:
    """(fp, c, doc, checks) of runs of n words that come ``least`` times or more; all such, and those whose fingerprints
    add up to it. For n = 1 also (lang, c): the words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held = 0
        words: Counter = Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            fps, ok, checks = (np.concatenate([h[k] for h in held]) for k in range(3))
            if shorter is not None:
                part = shorter.has(np.concatenate([h[3] for h in held]))
                part[:-1] &= part[1:]
                ok &= part
            at = np.flatnonzero(ok)
            at = at[np.argsort(fps[at])]
            fps, checks = fps[at], checks[at].astype(np.int64)
            first = np.flatnonzero(np.append(True, fps[1:] != fps[:-1])) if len(fps) else np.zeros(0, np.int64)
            counts, sums = np.diff(np.append(first, len(fps))), np.add.reduceat(checks, first) if len(fps) else checks
            ends = np.cumsum([len(h[0]) for h in held])
            block, docs = np.searchsorted(ends, at[first], "right"), np.empty(len(first), np.int64)
            for k in np.unique(block):
                mine = np.flatnonzero(block == k)
                docs[mine] = held[k][5][held[k][4][at[first[mine]] - (ends[k] - len(held[k][0]))]]
            fps = fps[first].view(np.int64)
            for k in range(0, len(fps), ROWS):
                part = slice(k, k + ROWS)
                yield batch_of(pa.array(fps[part]), pa.nulls(len(fps[part]), pa.string()), counts[part], docs[part], sums[part])

        def batch_of(fps: pa.Array, langs: pa.Array, counts, docs, sums) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([fps, langs, pa.array(counts, pa.int64()), pa.array(docs, pa.int64()), pa.array(sums, pa.int64())], ["fp", "lang", "c", "doc", "checks"])

        for block in blocks(batches):
            fps, ok, checks = np.zeros(len(block), np.uint64), np.zeros(len(block), bool), np.zeros(len(block), np.uint32)
            if len(block) >= n:
                end = len(block) - n + 1
                fps[:end], ok[:end], checks[:end] = block.fingerprints(n), block.whole(n), block.checks(n)
            parts = np.zeros(len(block) if shorter is not None else 0, np.uint64)
            if shorter is not None and len(block) >= n - 1:
                parts[: len(block) - n + 2] = block.fingerprints(n - 1)
            if n == 1:
                for lang, c in zip(block.langs, np.bincount(block.text, minlength=len(block.langs)).tolist()):
                    words[lang] += c
            held.append((fps, ok, checks, parts, block.text.astype(np.int32), block.docs))
            n_held += len(block)
            if n_held >= RUNS_HELD:
                yield from counted()
                held, n_held = [], 0
        if held:
            yield from counted()
        langs = [x for x, c in words.items() if c]
        yield batch_of(pa.nulls(len(langs), pa.int64()), pa.array(langs, pa.string()), [words[x] for x in langs], [0] * len(langs), [0] * len(langs))

    keys = ["fp", "lang"] if n == 1 else ["fp"]
    got = rows.mapInArrow(run, "fp long, lang string, c long, doc long, checks long").groupBy(*keys).agg(F.sum("c").alias("c"), F.min("doc").alias("doc"), F.sum("checks").alias("checks"))
    return got.where((F.col("c") >= least) | F.col("fp").isNull())


def spelled(rows: DataFrame, found: DataFrame, most_words: int) -> DataFrame:
    """(lang, phrase, fp, mark): the strings of fingerprints ``found`` (fp, doc) in the documents that they point at, of
    one to ``most_words`` words, each with its check."""
    lists = stored(found.groupBy("doc").agg(F.collect_list("fp").alias("fps")), "pointers")  # no more than a document has runs
    pointed = BitSet.of(lists.select(F.xxhash64("doc").alias("fp")))

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("phrases",), lambda: [Polynomial(base) for base in (WORD_BASE, WORD_CHECK, RUN_BASE, RUN_CHECK)])
        for batch in batches:
            yield batch.select(["doc", "lang", "text"]).filter(pa.array(pointed.has(batch["h"].to_numpy().view(np.uint64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch["fps"].to_pylist()
            for k in range(batch.num_rows):
                sure = np.array(wanted[k], np.int64).view(np.uint64)
                for block in blocks([batch.slice(k, 1)]):
                    for n in range(1, most_words + 1):
                        fps, checks = block.fingerprints(n), block.checks(n)
                        at = np.flatnonzero(block.whole(n) & np.isin(fps, sure))
                        at = at[np.unique(np.stack([fps[at], checks[at]]), axis=1, return_index=True)[1]]
                        text = [" ".join([block.word(j) for j in range(i, i + n)]) for i in at.tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array([block.langs[0]] * len(at), pa.string()), pa.array(text, pa.string()), pa.array(fps[at].view(np.int64)), pa.array(checks[at].astype(np.int64))], ["lang", "phrase", "fp", "mark"])

    few = rows.withColumn("h", F.xxhash64("doc")).mapInArrow(only, "doc long, lang string, text string")
    return few.join(lists, "doc").mapInArrow(run, "lang string, phrase string, fp long, mark long").distinct()


def verified(rows: DataFrame, sets: list[BitSet]) -> DataFrame:
    """(lang, phrase, f): exact counts of the phrases whose fingerprints the sets hold; sets[k] is of runs of k + 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        held: list[Block] = []

        def spell(block: Block, ids: np.ndarray, spelled: dict[int, str], n: int, at: np.ndarray, fps: np.ndarray) -> None:
            _, rep, group = np.unique(fps, return_index=True, return_inverse=True)
            runs = np.stack([ids[at + k] for k in range(n)])
            if not (runs == runs[:, rep[group]]).all() or not (block.salt[at] == block.salt[at[rep[group]]]).all():
                keys = np.concatenate([runs, [block.salt[at].view(np.int64)]])
                _, rep, group = np.unique(keys, axis=1, return_index=True, return_inverse=True)
            for r, c in zip(at[rep].tolist(), np.bincount(group).tolist()):
                words = ids[r : r + n].tolist()
                for w in words:
                    if w not in spelled:
                        spelled[w] = block.word(w)
                found[block.langs[block.text[r]], " ".join([spelled[w] for w in words])] += c

        def checked() -> None:
            known = [(b.word_ids(), {}) for b in held]
            for n, wanted in enumerate(sets, 1):
                for block, (ids, spelled) in zip(held, known):
                    fps = block.fingerprints(n)
                    at = np.flatnonzero(wanted.has(fps) & block.whole(n))
                    if len(at):
                        spell(block, ids, spelled, n, at, fps[at])

        def rows_of() -> Iterator[pa.RecordBatch]:
            langs, texts = [k[0] for k in found], [k[1] for k in found]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string()), pa.array([*found.values()], pa.int64())], ["lang", "phrase", "f"])

        size = 0
        for block in blocks(batches):
            held.append(block)
            size += len(block.low)
            if size >= TEXT_HELD:
                checked()
                held, size = [], 0
                if len(found) >= PHRASES_HELD:
                    yield from rows_of()
                    found.clear()
        if held:
            checked()
        yield from rows_of()

    return rows.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def phrase_counts(rows: DataFrame, levels: list[DataFrame], least: int) -> DataFrame:
    """(lang, phrase, f) of all phrases that come ``least`` times or more, from the levels' fingerprints."""
    found = levels[0].withColumn("n", F.lit(1))
    for n, level in enumerate(levels[1:], 2):
        found = found.unionByName(level.withColumn("n", F.lit(n)))
    named = stored(found.join(spelled(rows, found.select("fp", "doc"), len(levels)), "fp"), "spelled")
    # all occurrences are this string if their checks add up to its own that many times
    sure = named.withColumn("fits", F.col("checks").cast("decimal(38,0)") == F.col("c").cast("decimal(19,0)") * F.col("mark"))
    one = sure.groupBy("n", "fp").agg(F.bool_and("fits").alias("fits"), F.count("*").alias("strings"), F.first("lang").alias("lang"), F.first("phrase").alias("phrase"), F.first("c").alias("f"))
    one = stored(one, "checked")
    good, mixed_up = one.where("fits AND strings = 1").select("lang", "phrase", "f"), one.where("NOT fits OR strings > 1").select("n", "fp")
    if mixed_up.isEmpty():
        return good
    again = verified(rows, [BitSet.of(stored(mixed_up.where(F.col("n") == n).select("fp"), "collisions")) for n in range(1, len(levels) + 1)])
    return good.unionByName(again.where(F.col("f") >= least).join(good, ["lang", "phrase"], "left_anti"))


def wide(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 30, most_words: int = 4, keep: int = 2000, percent: int = 80, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """The first ``keep`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    ``percent``: a phrase goes if a longer candidate that holds it comes at least so often, in hundredths of its count.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.xxhash64(text)).alias("doc"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"), no_null(text).alias("text"))
    sets: list[BitSet] = []
    levels: list[DataFrame] = []
    for n in range(1, most_words + 1):
        got = stored(frequent_runs(rows, n, least, sets[-1] if sets else None), f"runs-{n}")
        if n == 1:
            totals = got.where("fp IS NULL").select("lang", F.col("c").alias("n"))
        levels.append(got.where("fp IS NOT NULL").select("fp", "c", "doc", "checks"))
        sets.append(BitSet.of(levels[-1]))
    f = stored(phrase_counts(rows, levels, least), "phrases")
    words = F.split("phrase", " ")
    longer = f.withColumn("w", words).withColumn("m", F.size("w")).where("m > 1")
    cands = longer.select("lang", "phrase", F.col("f").alias("a"), "w", "m")

    # both parts of each cut, all frequent since the whole is
    cut = cands.select("lang", "phrase", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    part = F.array(F.struct(F.lit(0).alias("side"), F.array_join(F.slice("w", 1, F.col("k")), " ").alias("part")), F.struct(F.lit(1).alias("side"), F.array_join(F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("part")))
    parts = cut.select("lang", "phrase", "a", "k", F.explode(part).alias("p")).select("lang", "phrase", "a", "k", "p.side", "p.part")
    known = parts.join(f.select("lang", F.col("phrase").alias("part"), F.col("f").alias("pf")), ["lang", "part"])
    sums = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("pf"))).alias(f"{'lr'[s]}{k}") for k in range(1, most_words) for s in (0, 1)]
    cuts = [
        F.when(F.col(f"l{k}").isNotNull(), F.struct(F.call_function("div", wide("a") * F.lit(2_000_000).cast("decimal(7,0)"), wide(f"l{k}") + wide(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in range(1, most_words)
    ]
    best = known.groupBy("lang", "phrase", "a").agg(*sums).withColumn("best", F.array_min(F.filter(F.array(*cuts), lambda x: x.isNotNull())))

    # the largest count of a longer candidate that holds the phrase
    places = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("m") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " "))))
    inner = cands.where("m > 2").select("lang", F.explode(F.array_distinct(places)).alias("phrase"), F.col("a").alias("over")).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    left = best.join(inner, ["lang", "phrase"], "left").where(F.col("over").isNull() | (wide("over") * 100 < wide("a") * percent))

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), F.asc("phrase")))
    first = left.select("lang", "phrase", "a", "best").withColumn("rank", rank).where(F.col("rank") <= keep)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY 1),
runs AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), range(1, 5) s(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*)::BIGINT AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
cands AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (
  SELECT c.lang, c.phrase, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS score
  FROM (SELECT *, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:m], ' ') AS two FROM cands, range(1, 4) s(k) WHERE k < m) c
  JOIN f x ON x.lang = c.lang AND x.phrase = one JOIN f y ON y.lang = c.lang AND y.phrase = two),
best AS (SELECT lang, phrase, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT c.lang, array_to_string(c.w[i:i + size - 1], ' ') AS phrase, c.a AS over
  FROM cands c, range(2, 4) s(size), range(1, 4) t(i) WHERE size < c.m AND i + size - 1 <= c.m),
dropped AS (SELECT DISTINCT c.lang, c.phrase FROM cands c JOIN inside i USING (lang, phrase) WHERE 100::HUGEINT * i.over >= 80::HUGEINT * c.a),
ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank, c.phrase, a, l, r, score::BIGINT AS score
  FROM cands c JOIN best USING (lang, phrase) ANTI JOIN dropped USING (lang, phrase))
SELECT ranked.*, n FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
