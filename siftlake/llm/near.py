"""Near duplicates by b-bit MinHash (operator 3), and connected components.

Per document: words (A-Z lower-cased, cut at white space), the set of distinct word shingles as 64-bit hashes, ``HASHES``
minima of it, of which ``BITS`` low bits each are packed into a signature, and ``BANDS`` band keys made of ``ROWS`` full
minima each. Documents with the same set are one class from the start and only its smallest id goes on, so exact copies
never meet. Candidates are documents that share a band. A shared signature bit pattern also arises by chance, with
probability 2^-BITS, so the estimate from bit counts is corrected for it; pairs whose corrected estimate is
``DEVIATIONS`` standard deviations below the threshold are let go. Every other link is confirmed on the full sets.

No group's pairs are written out. In each band group a member chosen by hash is the leader; each document is compared
with its leaders, the best estimate first, and components are formed. Only where members of one band group are then still
in different components, those outside of the group's largest component are compared with all the others, in blocks, and
never two of the largest component with each other; for a group whose copies its leaders connect that is nothing, however
large it is. Blocks are dealt twice: first signatures alone (64 bytes a member), which tell who has a promising partner,
then the full sets of those. So every candidate pair is either let go by its estimate, compared on full sets, or its two
documents are already connected: no cap, no sampling. Joins on leaders and labels, which a large group has in common,
are cut into pieces.

Null, empty and blank texts have an empty set and link with nothing. Texts with fewer words than a shingle have the
whole word sequence as their one shingle; texts of any length are cut whole. Keys are whole numbers (others raise
TypeError). Every text of a key that has several is compared, under a number of its own; such rows are linked with each
other, so they share a component, and stay or go together. An empty table gives no rows.
Columns of other names are left out by ``near_duplicates`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_list, discard, hot_keys, sliced, split_join, stored, stored_at, table, worker_state

HASHES, BITS, BANDS, ROWS = 128, 4, 40, 5
#: The chance to lose a link at the threshold itself: (1 - 0.8^5)^40 = 1e-7 for the bands, 1e-9 for the estimate.
DEVIATIONS = 6
#: Members of a band group that one task compares with each other.
BLOCK = 512
#: Ids of documents to compare that are broadcast at most (8 bytes each); beyond, they are joined.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240229)
_MULT = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_BAND = np.stack([_rng.permutation(HASHES)[: (HASHES // ROWS) * ROWS].reshape(-1, ROWS) for _ in range(-(-BANDS // (HASHES // ROWS)))]).reshape(-1, ROWS)[:BANDS]
_FOLD = _rng.integers(1, 1 << 62, max(ROWS, 64), dtype=np.int64).astype(np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of public multiply-xorshift hashes)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII white-space bytes only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out + h[k : len(h) - n + 1 + k] * _FOLD[8 + k])
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 512):
        part = x[None, k : k + 512] * _MULT[:, None]
        part += _ADD[:, None]
        np.minimum(low, part.min(1), out=low)
    return low


def sketch(df: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """key, n_shingles, content (16 bytes that tell the set), sig (packed low bits), bands; the last three null without shingles."""
    lanes = 64 // BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("sketch",))
        shift = (np.arange(lanes, dtype=np.uint64) * np.uint64(BITS))[None, :]
        for batch in sliced(batches, text):
            sets = [shingles(t, size) for t in bytes_list(batch[text])]
            full = [k for k, s in enumerate(sets) if len(s)]
            low = np.stack([minima(sets[k]) for k in full]).astype(np.uint64) if full else np.empty((0, HASHES), np.uint64)
            bits = _mix(low) & np.uint64((1 << BITS) - 1)
            sig = np.bitwise_or.reduce(bits.reshape(len(full), HASHES // lanes, lanes) << shift[:, None, :], 2).view(np.int64)
            bands = np.zeros((len(full), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for r in range(ROWS):
                bands = _mix(bands + low[:, _BAND[:, r]] * _FOLD[r])
            bands = bands.view(np.int64)
            at = dict(zip(full, range(len(full)), strict=True))
            pick = lambda rows: [rows[at[k]] if k in at else None for k in range(len(sets))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch[key], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([content_of(s) for s in sets], pa.binary()),
                    pa.array(pick(sig), pa.list_(pa.int64())), pa.array(pick(bands), pa.list_(pa.int64())),
                ],
                [key, "n_shingles", "content", "sig", "bands"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` long, n_shingles long, content binary, sig array<long>, bands array<long>")


def content_of(shingle_set: np.ndarray) -> bytes | None:
    """16 bytes that tell a set; none for the empty one."""
    return xxhash.xxh3_128_digest(shingle_set.tobytes()) if len(shingle_set) else None


def full_sets(rows: DataFrame, size: int) -> DataFrame:
    """rows: id, content, text. (id, set) of the rows whose text has that content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("sets",))
        for batch in sliced(batches, "text"):
            sets = [shingles(t, size) for t in bytes_list(batch["text"])]
            right = [k for k, c in enumerate(batch["content"].to_pylist()) if content_of(sets[k]) == c]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(right, pa.int64())), pa.array([sets[k].view(np.int64) for k in right], pa.list_(pa.int64()))], ["id", "set"])

    return rows.select("id", "content", "text").mapInArrow(run, "id long, set array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: equal lanes by bit count, less those equal by chance."""
    ones = int(sum(1 << k for k in range(0, 64, BITS)))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones

    def unequal(x: Column) -> Column:
        step = 1
        while step < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        return F.bit_count(x.bitwiseAND(F.lit(ones)))

    differ = F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-BITS
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in the edges; component: the smallest id reachable.

    Each round gives every id the smallest label among its own and its neighbours', then follows that label's own
    label, so distances halve; rounds end when none changes. Rounds are cut by tables in the shared folder.
    """
    spark = edges.sparkSession
    both, both_at = stored_at(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(b, a)).where("a <> b").distinct(), "edges")
    hubs = hot_keys(both.select(F.col("b").alias("id")), "id").collect()  # at most MOST_HOT
    labels, at = stored_at(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        # an id's label spreads to its neighbours; partial minima in each task, so that a hub sends few rows
        near = split_join(both.withColumnRenamed("b", "id"), labels, "id", F.col("a"), hot=hubs).groupBy("a").agg(F.min("component").alias("least"))
        reached = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "least").alias("to"), F.col("component").alias("was"))
        reached, reached_at = stored_at(reached, "labels")
        jump = reached.select(F.col("id").alias("to"), F.col("to").alias("jump"))
        # the label's old holder learns too: the component it named is joined to the new one
        hook = reached.where("to < was").groupBy(F.col("was").alias("h")).agg(F.min("to").alias("hook"))
        new = split_join(reached, jump, "to", F.col("id"), "left").join(hook, F.col("id") == hook["h"], "left")
        new = new.select("id", F.least("to", F.coalesce("jump", "to"), F.coalesce("hook", "to")).alias("component"), "was")
        fresh, fresh_at = stored_at(new, "labels")
        changed = fresh.where("component <> was").limit(1).count()
        discard(spark, reached_at)
        discard(spark, at)
        labels, at = fresh.select("id", "component"), fresh_at
        if not changed:
            discard(spark, both_at)
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """components() of what gave ``labels`` and of the links (a, b): only the components that the links join are told
    anew, so that links found before are not read again."""
    la, lb = labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    ends = split_join(links.select("a", "b"), lb, "b", F.col("a"), "left").join(la, "a", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    ends = stored(ends.where("a <> b").distinct(), "joined")
    if ends.isEmpty():
        return labels
    over = components(ends)
    # an id without a label so far is a component of its own, and is not told by the labels
    alone = over.join(labels.select("id"), "id", "left_anti")
    moved = split_join(labels, over.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", F.col("id"), "left")
    return stored(moved.select("id", F.coalesce("to", "component").alias("component")).unionByName(alone), "joined-labels")


class Corpus:
    """The input, and one row (id, key, content, sig, bands) for each set: its number, and a row that has it."""

    def __init__(self, df: DataFrame, docs: DataFrame, size: int, percent: int, key: str, text: str):
        self.df, self.docs, self.size, self.percent, self.key, self.text = df, docs, size, percent, key, text
        share = percent / 100
        #: Corrected estimates below this are let go.
        self.least = share - DEVIATIONS * (share * (1 - share) / HASHES) ** 0.5 / (1 - 2.0**-BITS)

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """Full sets of the documents of ``ids``: texts are read again, only those wanted are cut into shingles."""
        wanted = stored(ids.join(self.docs.select("id", F.col("key").alias("__key"), "content"), "id"), "wanted")
        few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        rows = self.df.select(F.col(self.key).cast("long").alias("__key"), F.col(self.text).alias("text")).join(few, "__key")
        return full_sets(rows, self.size).dropDuplicates(["id"])

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        sets, sets_at = stored_at(self.sets_of(ids), "sets")
        x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        ok = 100 * common >= self.percent * (F.size("x") + F.size("y") - common)
        # a leader (b) may have very many pairs
        found = stored(split_join(pairs, y, "b", F.col("a")).join(x, "a").where(ok).select("a", "b"), "links")
        discard(self.df.sparkSession, sets_at)
        return found

    def promising(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose estimate is near enough, with it."""
        sigs = self.docs.select("id", "sig")
        a, b = sigs.select(F.col("id").alias("a"), F.col("sig").alias("x")), sigs.select(F.col("id").alias("b"), F.col("sig").alias("y"))
        return split_join(pairs, b, "b", F.col("a")).join(a, "a").withColumn("est", estimate(F.col("x"), F.col("y"))).where(F.col("est") >= self.least).select("a", "b", "est")


def _pairs_of(group: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Of members dealt to one task: each one's number and those of its promising partners after it, the best first.

    Partners are in another component and, if the task has two blocks, in the other block; of the bands that the two
    share, this is the first.
    """
    n = group.num_rows
    matrix = lambda c: np.array(group[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(n, -1)
    label, block, shingles_of = (group[c].to_numpy() for c in ("c", "block", "n"))
    sig, bands, band = matrix("sig").view(np.uint64), matrix("bands"), group["band"][0].as_py()
    two, ratio, ones = len(np.unique(block)) > 1, group["percent"][0].as_py(), np.uint64(sum(1 << k for k in range(0, 64, BITS)))
    if group["i"][0].as_py() != group["j"][0].as_py() and not two:
        return
    for k in range(n):
        later = np.arange(k + 1, n)
        later = later[(label[later] != label[k]) & (100 * np.minimum(shingles_of[later], shingles_of[k]) >= ratio * np.maximum(shingles_of[later], shingles_of[k]))]
        if two:
            later = later[block[later] != block[k]]
        if not len(later):
            continue
        x = sig[later] ^ sig[k]
        for step in (1 << s for s in range(BITS.bit_length() - 1)):
            x |= x >> np.uint64(step)
        equal = 1 - np.bitwise_count(x & ones).sum(1) / HASHES
        est = (equal - 2.0**-BITS) / (1 - 2.0**-BITS)
        later, est = later[est >= least], est[est >= least]
        if len(later):
            first = bands[k][(bands[later] == bands[k]).argmax(1)] == band
            if first.any():
                yield k, later[first][np.argsort(-est[first], kind="stable")]


def _inside_links(member: DataFrame, corpus: Corpus) -> DataFrame:
    """Links between different components within band groups. member: band, a (document), c (its component).

    A group's members outside of its largest component, and those inside, are cut into blocks of about BLOCK members;
    a task gets two blocks of outsiders, or one of each kind. Promising pairs, the best first, are confirmed on full
    sets unless the links found before connect them already. What comes out is at most one link less than there are
    components in the two blocks.
    """
    sizes = member.groupBy("band", "c").count()
    groups = sizes.groupBy("band").agg(F.count("*").alias("parts"), F.sum("count").alias("m"), F.max(F.struct("count", "c")).alias("top")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    groups = groups.select("band", F.col("top.c").alias("main"), blocks(F.col("m") - F.col("top.count")).alias("outer"), blocks(F.col("top.count")).alias("inner"))
    signs = corpus.docs.select(F.col("id").alias("a"), "sig", "bands", "n")
    rows = split_join(member, groups, "band", F.col("a")).join(signs, "a").withColumn("percent", F.lit(corpus.percent))
    rows = rows.withColumn("block", F.when(F.col("c") == F.col("main"), -1 - F.pmod(F.xxhash64("a", "band"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("a", "band"), F.col("outer"))).cast("int"))
    # outsiders meet all blocks, those of the largest component (numbers below 0) only outsiders
    others = F.when(F.col("block") < 0, F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(-F.col("inner"), F.col("outer") - 1))
    rows = rows.withColumn("other", F.explode(others)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "outer", "inner", "main")
    least = corpus.least

    def partners(group: pa.Table) -> pa.Table:
        """The members that have a promising partner here."""
        worker_state(("blocks",))
        some = np.zeros(group.num_rows, bool)
        for k, later in _pairs_of(group, least):
            some[k] = some[later] = True
        return group.select(["band", "i", "j", "block", "a", "c", "n", "percent", "sig", "bands"]).filter(pa.array(some))

    kinds = "band long, i int, j int, block int, a long, c long, n long, percent int, sig array<long>, bands array<long>"
    rows = stored(rows.select([x.split()[0] for x in kinds.split(", ")]).groupBy("band", "i", "j").applyInArrow(partners, kinds), "partners")
    if rows.isEmpty():
        return rows.select("a", F.col("a").alias("b"))
    sets, sets_at = stored_at(corpus.sets_of(rows.select(F.col("a").alias("id")).distinct()), "sets")
    ratio = corpus.percent

    def confirm(group: pa.Table) -> pa.Table:
        worker_state(("blocks",))
        names, label = group["a"].to_numpy(), group["c"].to_numpy()
        parts = group["set"].combine_chunks()
        starts, values = parts.offsets.to_numpy(), parts.values.to_numpy(zero_copy_only=False)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for k, later in _pairs_of(group, least):
            for y in later.tolist():
                a, b = top(int(label[k])), top(int(label[y]))
                if a == b:
                    continue
                x, z = values[starts[k] : starts[k + 1]], values[starts[y] : starts[y + 1]]
                common = len(np.intersect1d(x, z, assume_unique=True))
                if 100 * common >= ratio * (len(x) + len(z) - common):
                    root[max(a, b)] = min(a, b)
                    out.append((names[k], names[y]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    found = rows.join(sets.withColumnRenamed("id", "a"), "a").groupBy("band", "i", "j").applyInArrow(confirm, "a long, b long").distinct()
    found = stored(found, "inside-links")
    discard(corpus.df.sparkSession, sets_at)
    return found


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept of each row. Rows with a null key have themselves as component (null, kept)."""
    spark = df.sparkSession
    if df.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be a column of whole numbers")
    rows, _ = stored_at(sketch(df.withColumn(key, F.col(key).cast("long")), size, key, text), "sketch")
    named = rows.where(F.col("content").isNotNull() & F.col(key).isNotNull())
    # each set is compared once, by the number of the first row that has it; sets that share one get others
    firsts, several = _numbered(stored(named.groupBy("content").agg(F.min(key).alias("key")), "firsts"), named.select(F.col(key).alias("key"), "content"))
    docs = named.join(firsts, (named["content"] == firsts["content"]) & (named[key] == firsts["key"]), "left_semi").select("content", F.col("n_shingles").alias("n"), "sig", "bands").dropDuplicates(["content"])
    docs, docs_at = stored_at(docs.join(firsts, "content"), "distinct")
    corpus = Corpus(df, docs, size, percent, key, text)

    keys = docs.select("id", F.explode("bands").alias("band"))
    leaders = keys.groupBy("band").agg(F.min_by("id", F.xxhash64("id", "band")).alias("b"), F.count("*").alias("n")).where("n > 1").select("band", "b")
    grouped, grouped_at = stored_at(keys.join(leaders, "band").select("band", F.col("id").alias("a"), "b"), "bands")
    stars = stored(corpus.promising(stored(grouped.where("a <> b").select("a", "b").distinct(), "star-pairs")), "stars")
    best = stored(stars.groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b")), "best")
    labels = components(corpus.links(best))

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        la, lb = labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        return split_join(pairs, lb, "b", F.col("a"), "left").join(la, "a", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    # the other leaders of documents that their best leader did not connect
    more = stored(apart(stored(stars.join(best, ["a", "b"], "left_anti"), "other-stars"), labels), "more")
    if not more.isEmpty():
        labels = joined(labels, corpus.links(more))
    # members of one band group that are still in different components
    of = labels.select(F.col("id").alias("a"), "component")
    member = stored(grouped.join(of, "a", "left").select("band", "a", F.coalesce("component", "a").alias("c")), "members")
    rest = _inside_links(member, corpus)
    if not rest.isEmpty():
        labels = joined(labels, rest)
    discard(spark, grouped_at)
    discard(spark, docs_at)
    if several is not None:
        labels = joined(labels, several)
    # every document takes the component of its set
    classes = firsts.join(labels, "id", "left").select("content", "key", F.coalesce("component", "id").alias("component_id"))
    if several is not None:  # numbers that are no keys give way to the smallest key
        least = classes.groupBy("component_id").agg(F.min("key").alias("least"))
        classes = split_join(classes, least, "component_id", F.col("content")).select("content", F.col("least").alias("component_id"))
    got = split_join(named.select(key, "n_shingles", "content"), classes.select("content", "component_id"), "content", F.col(key)).select(key, "n_shingles", "component_id")
    got = got.unionByName(rows.where(F.col("content").isNull() | F.col(key).isNull()).select(key, "n_shingles", F.col(key).alias("component_id")))
    return got.select(key, "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col(key)).alias("kept"))


def _numbered(firsts: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``firsts`` (content, key) with ``id``: the key, but for all sets of a key that is the first of several, one that no
    row has as its key. Also (a, b) by id: links of the sets that share a key with the first of them; None without any."""
    twice = stored(named.distinct().groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("first")).where("n > 1"), "several")
    if twice.isEmpty():
        return firsts.withColumn("id", F.col("key")), None
    alone = firsts.groupBy("key").agg(F.min("content").alias("own"))
    keys, salt = named.select(F.col("key").alias("id")).distinct(), 0
    while True:
        ids = firsts.join(alone, "key").select("content", "key", F.when(F.col("content") == F.col("own"), F.col("key")).otherwise(F.xxhash64(F.lit(salt), "content")).alias("id"))
        ids = stored(ids, "numbers")
        made = ids.where(F.col("id") != F.col("key"))
        if ids.groupBy("id").count().where("count > 1").isEmpty() and made.join(keys, "id", "left_semi").isEmpty():
            break
        salt += 1
    of = ids.select("content", "id")
    pairs = named.join(twice, "key").where(F.col("content") != F.col("first")).select("content", "first").distinct()
    several = pairs.join(of.withColumnRenamed("id", "a"), "content").join(of.select(F.col("content").alias("first"), F.col("id").alias("b")), "first").select("a", "b").distinct()
    return ids, stored(several, "same-key")


def keep_first(df: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one of each component, with their columns. Rows with a null key stay."""
    dropped = stored(near_duplicates(df, size, percent, key, text).where("NOT kept").select(key), "near-dropped")
    return df.join(dropped, key, "left_anti")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)
