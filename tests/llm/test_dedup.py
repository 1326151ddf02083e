"""Exact and near duplicates, decontamination and shards against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.llm import exact, leaks, near, shards

WORDS = [f"{a}{b}" for a in "bcdfghjklm" for b in ("a", "e", "i", "o", "u", "é")]
SCHEMA = "doc_id long, text string, source string, n long, component_id string"


def corpus(seed=5, n=160):
    rng = random.Random(seed)
    sentence = lambda k: [rng.choice(WORDS) for _ in range(k)]
    base = [sentence(rng.randint(30, 90)) for _ in range(20)]
    shared = sentence(40)
    out = []
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        if k % 7 == 0:
            words = sentence(30) + shared
        out.append((k, " ".join(words).replace(" b", "\n b" if k % 3 else "  B"), f"s{k % 2}", k, "clash"))
    return out + [(n, None, None, None, None), (n + 1, "", "s", 1, "x"), (n + 2, " \t\n", "s", 1, "x"), (n + 3, "one two", "s", 1, "x"), (n + 4, "ONE  two", "s", 1, "x"), (n + 5, "long " * 30_000, "s", 1, "x")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_exact(spark):
    rows = corpus() + [(500, "é 1", "s", 1, "x"), (501, "é1", "s", 1, "x"), (502, "é 1", "s", 1, "x")]
    groups: dict[str, list] = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = {(i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    assert {tuple(r) for r in exact.exact_duplicates(frame(spark, rows)).collect()} == want
    assert {r.doc_id for r in exact.keep_first(frame(spark, rows)).collect()} == {min(g)[1] for g in groups.values()}
    assert exact.exact_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_exact_beyond_the_broadcast_bound(spark, monkeypatch):
    """Pieces of 8 KB: unique rows still pass straight through."""
    rows = corpus(n=400)
    want = sorted(map(tuple, exact.exact_duplicates(frame(spark, rows)).collect()))
    stay = sorted(map(tuple, exact.keep_first(frame(spark, rows)).collect()), key=repr)
    monkeypatch.setattr(exact, "BROADCAST_BYTES", 1 << 13)
    monkeypatch.setattr(exact, "BITS_PER_ROW", 1 << 10)
    light = exact.exact_duplicates(frame(spark, rows))
    assert sorted(map(tuple, light.collect())) == want
    shuffled, real = [], exact._verdicts
    monkeypatch.setattr(exact, "_verdicts", lambda some, key: shuffled.append({r[key] for r in some.collect()}) or real(some, key))
    assert sorted(map(tuple, exact.keep_first(frame(spark, rows)).collect()), key=repr) == stay
    size = {r[0]: r[2] for r in want}
    assert {i for i, n in size.items() if n > 1} <= shuffled[0] and len([i for i in shuffled[0] if size[i] == 1]) <= 5


def test_exact_row_by_row(spark, monkeypatch):
    """Repeated and null keys, clashing names, and a text that is cut into pieces."""
    monkeypatch.setattr("siftlake.llm.common.HOT_ROWS", 3)
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (2, "ab"), (3, "c d"), (3, "c"), (None, "c"), (None, "zz"), (None, None)] + [(k, "hot") for k in range(10, 30)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, maybe int, print int, n int").repartition(3)
    got = sorted((tuple(r)[:4] for r in exact.exact_duplicates(df).collect()), key=repr)
    want = [(1, 1, 3, True), (1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False), (3, 3, 1, True), (3, 1, 3, False), (None, 1, 3, False), (None, None, 1, True), (None, None, 1, True)]
    assert got == sorted(want + [(k, 10, 20, k == 10) for k in range(10, 30)], key=repr)
    kept = exact.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=repr) == sorted([(1, "a b"), (1, "a b"), (1, "c"), (3, "c d"), (None, "c"), (None, "zz"), (None, None), (10, "hot")], key=repr)


def test_bloom_has_no_misses(spark):
    prints = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 3000)
    df = spark.createDataFrame([(str(x),) for x in [*prints, *prints[:50], *prints[:5]]], "sha string").repartition(4)
    unique, some = exact._split(df.withColumnRenamed("sha", "text_sha256"))
    hit = {r[0] for r in some.collect()}
    assert {str(x) for x in prints[:50]} <= hit and len(hit) < 400 and unique.count() + some.count() == 3055


def word_sets(rows, size):
    out = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        n = min(size, len(w))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    return out


@pytest.mark.parametrize("size,block", [(4, 512), (5, 8)])
def test_near(spark, monkeypatch, size, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = corpus()
    sets, root = word_sets(rows, size), {}
    top = lambda x: x if root.get(x, x) == x else top(root[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(frame(spark, rows), size, 80).collect()}
    assert got == {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def test_near_large_groups(spark, monkeypatch):
    """A group of near copies that outnumbers a block, outsiders beside it, and leaders cut into pieces."""
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr("siftlake.llm.common.HOT_ROWS", 20)
    rng = random.Random(11)
    base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(100)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2, 5, 6])):
            words[rng.randrange(100)] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(words), "s", k, "x"))
    sets, root = word_sets(rows, 4), {}
    top = lambda x: x if root.get(x, x) == x else top(root[x])
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    want = {i: top(i) for i in sets}
    assert 5 < len(set(want.values())) < 120
    assert {r.doc_id: r.component_id for r in near.near_duplicates(frame(spark, rows), 4, 80).collect()} == want


def test_near_recall_on_the_test_tables(spark):
    """Links of the rows whose id is divisible by 100, against all rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = word_sets(rows, 4)
    of = {r.doc_id: r.component_id for r in near.near_duplicates(docs, 4, 80).collect()}
    linked = [(a, b) for a in sets if a % 100 == 0 and sets[a] for b in sets if b != a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert linked and all(of[a] == of[b] for a, b in linked)


def test_near_empty_null_and_repeated_keys(spark):
    assert near.near_duplicates(frame(spark, corpus()).limit(0)).count() == 0
    rows = [(None, "a b c d e f", "s", 1, "x"), (2, "a b c d e f", "s", 1, "x"), (3, None, "s", 1, "x")]
    assert near.keep_first(frame(spark, rows)).count() == 3
    # key 5 has two texts, one of them a copy of key 4's; both rows of 5 go with it
    rows = [(4, "a b c d e f", "s", 1, "x"), (5, "a b c d e f", "s", 1, "x"), (5, "g h i j k l", "s", 1, "x"), (6, "m n o p q r", "s", 1, "x"), (6, "m n o p q r", "s", 1, "x")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near.near_duplicates(frame(spark, rows)).collect())
    assert got == [(4, 4, True), (5, 4, False), (5, 4, False), (6, 6, True), (6, 6, True)]
    with pytest.raises(TypeError):
        near.near_duplicates(frame(spark, rows), key="source")


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in near.components(edges).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 102: 100}


def test_components_are_joined_without_the_links_found_before(spark, monkeypatch):
    first = spark.createDataFrame([(k, k + 1) for k in range(1, 200) if k % 20], "a long, b long")
    more = spark.createDataFrame([(5, 33), (44, 27), (500, 199), (600, 601), (2, 3)], "a long, b long")
    want = {r.id: r.component for r in near.components(first.union(more)).collect()}
    labels, read, real = near.components(first), [], near.components
    monkeypatch.setattr(near, "components", lambda edges: read.append(edges.count()) or real(edges))
    assert {r.id: r.component for r in near.joined(labels, more).collect()} == want
    assert read == [4]  # (1, 21), (41, 21), (500, 181), (600, 601); one link was inside
    assert near.joined(labels, first) is labels


def test_near_reads_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    rng, read, real = random.Random(11), [], near.components
    base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(100)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2, 5, 6])):
            words[rng.randrange(100)] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(words), "s", k, "x"))
    monkeypatch.setattr(near, "components", lambda edges: read.append(edges.count()) or real(edges))
    near.near_duplicates(frame(spark, rows), 4, 80).collect()
    assert len(read) > 1 and sum(read[1:]) < read[0]


def benchmark_rows():
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(n))) for k, n in enumerate([30, 12, 10, 4, 1, 25])]
    return [*items, (6, None), (7, "..."), (8, items[0][1].upper())]


@pytest.mark.parametrize("block", [4 << 20, 100])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", block)
    rng, items = random.Random(4), benchmark_rows()
    rows = []
    for k in range(60):
        w = [rng.choice(WORDS) + "zz" for _ in range(20)]
        if k % 3 == 0:
            w[rng.randint(0, 20) : 0] = items[k % 6][1].split()[: rng.randint(1, 40)]
        rows.append((k, ", ".join(w), "s", 1, "x"))
    rows += [(60, None, None, 1, "x"), (61, "", "s", 1, "x"), (61, "", "s", 1, "x"), (62, items[0][1] + " - " + items[0][1], "s", 1, "x")]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = cut(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + min(10, len(w))]), set()).add(str(i))
    want = set()
    for i, t, *_ in rows:
        w, hit, found = cut(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want.add((i, len(w), len(hit), ",".join(sorted(found))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.find(frame(spark, rows), bench)
    assert {(r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), ",".join(r["items"])) for r in got.collect()} == want
    assert {r.doc_id for r in leaks.drop_contaminated(frame(spark, rows), bench).collect()} == {i for i, _, n, _ in want if not n}
    clean = leaks.find(leaks.remove_spans(frame(spark, rows), bench), bench).where(F.size("spans") > 0)
    assert clean.count() <= 2  # what stands together after the cut may be a window of its own


@pytest.mark.parametrize("block", [4 << 20, 100])
def test_leaks_row_by_row(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", block)
    items = benchmark_rows()
    first, second = items[0][1], items[1][1]
    half = lambda t: " ".join(t.split()[:5])
    # repeated and null keys; item 20 overlaps the end of item 0, and only longer items take part
    items = [items[0], items[1], items[8], (20, " ".join([*first.split()[-5:], "qq", *second.split()[:4]]))]
    overlap = first + " qq " + " ".join(second.split()[:4])
    rows = [(1, "zz"), (1, "zz"), (1, "zz " + first), (None, "zz yy"), (None, second + " xx"), (None, None), (2, overlap + " end"), (3, half(first) + " pp " + second + " pp " + half(first))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(repr(r.doc_id), r.n_words, [(s.start, s.stop) for s in r.spans], r["items"]) for r in leaks.find(df, bench).collect()]
    a, b = ["0", "8"], ["1"]
    n = len(overlap.split())
    want = [("1", 1, [], []), ("1", 1, [], []), ("1", 31, [(1, 31)], a), ("None", 2, [], []), ("None", 13, [(0, 12)], b), ("None", 0, [], []), ("2", n + 1, [(0, n)], ["0", "20", "8"]), ("3", 24, [(6, 18)], b)]
    assert sorted(got) == sorted(want)
    cleaned = [(r.doc_id, r.text) for r in leaks.remove_spans(df, bench).collect()]
    assert sorted(cleaned, key=repr) == sorted([(1, "zz"), (1, "zz"), (1, "zz "), (None, "zz yy"), (None, " xx"), (None, None), (2, " end"), (3, f"{half(first)} pp  pp {half(first)}")], key=repr)
    left = [(r.doc_id, r.text) for r in leaks.drop_contaminated(df, bench).collect()]
    assert sorted(left, key=repr) == sorted([(1, "zz"), (1, "zz"), (None, "zz yy"), (None, None)], key=repr)


def test_leaks_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert leaks.find(frame(spark, corpus()).limit(0), bench).count() == 0
    assert leaks.find(frame(spark, corpus()), bench).where(F.size("spans") > 0).count() == 0


@pytest.mark.parametrize("block", [4 << 20, 100])
def test_leaks_query_and_clashing_names(spark, monkeypatch, tmp_path, block):
    """The query's own columns, and columns called like the scan's."""
    monkeypatch.setattr(leaks, "BLOCK_BYTES", block)
    monkeypatch.setattr("siftlake.llm.common.HOT_ROWS", 2)
    items, hot = benchmark_rows()[:2] + [(7, "...")], benchmark_rows()[1][1]
    rows = [(k, f"aa {hot} bb" if k % 2 else "aa bb", 7, "s", "c") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long, spans string, cleaned string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in leaks.op9_decontamination(spark, str(tmp_path)).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == [(k, 14, 12, 1, sha("1"), True) if k % 2 else (k, 2, 0, 0, sha(""), False) for k in range(20)]
    cleaned = leaks.remove_spans(df, bench)
    assert cleaned.columns == df.columns and sorted(r.text for r in cleaned.collect()) == ["aa  bb"] * 10 + ["aa bb"] * 10
    assert leaks.drop_contaminated(df, bench).columns == df.columns and leaks.drop_contaminated(df, bench).count() == 10


@pytest.mark.parametrize("n", [1, 5, 8])
def test_shards(spark, n):
    # without the giant text: a row that weighs more than a shard leaves others empty
    rows = [r for r in corpus(n=400) if len(r[1] or "") < 10_000] + [(1000 + k, "same text", "hot", 1, "x") for k in range(300)] + [(7, "twice", "s", 1, "x")] * 2
    got = shards.kd_shards(frame(spark, rows).where("n < 400 OR n IS NULL"), ["n", "source"], n_shards=n).collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sizes = [sum(r["size"] for r in v) for _, v in sorted(by.items())]
    most = sorted((r["size"] for r in got), reverse=True)[0]
    assert sorted(by) == list(range(n)) and max(sizes) - min(sizes) <= 2 * most
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())


def test_shards_query(spark, tmp_path):
    """The query's columns, row by row, with null, repeated and very long texts."""
    rows = [(k, t, "en", s, len(t or "")) for k, t, s, *_ in corpus(n=300)] + [(5, "again", None, None, None), (None, "no key", "en", "s", 6), (900, "x" * 200_000, "en", "s", 200_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = shards.op10_shards(spark, str(tmp_path)).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = sorted(((k, size(t), zlib.crc32((t or "").encode())) for k, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} <= set(range(8))
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_by_target_and_empty(spark):
    rows = [r for r in corpus() if len(r[1] or "") < 10_000]
    df = frame(spark, rows)
    total = sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
    assert len({r.shard for r in shards.kd_shards(df, ["n"], target_bytes=total // 3 + 1).collect()}) == 3
    assert shards.kd_shards(df.limit(0), ["n"], n_shards=4).count() == 0


def test_every_text_of_a_repeated_key_is_compared(spark):
    """Components over texts, rows of one key linked, against plain Python."""
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + rng.choice("mnopq")
    bases = [[word() for _ in range(60)] for _ in range(12)]
    rows = []
    for k in range(90):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 3])):
            words[rng.randrange(60)] = word()
        rows.append((rng.randrange(60), " ".join(words)))
    rows += [(5, None), (5, ""), (None, rows[0][1]), (2, rows[0][1])]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in ((t or "").split() for _, t in rows)]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    live = [k for k, (key, _) in enumerate(rows) if key is not None and sets[k]]
    for n, i in enumerate(live):
        for j in live[:n]:
            if rows[i][0] == rows[j][0] or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    least = {}
    for k in live:
        least[root(k)] = min(least.get(root(k), 1 << 60), rows[k][0])
    want = sorted(((key, len(sets[k]), least[root(k)] if k in live else key) for k, (key, _) in enumerate(rows)), key=repr)
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
