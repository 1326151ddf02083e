"""The prefix trie of conversations against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from siftlake.llm import turns


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + t[h:] if rebuild else t
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key, m in members.items():
        own_saved = (len(m) - 1) * len(key[-1][1].encode()) if key else 0
        for d in range(len(key) + 1):
            saved[key[:d]] += own_saved
            leaves[key[:d]] += children[key] == 0
    return {
        (min(m), len(key), min(members[key[:-1]]) if key else None, len(m), children[key], leaves[key], saved[key], hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest())
        for key, m in members.items()
    }


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-20, 160):
        n = rng.choice([1, 1, 2, 3, 4, 6, 9])
        if c % 7 == 0:
            rows += [(c, k, "user", f"common {k}") for k in range(8)]  # the same conversation again and again
        elif c % 31 == 0:
            rows += [(c, k, "user", "ß" if k < 66 else f"own {c // 62} {k}") for k in range(70 + c % 3)]  # deeper than two blocks
        else:
            rows += [(c, k if k else None, rng.choice(["user", None]), rng.choice(["a", "é", None, "", "long text " * 9])) for k in range(n)]
    rows += [(None, 0, "user", "lost"), (3, 50, "user", "twice"), (3, 50, "user", "twice")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "shards"), [(1, 4), (2, 1), (3, 23)])
def test_trie_against_plain_python(spark, tmp_path, seed, shards):
    rows = made(seed)
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, conv string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        got = [tuple(r) for r in turns.op13_turn_trie(spark, str(tmp_path)).collect()]
        plain = [tuple(r) for r in turns.trie(turns.sequences(df)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert set(plain) == brute(rows, rebuild=False) and len(plain) == len(set(plain))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.sql(turns.OP13_SQL)
    assert set(want.fetchall()) == set(got)


def test_ends_in_several_texts(spark, monkeypatch):
    rows = [(k, "one" if k % 3 else f"m{k}") for k in range(-500, 4000)]
    got = {r.mark: r.ends_sha256 for r in turns.ends(spark.createDataFrame(rows, "conv long, mark string")).collect()}
    want = defaultdict(list)
    for k, m in rows:
        want[m].append(str(k))
    assert got == {m: hashlib.sha256(",".join(x).encode()).hexdigest() for m, x in want.items()}


def test_empty_table_gives_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.trie(turns.sequences(df)).count() == 0
    lone = spark.createDataFrame([(5, None, None, None)], df.schema)
    assert [tuple(r)[:7] for r in turns.trie(turns.sequences(lone)).orderBy("depth").collect()] == [(5, 0, None, 1, 1, 1, 0), (5, 1, 5, 1, 0, 1, 0)]
