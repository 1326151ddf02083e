"""Phrase collocations against plain Python, and the parts that the small tables don't reach."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftlake.llm import phrases


def brute(rows, least, keep):
    f, n = Counter(), Counter()
    for doc, lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            w = tuple(re.findall(r"[^ \t]+", piece))
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    key = (lang or "und", w[i : i + m])
                    f[key] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    dropped = {(g, p[i:j]) for (g, p), a in cands.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * f[g, p[i:j]]}
    out = defaultdict(list)
    for (g, p), a in cands.items():
        if (g, p) not in dropped:
            score, _, l, r = min((2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
            out[g].append((-score, -a, " ".join(p).encode(), l, r))
    return {(g, k, p.decode(), -a, l, r, n[g], -s) for g, x in out.items() for k, (s, a, p, l, r) in enumerate(sorted(x)[:keep], 1)}


def made(seed=5, n=120):
    rng = random.Random(seed)
    words = ["ab", "Ab", "cd", "é", "x", "yy", "zzz", "　", "q-r"]
    glue = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]
    text = lambda: "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randrange(60)))
    rows = [(k, rng.choice(["en", "fr", None]), text()) for k in range(n)]
    return [*rows, *rows[:40], (None, "en", text()), (7, "en", None), (8, "en", ""), (9, None, " ., \n")]


def test_against_plain_python(spark, monkeypatch):
    used = []
    rows = made()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, lang string, text string, phrase int")
    for least, keep in ((3, 2000), (12, 7)):
        got = phrases.collocations(df, least=least, keep=keep)
        assert {tuple(r) for r in got.collect()} == brute(rows, least, keep)
    # no check fits: all are counted again by string
    monkeypatch.setattr(phrases, "verified", lambda *a, real=phrases.verified: used.append(1) or real(*a))
    monkeypatch.setattr(phrases, "spelled", lambda *a, real=phrases.spelled: real(*a).withColumn("mark", F.lit(5)))
    assert {tuple(r) for r in phrases.collocations(df, least=3).collect()} == brute(rows, 3, 2000) and used
    assert phrases.collocations(df.limit(0), least=1).count() == 0


def test_query_is_what_its_sql_says(spark, tmp_path):
    rows = made(seed=8, n=400)
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = phrases.op12_phrases(spark, str(tmp_path)).toPandas()
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(phrases.OP12_SQL)
    assert len(got) > 20 and {tuple(r) for r in got[want.columns].itertuples(index=False)} == set(want.fetchall())


def block_of(*texts):
    (block,) = phrases.blocks([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["en"] * len(texts)), pa.array(texts)], ["doc", "lang", "text"])])
    return block


def test_words_whose_hashes_collide_are_parted():
    block = block_of("a bb a", "cc bb a")
    assert len(set(block.word_ids().tolist())) == 3
    block.hash = np.full(len(block), 7, np.uint64)
    ids = block.word_ids().tolist()
    assert ids[0] == ids[2] == ids[5] and ids[1] == ids[4] and len(set(ids)) == 3
    assert block.whole(2).tolist() == [True, True, False, True, True]  # no run goes on into the next text


def test_long_texts_in_blocks(monkeypatch):
    text = "one two three. " * 50 + "w" * 500 + " end; x"
    whole = Counter(block_of(text).fingerprints(2)[block_of(text).whole(2)].tolist())
    monkeypatch.setattr(phrases, "SLAB", 64)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["en"]), pa.array([text])], ["doc", "lang", "text"])
    parts = list(phrases.blocks([batch]))
    assert len(parts) > 10 and sum((Counter(b.fingerprints(2)[b.whole(2)].tolist()) for b in parts), Counter()) == whole


def test_bit_set_in_files_read_in_turn(spark, tmp_path, monkeypatch):
    values = np.random.default_rng(1).integers(-(2**63), 2**63, 70_000, dtype=np.int64)
    df = spark.createDataFrame([(int(v),) for v in values], "fp long")
    others = np.random.default_rng(2).integers(0, 2**63, 70_000, dtype=np.int64).view(np.uint64) << np.uint64(1)
    got = phrases.BitSet.of(df)
    assert got.has(values.view(np.uint64)).all() and got.has(others).mean() < 0.03
    monkeypatch.setattr(phrases, "PIECE_BITS", 16)
    small = phrases.BitSet.of(df)
    assert small.bits > small.piece_bits == 16
    found = small.has(others)
    monkeypatch.setattr(phrases, "KEPT_BITS", 0)
    assert small.has(values.view(np.uint64)).all() and (small.has(others) == found).all() and found.mean() < 0.03
