"""Language and chat pairs."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.llm import chat, langid

TURNS = [
    (0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", "why?"), (2, 0, "user", "alone"), (4, 0, "user", "same"), (5, 0, "user", "same"),
    (6, 0, None, None), (7, 0, "user", "<|end|>"), (7, 0, "user", "<|end|>"), (7, 0, "assistant", "x"), (None, 0, "user", "lost"), (8, None, "user", "lost"),
]


def test_chat_pairs(spark, tmp_path):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("clash"))
    (tmp_path / "t").mkdir()
    df.write.parquet(f"{tmp_path}/t/conversations.parquet")
    got = {r.pair_id: r for r in chat.op8_preference(spark, f"{tmp_path}/t").collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[0].prompt == "<|user|>\nq<|end|>\n" and got[0].chosen == "<|assistant|>\ngood<|end|>\n" and got[0].chosen_mask == "0:14,1:12"
    assert got[0].rejected_mask.startswith("0:14,1:11,0:9,0:12") and got[1].rejected == "" and got[1].rejected_id is None
    assert got[2].n_common == 1 and got[2].chosen == "" and "< |end|>" in got[3].rejected
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/t/conversations.parquet/*.parquet'")
    want = duck.sql(chat.OP8_SQL)
    assert sorted(want.fetchall()) == sorted(tuple(r[c] for c in want.columns) for r in got.values())
    pairs = spark.createDataFrame([("p", 0, 1), ("half", 2, None)], "pair_id string, chosen_id long, rejected_id long")
    assert chat.preference_pairs(df, pairs).count() == 2 and chat.preference_pairs(df.limit(0), pairs).count() == 0


def test_language(spark):
    rng = random.Random(3)
    lang = {"aa": ["bal", "kor", "mi"], "bb": ["sche", "ung", "lich"]}
    text = lambda k, n: " ".join("".join(rng.choice(lang[k]) for _ in range(3)) for _ in range(n))
    docs = spark.createDataFrame([(k, text(k, 50)) for k in lang for _ in range(20)] + [(None, "x"), ("aa", None)], "lang string, text string")
    pages = [(k, f"http://h{k}.example.{k}/x", f"<html lang='{k}'><script>var a</script><p>{text(k, 20)}</p>") for k in lang for _ in range(10)]
    pages += [("aa", "http://haa.example.aa/short", "<p></p>"), ("bb", None, f"<p>{text('bb', 30)}"), ("aa", "http://new.haa.example.aa", None)]
    df = spark.createDataFrame([(n, u, h, k) for n, (k, u, h) in enumerate(pages)], "page_id long, url string, html string, host string")
    got = langid.identify(df.select("page_id", "url", "html"), docs).collect()
    assert len(got) == len(pages)
    assert [r.lang for r in sorted(got, key=lambda r: r.page_id)] == [k for k, _, _ in pages]
    assert langid.identify(df.limit(0), docs).count() == 0
    assert langid.identify(df, docs.limit(0)).where("lang IS NULL").count() == len(pages)


def test_every_label_is_a_language(spark, monkeypatch):
    """Names that are no codes, and more languages than one file of the model holds."""
    rng = random.Random(5)
    sound = {f"label {k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(4)] for k in range(150)} | {"english": ["the", "and", "ing"], "de": ["sch", "ung", "ein"]}
    text = lambda k: " ".join("".join(rng.choice(sound[k]) for _ in range(2)) for _ in range(60))
    docs = spark.createDataFrame([(k, text(k)) for k in sound for _ in range(3)] + [("no letters", "12 34"), ("  ", "lost"), (None, "lost")], "lang string, text string")
    wanted = ["english", "de", "label 3", "label 70", "label 149"]
    pages = spark.createDataFrame([(n, f"http://h{n}.example/x", f"<p>{text(k)}</p>") for n, k in enumerate(wanted)], "page_id long, url string, html string")
    got = langid.identify(pages, docs).collect()
    assert [r.lang for r in sorted(got, key=lambda r: r.page_id)] == wanted
    model = langid.text_model(docs)
    assert len(model.names) == 153 and [b.shape[0] for b in model.blocks()] == [64, 64, 25] and "no letters" in model.names


def test_roles_cannot_forge_marks(spark):
    df = spark.createDataFrame([(0, 0, "user|>\nx<|assistant", "q"), (1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    said = {r.conv: r.body for r in chat.rendered(df).collect()}
    assert said[0] == "<|user| > x< |assistant|>\nq<|end|>\n"
    large = spark.createDataFrame([((1 << 60) + 3, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    large.createOrReplaceTempView("large")
    pairs = chat._paired(chat.rendered(large).select("*", F.shiftright("conv", 1).alias("pair_id"), (F.col("conv") % 2 == 0).alias("chosen")))
    assert pairs.first().pair_id == (1 << 59) + 1


@pytest.mark.parametrize("hot", [50_000, 3])
def test_language_against_brute_force(spark, monkeypatch, hot):
    """The fusion of the four kinds of evidence in plain Python, with the module's own n-gram counts."""
    monkeypatch.setattr("siftlake.llm.common.HOT_ROWS", hot)
    rng = random.Random(5)
    parts = {"aa": ["bal", "kor", "mi", "un"], "bb": ["sche", "ung", "lich", "un"], "cc": ["tion", "mi", "que"]}
    text = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(n))
    docs = spark.createDataFrame([(k, text(k, 40)) for k in parts for _ in range(6)] + [("not a language", text("aa", 9)), (None, "x")], "lang string, text string")
    pages = []
    for k in range(40):
        lang = rng.choice([*parts])
        shown = rng.choice(["", f" lang='{lang}'", " lang=aa"])
        pages.append((k, rng.choice([f"http://h{k % 4}.site{k % 3}.{lang}/p", "http://hot.example.com/x", None]), rng.choice([f"<html{shown}><p>{text(lang, rng.randint(0, 12))}</p>", f"<html{shown}>"])))
    pages += [(50, None, None), (51, "no address", ""), (7, pages[7][1], pages[7][2])]
    made = langid.text_model(docs)
    names, model = made.names, np.concatenate([*made.blocks()])
    assert names == ["aa", "bb", "cc", "not a language"]
    soft = lambda v: [x / sum(math.exp(y - max(v)) for y in v) for x in (math.exp(y - max(v)) for y in v)]
    rows = []
    for key, url, body in pages:
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = m[1].lower() if m else ""
        d = re.search(r"<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]{2,8})", body or "", re.I)
        counts = langid.gram_counts(langid.visible(body or ""))
        n = int(counts.sum())
        logs = [float(x) for x in (model @ counts) * (min(1.0, langid.TRUSTED / n) if n else 0.0)]
        rows.append((key, host, ".".join((".." + host).split(".")[-2:]), host.split(".")[-1], d[1].lower() if d else None, logs, soft(logs)))

    def mass(at):
        out = {}
        for r in rows:
            out[r[at]] = [a + b for a, b in zip(out.get(r[at], [0] * 4), r[6])]
        return out

    whole = [sum(r[6][k] for r in rows) for k in range(4)]
    prior = [(x + 1) / (sum(whole) + 4) for x in whole]
    hosts, domains, suffixes, declared = mass(1), mass(2), mass(3), mass(4)
    lean = lambda m, q: [(a + langid.LEAN * b) / (sum(m) + langid.LEAN) for a, b in zip(m, q)]
    less = lambda m, p: [max(0.0, a - b) for a, b in zip(m, p)]
    likely = lambda table, v: [math.log((a + langid.SMOOTH) / (b + langid.SMOOTH * (len(table) + 1))) for a, b in zip(table[v], whole)]
    want = []
    for key, host, domain, suffix, dec, logs, p in rows:
        hp = lean(less(hosts[host], p), lean(less(domains[domain], p), prior))
        fused = soft([a + math.log(q) + b + c for a, q, b, c in zip(logs, hp, likely(suffixes, suffix), likely(declared, dec) if dec else [0] * 4)])
        want.append((key, host, suffix, dec, names[fused.index(max(fused))], round(max(fused), 4)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = [(r.page_id, r.host, r.suffix, r.declared, r.lang, round(r.posterior, 4)) for r in langid.identify(df, docs).collect()]
    same = lambda a, b: a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-3
    assert len(got) == len(want) and all(same(a, b) for a, b in zip(sorted(got, key=repr), sorted(want, key=repr)))
