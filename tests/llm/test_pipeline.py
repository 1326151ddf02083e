"""The pipeline, stage by stage and whole, against plain Python on planted cases."""

import random
import re

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as cp
from siftlake.llm import toxic

WORDS = [f"{a}{b}{c}" for a in "bcdfghjk" for b in ("an", "el", "or", "it") for c in ("", "s", "ta", "mo")]
BAD = ["idiot", "moron", "clown", "scum", "loser"]


def planted(n=160, seed=2):
    rng = random.Random(seed)
    prose = lambda k: [rng.choice(WORDS) for _ in range(k)]
    bench = [(k, " ".join(prose(14))) for k in range(4)] + [(4, None)]
    docs, toxic_ids, labels = [], set(), []
    for k in range(n):
        words = prose(rng.randint(40, 80))
        if k % 4 == 0:
            toxic_ids.add(k)
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        elif k % 10 == 1:
            words = docs[k - 10][1].split() if k > 10 and docs[k - 10][0] % 4 else words  # exact copy, other white space
        elif k % 10 == 3:
            near = docs[k - 1][1].split() if docs[k - 1][0] % 4 else words
            words = [*near[:-1], "changed"]
        elif k % 20 == 7:
            at = rng.randrange(len(words))
            words[at:at] = bench[k % 4][1].split()
        docs.append((k, ("  " if k % 10 == 1 else " ").join(words), "en", f"s{k % 3}", len(words)))
        labels.append((k, 1, int(k % 4 == 0)))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, " \t", "en", "s", 2), (None, "alone here", "en", "s", 2), (n + 3, "grün 漢字 \U0001f600 " * 9000, "xx", "s", 1)]
    return docs, bench, labels, toxic_ids


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def first_copies(docs):
    best: dict = {}
    key = lambda d: re.sub(r"[\x20\x09-\x0D]", "", d[1] or "")
    for d in docs:
        if d[0] is not None and (key(d) not in best or (-len(d[1] or ""), d[0]) < (-len(best[key(d)][1] or ""), best[key(d)][0])):
            best[key(d)] = d
    return [d for d in docs if d[0] is None or best[key(d)] is d]


def first_near(docs):
    sets, root = {}, {}
    for i, t, *_ in docs:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - min(5, len(w)) + 1)} if w else set()
    top = lambda x: x if root.get(x, x) == x else top(root[x])
    for a in sets:
        for b in sets:
            if None not in (a, b) and a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [d for d in docs if d[0] is None or top(d[0]) == d[0]]


def uncontaminated(docs, bench):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for _, t in bench for w in [cut(t)] for k in range(len(w) - 9)}
    return [d for d in docs if not any(tuple(w[k : k + 10]) in windows for w in [cut(d[1])] for k in range(len(w) - 9))]


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    docs, bench, labels, toxic_ids = planted()
    at = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, docs, bench, toxic_ids


def test_run_against_brute_force(spark, case, monkeypatch):
    from tokenizers import Tokenizer

    import public_tokenizers

    at, docs, bench, toxic_ids = case
    want = [[d for d in docs if d[0] not in toxic_ids]]
    want.append(first_copies(want[-1]))
    want.append(first_near(want[-1]))
    want.append(uncontaminated(want[-1], bench))
    sizes = [len(docs), *map(len, want)]
    assert all(a > b for a, b in zip(sizes, sizes[1:]))
    kept = spark.read.parquet(f"{at}/documents.parquet")
    for (name, stage), rows in zip(cp.STAGES, want):
        kept = stage(spark, kept, at)
        got = [tuple(r) for r in kept.collect()]
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(got, key=repr) == sorted(rows, key=repr), name
        kept = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(2)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in want[-1]}
    got = cp.run(spark, at).collect()
    assert sorted(((r.doc_id, r.lang, r.source, r.n_tokens, r.ids, r.lossless) for r in got), key=repr) == sorted(((i, d[2], d[3], len(ids[i]), ids[i], True) for d in want[-1] for i in [d[0]]), key=repr)


def test_stages_keep_clashing_columns_and_empty_tables(spark, case):
    at, docs, *_ = case
    odd = spark.read.parquet(f"{at}/documents.parquet").selectExpr("*", "1 AS score", "2 AS kept", "3 AS spans", "4 AS print", "5 AS set", "6 AS toxicity").where("doc_id < 30 OR doc_id IS NULL")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, odd, at).columns == odd.columns, name
        assert stage(spark, odd.limit(0), at).count() == 0, name
    assert cp.STAGES[-1][1](spark, odd, at).count() == odd.count() and cp.STAGES[-1][1](spark, odd.limit(0), at).count() == 0


def test_clean_documents_stay(spark):
    """On the test tables: toxicity drops few documents that are labelled clean and most that are labelled toxic."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = cp.toxicity(spark, docs, sf).join(labels, "doc_id")
    left = {r.toxic: r["count"] for r in kept.groupBy("toxic").count().collect()}
    all_ = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    assert left[0] >= 0.99 * all_[0] and left.get(1, 0) <= 0.5 * all_[1]
    assert toxic.SAMPLE_TOXIC <= 5000
