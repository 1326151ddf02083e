"""Toxicity: the kernel against brute force, forms of insults, and held-out labels."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.llm import toxic

SYL = ["th", "er", "in", "on", "at", "es", "re", "an", "ti", "en", "or", "st"]
BAD = ["idiot", "moron", "clown", "scum", "loser"]


def labelled(n, seed=1, noise=0.0):
    rng, out = random.Random(seed), []
    for k in range(n):
        words = ["".join(rng.choice(SYL) for _ in range(rng.randint(1, 3))) for _ in range(60)]
        y = int(k % 4 == 0)
        for _ in range(rng.randint(1, 4) * y):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if rng.random() < noise:
            y = 1
        out.append((k, " ".join(w + "." if rng.random() < 0.1 else w for w in words), y))
    return out


@pytest.fixture(scope="module")
def model():
    """Fitted with one clean document in twenty labelled toxic."""
    return toxic.fit_rows([(t, y) for _, t, y in labelled(400, noise=0.05)], 0.25)


def score(model, *texts):
    return model.probability(toxic.Scorer(model).evidence(list(texts)))


def brute_kernel(x, y, width):
    """Common subsequences of ORDER characters within SPAN, weighted by the stretches they cover in both."""

    def features(s):
        out = {}
        for at in itertools.combinations(range(len(s)), toxic.ORDER):
            if at[-1] - at[0] < toxic.SPAN:
                u = "".join(s[k] for k in at)
                out[u] = out.get(u, 0) + toxic.DECAY ** (at[-1] - at[0] + 1)
        return out

    a, b = features(x), features(y)
    return sum(v * b.get(u, 0) for u, v in a.items()) / toxic.norm(width) / toxic.norm(len(y))


def test_kernel_is_the_subsequence_kernel():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc é") for _ in range(n))
    marks, others = [word(rng.randint(4, 12)) for _ in range(12)], [(word(rng.randint(1, 11)), 11) for _ in range(40)]
    want = [[brute_kernel(s, m, w) for m in marks] for s, w in others]
    assert np.allclose(toxic.Landmarks(marks).kernel(others), want, atol=1e-5)


def test_decision_is_that_of_the_worst_stretch(model):
    """The folded weights against the machine on every stretch."""
    text = "Then the idi-ot was. an on th e i d i o t of\nesto scum sc um"
    found = toxic.sentences([text, "", "x"])
    spelled = [found.text(a, b) for a, b in zip(found.first.tolist(), found.stops().tolist())]
    assert spelled == [" then the idiot was ", " an on th eidiot of ", " esto scum sc um ", " x "]
    value, _ = toxic.decided(found, model, model.folded())
    got, _ = toxic.worst(found, value)
    for s, v in zip(spelled, got, strict=True):
        stretches = [(s[k : k + w], w) for k in range(len(s)) for w in toxic.WIDTHS]
        assert abs((model.landmarks.kernel(stretches) @ model.alpha).max() + model.bias - v) < 1e-3


def test_held_out_accuracy(model):
    rows = labelled(200, seed=2)
    p = score(model, *[t for _, t, _ in rows])
    assert sum((x >= 0.5) == bool(y) for x, (_, _, y) in zip(p, rows, strict=True)) >= 190


def test_gaps_and_inserted_characters(model):
    base = "then erin the thatre {} on an ester."
    assert (score(model, *[base.format(x) for x in ("idiot", "id-iot", "i d i o t", "a b c i d i o t", "IDIOT!", "idxiot", "id iot", "scxum")]) >= 0.5).all()
    assert score(model, base.format("ontire"))[0] < 0.5 and score(model, "")[0] < 0.5


def test_long_texts_are_read_whole(model):
    rng = random.Random(8)
    clean = " ".join("".join(rng.choice(SYL) for _ in range(3)) for _ in range(60_000))
    dense = clean + "\n" + "idiot scum moron. " * 4000
    assert len(clean) > toxic.BLOCK and score(model, clean)[0] < 0.5 <= score(model, dense)[0]
    top = lambda t: toxic.Scorer(model).evidence([t])[0, 0]
    unbroken = "er" * 500 + "idiot" + "an" * 500
    assert top(unbroken) > top(unbroken.replace("idiot", ""))
    # wherever a block ends
    assert all(top("z" * (toxic.BLOCK - k) + " idiot " + "z" * 50) > 0 for k in range(0, 9, 2))


def test_fit_and_score(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled(300)] + [(900, None), (901, "x " * 20_000), (3, "again")], "doc_id long, text string").withColumn("toxicity", F.lit(1))
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled(300)] + [(900, None), (None, 1), (1, 7)], "doc_id long, toxic int")
    model = toxic.fit(docs, labels)
    got = toxic.score(docs, model)
    assert got.count() == 303 and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    kept = toxic.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == got.where("score < 0.5").count()
    none = toxic.fit(docs, labels.limit(0))
    assert toxic.keep_clean(docs, none).count() == 303 and toxic.score(docs.limit(0), none).count() == 0
    alone = toxic.fit(docs, labels.where("doc_id < 20"))  # too few to tell a word from chance
    assert toxic.keep_clean(docs, alone).count() == 303


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_held_out_labels_of_the_test_tables():
    """Precision and recall of 0.9 on held-out labels, and recall of 0.9 where each telling word is spelled otherwise."""
    import duckdb

    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, ''), toxic FROM '{d}/documents.parquet' JOIN '{d}/labels.parquet' USING (doc_id) WHERE toxic IN (0, 1) ORDER BY doc_id").fetchall()
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    train = [(t, y) for i, t, y in rows if not out(i)]
    bad, good = [x for x in train if x[1]], [x for x in train if not x[1]]
    model = toxic.fit_rows(bad[: toxic.SAMPLE_TOXIC] + good[: toxic.SAMPLE_CLEAN], len(bad) / len(train))
    test = [(t, y) for i, t, y in rows if out(i)]
    p, y = score(model, *[t for t, _ in test]) >= 0.5, np.array([y for _, y in test])
    assert (p & (y == 1)).sum() >= 0.9 * p.sum() and (p & (y == 1)).sum() >= 0.9 * y.sum()
    marks = [m.strip() for m in model.landmarks.stretches[:40] if m.strip().isascii() and not any(m.strip().startswith(x) for x in ("ach", "bo"))]
    holding = [t for (t, z) in test if z and any(f" {m} " in t for m in marks)]
    assert len(holding) > 30

    def spelled(t, form):
        for m in marks:
            t = t.replace(f" {m} ", f" {form(m)} ")
        return t

    half = lambda w: len(w) // 2
    for form in (lambda w: w, lambda w: " ".join(w), lambda w: "-".join(w), lambda w: w[: half(w)] + " " + w[half(w) :], lambda w: w[: half(w)] + "u" + w[half(w) :]):
        assert (score(model, *[spelled(t, form) for t in holding]) >= 0.5).mean() >= 0.9
