"""Tokens: transducer against the tokenizers library, decoding, counting, id files."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from siftlake.llm import bpe, idfile, tokens

P = pytest.importorskip("public_tokenizers")
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PARTS = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "1", "23", "!", "<|endoftext|>", "<|startoftext|>", "\U0001f600", "中", "Σ", "\x1c", "\r\n", "ﬁ", "é", "՘", "x" * 30, "\x85"]
LONG = ["aaaa" * 60, " " * 150, "12" * 90, "!?" * 80]


def ids(text):
    return [i for block in tokens.ids_stream(BYTES).document(text) for x, _ in block for i in x]


def texts(n, parts, most=30, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_encoding_is_the_librarys():
    library = tokens.library_of(BYTES)
    for t in texts(800, PARTS):
        assert ids(t) == library.encode(t, add_special_tokens=False).ids


def test_words_of_ascii_letters_need_no_cutting(monkeypatch):
    stream, cut, text = tokens._ids_stream(BYTES), [], "Plain words, and Zürich ends with 12 words"
    real = stream.cut
    monkeypatch.setattr(stream, "cut", lambda chunk: cut.append(chunk) or real(chunk))
    assert [i for block in stream.document(text) for x, _ in block for i in x] == tokens.library_of(BYTES).encode(text, add_special_tokens=False).ids
    assert cut == [" words,", " Zürich", " 12", " words"]  # the last one is what was held back, with its space


def test_small_blocks_and_endless_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 64)
    monkeypatch.setattr(tokens, "BLOCK", 64)
    library, counter = tokens.library_of(BYTES), tokens.TokenCounter(WORDS, tokens.prove_whole(WORDS))
    for t in texts(400, [p for p in PARTS if p != "՘"] + LONG):
        assert ids(t) == library.encode(t, add_special_tokens=False).ids
        assert counter.text(t) == len(tokens.library_of(WORDS).encode(t, add_special_tokens=False).ids)


def test_window_stays_bounded():
    stream = bpe.PieceStream(tokens.merges_of(BYTES), tokens.lookahead_of(BYTES))
    rng, got = random.Random(2), []
    data = bytes(rng.choice(b"abcdeth") for _ in range(60_000))
    for part in stream.feed(data):
        got += part
        assert len(stream.window) < tokens.lookahead_of(BYTES) + 2 * bpe.STEP
    assert got + stream.finish() == tokens.merges_of(BYTES).merge(data)


def test_lookahead_needs_a_proper_list():
    merges = tokens.merges_of(BYTES)
    assert 0 < merges.lookahead() < 2000
    other = object.__new__(bpe.Merges)
    other.__dict__ |= merges.__dict__ | {"order": merges.order[::-1]}
    with pytest.raises(ValueError):
        other.lookahead()


@pytest.mark.parametrize("step", [1, 2, 3, 7])
def test_byte_to_text(step):
    for data in ("aé中\U0001f600b".encode(), b"\xe4\xb8", b"ok\xff\xc3(", b"\xf0\x9f\x98", b""):
        state = bpe.ByteToText()
        out = "".join(state.feed(data[k : k + step]) for k in range(0, len(data), step)) + state.finish()
        assert out == data.decode("utf-8", "replace")


def test_dataframes(spark):
    rows = [(1, "Hello <|endoftext|> é", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (None, "word " * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = tokens.decode(tokens.encode(df, BYTES), BYTES).collect()
    assert sorted(r.decoded for r in back) == sorted(t or "" for _, t, _ in rows)
    got = {(r.doc_id, r.decoded_sha256) for r in tokens.encode_decode(df, BYTES).collect()}
    assert got == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows}
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df, WORDS, 2048).collect()}
    assert counts[2] == (0, 0, False) and counts[None] == (15_000, 3000, True)
    assert tokens.encode_decode(df.limit(0), BYTES).count() == 0


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31])
def test_packing(width):
    x = np.random.default_rng(width).integers(0, 1 << width, 640).astype(np.uint32)
    data = idfile.pack(x, width)
    assert len(data) == 640 * width // 8 and (idfile.unpack(data, width) == x).all()


def test_id_files(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 400)))) for k in range(60)] + [(None, "null key"), (7, None), (99, "w " * 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    to = f"file://{tmp_path}/ids"
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in idfile.read(idfile.write(df, BYTES, 0, to), to).collect()), key=lambda r: r[2])
    library, start, want = tokens.library_of(BYTES), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        x = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i is not None, i or 0, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert got == want


def test_random_access(tmp_path):
    import io

    out = io.BytesIO()
    writer = idfile.Writer(out, 17)
    docs = [np.arange(k * 1000, dtype=np.uint32) % 100_003 for k in range(40)]
    for k, d in enumerate(docs):
        writer.add(k, [d])
    writer.close()
    reader = idfile.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert all((reader.document(k) == docs[k]).all() for k in (0, 1, 17, 39))
    with pytest.raises(ValueError):
        idfile.Reader(io.BytesIO(out.getvalue()[:-1]), len(out.getvalue()) - 1)
