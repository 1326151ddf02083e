"""Encoding, decoding and counting tokens of whole texts (operators 2 and 7).

Nulls and empty texts have no tokens. Rows are handled one by one, so repeated rows, ties and extra columns need no
rule: each input row gives one output row. A text's length does not matter: ``TextStream`` handles it in blocks.
Vocabulary files are named by a path that every executor has.
"""

from __future__ import annotations

import hashlib
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .bpe import BLOCK, CACHE_BYTES, RARE, ByteToText, Merges, TextStream, kept_bytes
from .common import sliced, table, text_list, worker_state

#: Arrays given to ``ByteToText`` at once.
DECODE_AT_ONCE = 1 << 15


@lru_cache(maxsize=4)
def merges_of(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=4)
def library_of(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def lookahead_of(path: str) -> int:
    return merges_of(path).lookahead()


def library_pieces(path: str):
    cut = library_of(path).pre_tokenizer.pre_tokenize_str

    def pieces(text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in cut(text)]

    return pieces


def ids_stream(path: str) -> TextStream:
    """Values are ids and their digits. Kept by each Python worker, with its caches, from task to task."""
    return worker_state(("ids", path), lambda: _ids_stream(path))


def packed_stream(path: str) -> TextStream:
    """Values are ids alone, as 32-bit integers."""
    return worker_state(("packed", path), lambda: TextStream(merges_of(path), lookahead_of(path), lambda ids: array("i", ids).tobytes(), library_pieces(path), CACHE_BYTES // 4))


def _ids_stream(path: str) -> TextStream:
    merges = merges_of(path)
    own = merges.ids  # one int object for each id, so that caches stay small

    def value(ids: list[int]) -> tuple[tuple[int, ...], str]:
        return tuple([own[i] for i in ids]), ",".join(map(str, ids))

    return TextStream(merges, lookahead_of(path), value, library_pieces(path))


def encode(df: DataFrame, path: str, text: str = "text", to: str = "ids", lossless: str | None = None) -> DataFrame:
    """All columns of ``df`` and ``to``: array<int>, the ids of the whole text (an existing column ``to`` is replaced).

    ``lossless`` names a column that tells whether decoding the ids gives the text again; it is found in the same pass.
    """
    added = [to] if lossless is None else [to, lossless]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, body = packed_stream(path), merges_of(path).bytes_of
        for batch in sliced(batches, text, 1 << 20):
            flat, ends, same = bytearray(), [0], []
            for t in text_list(batch[text]):
                state, back = ByteToText(), []
                for block in stream.document(t):
                    ids = b"".join(block)
                    flat += ids
                    if lossless is not None:
                        back.append(state.feed(b"".join([body[i] for i in memoryview(ids).cast("i")])))
                ends.append(len(flat) // 4)
                same.append("".join(back) + state.finish() == t)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)) if flat else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], ids, pa.array(same, pa.bool_())][: len(keep) + len(added)], [*keep, *added])

    keep = [c for c in df.columns if c not in added]
    kinds = [f"`{to}` array<int>", f"`{lossless}` boolean"][: len(added)]
    return df.mapInArrow(run, ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], *kinds]))


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """All columns of ``df`` and ``to``: the text that the ids stand for, special ones included. Null ids: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body = merges_of(path).bytes_of
        for batch in sliced(batches, ids, 1 << 20):
            texts = []
            for row in batch[ids]:
                state, row = ByteToText(), [] if row.values is None else row.values.to_numpy()
                texts.append("".join(state.feed(b"".join([body[i] for i in row[k : k + DECODE_AT_ONCE].tolist()])) for k in range(0, len(row), DECODE_AT_ONCE)) + state.finish())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(texts, pa.string())], [*keep, to])

    keep = [c for c in df.columns if c != to]
    return df.mapInArrow(run, ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], f"`{to}` string"]))


def encode_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each row: both transducers in one pass, block by block.

    Neither a text's ids nor its decoded form is ever held whole; the digests grow with the blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, body = ids_stream(path), merges_of(path).bytes_of
        for batch in sliced(batches, text):
            counts, ids_sha, text_sha = [], [], []
            for whole in text_list(batch[text]):
                n, said, back, state = 0, hashlib.sha256(), hashlib.sha256(), ByteToText()
                for block in stream.document(whole):
                    ids: list[int] = []
                    for x, _ in block:
                        ids += x
                    words = [s for _, s in block if s]
                    if words:
                        said.update((("," if n else "") + ",".join(words)).encode())
                    n += len(ids)
                    back.update(state.feed(b"".join([body[i] for i in ids])).encode())
                back.update(state.finish().encode())
                counts.append(n)
                ids_sha.append(said.hexdigest())
                text_sha.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


# --- counting ---------------------------------------------------------------------------------------------------------

#: How word-end vocabularies cut lower-cased text (fixed pattern of the published vocabulary).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters that str.split() takes for white space and the vocabulary's pattern does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def prove_whole(path: str) -> frozenset[str]:
    """Vocabulary strings that, as a piece of their own, encode to one token: shown by running the merges on each."""
    merges, proven = merges_of(path), set()
    for token, i in merges.vocab.items():
        if token.endswith(merges.end):
            data = merges.bytes_of[i]
            try:
                piece = data.decode()
            except UnicodeDecodeError:
                continue
            if piece and WORDS.fullmatch(piece) and merges.merge(data) == [i]:
                proven.add(piece)
    return frozenset(proven)


class TokenCounter:
    """Counts a text's tokens: whole-token pieces by a set lookup, the others by merging, each distinct word once."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.path, self.whole, self.merges = path, whole, merges_of(path)
        self.seen: dict[str, int] = {}
        self.room = CACHE_BYTES
        self.specials = list(self.merges.special)

    def word(self, word: str) -> int:
        if RARE.search(word):
            n = len(library_of(self.path).encode(word, add_special_tokens=False).ids)
        else:
            plain = (word if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ")).lower()
            n = sum(1 if piece in self.whole else self._merged(piece) for piece in WORDS.findall(plain))
        if self.room > 0 and len(word) < 64:
            self.seen[word] = n
            self.room -= kept_bytes(word)
        return n

    def _merged(self, piece: str) -> int:
        return len(self.merges.merge(piece.encode()))

    def text(self, text: str) -> int:
        n, parts = 0, [text]
        for name in self.specials:
            if name in text:
                parts = [y for x in parts for y in x.split(name)]
        n = len(parts) - 1
        for part in parts:
            for k in self._blocks(part):
                words = regex.split(r"\s+", k) if any(c in k for c in SEPARATORS) else k.split()
                found = [*map(self.seen.get, words)]
                if None in found:
                    found = [self.word(w) if c is None else c for w, c in zip(words, found, strict=True)]
                n += sum(found)
        return n

    @staticmethod
    def _blocks(text: str) -> Iterator[str]:
        """Blocks that end where white space begins."""
        at = 0
        while len(text) - at > 2 * BLOCK:
            m = regex.compile(r"\s").search(text, at + BLOCK)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text


def count_tokens(df: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of each row."""
    proven = df.sparkSession.sparkContext.broadcast(prove_whole(path))  # at most the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(("count", path), lambda: TokenCounter(path, proven.value))
        for batch in sliced(batches, text):
            texts = text_list(batch[text])
            n = [counter.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], [key, "n_bytes", "n_tokens", "over_limit"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)
