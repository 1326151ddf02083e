"""Fixed-width bit-packed token-id files (operator 6).

One file holds the ids of a run of documents in ascending key order. Layout, all little-endian:

    header   16 bytes: magic "SLIDFW01", width (u32), block size in ids (u32)
    blocks   ids of all documents one after the other, ``width`` bits each, cut into blocks of ``block size`` ids;
             a block is a whole number of 64-bit words (block size is a multiple of 64), the last one zero-padded
    tables   block offsets (u64 each), document starts in ids (u64 each, one more than documents), keys (i64 each)
    footer   48 bytes: number of ids, documents, blocks, null keys, offset of the tables (u64 each), magic

``width`` is the fewest bits that hold the largest id. Blocks are packed and unpacked 64 ids at a time in numpy, and the
offsets give any range of ids without reading the rest. Writers keep one block in memory. A file is written under a
name of its own and then renamed, so a task that is run again replaces it whole.

Null texts are empty: they get the end id alone. Null keys sort first. Rows with the same key are ordered by their text;
rows that repeat both are written one by one. Keys are whole numbers (others fail the cast). Texts of any length are
encoded whole, in blocks. Columns of other names are left out. An empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import TextStream, byte_alphabet
from .common import new_path, sliced, stored, table, text_list, worker_state
from .tokens import library_of, library_pieces, lookahead_of, merges_of

MAGIC = b"SLIDFW01"
BLOCK_IDS = 1 << 16
#: What a worker keeps of the ids of words it has met.
WORDS_BYTES = 200 << 20


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids, a multiple of 64 of them, in ``width`` bits each."""
    lanes = ids.astype(np.uint64).reshape(-1, 64)
    words = np.zeros((len(lanes), width), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        words[:, word] |= lanes[:, k] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= lanes[:, k] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    out, mask = np.empty((len(words), 64), np.uint32), np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = x & mask
    return out.ravel()


class Writer:
    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_null = 0
        self.at, self.offsets, self.starts, self.keys = 16, [], [0], []
        sink.write(MAGIC + struct.pack("<II", width, BLOCK_IDS))

    def add(self, key: int | None, parts: list[np.ndarray]) -> None:
        for part in parts:
            self.held.append(part)
            self.n_held += len(part)
            self.n_ids += len(part)
        self.n_null += key is None
        self.keys.append(0 if key is None else key)
        self.starts.append(self.n_ids)
        if self.n_held >= BLOCK_IDS:
            ids = np.concatenate(self.held)
            whole = len(ids) - len(ids) % BLOCK_IDS
            for k in range(0, whole, BLOCK_IDS):
                self._block(ids[k : k + BLOCK_IDS])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.sink.write(data)
        self.offsets.append(self.at)
        self.at += len(data)

    def close(self) -> None:
        if self.n_held:
            ids = np.concatenate(self.held)
            self._block(np.concatenate([ids, np.zeros(-len(ids) % 64, ids.dtype)]))
        for values, kind in ((self.offsets, "<u8"), (self.starts, "<u8"), (self.keys, "<i8")):
            self.sink.write(np.array(values, kind).tobytes())
        self.sink.write(struct.pack("<QQQQQ", self.n_ids, len(self.keys), len(self.offsets), self.n_null, self.at) + MAGIC)


class Reader:
    """Random access to a file: ``ids(a, b)`` reads the blocks that hold ids a to b and no others."""

    def __init__(self, source, size: int):
        self.source = source
        magic, self.width, self.block = struct.unpack("<8sII", self._bytes(0, 16))
        *counts, end = struct.unpack("<QQQQQ8s", self._bytes(size - 48, 48))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not an id file, or cut short")
        self.n_ids, self.n_docs, n_blocks, self.n_null, at = counts
        tables = self._bytes(at, size - 48 - at)
        self.offsets = np.frombuffer(tables, "<u8", n_blocks)
        self.starts = np.frombuffer(tables, "<u8", self.n_docs + 1, 8 * n_blocks).astype(np.int64)
        self.keys = np.frombuffer(tables, "<i8", self.n_docs, 8 * (n_blocks + self.n_docs + 1))
        self.tables_at = at

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, first: int, stop: int) -> np.ndarray:
        if stop <= first:
            return np.empty(0, np.uint32)
        a, b = first // self.block, (stop - 1) // self.block
        end = int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else self.tables_at
        got = unpack(self._bytes(int(self.offsets[a]), end - int(self.offsets[a])), self.width)
        return got[first - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def key(self, k: int) -> int | None:
        return None if k < self.n_null else int(self.keys[k])


def library_stream(path: str) -> TextStream:
    """Cuts text into words and pieces; the ids of a piece come from the tokenizers library, once for each word kept.

    Merges never cross such pieces, so a text's ids are those of its pieces one after the other.
    """
    model = library_of(path).model
    letters = {b: ch for ch, b in byte_alphabet().items()}

    class Words(TextStream):
        def ids_of(self, piece: str, keep: bool = True) -> list[int]:
            return [t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(letters))]

    merges = merges_of(path)
    return worker_state(("library", path), lambda: Words(merges, lookahead_of(path), lambda ids: array("I", ids).tobytes(), library_pieces(path), WORDS_BYTES))


def write(df: DataFrame, path: str, end_id: int, to: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all rows and write their ids, in ascending key order, as files in folder ``to``.

    Returns the manifest, one row a file: file, part, n_docs, n_ids. Rows are dealt by key ranges, so parts are in
    order; a hot key only makes its own range longer.
    """
    from pyarrow import fs

    width = width_of(max(len(merges_of(path).bytes_of), end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, part = library_stream(path), TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(to)
        name, own = f"{root}/part-{part:06d}.ids", f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        writer = sink = None
        end = np.array([end_id], np.uint32)
        for batch in sliced(batches, text):
            for k, whole in zip(batch[key].to_pylist(), text_list(batch[text]), strict=True):
                if writer is None:
                    store.create_dir(root)
                    sink = store.open_output_stream(own)
                    writer = Writer(sink, width)
                writer.add(k, [*(np.frombuffer(b"".join(block), "<u4") for block in stream.document(whole)), end])
        if writer is not None:
            writer.close()
            sink.close()
            store.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([len(writer.keys)], pa.int64()), pa.array([writer.n_ids], pa.int64())], ["file", "part", "n_docs", "n_ids"])

    rows = df.select(F.col(key).cast("long").alias(key), text)
    dealt = rows.repartitionByRange(key).sortWithinPartitions(F.col(key).asc_nulls_first(), text)
    return stored(dealt.mapInArrow(run, "file string, part int, n_docs long, n_ids long"), "ids-manifest")


def read(manifest: DataFrame, to: str, key: str = "doc_id") -> DataFrame:
    """Read the files back: key, start, n_tokens and ids_crc32 of each document, a block at a time."""
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("read",))
        for batch in batches:
            for name, before in zip(batch["file"].to_pylist(), batch["before"].to_pylist(), strict=True):
                store, _ = fs.FileSystem.from_uri(to)
                size = store.get_file_info(name).size
                with store.open_input_file(name) as source:
                    reader = Reader(source, size)
                    a = 0
                    while a < reader.n_docs:
                        # as many whole documents as about one block holds
                        b = max(a + 1, int(np.searchsorted(reader.starts, reader.starts[a] + 4 * reader.block, "right")) - 1)
                        at = int(reader.starts[a])
                        ids = reader.ids(at, int(reader.starts[b])).astype("<u4").data
                        bounds = (reader.starts[a : b + 1] - at).tolist()
                        crc = [zlib.crc32(ids[x:y]) for x, y in zip(bounds, bounds[1:])]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([reader.key(k) for k in range(a, b)], pa.int64()), pa.array(reader.starts[a:b] + before), pa.array(np.diff(reader.starts[a : b + 1])), pa.array(crc, pa.int64())],
                            [key, "start", "n_tokens", "ids_crc32"],
                        )
                        a = b

    # one row a file: counts only
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = stored(manifest.select("file", "part", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before")), "ids-files")
    n = max(1, min(manifest.count(), 20_000))
    return files.repartitionByRange(n, "part").mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    to = new_path(spark, "token-ids")
    manifest = write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, to=to)
    return read(manifest, to)
