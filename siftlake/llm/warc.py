"""Web archives as Zstandard frames, one record a frame (operator 11): writer with de-duplication, and reader.

A ``.warc.zst`` file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary all other frames use,
itself compressed or plain; then comes one frame for each record. So a reader can begin at any record that it has the
offset of. ``write`` trains a dictionary of at most ``DICTIONARY`` bytes on the first ``TRAINED`` bytes of its own file
(none if there is too little to train on; the file then has no such frame) and lists chunks of about ``CHUNK`` compressed
bytes. ``read`` gives every chunk to a task of its own, which loads the dictionary from the file's start, decodes one
frame at a time and checks it: version line, header syntax, required headers, Content-Length against the block, the two
line breaks at the end, exactly one record in a frame, and both digests of the block and payload. What fails is a row
with ``error`` told (``strict``: the job fails).

Of records with equal payloads of ``least_bytes`` or more, the one with the largest key (of equal ones, the largest url)
is a response and the others revisit it: they hold the response's HTTP header alone, with the payload's length and digest.
Rows that repeat key, url and payload of a response are responses too. Smaller payloads are all responses. Equal means
the same SHA-256. Payloads never shuffle to find copies: only counts and the largest (key, url) of each digest do, summed
in the tasks first; digests that come once are let go, and rows of digests with many copies are dealt in pieces to the
join that tells them their response.

Null payloads are empty, null urls too; null keys come before all others. Keys are whole numbers. A task holds one
record at a time, and the training sample. Files are written under a name of their own and then renamed, so a task that
runs again replaces its file whole. Columns of other names are left out. An empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_ROWS, MOST_HOT, new_path, no_null, sliced, split_join, stored, table, worker_state

#: Fixed values of the format: magic numbers of the dictionary's frame, of a dictionary, of any frame.
SKIPPABLE, DICT_MAGIC, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY, TRAINED, CHUNK, READ, LEVEL = 1 << 16, 4 << 20, 8 << 20, 1 << 16, 3
RECORD = "key long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string, record_bytes long, file string, at long, error string"


def digest(data: bytes) -> str:
    """SHA-1 in base32, as archives tell it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, key: int | None, url: str, payload: bytes, refers_to: tuple[int | None, str] | None, date: str, number: str) -> bytes:
    """One record. Ids tell key and digest, so that a revisit names its response without a look-up."""
    told = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{name_of(key, told)}{number if kind == 'revisit' else ''}>", "WARC-Date": date, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{told}", "WARC-Block-Digest": f"sha1:{digest(block)}"}
    if kind == "revisit":
        head |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": f"<{name_of(refers_to[0], told)}>", "WARC-Refers-To-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", refers_to[1])}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def name_of(key: int | None, told: str) -> str:
    return f"urn:page:{'none' if key is None else key}:{told}"


def key_of(name: str) -> int | None:
    got = re.fullmatch(r"<urn:page:(none|-?\d+):[A-Z2-7]{32}[^>]*>", name)
    if not got:
        raise ValueError("record id of another form")
    return None if got[1] == "none" else int(got[1])


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL)
    except zstandard.ZstdError:  # too few or too small
        return None


def head_frame(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def dictionary_of(source) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary at a file's start, and where its records begin."""
    source.seek(0)
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        return None, 0
    size = struct.unpack("<I", head[4:])[0]
    body = source.read(size)
    if len(body) < size:
        raise ValueError("dictionary cut short")
    if body[:4] == struct.pack("<I", FRAME):
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    if body[:4] != struct.pack("<I", DICT_MAGIC):
        raise ValueError("no dictionary in the leading frame")
    return zstandard.ZstdCompressionDict(body), 8 + size


def frames(source, dictionary: zstandard.ZstdCompressionDict | None, at: int, stop: int) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, content, None) of each frame that begins in at .. stop, or (offset, None, what is wrong) and the end."""
    tool = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    source.seek(at)
    data = b""
    while at < stop:
        frame, parts, taken = tool.decompressobj(), [], 0
        try:
            while not frame.eof:
                data = data or source.read(READ)
                if not data:
                    yield at, None, "frame cut short"
                    return
                parts.append(frame.decompress(data))
                taken += len(data) - len(frame.unused_data)
                data = frame.unused_data
        except zstandard.ZstdError as e:
            yield at, None, f"no valid frame: {e}"
            return
        yield at, b"".join(parts), None
        at += taken


def parsed(data: bytes) -> dict:
    """Headers and what the block tells of its payload; ValueError if anything is not as it should be."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no version line")
    said: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError("malformed header")
        said[name.lower()] = value.strip()
    if lost := [x for x in REQUIRED if x.lower() not in said]:
        raise ValueError(f"without {lost[0]}")
    if not said["content-length"].isdigit() or len(rest) != int(said["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("block of another length than told")
    block = rest[:-4]
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z", said["warc-date"]):
        raise ValueError("malformed date")
    if "warc-block-digest" in said and said["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    out = {"type": said["warc-type"], "headers": said, "payload": None, "bytes": None, "digest": said.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    if out["type"] in ("response", "revisit"):
        http, mark, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
        if not mark or not length:
            raise ValueError("no HTTP header with a length")
        out["bytes"] = int(length[1])
        if out["type"] == "response":
            if len(payload) != out["bytes"]:
                raise ValueError("payload of another length than told")
            if out["digest"] is not None and digest(payload) != out["digest"]:
                raise ValueError("payload digest differs")
            out["payload"] = payload
        elif payload or "warc-refers-to" not in said or out["digest"] is None:
            raise ValueError("revisit with a payload, or without digest or response")
    return out


def responses(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """rows (key, url, payload) with ``kept``: of copies, the (key, url) that is the response, else null."""
    told = rows.withColumn("sha", F.when(F.octet_length("payload") >= least_bytes, F.unhex(F.sha2("payload", 256))))
    copies = told.where("sha IS NOT NULL").groupBy("sha").agg(F.count("*").alias("n"), F.max(F.struct("key", "url")).alias("kept")).where("n > 1")
    known = stored(copies, "copies")
    most = F.greatest(F.lit(HOT_ROWS), F.ceil(F.lit(rows.count() / MOST_HOT)))
    hot = [tuple(r) for r in known.where(F.col("n") > most).select("sha", F.ceil(F.col("n") / most).cast("int")).collect()]  # at most MOST_HOT
    return split_join(told, known.select("sha", "kept"), "sha", F.xxhash64("key", "url"), "left", hot)


def write(rows: DataFrame, to: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write rows (key, url, payload, kept) as archives in folder ``to``; the chunks to read: file, dictionary, at, stop, n."""
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("archive",))
        part, number, store, root = TaskContext.get().partitionId(), 0, *fs.FileSystem.from_uri(to)
        name, own = f"{root}/part-{part:06d}.warc.zst", f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        sink = tool = None
        held: list[bytes] = []
        size = at = 0
        chunks: list[tuple[int, int, int]] = []  # at, stop, records
        open_at = open_n = 0

        def begin() -> None:
            nonlocal sink, tool, at, open_at
            store.create_dir(root)
            sink = store.open_output_stream(own)
            dictionary = trained(held)
            if dictionary is not None:
                head = head_frame(dictionary)
                sink.write(head)
                at = open_at = len(head)
            tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True) if dictionary else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
            for data in held:
                put(data)
            held.clear()

        def put(data: bytes) -> None:
            nonlocal at, open_at, open_n
            frame = tool.compress(data)
            sink.write(frame)
            at, open_n = at + len(frame), open_n + 1
            if at - open_at >= CHUNK:
                chunks.append((open_at, at, open_n))
                open_at, open_n = at, 0

        for batch in sliced(batches, "payload"):
            for key, url, payload, kept in zip(*(batch[c].to_pylist() for c in ("key", "url", "payload", "kept")), strict=True):
                response = kept is None or (kept["key"], kept["url"]) == (key, url)
                data = record("response" if response else "revisit", key, url, payload, None if response else (kept["key"], kept["url"]), date, f":{part}-{number}")
                number += 1
                if sink is None:
                    held.append(data)
                    size += len(data)
                    if size >= TRAINED:
                        begin()
                else:
                    put(data)
        if sink is None and held:
            begin()
        if sink is not None:
            sink.close()
            store.move(own, name)
            if open_n:
                chunks.append((open_at, at, open_n))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(chunks)), *(pa.array([c[k] for c in chunks], pa.int64()) for k in range(3))], ["file", "at", "stop", "n"])

    return stored(rows.select("key", "url", "payload", "kept").mapInArrow(run, "file string, at long, stop long, n long"), "archives")


def read(chunks: DataFrame, to: str, strict: bool = True, payloads: bool = False) -> DataFrame:
    """One row a record of chunks (file, at, stop) of archives in the store of ``to``; with ``payloads``, their bytes too.

    ``stop`` may lie beyond a file's end and ``at`` before its first record: (file, 0, size) reads any archive whole.
    """
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("archive",))
        store, _ = fs.FileSystem.from_uri(to)
        for batch in batches:
            for name, at, stop in zip(*(batch[c].to_pylist() for c in ("file", "at", "stop")), strict=True):
                rows: list[tuple] = []
                size = 0
                for row in _records(store, name, at, stop, strict, payloads):
                    rows.append(row)
                    size += len(row[-1]) if payloads and row[-1] else 0
                    if len(rows) == 5000 or size > READ << 6:
                        yield _batch(rows, payloads)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, payloads)

    n = max(1, min(chunks.count(), 20_000))
    dealt = chunks.select("file", "at", "stop").repartitionByRange(n, "file", "at")
    return dealt.mapInArrow(run, RECORD + (", payload binary" if payloads else ""))


def _records(store, name: str, at: int, stop: int, strict: bool, payloads: bool) -> Iterator[tuple]:
    size = store.get_file_info(name).size
    with store.open_input_file(name) as source:
        try:
            dictionary, first = dictionary_of(source)
            found = frames(source, dictionary, max(at, first), min(stop, size))
        except (ValueError, zstandard.ZstdError) as e:
            found = iter([(0, None, str(e))])
        for offset, data, wrong in found:
            got: dict = {"type": None, "headers": {}, "bytes": None, "digest": None, "payload": None}
            key = refers = None
            if wrong is None:
                try:
                    got = parsed(data)
                    key = key_of(got["headers"]["warc-record-id"])
                    refers = key_of(got["headers"]["warc-refers-to"]) if got["type"] == "revisit" else None
                except ValueError as e:
                    wrong = str(e)
            if wrong is not None and strict:
                raise ValueError(f"{name} at {offset}: {wrong}")
            row = (key, got["type"], got["headers"].get("warc-target-uri"), refers, got["bytes"], got["digest"], None if data is None else len(data), name, offset, wrong)
            yield row + ((got["payload"],) if payloads else ())


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), *([pa.binary()] if payloads else [])]
    names = [x.split()[0] for x in RECORD.split(", ")] + (["payload"] if payloads else [])
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def archive(df: DataFrame, to: str, least_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all rows as records, copies as revisits; the chunks that ``read`` takes."""
    rows = df.select(F.col(key).cast("long").alias("key"), no_null(url).alias("url"), no_null(payload).cast("binary").alias("payload"))
    return write(responses(rows, least_bytes), to)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = new_path(spark, "archive")
    got = read(archive(table(spark, sf_dir, "pages"), to), to)
    return got.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
ranked AS (
  SELECT *, first_value(page_id) OVER w AS top, first_value(url) OVER w AS top_url
  FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT page_id, strlen(html) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 1 + 5 * g, 5))::BIGINT >> (15 - 5 * k)) % 32, 1), '' ORDER BY g, k) FROM range(8) a(g), range(4) b(k)) AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top AND url = top_url THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM top AND url = top_url THEN NULL ELSE top END AS refers_to
FROM ranked
"""
