"""Web archives: what is written comes back; damaged files are told; copies revisit their response."""

import base64
import hashlib
import random

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from siftlake.llm import warc


def made(n=300):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice(["<p>", "é", "word ", "\r\n\r\n", "x" * 50]) for _ in range(rng.randrange(200)))
    rows = [(k, rng.choice(["http://a.example/ b", None, "http://é.example/"]), text()) for k in range(n)]
    rows += [(1000 + k, "http://c.example", rows[k % 3][2]) for k in range(60)] + [(2000, "u1", "tie"), (2000, "u2", "tie"), (2000, "u2", "tie"), (3, "z", "other text of a repeated key")]
    return [*rows, (4000, "empty", None), (4001, None, ""), (None, "null key", "no key"), (None, None, "no key"), (5000, "long", "long " * 300_000)]


@pytest.fixture
def pages(spark, tmp_path):
    spark.createDataFrame([(*r, "x", 1) for r in made()], "page_id long, url string, html string, payload string, n int").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    return spark.read.parquet(f"{tmp_path}/pages.parquet")


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archive_round_trip(spark, tmp_path, pages):
    got = [tuple(r) for r in warc.op11_warc(spark, str(tmp_path)).collect()]
    rows = made()
    top = {}
    for key, url, html in rows:
        top[html or ""] = max(top.get(html or "", (-1, "")), (-1 if key is None else key, url or ""))
    want = []
    for key, url, html in rows:
        kept = top[html or ""]
        first = (-1 if key is None else key, url or "") == kept
        want.append((key, len((html or "").encode()), b32(html), "response" if first else "revisit", None if first or kept[0] == -1 else kept[0]))
    order = lambda r: [(x is not None, x) for x in r]
    assert sorted(got, key=order) == sorted(want, key=order)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    sql = duck.sql(warc.OP11_SQL)
    assert sql.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and sorted(sql.fetchall(), key=order) == sorted(want, key=order)


def test_payloads_come_back_and_small_ones_are_kept(spark, tmp_path, pages):
    to = f"file://{tmp_path}/a"
    chunks = warc.archive(pages, to, least_bytes=4)
    got = warc.read(chunks, to, payloads=True)
    by = {(r.key, r.url, r.payload_digest): bytes(r.payload) for r in got.where("record_type = 'response'").collect()}
    for key, url, html in made():
        if len((html or "").encode()) < 4:
            assert by[key, (url or "").replace(" ", "%20"), b32(html)] == (html or "").encode()
    assert set(map(hashlib.sha256, ())) == set() and {hashlib.sha256(x).digest() for x in by.values()} == {hashlib.sha256((h or "").encode()).digest() for _, _, h in made()}
    assert got.count() == len(made())
    whole = chunks.groupBy("file").agg(F.lit(0).alias("at"), F.lit(1 << 40).alias("stop"))
    assert warc.read(whole, to).count() == len(made())


def test_hot_copies_are_dealt_in_pieces(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "HOT_ROWS", 5)
    rows = pages.select(F.col("page_id").alias("key"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    got = warc.responses(rows)
    assert got.count() == rows.count() and {r.n for r in got.where("kept IS NOT NULL").groupBy("kept").agg(F.count("*").alias("n")).collect()} >= {21, 3, 2}
    assert got.where("payload = 'tie'").select("kept.url").distinct().collect() == [("u2",)]


def archive_of(path, records, dictionary=b"", stop=None):
    path.write_bytes((dictionary + b"".join(records))[:stop])
    return path


def test_damage_is_told(spark, tmp_path):
    good = warc.record("response", 1, "http://a", b"<p>one</p>", None, "2024-01-01T00:00:00Z", "")
    twice, short = good + good, good.replace(b"one", b"oned")
    cases = {
        "good": good, "twice": twice, "short": short, "digest": good.replace(b"one", b"two"), "version": b"WARC/9" + good[8:], "without": good.replace(b"WARC-Date", b"WARC-Dote"),
        "header": good.replace(b"WARC-Date:", b"WARC-Date"), "revisit": warc.record("revisit", 2, "http://b", b"<p>one</p>", (1, "http://a"), "2024-01-01T00:00:00Z", ":0"), "info": good.replace(b"WARC-Type: response", b"WARC-Type: warcinfo"),
    }
    press = zstandard.ZstdCompressor(level=3)
    (tmp_path / "in").mkdir()
    for name, data in cases.items():
        archive_of(tmp_path / "in" / name, [press.compress(good), press.compress(data), press.compress(good)])
    archive_of(tmp_path / "in" / "cut", [press.compress(good), press.compress(good)], stop=-5)
    archive_of(tmp_path / "in" / "noise", [press.compress(good), b"nothing of the kind" * 9])
    archive_of(tmp_path / "in" / "empty", [])
    files = [(str(p), 0, 1 << 30) for p in (tmp_path / "in").iterdir()]
    chunks = spark.createDataFrame(files, "file string, at long, stop long")
    to = f"file://{tmp_path}/in"
    got = warc.read(chunks, to, strict=False).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["at"]):
        by.setdefault(r.file.rsplit("/", 1)[-1], []).append(r)
    wrong = {name: [r.error for r in rows if r.error] for name, rows in by.items()}
    assert {n for n, w in wrong.items() if not w} == {"good", "revisit", "info"} and "empty" not in by
    assert all(len(by[n]) == 3 and by[n][0].error is None and by[n][2].error is None for n in cases)
    assert wrong["twice"] == wrong["short"] == ["block of another length than told"] and wrong["digest"] == ["block digest differs"] and wrong["version"] == ["no version line"]
    assert wrong["without"] == ["without WARC-Date"] and wrong["header"] == ["malformed header"] and wrong["cut"] == ["frame cut short"] and wrong["noise"][0].startswith("no valid frame")
    assert by["revisit"][1].refers_to == 1 and by["revisit"][1].payload_bytes == 10
    with pytest.raises(Exception, match="block digest differs"):
        warc.read(chunks.where("file LIKE '%digest'"), to).collect()


def test_dictionary_frame(tmp_path):
    records = [warc.record("response", k, f"http://a/{k}", f"<html><p>number {k} of many</p></html>".encode(), None, "2024-01-01T00:00:00Z", "") for k in range(400)]
    dictionary = warc.trained(records)
    assert dictionary is not None and warc.trained([b"x"]) is None
    press = zstandard.ZstdCompressor(dict_data=dictionary)
    for head in (warc.head_frame(dictionary), (0x184D2A5D).to_bytes(4, "little") + len(dictionary.as_bytes()).to_bytes(4, "little") + dictionary.as_bytes()):
        at = archive_of(tmp_path / "x", [press.compress(r) for r in records], head)
        with at.open("rb") as source:
            known, first = warc.dictionary_of(source)
            assert first == len(head) and [d for _, d, _ in warc.frames(source, known, first, at.stat().st_size)] == records
            with pytest.raises(ValueError):
                archive_of(tmp_path / "y", [], head, stop=100)
                warc.dictionary_of((tmp_path / "y").open("rb"))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op11_warc(spark, str(tmp_path)).count() == 0
