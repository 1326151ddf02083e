"""Language of web pages by Bayesian evidence fusion (operator 1).

Four kinds of evidence about a page's language are added as logarithms: how likely its text is in each language, how
likely its declared markup language and its address suffix are, and a prior of its host. The text model counts hashed
character n-grams of all labelled documents. The other three are estimated over all pages from the text's own posterior,
by grouped aggregation: each page adds its posterior to the counts of its declared language, suffix, host and domain. A
host's prior leans on its domain's, and that on the whole table's, the more the fewer other pages it has (``LEAN``); a
page's own share is taken out of its host's counts first.

Text is what stands outside of tags, scripts, styles, comments and navigation. A long text is not surer than
``TRUSTED`` n-grams; pages of any length are read whole. Null or empty pages have no text evidence and no declaration; null addresses have the host "" and
so share a prior; both still get a row. Ties go to the first language in alphabetical order. Repeated rows are scored
one by one. Columns of other names are left out. Every label is a language, whatever it looks like and however many there
are; null and blank ones are no label. The model lies in files of ``AT_ONCE`` languages, made by tasks, of which a worker
keeps ``KEPT`` bytes and reads the others for each group of pages; work and a page's row grow with the number of labels,
whose names alone come to the driver. Hosts, domains, suffixes and declared languages that very many pages share are
joined in pieces. Without any labelled document there is no language to choose, and language and posterior are null.
"""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, new_path, no_null, sliced, split_join, stored, table, text_list, worker_state

BUCKETS, LENGTHS = 1 << 15, (1, 2, 3)
SMOOTH, LEAN, TRUSTED = 0.5, 8.0, 60
#: Languages of one file of the model, pages that are scored together, bytes of the model that a worker keeps.
AT_ONCE, TOGETHER, KEPT = 64, 64, 128 << 20
_HIDDEN = re.compile(r"<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")


def visible(page: str) -> str:
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page)))


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of the lower-cased letters of a text, words set apart by one space."""
    letters = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    x = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = np.zeros(BUCKETS, np.int64)
    if len(x) < 3:
        return out
    for n in LENGTHS:
        h = np.full(len(x) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ x[k : len(x) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out += np.bincount((h >> np.uint64(20)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    return out


class Model:
    """Log probabilities (language x bucket) in files of the shared folder; names in alphabetical order."""

    def __init__(self, names: list[str], folder: str):
        self.names, self.folder = names, folder

    def blocks(self) -> Iterator[np.ndarray]:
        kept: dict[int, np.ndarray] = worker_state(("language", self.folder), dict)
        for k in range(-(-len(self.names) // AT_ONCE)):
            if k in kept:
                yield kept[k]
                continue
            store, root = fs.FileSystem.from_uri(self.folder)
            with store.open_input_stream(f"{root}/{k:06d}.f32") as source:
                block = np.frombuffer(source.read(), "<f4").reshape(-1, BUCKETS).astype(np.float64)
            if (len(kept) + 1) * block.nbytes <= KEPT:
                kept[k] = block
            yield block


def text_model(documents: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Languages and log probabilities from all labelled documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("language",))
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, counts in sums.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])
            sums.clear()

        for batch in sliced(batches, text):
            joined: dict[str, list[str]] = {}
            for name, t in zip(batch[lang].to_pylist(), text_list(batch[text]), strict=True):
                joined.setdefault(name, []).append(t)
            for name, texts in joined.items():
                sums[name] = sums.get(name, 0) + gram_counts("\n".join(texts))
                if len(sums) * BUCKETS * 8 > KEPT:
                    yield from told()
        yield from told()

    labelled = documents.where(F.trim(F.col(lang)) != "").select(lang, text)
    totals = stored(labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "gram-counts")
    names = sorted(r[lang] for r in labelled.select(lang).distinct().collect())
    folder = new_path(documents.sparkSession, "language-model")
    place = documents.sparkSession.createDataFrame([(n, k // AT_ONCE, k % AT_ONCE) for k, n in enumerate(names)], "lang string, block int, at int")

    def write(group: pa.Table) -> pa.Table:
        worker_state(("language",))
        block = group["block"][0].as_py()
        dense = np.full((min(AT_ONCE, len(names) - block * AT_ONCE), BUCKETS), SMOOTH)
        some = group.filter(group["bucket"].is_valid())
        dense[some["at"].to_numpy(), some["bucket"].to_numpy()] += some["n"].to_numpy()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        own = f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as sink:
            sink.write(np.log(dense / dense.sum(1, keepdims=True)).astype("<f4").tobytes())
        store.move(own, f"{root}/{block:06d}.f32")
        return pa.table({"block": pa.array([block], pa.int32())})

    # at most AT_ONCE x BUCKETS counts a group; labels whose documents have no letters too
    place.join(totals, "lang", "left").select("block", "at", "bucket", "n").groupBy("block").applyInArrow(write, "block int").write.format("noop").mode("overwrite").save()
    return Model(names, folder)


def page_evidence(pages: DataFrame, model: Model, key: str, body: str) -> DataFrame:
    """key, url and the text's log likelihoods, an array over languages (of at most TRUSTED n-grams' weight)."""
    keep = [c for c in pages.columns if c != body]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in sliced(batches, body):
            for k in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(k, TOGETHER)
                counts = np.stack([gram_counts(visible(page)) for page in text_list(batch[body])]).astype(np.float64)
                n = counts.sum(1)
                logs = np.concatenate([counts @ block.T for block in model.blocks()], axis=1) * np.where(n > 0, np.minimum(1.0, TRUSTED / np.maximum(n, 1)), 0.0)[:, None]
                ends = np.arange(len(n) + 1, dtype=np.int32) * logs.shape[1]
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.ListArray.from_arrays(pa.array(ends), pa.array(logs.ravel()))], [*keep, "text_log"])

    return pages.mapInArrow(run, ", ".join([*[f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep], "text_log array<double>"]))


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def declared_language(page: Column) -> Column:
    found = F.lower(F.regexp_extract(page, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]{2,8})", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def identify(pages: DataFrame, documents: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """key, host, suffix, declared, text_lang, lang, posterior of each row."""
    model = text_model(documents)
    names = model.names
    if not names:
        none = F.lit(None).cast("string")
        return pages.select(key, host_of(no_null(url)).alias("host"), none.alias("suffix"), declared_language(no_null(body)).alias("declared"), none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("posterior"))
    n = len(names)
    rows = pages.select(F.col(key), host_of(no_null(url)).alias("host"), declared_language(no_null(body)).alias("declared"), F.col(body).alias("__body"))
    rows = rows.withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).withColumn("domain", F.array_join(F.slice(F.split(F.concat(F.lit(".."), F.col("host")), r"\."), -2, 2), "."))
    rows = page_evidence(rows, model, key, "__body").withColumn("p", softmax(F.col("text_log")))
    rows = stored(rows, "page-evidence")

    def mass(*by: str) -> DataFrame:
        """Posterior of each language by group: partial sums in each task first, so hot hosts send few rows."""
        sums = rows.select(*by, F.posexplode("p").alias("k", "x")).groupBy(*by, "k").agg(F.sum("x").alias("x"))
        return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("m"))  # as many as languages

    whole = [r["x"] for r in rows.select(F.posexplode("p").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()] or [0.0] * n
    whole = F.array(*[F.lit(float(x)) for x in whole])
    total = F.aggregate(whole, F.lit(0.0), lambda a, x: a + x)
    prior = F.transform(whole, lambda x: (x + 1) / (total + n))

    def likelihood(column: str) -> DataFrame:
        """log P(value | language) of a column's values, smoothed to the number of values."""
        found = mass(column)
        values = found.count()
        return found.select(F.col(column), F.zip_with("m", whole, lambda a, b: F.log((a + SMOOTH) / (b + SMOOTH * (values + 1)))).alias(f"{column}_log"))

    domains = mass("domain").select("domain", F.col("m").alias("dm"))
    hosts = mass("host").select("host", F.col("m").alias("hm"))
    # a domain's and a host's counts without those of the page itself
    size = lambda m: F.aggregate(m, F.lit(0.0), lambda a, x: a + x)
    less = lambda m, p: F.zip_with(m, p, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    joined = rows.withColumn("declared", F.coalesce("declared", F.lit("")))
    likely = likelihood("declared").where("declared IS NOT NULL")
    for key_of, few, how in (("host", hosts, "inner"), ("domain", domains, "inner"), ("suffix", likelihood("suffix"), "inner"), ("declared", likely, "left")):
        many = hot_keys(rows.select(F.coalesce(key_of, F.lit("")).alias(key_of)), key_of).collect()  # at most MOST_HOT
        joined = split_join(joined, few, key_of, F.monotonically_increasing_id(), how, many)
    joined = joined.withColumn("declared", F.when(F.col("declared") != "", F.col("declared")))
    joined = joined.withColumn("dm", less(F.col("dm"), F.col("p"))).withColumn("hm", less(F.col("hm"), F.col("p")))
    joined = joined.withColumn("dp", F.zip_with("dm", prior, lambda m, q: (m + LEAN * q) / (size(F.col("dm")) + LEAN)))
    joined = joined.withColumn("hp", F.zip_with("hm", "dp", lambda m, q: (m + LEAN * q) / (size(F.col("hm")) + LEAN)))
    none = F.array_repeat(F.lit(0.0), n)
    logs = F.zip_with(F.zip_with("text_log", F.transform("hp", lambda q: F.log(q)), lambda a, b: a + b), F.zip_with("suffix_log", F.coalesce("declared_log", none), lambda a, b: a + b), lambda a, b: a + b)
    labels = F.lit(names)
    pick = lambda p: F.element_at(labels, F.array_position(p, F.array_max(p)).cast("int"))
    fused = joined.withColumn("fused", softmax(logs))
    return fused.select(key, "host", "suffix", "declared", pick(F.col("p")).alias("text_lang"), pick(F.col("fused")).alias("lang"), F.round(F.array_max("fused"), 6).alias("posterior"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
