"""Corpus pipeline over ``documents``: toxicity, exact dedup, near dedup, decontamination, BPE encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of ``documents``, further ones of ``docs`` included, whatever they are called; the last returns each document's ids and
whether decoding them gives its text again.

Null and empty texts are clean, copies of each other (one of them stays), like no other text and without tokens. Rows
with a null doc_id go only if they are toxic or contaminated. Rows that repeat a doc_id are judged text by text, but stay
or go together among near duplicates. Long texts are read whole. Empty tables give no rows; without labels no row is
toxic, without benchmark items none is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import exact, leaks, near, tokens, toxic
from siftlake.llm.common import discard, new_path, scratch, small_batches, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores below one half; it learns from the labelled documents of the source tables."""
    small_batches(spark)
    model = toxic.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxic.keep_clean(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near.keep_first(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return leaks.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = tokens.encode(docs.select("doc_id", "lang", "source", "text"), path, lossless="lossless")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: No stage but exact dedup can be said in SQL; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage leaves in the shared folder is deleted once its rows are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{k}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
