"""A training corpus from the table ``documents``: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import langid
from voxmill.llm._common import drop_rows, table, written
from voxmill.llm.decontaminate import contamination
from voxmill.llm.nearcopies import keep_one
from voxmill.llm.packing import digest, pack_documents
from voxmill.llm.substrings import remove_repeats
from voxmill.llm.tokens import vocabulary

#: Bytes of an Arrow batch between Spark and Python, about. By Spark's default a batch is 10,000 rows, so long texts would
#: take tens of MB in each task, once in the executor and once in its worker.
BATCH_BYTES = 4_000_000

#: A text of some length whose two likeliest languages differ by less has no language that could be told.
LEAST_MARGIN = 0.002


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts, texts without a letter and undecided ones go."""
    found = langid.identify(docs, langid.learn(docs), LEAST_MARGIN)
    return found.where("lang_pred <> 'und'").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, Jaccard similarity 0.8 or more): the smallest doc_id."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that an earlier document has. Texts without any stay as they are;
    documents of which nothing is left go. n_chars follows the text."""
    found = remove_repeats(docs, whole=False)
    cut = F.col("n_removed") > 0
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    columns["text"] = F.when(cut, F.col("kept")).otherwise(columns["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(cut, F.length("kept")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.where(~cut | (F.col("n_removed") < F.col("n_words"))).select(*(columns[c].alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of 10 words with a benchmark item."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    return drop_rows(docs, found.select(F.xxhash64("doc_id", "text_key").alias("id")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 ids."""
    return digest(pack_documents(docs, vocabulary("byte_bpe_50k.json"), at_once=2_000_000))


def _in_small_batches(stage):
    """The stage with the session's Arrow batches bounded by bytes; a smaller bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return bounded


STAGES = [
    ("language", _in_small_batches(language)),
    ("near_dedup", _in_small_batches(near_dedup)),
    ("substring_dedup", _in_small_batches(substring_dedup)),
    ("decontamination", _in_small_batches(decontamination)),
    ("packing", _in_small_batches(packing)),
]

#: Compression, fingerprints and token ids have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
