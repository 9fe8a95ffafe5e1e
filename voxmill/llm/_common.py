"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting (a test) gets a folder of its own; on a cluster that raises.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="voxmill-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (in a folder for each value of the columns ``by``) and read it back:
    cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        discard_path(df.sparkSession, df.written_at)


def discard_path(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Spark deletes the shuffle files of an execution when it ends, not when the driver's memory is next cleared. For jobs that run
    each DataFrame once, into a table of ``written``."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int):
    """Arrow batches of the session hold about ``most`` bytes; a smaller bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= most:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text="text"):
    """Tells rows of one doc_id apart by their text (a null text has a key too)."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def ascii_lower(text):
    """Lower-case A-Z alone. Pure ASCII takes the fast built-in; other texts keep their non-ASCII capitals."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def sub_batches(sizes, limit: int):
    """Cut rows into runs of about ``limit`` units of size; a single larger row is a run of its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def drained(batches):
    """The batches; then Arrow's pool and the C library give back to the system what they kept for them, as the Python
    worker lives on beside the next stages."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_slices(column, limit: int):
    """(first row, one after the last, texts as Python values) of runs of about ``limit`` bytes of an Arrow column, so
    that a large batch is not held as Python objects all at once."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in sub_batches(sizes, limit):
        yield a, b, column.slice(a, b - a).to_pylist()


#: Bits of a membership filter: 2 MB, whatever the number of its members.
FILTER_BITS = 1 << 24


def id_filter(ids: DataFrame) -> DataFrame:
    """A bitmap over the hashes of ``ids`` (id long), as at most FILTER_BITS / 64 rows (word, bits): safe to broadcast.

    It saves the shuffle of texts that a join would drop. It says no only where that is sure; with very many members it
    says maybe more often, and the join behind it does the rest.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    return ids.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def maybe_in(rows: DataFrame, bitmap: DataFrame) -> DataFrame:
    """``rows`` with a boolean column ``maybe``: false where ``id`` is surely not in the filter."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bit = F.call_function("shiftright", F.col("bits"), place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    joined = rows.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(bitmap), "word", "left")
    return joined.withColumn("maybe", F.coalesce(bit, F.lit(0)) == 1).drop("word", "bits")


def row_key():
    """Tells rows of documents apart by doc_id and text; rows alike in both share a key."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_key(F.col("text").cast("string")))


def drop_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``row_key`` is in ``keys`` (id long). Texts of rows that surely stay are not
    shuffled."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), row_key().alias("id"))
    split = maybe_in(rows, id_filter(keys))
    stay = split.where("not maybe").select("row").union(split.where("maybe").join(keys.distinct(), "id", "left_anti").select("row"))
    return stay.select("row.*")
