"""Reading tables, and the voxel views of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

VOXEL = ["image_id", "t", "c", "z", "y", "x"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that ``spark.checkpoint.dir`` names; only a local session may leave that unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found := tempfile.mkdtemp(prefix="voxmill-"))
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def written(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder. ``group``: bytes of a row group, which a task holds (for rows that are
    long)."""
    path = fresh_path(df.sparkSession, name)
    (df.write.option("parquet.block.size", group) if group else df.write).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def discard(*gone: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in gone:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def voxels(embeddings: DataFrame) -> DataFrame:
    """Image scan: each vector is a row of 64 voxels of a stack of 64 x 64 planes."""
    v = embeddings.select("vec_id", F.posexplode("embedding").alias("x", "v"))
    zero = F.lit(0)
    return v.select(zero.cast("long").alias("image_id"), zero.alias("t"), zero.alias("c"), F.floor(F.col("vec_id") / 64).alias("z"), (F.col("vec_id") % 64).alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("val"))


def volumes(embeddings: DataFrame) -> DataFrame:
    """Image scan: each vector is a row of 64 voxels; 256 vectors are an image of four planes."""
    v = embeddings.select("vec_id", F.posexplode("embedding").alias("x", "v"))
    zero = F.lit(0)
    return v.select(F.floor(F.col("vec_id") / 256).alias("image_id"), zero.alias("t"), zero.alias("c"), (F.floor(F.col("vec_id") / 64) % 4).alias("z"), (F.col("vec_id") % 64).alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("val"))


def time_lapse(vox: DataFrame) -> DataFrame:
    """The stack as frames of four planes, with the absolute value as a second channel."""
    split = vox.withColumn("t", F.floor(F.col("z") / 4).cast("int")).withColumn("z", F.col("z") % 4)
    return split.union(split.withColumn("c", F.lit(1)).withColumn("val", F.abs("val")))


def result(vox: DataFrame, threshold: float = 0.02) -> DataFrame:
    """A result volume: class and certainty from a box mean along x, coded as class * 10 + 1 + certainty; every 17th
    voxel is unclassified (code 0)."""
    row = W.partitionBy("image_id", "t", "c", "z", "y").orderBy("x").rowsBetween(-1, 1)
    mean = F.round(F.avg("val").over(row), 9)
    seen = vox.withColumn("mean", mean)
    code = code_of((F.col("mean") > threshold).cast("int"), F.least(F.lit(1.0), F.abs(F.col("mean") - threshold) * 10))
    none = (F.col("z") * 4096 + F.col("y") * 64 + F.col("x")) % 17 == 0
    return seen.select(*VOXEL, F.when(none, 0).otherwise(code).cast("int").alias("code"))


def code_of(class_id, certainty):
    return class_id * 10 + 1 + F.floor(F.round(certainty * 9, 7))


def truth(vox: DataFrame, threshold: float = 0.1) -> DataFrame:
    return vox.select(*VOXEL, (F.col("val") > threshold).cast("int").alias("class_id"))


def instances(lineitem: DataFrame) -> DataFrame:
    """Labelled rows: an order is a label, its line items are the labelled points."""
    return lineitem.select(F.col("l_orderkey").alias("label_id"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("class_id"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y"), F.col("l_quantity").alias("f0"), F.col("l_extendedprice").alias("f1"), F.col("l_discount").alias("f2"), F.col("l_tax").alias("f3"))


def file_names(events: DataFrame) -> DataFrame:
    """Paths of an image series, a file for each event."""
    i = F.col("event_id")
    name = F.format_string("/data/%s--W%03d--P%02d--Z%03d--T%03d--ch%d.tif", "event_type", i % 96, i % 4, i % 16, F.floor(i / 64), i % 2)
    return events.select(i.alias("file_id"), name.alias("path"))
