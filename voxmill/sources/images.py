"""Image files: planes written as plain grey maps (text), read back by their names; listings of files by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxmill.operators import grid
from voxmill.sources.tables import VOXEL, exists

#: Naming of a plane's folder: channel, frame and plane.
NAME = "image--I%05d--C%02d--T%05d--Z%05d"


def write_planes(vox: DataFrame, path: str, value: Column, name: str = NAME, levels: int = 65535) -> None:
    """One folder a plane, one text line a row of the image, in the plain grey-map form: a header line, then the values.

    ``value``: a whole number from 0 to ``levels``. A line holds its own place, so a plane may have several part files.
    """
    plane = F.format_string(name, "image_id", "c", "t", "z").alias("plane")
    row = F.array_sort(F.collect_list(F.struct("x", value.cast("long").alias("v"))))
    lines = vox.groupBy(plane, "y").agg(F.concat(F.format_string("P2 %d %d :", "y", F.lit(levels)), F.array_join(F.transform(row, lambda p: p["v"].cast("string")), " ")).alias("line"))
    lines.repartition("plane").sortWithinPartitions("plane", "y").select("plane", "line").write.partitionBy("plane").text(path)


#: The name of a file's folder, without a partition column's name before it.
FOLDER = r"(?:[^/=]*=)?([^/]*)/[^/]*$"


def list_files(spark: SparkSession, path: str, pattern: str = ".*", folder: str = ".*") -> DataFrame:
    """path, size of all files below a folder whose name, and whose folder's name, match as a whole; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name, parent = F.regexp_extract("path", r"[^/]*$", 0), F.regexp_extract("path", FOLDER, 1)
    return files.where(name.rlike(f"^({pattern})$") & parent.rlike(f"^({folder})$")).select("path", F.col("length").alias("size"))


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """The voxels of ``write_planes``: image, channel, frame and plane come from the folder's name, which prunes folders too."""
    lines = spark.read.text(path)  # ``plane`` is a partition column

    def part(letter: str) -> Column:
        return F.regexp_extract("plane", rf"--{letter}(\d+)", 1).cast("int")

    head, body = F.substring_index("value", ":", 1), F.substring_index("value", ":", -1)
    rows = lines.where(F.col("value").startswith("P2 ")).select(part("I").cast("long").alias("image_id"), part("T").alias("t"), part("C").alias("c"), part("Z").cast("long").alias("z"), F.get(F.split(head, " "), 1).cast("long").alias("y"), F.posexplode(F.split(body, " ")).alias("x", "v"))
    return rows.select("image_id", "t", "c", "z", "y", F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("val"))


def sequence(spark: SparkSession, path: str, pattern: str, z_group: int, t_group: int) -> DataFrame:
    """name, z, t, place of the folders of planes that match a regular expression, whose groups of the given numbers are plane
    and frame: one stack a frame, sorted by name."""
    folders = list_files(spark, path, "part.*").select(F.regexp_extract("path", FOLDER, 1).alias("name")).where(F.col("name").rlike(pattern)).distinct()
    t = F.regexp_extract("name", pattern, t_group).cast("int")
    return folders.select("name", F.regexp_extract("name", pattern, z_group).cast("int").alias("z"), t.alias("t")).withColumn("place", F.row_number().over(W.partitionBy("t").orderBy("name")))


def region(vox: DataFrame, offset: dict[str, int], size: dict[str, int], frame: int, channel: int) -> DataFrame:
    """A cube of one frame and channel: from ``offset`` on, ``size`` voxels along each axis."""
    found = vox.where((F.col("t") == frame) & (F.col("c") == channel))
    for axis, low in offset.items():
        found = found.where(F.col(axis).between(low, low + size[axis] - 1))
    return found


def write_result(result: DataFrame, path: str) -> None:
    """Adds or replaces the planes that ``result`` (VOXEL, code) holds; those of an earlier run stay, so a job that was cut
    off goes on where it was."""
    spark = result.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        result.select(*VOXEL, "code").repartition("image_id", "t", "z").write.mode("overwrite").partitionBy("image_id", "t", "z").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def read_result(spark: SparkSession, path: str, bounds: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The planes written so far; bounds on image_id, t and z prune folders, others reach the scan."""
    found = spark.read.schema("c int, y long, x long, code int, image_id long, t int, z long").parquet(path)
    for axis, (low, high) in (bounds or {}).items():
        found = found.where(F.col(axis).between(low, high))
    return found.select(*VOXEL, "code")


def missing_planes(planes: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Planes (image_id, t, z) that the result at ``path`` does not hold yet."""
    if not exists(spark, path):
        return planes
    return planes.join(read_result(spark, path).select("image_id", "t", "z").distinct(), ["image_id", "t", "z"], "left_anti")


def write_pyramids(raw: DataFrame, result: DataFrame, classes: tuple[int, ...], path: str, levels: int = 3) -> None:
    """A data set of the raw channels (``raw``: VOXEL, val) and one for each class of ``result`` (VOXEL, code), each as an image
    and its averages of 2 x 2 blocks, of 4 x 4, and so on: folders data_set, then level. Blocks that are cut off are left out, so
    a small image may have fewer levels. Null values count in no average; a class without a voxel is an image of zeros. There
    must be nothing at ``path`` yet."""
    sets = raw.select(F.lit("raw").alias("data_set"), *VOXEL, F.col("val").cast("double").alias("val"))
    coded = grid.class_images(result, classes)
    sets = sets.unionByName(coded.select(F.concat(F.lit("class-"), "class_id").alias("data_set"), *VOXEL, F.col("val").cast("double").alias("val")))
    level = sets
    for n in range(levels):
        if n:
            key = [F.col("z"), F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")]
            counted = level.groupBy("data_set", "image_id", "t", "c", *key).agg(F.avg("val").alias("val"), F.count("*").alias("n"))
            level = counted.where("n = 4").select("data_set", *VOXEL, "val")
        level.withColumn("level", F.lit(n)).repartition("data_set", "image_id", "t", "z").write.mode("append" if n else "error").partitionBy("data_set", "level").parquet(path)
        level = level.sparkSession.read.schema(_PYRAMID).parquet(path).where(F.col("level") == n).drop("level")


_PYRAMID = "image_id long, t int, c int, z long, y long, x long, val double, data_set string, level int"


def read_pyramid(spark: SparkSession, path: str) -> DataFrame:
    """Voxels of ``write_pyramids``; filters on data_set and level prune folders."""
    return spark.read.schema(_PYRAMID).parquet(path)


def split_channels(rgb: Column) -> list[Column]:
    """The three channels of a packed 24-bit colour."""
    return [F.shiftright(rgb, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0)]


def merged_channels(red: Column, green: Column, blue: Column) -> Column:
    """Three channels packed into a 24-bit colour; values are clipped to 0..255, so none runs into its neighbour."""
    r, g, b = (F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(255)) for v in (red, green, blue))
    return r * 65536 + g * 256 + b
