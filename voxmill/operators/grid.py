"""Grid operators: boxes, tiles, halos, padding, and joins by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.sources.tables import VOXEL


def interval(vox: DataFrame, **bounds: tuple[int, int]) -> DataFrame:
    """Voxels in an inclusive box; raw columns, so that the bounds reach the scan."""
    for axis, (low, high) in bounds.items():
        vox = vox.where(F.col(axis).between(low, high))
    return vox


def gate(v: Column, low: float, high: float) -> Column:
    """Inside [low, high]: value - low; outside: 0."""
    return F.when(v.between(low, high), v - low).otherwise(F.lit(0))


def threshold(v: Column, above: float | None = None, low: float | None = None, high: float | None = None) -> Column:
    """255 over ``above``, from ``low`` on, or from ``low`` to ``high``; else 0."""
    inside = v > above if above is not None else v >= low if high is None else v.between(low, high)
    return F.when(inside, 255).otherwise(0)


def multiplied(a: DataFrame, b: DataFrame) -> DataFrame:
    """Voxel-wise product of two images."""
    return a.select(*VOXEL, "val").join(b.select(*VOXEL, F.col("val").alias("other")), VOXEL).select(*VOXEL, (F.col("val") * F.col("other")).alias("val"))


def with_tile(vox: DataFrame, size: int) -> DataFrame:
    return vox.withColumn("ty", F.floor(F.col("y") / size)).withColumn("tx", F.floor(F.col("x") / size))


def with_halo(vox: DataFrame, size: int, halo: int, edges: dict[str, int]) -> DataFrame:
    """Each voxel in every tile (``t{axis}``) whose box, grown by ``halo``, holds it: an explode to the few tiles around, no
    range join. ``edges``: the image's length along each tiled axis; there are no tiles beyond it."""
    for axis, n in edges.items():
        low = F.greatest(F.lit(0).cast("long"), F.floor((F.col(axis) - halo) / size))
        high = F.least(F.lit((n - 1) // size).cast("long"), F.floor((F.col(axis) + halo) / size))
        vox = vox.withColumn(f"t{axis}", F.explode(F.sequence(low, high)))
    return vox


def tiles(bounds: dict[str, tuple[int, int]], sizes: dict[str, int]) -> DataFrame:
    """The tiles of an interval (inclusive bounds of each axis): number and bounds along each axis, the last one clamped."""
    spark = SparkSession.active()
    found = spark.range(1).drop("id")
    for axis, (low, high) in bounds.items():
        step = sizes.get(axis, high - low + 1)
        found = found.withColumn(f"t{axis}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((high - low) // step).cast("long"))))
        found = found.withColumn(f"{axis}0", low + F.col(f"t{axis}") * step).withColumn(f"{axis}1", F.least(F.lit(high).cast("long"), low + (F.col(f"t{axis}") + 1) * step - 1))
    return found


def tile_sizes(bounds: dict[str, tuple[int, int]], n_tiles: int | None = None, most_voxels: int | None = None) -> dict[str, int]:
    """Edges of tiles of an interval: ``n_tiles`` cuts along the slowest axis, or cubes of ``most_voxels`` at most. A tile
    holds one frame."""
    if n_tiles:
        low, high = bounds["z"]
        return {"t": 1, "z": max(1, -(-(high - low + 1) // n_tiles))}
    edge = max(1, int(round((most_voxels or 1) ** (1 / 3), 9)))
    return {"t": 1, "z": edge, "y": edge, "x": edge}


def mirror(i: Column, n: int) -> Column:
    """Place inside 0..n-1 that a place outside mirrors; the edge is not repeated."""
    r = F.pmod(i, F.lit(2 * (n - 1)))
    return F.when(r < n, r).otherwise(2 * (n - 1) - r)


def padded(vox: DataFrame, by: int, edges: dict[str, int]) -> DataFrame:
    """Images grown by ``by`` mirrored voxels at both ends of each axis of ``edges`` (axis: length): each voxel goes to all
    places ``p{axis}`` that show it, as often as a border wider than the image repeats it."""
    for axis, n in edges.items():
        at, period = F.col(axis), 2 * (n - 1)
        if period:
            places = F.array(*(k * period + side for k in range(-(by // period) - 1, by // period + 2) for side in (at, -at)))
        else:  # one voxel shows in all places
            places = F.array(*(k + at for k in range(-by, by + 1)))
        vox = vox.withColumn(f"p{axis}", F.explode(F.array_distinct(places))).where(F.col(f"p{axis}").between(-by, n - 1 + by))
    return vox


def class_images(result: DataFrame, classes: tuple[int, ...]) -> DataFrame:
    """A row for each voxel and class: the certainty where the voxel is of that class, else 0."""
    spread = result.withColumn("class_id", F.explode(F.array(*(F.lit(c) for c in classes))))
    low = F.col("class_id") * 10 + 1
    return spread.withColumn("val", F.when(F.col("code").between(low, low + 9), F.col("code") - low).otherwise(0))


def candidates(seeds: DataFrame, points: DataFrame, radius: int) -> DataFrame:
    """Seeds with the values of the points in the square of ``radius`` around, in the same plane of the same image: seeds are
    spread over the square and met by an equi-join."""

    def around(axis: str):
        return F.explode(F.sequence(F.col(axis) - radius, F.col(axis) + radius))

    spread = seeds.select(*VOXEL, around("y").alias("py")).withColumn("px", around("x"))
    plane = ["image_id", "t", "c", "z"]
    return spread.join(points.select(*plane, F.col("y").alias("py"), F.col("x").alias("px"), "val"), [*plane, "py", "px"])
