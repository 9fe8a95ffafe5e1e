"""Neighbourhood kernels as windows and block aggregates over voxel tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

AXES = ("z", "y", "x")


def line(axis: str):
    """All voxels along one axis, in order."""
    return W.partitionBy("image_id", "t", "c", *(a for a in AXES if a != axis)).orderBy(axis)


def blocks(vox: DataFrame, by: int, bx: int, bz: int = 1, how=F.avg, full: bool = True) -> DataFrame:
    """Block aggregate on global places; blocks cut off in x or y are dropped, those cut off in z stay."""
    key = [F.floor(F.col(a) / b).alias(a) for a, b in (("z", bz), ("y", by), ("x", bx))]
    length = [(F.max(a) - F.min(a) + 1).alias(f"n{a}") for a in ("y", "x")]
    found = vox.groupBy("image_id", "t", "c", *key).agg(how("val").alias("val"), *length)
    return (found.where((F.col("ny") == by) & (F.col("nx") == bx)) if full else found).drop("ny", "nx")


def bins(b: int, anisotropy: float, planes: int) -> tuple[int, int, int]:
    """Factors (z, y, x) of a level: z is divided by the anisotropy, and 1 for a single plane."""
    return (1 if planes == 1 else math.ceil(b / anisotropy), b, b)


def next_anisotropy(anisotropy: float, factors: tuple[int, int, int]) -> float:
    return anisotropy / (factors[2] / factors[0])


def gaussian_weights(sigma: float) -> list[float]:
    r = math.ceil(3 * sigma)
    w = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def normalised(vox: DataFrame) -> DataFrame:
    """Values less their mean over the image, in standard deviations (where there is one)."""
    stats = vox.groupBy("image_id", "t", "c").agg(F.avg("val").alias("m"), F.stddev("val").alias("s"))
    return vox.join(stats, ["image_id", "t", "c"]).withColumn("val", (F.col("val") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).drop("m", "s")


def patch_components(vox: DataFrame, size: int, step: int, k: int) -> DataFrame:
    """component, place, weight, value: the ``k`` leading right singular vectors of the matrix of all square patches (not
    centred), taken every ``step`` voxels of each plane; the largest weight of each is positive.

    Each patch is a row of one group; only the sums of products of its places (size to the fourth) leave the tasks.
    """

    def first(axis: str):
        high = F.floor(F.col(axis) / step)
        return F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.ceil((F.col(axis) - size + 1) / step)), high))

    spread = vox.withColumn("py", first("y")).withColumn("px", first("x"))
    place = (F.col("y") - F.col("py") * step) * size + F.col("x") - F.col("px") * step
    patches = spread.groupBy("image_id", "t", "c", "z", "py", "px").agg(F.array_sort(F.collect_list(F.struct(place.alias("i"), "val"))).alias("p")).where(F.size("p") == size * size)

    def products(batches):
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), float)
            g = x.T @ x
            i, j = np.indices(g.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": g.ravel()})

    sums = patches.select(F.transform("p", lambda q: q["val"]).alias("v")).mapInPandas(products, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    gram = np.zeros((size * size, size * size))
    gram[sums["i"], sums["j"]] = sums["g"]
    values, vectors = np.linalg.eigh(gram)
    rows = []
    for c in range(k):
        v = vectors[:, -1 - c]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        rows += [(c, i, float(round(x, 5)), float(round(max(values[-1 - c], 0.0) ** 0.5, 4))) for i, x in enumerate(v)]
    return vox.sparkSession.createDataFrame(rows, "component int, place int, weight double, value double")


def extremes(vox: DataFrame, how) -> DataFrame:
    """Grey erosion (min) or dilation (max) by one voxel in y and x."""
    for axis in ("x", "y"):
        vox = vox.withColumn("val", how("val").over(line(axis).rangeBetween(-1, 1)))
    return vox


def pyramid(vox: DataFrame, levels: int) -> DataFrame:
    """Levels of an image: each the average of 2 x 2 blocks of the one before."""
    found = level = vox.select("image_id", "t", "c", *AXES, "val")
    found = found.withColumn("level", F.lit(0))
    for i in range(1, levels):
        level = blocks(level, 2, 2)
        found = found.unionByName(level.withColumn("level", F.lit(i)))
    return found
