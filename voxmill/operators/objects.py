"""Connected components, what is measured on them, and their review. Objects are told apart by image, frame and channel too."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxmill.operators import grid, kernels, lines
from voxmill.sources.tables import VOXEL, written

KEY = ["image_id", "t", "c"]
#: Steps (dz, dy, dx) to half of the neighbours; the other half lies the other way.
NEIGHBOURS = {6: [(0, 0, 1), (0, 1, 0), (1, 0, 0)], 4: [(0, 0, 1), (0, 1, 0)], 8: [(0, 0, 1), (0, 1, 0), (0, 1, 1), (0, 1, -1)]}


def place(z, y, x):
    """The number of a voxel in its image; axes are under 2**20 long."""
    return z * (1 << 40) + y * (1 << 20) + x


def _labelled(steps: list[tuple[int, int, int]]):
    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        """The least voxel number of each component inside a tile: least labels go to neighbours, then each voxel takes
        the label of its label, until nothing changes."""
        at = pdf[["z", "y", "x"]].to_numpy(np.int64)
        low = at.min(axis=0) - 1
        shape = at.max(axis=0) - low + 2
        order = np.lexsort(at.T[::-1])
        pdf, at = pdf.iloc[order], at[order]
        cell = np.full(shape, len(at), np.int64)
        cell[tuple((at - low).T)] = np.arange(len(at))
        near = [cell[tuple((at - low + np.array(s)).T)] for s in steps]
        labels = np.arange(len(at) + 1)
        while True:
            before = labels.copy()
            for other in near:
                least = np.minimum(labels[:-1], np.where(other < len(at), labels[other], len(at)))
                np.minimum.at(labels, other[other < len(at)], least[other < len(at)])
                labels[:-1] = np.minimum(labels[:-1], least)
            labels = labels[labels]
            if (labels == before).all():
                break
        root = at[labels[:-1]]
        return pd.DataFrame({**{k: pdf[k] for k in VOXEL}, "label": place(root[:, 0], root[:, 1], root[:, 2])})

    return label


def components(vox: DataFrame, neighbours: int = 6, tile: int = 32) -> DataFrame:
    """``vox`` (foreground voxels) with object_id: the smallest voxel number of its component in its image, frame and channel.

    Tiles are labelled each for itself; only labels that meet at a tile's border become nodes of a graph, whose components
    are found in rounds of least neighbours and pointer jumping. ``neighbours`` 6 joins planes; 4 and 8 label each plane.
    """
    steps = NEIGHBOURS[neighbours]
    own = [F.floor(F.col(a) / tile).alias(f"t{a}") for a in ("z", "y", "x")]
    shape = ", ".join(f"{k} {vox.schema[k].dataType.simpleString()}" for k in VOXEL) + ", label long"
    if neighbours == 6:
        labelled = vox.select(*VOXEL).groupBy(*KEY, *own).applyInPandas(_labelled(steps), shape)
    else:
        labelled = vox.select(*VOXEL).groupBy(*KEY, "z", *own[1:]).applyInPandas(_labelled(steps), shape)
    labelled = written(labelled, "labelled")

    edge = F.lit(False)
    for a in ("z", "y", "x"):
        edge = edge | (F.col(a) % tile == 0) | (F.col(a) % tile == tile - 1)
    border = labelled.where(edge).select(*KEY, place(F.col("z"), F.col("y"), F.col("x")).alias("id"), "label")
    ahead = F.explode(F.array(*(F.lit(place(*s)).cast("long") for s in steps)))
    stepped = border.select(*KEY, F.col("label").alias("a"), "id", ahead.alias("step"))
    met = stepped.select(*KEY, "a", (F.col("id") + F.col("step")).alias("id")).join(border.select(*KEY, "id", F.col("label").alias("b")), [*KEY, "id"])
    edges = written(met.where("a <> b").select(*KEY, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = _roots(edges)
    return labelled.join(roots, [*KEY, "label"], "left").select(*VOXEL, F.coalesce("root", "label").alias("object_id"))


def _roots(edges: DataFrame) -> DataFrame:
    """label, root: the least label that the edges (a < b) reach from each label they touch."""
    both = written(edges.union(edges.select(*KEY, "b", "a")), "both")
    labels = both.select(*KEY, F.col("a").alias("label"), F.col("a").alias("root")).distinct()
    while True:
        labels = written(labels, "labels")
        around = both.join(labels.select(*KEY, F.col("label").alias("b"), F.col("root").alias("near")), [*KEY, "b"]).groupBy(*KEY, F.col("a").alias("label")).agg(F.min("near").alias("near"))
        low = written(labels.join(around, [*KEY, "label"]).select(*KEY, "label", F.least("root", "near").alias("low"), "root"), "low")
        jumped = low.join(low.select(*KEY, F.col("label").alias("low"), F.col("low").alias("next")), [*KEY, "low"], "left").select(*KEY, "label", F.least("low", F.coalesce("next", "low")).alias("new"), "root")
        jumped = written(jumped, "jumped")
        if not jumped.where("new < root").limit(1).count():
            return labels
        labels = jumped.select(*KEY, "label", F.col("new").alias("root"))


def opened(objects: DataFrame, least: int) -> DataFrame:
    """Without components of fewer than ``least`` voxels."""
    big = objects.groupBy(*KEY, "object_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return objects.join(big, [*KEY, "object_id"], "left_semi")


def _moment(a: str, b: str) -> Column:
    """Population covariance of two whole coordinates, to six places, halves away from zero. It comes from sums of whole numbers,
    so the order of the voxels, which a running covariance follows, moves no half to the other side."""
    n = "cast(count(*) as decimal(20, 0))"
    once = "cast(sum({}) as decimal(20, 0))"
    m = f"({n} * sum(cast(cast({a} as long) * {b} as decimal(13, 0))) - {once.format(a)} * {once.format(b)})"
    return F.expr(f"cast((2000000 * abs({m}) + {n} * {n}) div (2 * {n} * {n}) as double) / 1e6 * if({m} < 0, -1, 1)")


def measures(objects: DataFrame) -> DataFrame:
    """Volume, bounding box, centroid and second moments of each object."""
    return objects.groupBy(*KEY, "object_id").agg(
        F.count("*").alias("volume"),
        *(f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in ("z", "y", "x")),
        *(F.round(F.avg(a), 6).alias(f"mean_{a}") for a in ("z", "y", "x")),
        *(_moment(a, b).alias(f"cov_{a}{b}") for a, b in (("z", "z"), ("y", "y"), ("x", "x"), ("z", "y"), ("z", "x"), ("y", "x"))),
    )


def ellipsoids(measured: DataFrame) -> DataFrame:
    """Inertia ellipsoid of each object of ``measures``: its radii, largest first, and the direction of the longest axis as
    azimuth and elevation in degrees (null where two radii are as long)."""
    cov = {(a, b): F.col(f"cov_{a}{b}") for a, b in (("z", "z"), ("y", "y"), ("x", "x"), ("z", "y"), ("z", "x"), ("y", "x"))}
    values = lines.eigenvalues(cov, ["z", "y", "x"])
    found = measured.withColumns({f"l{i}": v for i, v in enumerate(values)})
    sym = cov | {(b, a): v for (a, b), v in cov.items()}

    def product(a: str, b: str) -> Column:  # of the matrix without the second and without the third eigenvalue
        return sum(((sym[a, k] - (F.col("l1") if a == k else 0)) * (sym[k, b] - (F.col("l2") if k == b else 0)) for k in "zyx"), F.lit(0.0))

    columns = F.array(*(F.struct(F.abs(product(b, b)).alias("size"), *(product(a, b).alias(a) for a in "zyx")) for b in "zyx"))
    found = found.withColumn("axis", F.array_max(columns)).withColumn("clear", (F.col("l0") - F.col("l1") > 1e-9) & (F.col("axis.size") > 1e-12))
    flat = F.sqrt(F.col("axis.x") ** 2 + F.col("axis.y") ** 2)
    return found.select(*measured.columns, *(F.sqrt(5 * F.greatest(F.lit(0.0), F.col(f"l{i}"))).alias(f"radius{i}") for i in range(3)), F.when(F.col("clear"), F.degrees(F.atan2("axis.y", "axis.x"))).alias("azimuth"), F.when(F.col("clear"), F.degrees(F.atan2(F.col("axis.z"), flat))).alias("elevation"))


def calibrated(measured: DataFrame, factors: tuple[int, int, int], pixel: tuple[float, float, float]) -> DataFrame:
    """With ``calibrated``: the volume in physical units, of objects found in an image binned by ``factors`` (z, y, x)."""
    unit = 1.0
    for b, p in zip(factors, pixel, strict=True):
        unit *= b * p
    return measured.withColumn("calibrated", F.col("volume") * unit)


def segmented(result: DataFrame, class_id: int, factors: tuple[int, int, int], threshold: float, least: int) -> DataFrame:
    """Objects of a class: its image binned by averages, thresholded from ``threshold`` on, labelled and opened; in voxels
    of the binned image."""
    low = 10 * class_id + 1
    image = result.withColumn("val", grid.gate(F.col("code"), low, low + 9).cast("double"))
    binned = kernels.blocks(image, factors[1], factors[2], factors[0])
    return opened(components(binned.where(F.col("val") >= threshold)), least)


def analyzed(vox: DataFrame, low: float, high: float, least: int, channel: int = 0, frame: int | None = None) -> DataFrame:
    """Measures with ellipsoids of the objects whose voxels lie in a band of values, of one channel and frame."""
    band = vox.where((F.col("c") == channel) & F.col("val").between(low, high))
    if frame is not None:
        band = band.where(F.col("t") == frame)
    return ellipsoids(measures(opened(components(band), least)))


def by_volume(measured: DataFrame, least: int, scale: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """Objects of more than ``least`` voxels, their place by volume in the image and frame (largest first, ties by id), their
    centroid in image coordinates and a display name."""
    order = W.partitionBy(*KEY).orderBy(F.desc("volume"), "object_id")
    found = measured.where(F.col("volume") > least).withColumn("place", F.row_number().over(order))
    return found.select(*KEY, "object_id", "volume", "place", *((F.col(f"mean_{a}") * b).alias(f"centre_{a}") for a, b in zip("zyx", scale, strict=True)), F.format_string("#%d volume %d", "place", "volume").alias("name"))


def drawn(image: DataFrame, objects: DataFrame, approved: DataFrame) -> DataFrame:
    """The image's voxels with ``mask``: 255 in approved objects (KEY and object_id), else 0."""
    inside = objects.join(approved, [*KEY, "object_id"], "left_semi").select(*VOXEL, F.lit(255).alias("mask"))
    return image.select(*VOXEL).join(inside, VOXEL, "left").fillna(0, ["mask"])


def without_specks(image: DataFrame, threshold: float, least: int, neighbours: int = 4) -> DataFrame:
    """Plane by plane, components above the threshold of under ``least`` voxels become 0, and holes (components of the rest
    that touch no border of the plane) become 1."""
    high = F.col("val") > threshold
    found = written(components(image.where(high), neighbours), "specks")
    rest = written(components(image.where(~high), neighbours), "holes")
    plane = image.groupBy(*KEY, "z").agg(*(f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in ("y", "x")))
    small = found.groupBy(*KEY, "z", "object_id").agg(F.count("*").alias("n")).where(F.col("n") < least).select(*KEY, "z", "object_id", F.lit(0.0).alias("new"))
    edge = (F.col("y") == F.col("min_y")) | (F.col("y") == F.col("max_y")) | (F.col("x") == F.col("min_x")) | (F.col("x") == F.col("max_x"))
    holes = rest.join(plane, [*KEY, "z"]).groupBy(*KEY, "z", "object_id").agg(F.bool_or(edge).alias("open")).where("not open").select(*KEY, "z", "object_id", F.lit(1.0).alias("new"))
    changed = found.join(small, [*KEY, "z", "object_id"]).unionByName(rest.join(holes, [*KEY, "z", "object_id"])).select(*VOXEL, "new")
    return image.join(changed, VOXEL, "left").withColumn("val", F.coalesce("new", "val")).drop("new")


def rescaled01(image: DataFrame) -> DataFrame:
    """Values from 0 to 1 by the least and the largest of each image, frame and channel; 0 where they are the same."""
    ends = image.groupBy(*KEY).agg(F.min("val").alias("low"), F.max("val").alias("high"))
    span = F.col("high") - F.col("low")
    return image.join(ends, KEY).withColumn("val", F.when(span > 0, (F.col("val") - F.col("low")) / span).otherwise(0.0)).select(*VOXEL, "val")


def post_processed(image: DataFrame, rounds: int, threshold: float, least: int, binary: bool = False, sigma: float = 2.0) -> DataFrame:
    """A probability image cleaned: smoothed, rescaled and eroded, without specks and holes; smoothed ``rounds`` times more
    and again without them; made binary if asked; dilated and rescaled."""
    blur = {"y": sigma, "x": sigma}
    found = written(kernels.extremes(rescaled01(lines.gaussian(image.select(*VOXEL, "val"), blur)), F.min), "eroded")
    found = without_specks(found, threshold, least)
    for _ in range(rounds):
        found = lines.gaussian(found, blur)
    found = without_specks(written(found, "smooth"), threshold, least)
    if binary:
        found = found.withColumn("val", (F.col("val") > threshold).cast("double"))
    return rescaled01(kernels.extremes(found, F.max))
