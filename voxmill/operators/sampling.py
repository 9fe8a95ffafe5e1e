"""Instance sets: balancing, bags, votes, splits. Every draw is an md5 key, the same on every engine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxmill.operators import lines
from voxmill.sources.tables import VOXEL, written


def draw(*parts) -> Column:
    """A 32-bit number from the parts, joined by commas."""
    return F.conv(F.substring(F.md5(F.concat_ws(",", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


def draws(keys: Iterable[bytes], *parts: int) -> np.ndarray:
    """``draw`` of each key (with its comma at the end) and the parts, within a task."""
    end = b",".join(b"%d" % p for p in parts)
    return np.frombuffer(b"".join([hashlib.md5(key + end).digest() for key in keys]), ">u4")[::4].astype(np.int64)


def label_bags(inst: DataFrame, trees: int, percent: int) -> DataFrame:
    """Label-balanced bags: of each tree a label is in or out as a whole; rows weigh by the largest class over theirs."""
    spread = inst.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    bag = spread.where(draw("label_id", "tree_id") % 100 < percent)
    sizes = bag.groupBy("tree_id", "class_id").agg(F.count("*").alias("n"))
    weights = sizes.withColumn("weight", F.max("n").over(W.partitionBy("tree_id")) / F.col("n"))
    return bag.join(F.broadcast(weights.drop("n")), ["tree_id", "class_id"])  # trees x classes rows


def until_significant(votes: DataFrame, every: int = 10, a: float = 4.0) -> DataFrame:
    """Votes (row_id, tree_id, p0 of class 0) summed tree by tree; checked after tree 11, 21, ... and the last. The first
    check that is decisive gives class, certainty and trees used."""
    w = W.partitionBy("row_id").orderBy("tree_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = votes.withColumn("n", F.count("*").over(w)).withColumn("mean", F.round(F.sum("p0").over(w) / F.count("*").over(w), 9)).withColumn("trees", F.count("*").over(W.partitionBy("row_id")))
    p = F.greatest("mean", 1 - F.col("mean"))
    sure = (p >= 1) | ((2 * p - 1) ** 2 / (p * (1 - p) / F.col("n")) > a * a)
    checked = run.where(((F.col("n") > every) & (F.col("n") % every == 1) & sure) | (F.col("n") == F.col("trees")))
    first = checked.groupBy("row_id").agg(F.min_by(F.struct("mean", "n"), "n").alias("s"))
    return first.select("row_id", F.when(F.col("s.mean") >= 0.5, 0).otherwise(1).alias("class_id"), F.round(F.abs(2 * F.col("s.mean") - 1), 6).alias("certainty"), F.col("s.n").alias("n_trees"))


def significant_votes(votes: DataFrame, classes: int, every: int = 10, a: float = 4.0) -> DataFrame:
    """The two likeliest classes with their probabilities and the trees used, from votes (row_id, tree_id, probs: one for
    each class) summed tree by tree; checked after tree 11, 21, ... and the last. Of equal classes the first one leads."""
    w = W.partitionBy("row_id").orderBy("tree_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = votes.select("row_id", "tree_id", F.count("*").over(w).alias("n"), F.count("*").over(W.partitionBy("row_id")).alias("trees"), F.array(*(F.sum(F.get("probs", c)).over(w) for c in range(classes))).alias("sums"))
    total = F.aggregate("sums", F.lit(0.0), lambda t, x: t + x)
    ranked = F.sort_array(F.transform("sums", lambda x, i: F.struct(F.round(x / total, 9).alias("p"), (-i).alias("i"))), asc=False)
    run = run.where(((F.col("n") > every) & (F.col("n") % every == 1)) | (F.col("n") == F.col("trees"))).withColumn("r", ranked)
    p, q = F.get("r", 0)["p"], F.get("r", 1)["p"]
    sure = (p >= 1) | ((p - q) ** 2 / (p * (1 - p) / F.col("n")) > a * a)
    first = run.where(sure | (F.col("n") == F.col("trees"))).groupBy("row_id").agg(F.min_by(F.struct("r", "n"), "n").alias("s"))
    r = F.col("s.r")
    return first.select("row_id", (-F.get(r, 0)["i"]).alias("class_id"), F.get(r, 0)["p"].alias("prob"), (-F.get(r, 1)["i"]).alias("second_id"), F.get(r, 1)["p"].alias("second_prob"), F.col("s.n").alias("n_trees"))


def without_neighbours(points: DataFrame, plane: list[str], radius: int, order: list[str]) -> DataFrame:
    """What a pass through the points of each ``plane`` (columns) in the given order keeps, if each point that it keeps takes
    away those within ``radius`` of it in y and x. Points of a plane differ in y and x, and ``order`` ends with both.

    Found in rounds that do not hang on any order of work: a point that no other one left within the radius goes before is
    kept, and what lies within the radius of such a point goes. Neighbours are met by an equi-join of cells of the radius, so a
    point meets as many others as its 3 x 3 cells hold. Every round is written.
    """
    cell = max(1, radius)
    here = [*plane, "cy", "cx"]

    def around(df: DataFrame, prefix: str) -> DataFrame:
        """Each point in its own cell and the eight beside it, with y, x and place under other names."""
        steps = [F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c) for c in ("cy", "cx")]
        names = [F.col(c).alias(f"{prefix}{c}") for c in ("y", "x", "place")]
        return df.select(*plane, steps[0], "cx", *names).select(*plane, "cy", steps[1], *(f"{prefix}{c}" for c in ("y", "x", "place")))

    close = (F.abs(F.col("y") - F.col("oy")) <= radius) & (F.abs(F.col("x") - F.col("ox")) <= radius)
    own = [*plane, "y", "x"]
    left = points.select("*", F.struct(*order).alias("place"), *(F.floor(F.col(a) / cell).alias(f"c{a}") for a in ("y", "x")))
    left, kept = written(left, "points"), []
    while not left.isEmpty():
        later = left.join(around(left, "o"), here).where(close & (F.col("oplace") < F.col("place"))).select(*own).distinct()
        first = written(left.join(later, own, "left_anti"), "points")
        kept.append(first)
        beside = left.join(around(first, "o"), here).where(close).select(*own).distinct()
        left = written(left.join(beside, own, "left_anti"), "points")
    found = left
    for more in kept:
        found = found.union(more)
    return found.drop("place", "cy", "cx")


def useful_pixels(scored: DataFrame, per_class: int, radius: int, sigma: float = 2.0) -> DataFrame:
    """Voxels to learn from next: ``scored`` (VOXEL, class_id: the truth, val: correctness, under 10 if wrong) gives for each
    class of a plane up to ``per_class`` wrong ones, the most certainly wrong first and none within ``radius`` of another,
    each with a partner of another class nearby, else the most certainly wrong other one of the plane. How certainly wrong a
    voxel is tells the correctness of its plane smoothed with ``sigma``, so a wrong region goes before a wrong speck (0: the
    voxel's own); whether it is wrong, its own. Ties by y and x."""
    plane = ["image_id", "t", "c", "z"]
    blurred = lines.gaussian(scored, {"y": sigma, "x": sigma}).select(*VOXEL, F.round("val", 6).alias("blurred"))
    scored = written(scored.join(blurred, VOXEL), "scored").withColumn("own", F.col("val")).withColumn("val", F.col("blurred"))
    order = ["val", "y", "x"]
    wrong = without_neighbours(scored.where("own > 0 and own < 10"), [*plane, "class_id"], radius, order)
    place = F.row_number().over(W.partitionBy(*plane, "class_id").orderBy(*order))
    chosen = wrong.withColumn("place", place).where(F.col("place") <= per_class)  # per_class rows a class and plane
    reach = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    size = 2 * radius + 1
    near = chosen.select(*plane, "y", "x", "class_id").withColumn("dy", reach).withColumn("dx", reach)
    near = near.withColumn("cy", F.floor(F.col("y") / size) + F.col("dy")).withColumn("cx", F.floor(F.col("x") / size) + F.col("dx"))
    others = scored.select(*plane, F.col("y").alias("py"), F.col("x").alias("px"), F.col("class_id").alias("other"), F.col("val").alias("pval"), F.floor(F.col("y") / size).alias("cy"), F.floor(F.col("x") / size).alias("cx"))
    close = near.join(others, [*plane, "cy", "cx"]).where((F.col("other") != F.col("class_id")) & (F.abs(F.col("y") - F.col("py")) <= radius) & (F.abs(F.col("x") - F.col("px")) <= radius))
    local = close.groupBy(*plane, "y", "x", "class_id").agg(F.min(F.struct("pval", "py", "px")).alias("partner"))
    best = scored.groupBy(*plane, F.col("class_id").alias("other")).agg(F.min(F.struct(F.col("val").alias("pval"), F.col("y").alias("py"), F.col("x").alias("px"))).alias("b"))
    distant = chosen.select(*plane, "y", "x", "class_id").join(best, plane).where("other <> class_id").groupBy(*plane, "y", "x", "class_id").agg(F.min("b").alias("far"))
    found = chosen.join(local, [*plane, "y", "x", "class_id"], "left").join(distant, [*plane, "y", "x", "class_id"], "left").withColumn("p", F.coalesce("partner", "far"))
    return found.select(*plane, "y", "x", "class_id", "place", F.col("p.py").alias("partner_y"), F.col("p.px").alias("partner_x"), F.col("partner").isNotNull().alias("near"))


def class_weighted(inst: DataFrame) -> DataFrame:
    """Rows with the weight of their class: the size of the largest class over that of theirs."""
    sizes = inst.groupBy("class_id").agg(F.count("*").alias("size"))
    weights = sizes.select("class_id", (F.max("size").over(W.partitionBy()) / F.col("size")).alias("weight"))  # a row a class
    return inst.join(F.broadcast(weights), "class_id")


def class_shares(inst: DataFrame) -> DataFrame:
    """Share of each class and its place by size (ties by name): the model of least knowledge."""
    sizes = inst.groupBy("class_id").agg(F.count("*").alias("size"))  # a row a class
    place = F.row_number().over(W.partitionBy().orderBy(F.desc("size"), "class_id"))
    return sizes.select("class_id", (F.col("size") / F.sum("size").over(W.partitionBy())).alias("prob"), place.alias("place"))


def balanced(inst: DataFrame) -> DataFrame:
    """Rows with ``copies``, how often each is taken to give all classes an equal share; what is over a whole number is
    drawn by the md5 key of (label_id, n)."""
    sizes = inst.groupBy("class_id").agg(F.count("*").alias("size"))
    every = W.partitionBy()
    ratios = sizes.select("class_id", (F.sum("size").over(every) / F.count("*").over(every) / F.col("size")).alias("ratio"))
    over = F.floor(F.round((F.col("ratio") - F.floor("ratio")) * 1000000, 3))
    return inst.join(F.broadcast(ratios), "class_id").withColumn("copies", F.floor("ratio") + F.when(draw("label_id", "n") % 1000000 < over, 1).otherwise(0))


def rectangle_pixels(regions: DataFrame, edge: int) -> DataFrame:
    """A row for each pixel of rectangles (x0..x1, y0..y1, inclusive) that lies in an image of ``edge`` x ``edge``."""

    def inside(axis: str):
        low, high = F.greatest(F.lit(0).cast("long"), f"{axis}0"), F.least(F.lit(edge - 1).cast("long"), f"{axis}1")
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    return regions.withColumn("x", inside("x")).withColumn("y", inside("y"))


def thick_line(points: DataFrame, width: int) -> DataFrame:
    """Pixels of strokes (points in the order n of each label, ties by x and y) as wide lines: from each point but the first, ``width``
    steps across the direction it was reached in."""
    order, half = W.partitionBy("label_id").orderBy("n", "x", "y"), width // 2
    moved = points.withColumns({f"d{a}": F.col(a) - F.lag(a).over(order) for a in "xy"}).where("dx is not null").withColumn("len", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    spread = moved.withColumn("i", F.explode(F.sequence(F.lit(-half), F.lit(width - 1 - half))))

    def step(by: str):
        return F.when(F.col("len") > 0, F.col("i") * F.col(by) / F.col("len")).otherwise(0.0)

    return spread.select("label_id", "n", "i", F.floor(F.col("x") - step("dy") + 0.5).alias("px"), F.floor(F.col("y") + step("dx") + 0.5).alias("py"))
