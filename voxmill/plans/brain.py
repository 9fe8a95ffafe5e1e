"""Training loops: sample what the last forest got wrong, train again, score the next image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators import distance, pyramid, sampling
from voxmill.plans import forest, scoring
from voxmill.sources.tables import VOXEL, written

#: Trees, depth and bins of the forests within a loop.
OPTIONS = {"trees": 8, "depth": 4, "n_bins": 16}


def _row_id():
    return F.xxhash64(*VOXEL)


def iterate(vox: DataFrame, truth: DataFrame, settings: pyramid.Settings, rounds: int, per_class: int, most_rows: int = 100_000) -> DataFrame:
    """round, rows, n, right: training from a label image. Each round scores all images with the forest so far (the first:
    by a draw), picks useful voxels from what is wrong, adds them and trains again, until there are ``most_rows``; every
    round is written, so a lost executor costs a round at most."""
    names, rows, found, nodes = pyramid.feature_names(settings), None, [], None
    truth = truth.select(*VOXEL, "class_id")
    for k in range(rounds):
        if nodes is None:
            coded = truth.select(*VOXEL, (F.when(sampling.draw(*VOXEL) % 2 == 0, 5).otherwise(15)).alias("code"))
        else:
            coded = pyramid.tile_features(vox, settings, nodes=nodes).select(*VOXEL, "code")
        seen = written(truth.join(coded, VOXEL).select(*VOXEL, "class_id", scoring.correctness(F.col("code"), F.col("class_id")).alias("val")), "seen")
        useful = sampling.useful_pixels(seen, per_class, 3)
        both = useful.select("image_id", "t", "c", "z", "y", "x").union(useful.select("image_id", "t", "c", "z", F.col("partner_y").alias("y"), F.col("partner_x").alias("x")).where("y is not null"))
        chosen = both.distinct().join(truth, VOXEL)
        vectors = pyramid.tile_features(vox, settings, keep=chosen).join(chosen, VOXEL).select(_row_id().alias("row_id"), F.lit(-1).cast("long").alias("label_id"), "class_id", *VOXEL, "features")
        rows = written(vectors if rows is None else rows.unionByName(vectors).dropDuplicates(["row_id"]), "rows")
        nodes = written(forest.train(rows, 2, len(names), **OPTIONS), "nodes")
        found.append(seen.agg(F.lit(k).alias("round"), F.count("*").alias("n"), F.count_if(F.col("val") > 10).alias("right")))
        if rows.count() >= most_rows:
            break
    last = pyramid.tile_features(vox, settings, nodes=nodes).select(*VOXEL, "code").join(truth, VOXEL)
    right = scoring.correctness(F.col("code"), F.col("class_id")) > 10
    found.append(last.agg(F.lit(len(found)).alias("round"), F.count("*").alias("n"), F.count_if(right).alias("right")))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every


def two_stages(rows: DataFrame, vox: DataFrame, settings: pyramid.Settings) -> DataFrame:
    """feature, usage of a second forest that has one feature more: the distance to the foreground that a first forest of
    background against foreground finds."""
    names = pyramid.feature_names(settings)
    plain = rows.withColumn("class_id", F.least("class_id", F.lit(1)))
    first = written(forest.train(plain, 2, len(names), **OPTIONS), "first")
    coded = pyramid.tile_features(vox, settings, nodes=first).select(*VOXEL, "class_id")
    far = distance.distance_map(written(coded, "coded"), F.col("class_id") == 1)
    more = rows.join(far, VOXEL).withColumn("features", F.concat(F.col("features").cast("array<double>"), F.array(F.sqrt(F.coalesce("d2", F.lit(1 << 40)).cast("double"))))).drop("d2")
    second = forest.train(written(more, "rows"), 2, len(names) + 1, **OPTIONS)
    return forest.usage(second, len(names) + 1).select("feature", "usage", (F.col("feature") == len(names)).alias("distance"))
