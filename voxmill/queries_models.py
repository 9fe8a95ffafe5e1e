"""Registered queries over feature pyramids and forests: training, scoring, selection, evaluation, tiles, batches, loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.operators import objects, pyramid, sampling
from voxmill.plans import brain, compare, forest
from voxmill.queries import INST, inst, query
from voxmill.queries_volumes import FEATURES, PLACE, stored, vlab, vols
from voxmill.sources import images, instances, tables
from voxmill.sources.tables import VOXEL, fresh_path

_KEY = "CAST('0x' || substr(md5(concat({0})), 1, 8) AS BIGINT)"
_ROWS = f"""rws AS (SELECT o_orderkey AS row_id, o_custkey AS label_id, o_totalprice AS f0, CAST(o_custkey % 50 AS DOUBLE) AS f1, CAST(day(o_orderdate) AS DOUBLE) AS f2, CAST(o_orderkey % 100 AS DOUBLE) AS f3,
CASE WHEN {_KEY.format("o_orderkey")} % 10 = 0 THEN 0 WHEN o_custkey % 50 < 20 THEN 0 WHEN o_orderkey % 100 < 50 THEN 1 ELSE 2 END AS class_id FROM orders)"""


def rows_of(spark, d):
    """Orders as training rows: row_id, label_id (the customer), four features, and a class that two of them tell, but for
    one row in ten."""
    o = tables.table(spark, d, "orders")
    features = [F.col("o_totalprice").cast("double"), (F.col("o_custkey") % 50).cast("double"), F.dayofmonth("o_orderdate").cast("double"), (F.col("o_orderkey") % 100).cast("double")]
    known = F.when((sampling.draw("o_orderkey") % 10 == 0) | (F.col("o_custkey") % 50 < 20), 0).when(F.col("o_orderkey") % 100 < 50, 1).otherwise(2)
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("label_id"), known.alias("class_id"), F.array(*features).alias("features"))


# --- splits, bags, votes --------------------------------------------------------------------------------------------


def _plog(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ({x}) * log2({x}) ELSE 0 END"


def _entropy(parts: list[str]) -> str:
    return f"({_plog(' + '.join(parts))}" + "".join(f" - {_plog(x)}" for x in parts) + ")"


_LEFT, _RIGHT, _ALL = ([f"{side}{c}" for c in range(3)] for side in "lrt")
_GAIN = f"round(({_entropy(_LEFT)} + {_entropy(_RIGHT)}) / (t0 + t1 + t2), 9) AS after, round({_entropy(_ALL)} / (t0 + t1 + t2) - ({_entropy(_LEFT)} + {_entropy(_RIGHT)}) / (t0 + t1 + t2), 9) AS gain, (l0 + l1 + l2) / (t0 + t1 + t2) AS share_left"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE class_id = {c}) AS c{c}" for c in range(3))
_SPLIT = "SELECT DISTINCT ON (node_id) node_id, feature, bin, round(gain, 6) AS gain, round(share_left, 6) AS share_left FROM g ORDER BY node_id, after, feature, bin"
query("g2_split_level", f"""WITH {_ROWS}, e AS (SELECT label_id % 7 AS node_id, class_id, unnest([0, 1, 2, 3]) AS feature, unnest([floor(f0 / 20000), floor(f1 / 5), f2, floor(f3 / 7)]) AS bin FROM rws),
h AS (SELECT node_id, feature, CAST(bin AS INT) AS bin, {_COUNTS} FROM e GROUP BY 1, 2, 3),
s AS (SELECT node_id, feature, bin, lead(bin) OVER w AS more, {', '.join(f'sum(c{c}) OVER w AS l{c}, sum(c{c}) OVER v AS t{c}' for c in range(3))} FROM h WINDOW w AS (PARTITION BY node_id, feature ORDER BY bin), v AS (PARTITION BY node_id, feature)),
k AS (SELECT *, t0 - l0 AS r0, t1 - l1 AS r1, t2 - l2 AS r2 FROM s WHERE more IS NOT NULL), g AS (SELECT *, {_GAIN} FROM k) {_SPLIT}""")(
    lambda s, d: split_level(rows_of(s, d), [F.floor(F.get("features", 0) / 20000), F.floor(F.get("features", 1) / 5), F.get("features", 2), F.floor(F.get("features", 3) / 7)], forest.best_splits)
)
query("g2_midpoint_split", f"""WITH {_ROWS}, e AS (SELECT CAST(label_id % 7 AS INT) AS tree_id, class_id, unnest([0, 1, 2, 3]) AS feature, unnest([CAST(f0 AS DOUBLE), f1, f2, f3]) AS v FROM rws),
h AS (SELECT tree_id, feature, v, {_COUNTS} FROM e GROUP BY 1, 2, 3),
s AS (SELECT tree_id, feature, v, lead(v) OVER w AS more, {', '.join(f'sum(c{c}) OVER w AS l{c}, sum(c{c}) OVER u AS t{c}' for c in range(3))} FROM h WINDOW w AS (PARTITION BY tree_id, feature ORDER BY v), u AS (PARTITION BY tree_id, feature)),
k AS (SELECT *, t0 - l0 AS r0, t1 - l1 AS r1, t2 - l2 AS r2 FROM s WHERE more IS NOT NULL), g AS (SELECT *, {_GAIN} FROM k)
SELECT DISTINCT ON (tree_id) tree_id, feature, round(v / 2 + more / 2, 6) AS split, round(share_left, 6) AS share_left, CAST(t0 + t1 + t2 AS BIGINT) AS n FROM g WHERE gain > 0.01 ORDER BY tree_id, after, feature, v""")(lambda s, d: roots(rows_of(s, d)))


def roots(rows):
    """The roots of seven trees, to which labels are dealt: midpoints of sorted values, all features looked at."""
    dealt = rows.select("class_id", "features", F.array(F.struct((F.col("label_id") % 7).cast("int").alias("tree_id"), F.lit(1.0).alias("weight"))).alias("at"))
    return forest.grow(dealt, 3, 4, 7, depth=1, k=4).where("feature is not null").select("tree_id", "feature", F.round("split", 6).alias("split"), F.round("share_left", 6).alias("share_left"), "n")


query("g4_nominal_split", f"""WITH {_ROWS}, e AS (SELECT label_id % 7 AS node_id, class_id, unnest([0, 1]) AS feature, unnest([f1 % 5, f3 % 9]) AS bin FROM rws),
h AS (SELECT node_id, feature, CAST(bin AS INT) AS bin, {', '.join(f'count(*) FILTER (WHERE class_id = {c}) AS l{c}' for c in range(3))} FROM e GROUP BY 1, 2, 3),
s AS (SELECT *, {', '.join(f'sum(l{c}) OVER v AS t{c}' for c in range(3))} FROM h WINDOW v AS (PARTITION BY node_id, feature)), k AS (SELECT *, t0 - l0 AS r0, t1 - l1 AS r1, t2 - l2 AS r2 FROM s), g AS (SELECT *, {_GAIN} FROM k) {_SPLIT}""")(
    lambda s, d: split_level(rows_of(s, d), [F.get("features", 1) % 5, F.get("features", 3) % 9], forest.best_nominal_splits)
)


def split_level(rows, bins, how):
    """The best split of seven nodes, dealt by label."""
    binned = rows.select(F.lit(0).alias("tree_id"), (F.col("label_id") % 7).alias("node_id"), "class_id", F.lit(1.0).alias("weight"), F.array(*(b.cast("int") for b in bins)).alias("binned"))
    return how(forest.histograms(binned), 3).select("node_id", "feature", "bin", F.round("gain", 6).alias("gain"), F.round("share_left", 6).alias("share_left"))


query("n8_bootstrap", f"WITH {_ROWS}, u AS (SELECT row_id, tree_id, {_KEY.format("row_id, ',', tree_id, ',', 1")} / 4294967296.0 AS u FROM rws, range(0, 3) r(tree_id)), w AS (SELECT row_id, tree_id, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT AS weight FROM u) SELECT * FROM w WHERE weight > 0")(
    lambda s, d: forest.bootstrap(rows_of(s, d).select("row_id"), 3).select("row_id", "tree_id", "weight")
)
query("n10_scrambled_attribute", f"""WITH {_ROWS}, b AS (SELECT row_id, f0, f2, {_KEY.format("row_id, ',', 1")} % 64 AS bucket FROM rws),
n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY row_id) AS src, row_number() OVER (PARTITION BY bucket ORDER BY {_KEY.format("row_id, ',', 2, ',', 1")}, row_id) AS dst FROM b)
SELECT n.row_id, n.f0, o.f2 FROM n JOIN n o ON n.bucket = o.bucket AND n.dst = o.src""")(
    lambda s, d: forest.scrambled(rows_of(s, d), 2).select("row_id", F.get("features", 0).alias("f0"), F.get("features", 2).alias("f2"))
)
_DRAW = _KEY.format("vec_id, ',', tree_id, ',', {0}")
_P = ", ".join(f"({_DRAW.format(c)} % 100 + CASE WHEN vec_id % 3 = {c} THEN 40 ELSE 0 END) AS a{c}" for c in range(3))
query("g7_significant_classes", f"""WITH v AS (SELECT vec_id AS row_id, tree_id, {_P} FROM embeddings, range(0, 35) r(tree_id)),
r AS (SELECT row_id, count(*) OVER w AS n, count(*) OVER (PARTITION BY row_id) AS trees, {', '.join(f'sum(a{c}) OVER w AS s{c}' for c in range(3))} FROM v WINDOW w AS (PARTITION BY row_id ORDER BY tree_id)),
k AS (SELECT row_id, n, trees, list_reverse_sort([{', '.join(f"{{'p': round(s{c} / (s0 + s1 + s2), 9), 'i': {-c}}}" for c in range(3))}]) AS r FROM r WHERE (n > 10 AND n % 10 = 1) OR n = trees),
q AS (SELECT *, r[1].p AS p, r[2].p AS q FROM k)
SELECT DISTINCT ON (row_id) row_id, -r[1].i AS class_id, round(p, 6) AS prob, -r[2].i AS second_id, round(q, 6) AS second_prob, n AS n_trees FROM q WHERE p >= 1 OR (p - q) ** 2 / (p * (1 - p) / n) > 16 OR n = trees ORDER BY row_id, n""")(
    lambda s, d: sampling.significant_votes(class_votes(s, d), 3).select("row_id", "class_id", F.round("prob", 6).alias("prob"), "second_id", F.round("second_prob", 6).alias("second_prob"), "n_trees")
)


def class_votes(spark, d):
    spread = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id")).withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(34))))
    return spread.withColumn("probs", F.array(*((sampling.draw("row_id", "tree_id", F.lit(c)) % 100 + F.when(F.col("row_id") % 3 == c, 40).otherwise(0)).cast("double") for c in range(3))))


def stumps(rows):
    """A tree of one split for each feature, at its rounded mean, with the class shares of both sides."""
    means = rows.agg(*(F.round(F.avg(F.get("features", i)), 6).alias(f"m{i}") for i in range(4)))
    cut = means.select(F.explode(F.array(*(F.struct(F.lit(i).alias("tree_id"), F.col(f"m{i}").alias("split")) for i in range(4)))).alias("s")).select("s.*")
    sides = rows.select("class_id", F.posexplode("features").alias("tree_id", "v")).join(cut, "tree_id").groupBy("tree_id", F.when(F.col("v") <= F.col("split"), 2).otherwise(3).cast("long").alias("node_id"))
    leaves = sides.agg(F.count("*").alias("n"), F.array(*(F.avg((F.col("class_id") == c).cast("double")) for c in range(3))).alias("probs"))
    none = F.lit(None)
    leaves = leaves.select("tree_id", "node_id", none.cast("int").alias("feature"), none.cast("double").alias("split"), none.cast("double").alias("share_left"), "n", "probs")
    whole = leaves.groupBy("tree_id").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("node_id") == 2, F.col("n"))) / F.sum("n")).alias("share_left"))
    roots = whole.join(cut, "tree_id").select("tree_id", F.lit(1).cast("long").alias("node_id"), F.col("tree_id").alias("feature"), "split", "share_left", "n", F.array().cast("array<double>").alias("probs"))
    return roots.unionByName(leaves)


_STUMPS = f"{_ROWS}, cut AS (SELECT unnest([0, 1, 2, 3]) AS tree_id, unnest([round(avg(f0), 6), round(avg(f1), 6), round(avg(f2), 6), round(avg(f3), 6)]) AS split FROM rws), e AS (SELECT row_id, class_id, unnest([0, 1, 2, 3]) AS tree_id, unnest([f0, f1, f2, f3]) AS v FROM rws), w AS (SELECT row_id, class_id, tree_id, split, CASE WHEN v <= split THEN 2 ELSE 3 END AS node_id FROM e JOIN cut USING (tree_id)), leaf AS (SELECT tree_id, node_id, count(*) AS n, avg((class_id = 0)::INT) AS p0, avg((class_id = 1)::INT) AS p1 FROM w GROUP BY 1, 2)"
query("g6_tree_scoring", f"WITH {_STUMPS} SELECT row_id, tree_id, node_id, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM w JOIN leaf USING (tree_id, node_id)")(lambda s, d: leaves(s, d))


def leaves(spark, d):
    """Each row walks each tree, as joins of rows with nodes."""
    rows = rows_of(spark, d)
    nodes = tables.written(stumps(rows), "stumps")
    return forest.walked(rows.select("row_id", "features"), nodes, 1).join(nodes.select("tree_id", "node_id", "probs"), ["tree_id", "node_id"]).select("row_id", "tree_id", "node_id", F.round(F.get("probs", 0), 6).alias("p0"), F.round(F.get("probs", 1), 6).alias("p1"))


query("g9_top_two", f"WITH {_STUMPS}, m AS (SELECT row_id, round(avg(p0), 9) AS p0, round(avg(p1), 9) AS p1, round(1 - avg(p0) - avg(p1), 9) AS p2 FROM w JOIN leaf USING (tree_id, node_id) GROUP BY 1), l AS (SELECT row_id, list_reverse_sort([{{'p': round(p0, 6), 'i': 0}}, {{'p': round(p1, 6), 'i': -1}}, {{'p': round(p2, 6), 'i': -2}}]) AS r FROM m) SELECT row_id, -r[1].i AS class_id, -r[2].i AS second_id, r[1].p AS prob FROM l")(
    lambda s, d: vectorised(s, d)
)


def vectorised(spark, d):
    """The same forest by the vectorised scorer."""
    rows = rows_of(spark, d)
    found = forest.scored(rows, stumps(rows), 3, ["row_id"])
    return found.select("row_id", F.col("class_id").cast("int").alias("class_id"), "second_id", F.round("prob", 6).alias("prob"))


query("s10_stored_forest", f"WITH {_STUMPS}, t AS (SELECT tree_id, 1 AS node_id, tree_id AS feature, split, count(*) AS n FROM w GROUP BY 1, 3, 4 UNION ALL SELECT tree_id, node_id, NULL, NULL, n FROM leaf) SELECT *, 'lines' AS relation FROM t")(lambda s, d: reloaded(s, d))


def reloaded(spark, d):
    path = fresh_path(spark, "forest")
    instances.save_forest(stumps(rows_of(spark, d)), path, {"relation": "lines", "features": FEATURES})
    nodes, settings = instances.load_forest(spark, path)
    return nodes.select("tree_id", "node_id", "feature", "split", "n", F.lit(settings["relation"]).alias("relation"))


query("s9_instance_text", f"WITH {INST} SELECT class_id AS class, count(*) AS n, round(sum(round(f2, 6)), 4) AS total FROM inst GROUP BY 1")(lambda s, d: arff_text(s, d))


def arff_text(spark, d):
    """The data lines of a written instance file, as text."""
    path = fresh_path(spark, "arff")
    instances.write_arff(inst(spark, d).select(*FEATURES, F.col("class_id").alias("class")), path, "lines", FEATURES, [], ["A", "N", "R"])
    parts = spark.read.text(f"{path}/data").select(F.split("value", ",").alias("p"))
    return parts.groupBy(F.element_at("p", -1).alias("class")).agg(F.count("*").alias("n"), F.round(F.sum(F.get("p", 2).cast("double")), 4).alias("total"))


# --- forests --------------------------------------------------------------------------------------------------------

SMALL = {"trees": 8, "percent": 66}


def trained(spark, d):
    rows = rows_of(spark, d)
    return rows, forest.train(rows.where(F.col("label_id") % 5 > 0), 3, 4, **SMALL)


def hits(scored):
    return scored.groupBy("class_id").agg(F.count("*").alias("n"), F.count_if(F.col("class_id") == F.col("seen")).alias("hits"), F.round(F.avg("n_trees"), 4).alias("mean_trees"))


query("g1_forest")(lambda s, d: accuracy(*trained(s, d)))


def accuracy(rows, nodes, classes: int = 3):
    held_out = rows.where(F.col("label_id") % 5 == 0).withColumnRenamed("class_id", "truth")
    found = forest.scored(held_out, nodes, classes, ["row_id", "truth"]).select(F.col("class_id").alias("seen"), F.col("truth").alias("class_id"), "n_trees")
    return hits(found)


query("g5_missing_values")(lambda s, d: with_gaps(s, d))


def with_gaps(spark, d):
    """Trained and scored with every third value of the first feature missing."""
    rows = rows_of(spark, d).withColumn("features", F.transform("features", lambda v, i: F.when((i > 0) | (F.col("row_id") % 3 > 0), v)))
    return accuracy(rows, forest.train(rows.where(F.col("label_id") % 5 > 0), 3, 4, **SMALL))


query("g11_feature_usage")(lambda s, d: forest.usage(trained(s, d)[1], 4).select("feature", "usage", F.round("relative", 6).alias("relative")))
query("o1_most_used_features")(lambda s, d: forest.selected(forest.usage(trained(s, d)[1], 4), most=2).select("feature", "usage"))
query("g15_tree_shapes")(lambda s, d: forest.shapes(trained(s, d)[1]))
query("g14_two_passes")(lambda s, d: second_pass(s, d))


def second_pass(spark, d):
    """Trained on all features, then on those used enough (their relative usage); features that still split, by usage."""
    nodes, kept = forest.two_passes(rows_of(spark, d), 3, 4, 0.5, **SMALL)
    return forest.usage(nodes, 4).select("feature", "usage", F.col("feature").isin(kept).alias("kept"))


query("i4_forest_error")(lambda s, d: oob(s, d))


def oob(spark, d):
    rows = rows_of(spark, d)
    nodes = forest.train(rows, 3, 4, **SMALL)
    return forest.out_of_bag(rows, nodes, 3, SMALL["trees"], SMALL["percent"]).select("n", F.round("error", 6).alias("error"))


query("i6_learners_compared")(lambda s, d: compare.compared(learners(s, d), 10).select("measure", "folds", *(F.round(c, 6).alias(c) for c in ("balanced", "classic", "mean", "t"))))


def learners(spark, d):
    """Ten runs of ten folds of both learners over all orders."""
    return compare.cross_validated(rows_of(spark, d), 3, 4, trees=2, k=2)


query("i5_importance")(lambda s, d: risen(s, d))


def risen(spark, d):
    rows = rows_of(spark, d)
    return forest.importance(rows, forest.train(rows, 3, 4, **SMALL), 3, 4, SMALL["trees"], SMALL["percent"]).select("feature", F.round("rise", 6).alias("rise"))


# --- pyramids, tiles and loops --------------------------------------------------------------------------------------

SETTINGS = pyramid.Settings([1, 2], depth=2, planes=4)


def label_rows(spark, d):
    """Labelled voxels: their label of the least number, and the class that the voxel's value tells."""
    labels = vlab(spark, d).groupBy(*PLACE).agg(F.min("label_id").alias("label_id"))
    return tables.truth(vols(spark, d)).join(labels, PLACE).select(*VOXEL, "label_id", "class_id")


query("d1_feature_pyramid")(lambda s, d: pyramid.tile_features(vols(s, d), SETTINGS, keep=label_rows(s, d)).select(*PLACE, F.transform("features", lambda v: F.round(v.cast("double"), 4)).alias("features")))
query("d2_depths_and_names")(lambda s, d: feature_rows(s, d).groupBy("level", "depth", "feature", "source").agg(F.count("*").alias("n"), F.round(F.avg("val"), 4).alias("mean")))


def feature_rows(spark, d):
    """Long form at the labelled voxels: a row a feature, with its level, depth and the image that it is made from."""
    found = pyramid.tile_features(vols(spark, d), SETTINGS, keep=label_rows(spark, d)).select(*PLACE, F.posexplode("features").alias("k", "val"))
    names = pyramid.feature_names(SETTINGS)
    table = pyramid.name_table(spark, SETTINGS).withColumn("k", F.array_position(F.array(*(F.lit(n) for n in names)), F.col("feature")) - 1)
    return found.join(table, "k")


def projected(spark, d):
    """Two features alone: the steps that none of them is made from are not computed."""
    settings = pyramid.Settings([1, 2], depth=2, planes=4, subset=["Bin1x1x1_Orig_ch0", "Mean2_2_2_Bin1x1x1_Orig_ch0"])
    return pyramid.tile_features(vols(spark, d), settings, keep=label_rows(spark, d)).select(*PLACE, (F.round(F.get("features", 0).cast("double"), 5) + F.lit(0.0)).alias("val"), (F.round(F.get("features", 1).cast("double"), 3) + F.lit(0.0)).alias("mean"))


query("p5_feature_projection")(lambda s, d: projected(s, d))


def voxel_rows(spark, d, settings=SETTINGS):
    """Training rows: vectors at the labelled voxels."""
    labels = label_rows(spark, d)
    found = pyramid.tile_features(vols(spark, d), settings, keep=labels).join(labels, VOXEL)
    place = F.col("image_id") * 4 * 4096 + F.col("z") * 4096 + F.col("y") * 64 + F.col("x")
    return tables.written(found.select(place.alias("row_id"), "label_id", "class_id", *VOXEL, "features"), "vectors")


def voxel_forest(spark, d, settings=SETTINGS):
    rows = voxel_rows(spark, d, settings)
    return tables.written(forest.train(rows, 2, len(pyramid.feature_names(settings)), trees=12, depth=5, n_bins=16), "nodes")


query("g16_apply_classifier")(lambda s, d: pyramid.tile_features(vols(s, d), SETTINGS, nodes=voxel_forest(s, d)).select(*PLACE, "class_id", "n_trees", "code"))
query("g17_batch_apply")(lambda s, d: batch(s, d))


def batch(spark, d):
    """All images of a folder whose names match are scored in one job, into one resumable result."""
    path, out = stored(spark, d), fresh_path(spark, "results")
    wanted = images.list_files(spark, path, "part.*", r"image--I\d+--C00--.*").select(F.regexp_extract("path", r"--I(\d+)--", 1).cast("long").alias("image_id")).distinct()
    own = images.read_planes(spark, path).join(wanted, "image_id", "left_semi").withColumn("val", F.col("val") / 60000 - 0.5)
    own = own.withColumn("z", F.col("t") * 2 + F.col("z")).withColumn("t", F.lit(0))
    images.write_result(pyramid.tile_features(own, SETTINGS, nodes=voxel_forest(spark, d)), out)
    return images.read_result(spark, out).groupBy("image_id", "z", F.floor((F.col("code") - 1) / 10).alias("class_id")).agg(F.count("*").alias("n"))


query("g22_data_set_pipeline")(lambda s, d: data_sets(s, d))


def data_sets(spark, d):
    """Scored, then the foreground's objects measured; every row tagged with its data set."""
    coded = tables.written(pyramid.tile_features(vols(spark, d), SETTINGS, nodes=voxel_forest(spark, d)).select(*VOXEL, "code"), "coded")
    found = objects.measures(objects.segmented(coded, 1, (1, 2, 2), 1, 2))
    return found.select(F.concat(F.lit("image-"), "image_id").alias("data_set"), "object_id", "volume", "min_z", "max_z", "min_y", "max_y", "min_x", "max_x")


query("g19_iterative_training")(lambda s, d: brain.iterate(vols(s, d), tables.truth(vols(s, d)), SETTINGS, rounds=2, per_class=20))
query("g20_two_stages")(lambda s, d: brain.two_stages(voxel_rows(s, d), vols(s, d), SETTINGS))
query("g21_recomputed_vectors")(lambda s, d: recomputed(s, d))


def recomputed(spark, d):
    """The labels' vectors under other settings, and the forest trained again."""
    settings = pyramid.Settings([1, 2], depth=1, planes=4, only_differences=True)
    rows = voxel_rows(spark, d, settings)
    return accuracy(rows, forest.train(rows.where(F.col("label_id") % 5 > 0), 2, len(pyramid.feature_names(settings)), trees=8, depth=4, n_bins=16), 2)
