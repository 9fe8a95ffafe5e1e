"""Registered queries over several images: files, tiles with halos, kernels in three dimensions, objects and their review.

256 vectors are an image of four planes of 64 x 64; the last plane of the last image can be cut off. The SQL of kernels
along lines holds each line as a list; tests hold the kernels against numpy as well.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxmill.functions import scalars
from voxmill.operators import distance, grid, kernels, lines, objects, sampling
from voxmill.plans import scoring
from voxmill.queries import INST, inst, query
from voxmill.sources import images, instances, rasters, tables
from voxmill.sources.tables import VOXEL, fresh_path

VOLS = "vols AS (SELECT vec_id // 256 AS image_id, 0 AS t, 0 AS c, (vec_id // 64) % 4 AS z, vec_id % 64 AS y, i - 1 AS x, CAST(embedding[i] AS DOUBLE) AS val FROM embeddings, unnest(range(1, 65)) AS u(i))"
VRES = f"""{VOLS}, means AS (SELECT image_id, z, y, x, round(avg(val) OVER (PARTITION BY image_id, z, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 9) AS m FROM vols),
result AS (SELECT image_id, z, y, x, CASE WHEN (z * 4096 + y * 64 + x) % 17 = 0 THEN 0 ELSE (CASE WHEN m > 0.02 THEN 1 ELSE 0 END) * 10 + 1 + CAST(floor(round(least(1.0, abs(m - 0.02) * 10) * 9, 7)) AS INT) END AS code FROM means),
gt AS (SELECT image_id, z, y, x, CASE WHEN val > 0.1 THEN 1 ELSE 0 END AS class_id FROM vols)"""
VLAB = f"{INST}, vlab AS (SELECT *, label_id % 2 AS image_id, label_id // 2 % 4 AS z, label_id % 3 AS t FROM inst)"
PLACE = ["image_id", "z", "y", "x"]


def vols(spark, d):
    return tables.volumes(tables.table(spark, d, "embeddings"))


def vres(spark, d):
    return tables.result(vols(spark, d))


def vlab(spark, d):
    i = F.col("label_id")
    return inst(spark, d).withColumns({"image_id": i % 2, "z": F.floor(i / 2) % 4, "t": (i % 3).cast("int")})


def on_vols(name: str, sql: str):
    """A query over the images; ``sql`` goes on from the view vols."""

    def add(f):
        query(name, f"WITH {VOLS} {sql}" if sql[:1] != "," else f"WITH {VOLS}{sql}")(lambda spark, d: f(vols(spark, d)))
        return f

    return add


def exported(df, name: str, *parts: str):
    """Written partitioned by ``parts``, and read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


# --- files ----------------------------------------------------------------------------------------------------------

def frames(spark, d):
    """The images as frames of two planes."""
    return vols(spark, d).withColumn("t", F.floor(F.col("z") / 2).cast("int")).withColumn("z", F.col("z") % 2)


def stored(spark, d) -> str:
    path = fresh_path(spark, "planes")
    images.write_planes(frames(spark, d), path, F.floor((F.col("val") + 0.5) * 60000))
    return path


def as_pngs(spark, d) -> str:
    path = fresh_path(spark, "pngs")
    rasters.write_pngs(frames(spark, d), path, F.floor((F.col("val") + 0.5) * 60000))
    return path


_NAMES = "format('image--I{:05d}--C00--T{:05d}--Z{:05d}', image_id, z // 2, z % 2)"
query("s1_image_scan", f"WITH {VOLS} SELECT image_id, z // 2 AS t, z % 2 AS z, y, x, floor((val + 0.5) * 60000) AS val FROM vols")(
    lambda s, d: images.read_planes(s, stored(s, d)).select("image_id", "t", "z", "y", "x", "val")
)
query("s3_image_sequence", f"WITH {VOLS}, n AS (SELECT DISTINCT {_NAMES} AS name, z % 2 AS z, z // 2 AS t FROM vols WHERE image_id = 0) SELECT name, z, t, row_number() OVER (PARTITION BY t ORDER BY name) AS place FROM n")(
    lambda s, d: images.sequence(s, stored(s, d), r"^image--I00000--C00--T(\d+)--Z(\d+)$", 2, 1)
)
query("s4_cube_region", f"WITH {VOLS} SELECT image_id, y, x, floor((val + 0.5) * 60000) AS val FROM vols WHERE z = 3 AND y BETWEEN 5 AND 14 AND x BETWEEN 20 AND 49")(
    lambda s, d: images.region(images.read_planes(s, stored(s, d)), {"z": 1, "y": 5, "x": 20}, {"z": 1, "y": 10, "x": 30}, 1, 0).select("image_id", "y", "x", "val")
)
query("s5_files_by_pattern", f"WITH {VOLS} SELECT DISTINCT {_NAMES} AS folder, true AS filled FROM vols WHERE z % 2 = 1")(
    lambda s, d: images.list_files(s, stored(s, d), r"part-.*\.txt", r"image--.*--Z00001").groupBy(F.regexp_extract("path", images.FOLDER, 1).alias("folder")).agg((F.sum("size") > 0).alias("filled"))
)
#: A file's samples are clipped to 16 bits.
_SAMPLE = "greatest(0, least(65535, floor((val + 0.5) * 60000)))"
query("s1_png_scan", f"WITH {VOLS} SELECT image_id, z // 2 AS t, z % 2 AS z, y, x, {_SAMPLE} AS val FROM vols")(
    lambda s, d: rasters.read_pngs(s, as_pngs(s, d)).select("image_id", "t", "z", "y", "x", "val")
)
query("s4_png_region", f"WITH {VOLS} SELECT image_id, y, x, {_SAMPLE} AS val FROM vols WHERE z = 3 AND y BETWEEN 5 AND 14 AND x BETWEEN 20 AND 49")(
    lambda s, d: images.region(rasters.read_pngs(s, as_pngs(s, d)), {"z": 1, "y": 5, "x": 20}, {"z": 1, "y": 10, "x": 30}, 1, 0).select("image_id", "y", "x", "val")
)
query("s11_resumed_result", f"WITH {VRES} SELECT image_id, z, y, x, code FROM result")(lambda s, d: resumed(s, d).select(*PLACE, "code"))


def resumed(spark, d):
    """A result sink that was cut off after the planes z = 0 and 1: the others are found missing and added."""
    path, result = fresh_path(spark, "result"), vres(spark, d)
    images.write_result(result.where("z < 2"), path)
    left = images.missing_planes(result.select("image_id", "t", "z").distinct(), spark, path)
    images.write_result(result.join(left, ["image_id", "t", "z"], "left_semi"), path)
    return images.read_result(spark, path)


_CLASSES = "SELECT class_id, image_id, z, y, x, CASE WHEN code BETWEEN class_id * 10 + 1 AND class_id * 10 + 10 THEN code - class_id * 10 - 1 ELSE 0 END AS val FROM result, (VALUES (0), (1)) k(class_id)"
query("s13_class_probabilities", f"WITH {VRES} SELECT class_id, image_id, z, y, x, val * 25 AS val FROM ({_CLASSES})")(
    lambda s, d: exported(grid.class_images(vres(s, d), (0, 1)).withColumn("val", F.col("val") * 25), "probabilities", "class_id", "t").select("class_id", *PLACE, "val")
)
query("s14_frame_masks", f"WITH {VRES} SELECT image_id, z, y, x, CAST(ceil(code / 10) AS BIGINT) AS label FROM result")(
    lambda s, d: exported(vres(s, d).select(*VOXEL, F.ceil(F.col("code") / 10).alias("label")), "masks", "image_id", "t").select(*PLACE, "label")
)
query("s15_named_slices", f"WITH {VRES} SELECT format('classified--C01--T{{:05d}}--Z{{:05d}}', image_id + 1, z + 1) AS name, y, x, code FROM result")(lambda s, d: slices(s, d))


def slices(spark, d):
    """Raw codes, a folder a frame and plane; the images are the frames of one result."""
    path, name = fresh_path(spark, "slices"), F.format_string("classified--C01--T%05d--Z%05d", F.col("image_id") + 1, F.col("z") + 1)
    vres(spark, d).select(name.alias("name"), "y", "x", "code").repartition("name").write.partitionBy("name").parquet(path)
    return spark.read.schema("y long, x long, code int, name string").parquet(path)


_HALF = "SELECT data_set, image_id, z, y // 2 AS y, x // 2 AS x, avg(val) AS val FROM {} GROUP BY data_set, image_id, z, y // 2, x // 2 HAVING count(*) = 4"
query("s16_class_pyramids", f"""WITH {VRES}, l0 AS (SELECT 'raw' AS data_set, image_id, z, y, x, val FROM vols UNION ALL SELECT 'class-' || class_id, image_id, z, y, x, val FROM ({_CLASSES})),
l1 AS ({_HALF.format("l0")}), l2 AS ({_HALF.format("l1")})
SELECT data_set, 0 AS level, image_id, z, y, x, round(val, 6) AS val FROM l0 UNION ALL SELECT data_set, 1, image_id, z, y, x, round(val, 6) FROM l1 UNION ALL SELECT data_set, 2, image_id, z, y, x, round(val, 6) FROM l2""")(
    lambda s, d: class_pyramids(s, d).select("data_set", "level", *PLACE, F.round("val", 6).alias("val"))
)


def class_pyramids(spark, d):
    path = fresh_path(spark, "pyramids")
    images.write_pyramids(vols(spark, d), vres(spark, d), (0, 1), path)
    return images.read_pyramid(spark, path)


query("s17_class_images", f"WITH {VRES} {_CLASSES}")(lambda s, d: grid.class_images(vres(s, d), (0, 1)).select("class_id", *PLACE, "val"))
query("s18_result_table", f"WITH {VRES} SELECT 'image-' || image_id AS data_set, (code - 1) // 10 AS class_id, 'image-' || image_id || '--class' || (code - 1) // 10 || '.parquet' AS output, count(*) AS n FROM result WHERE code > 0 GROUP BY image_id, (code - 1) // 10")(lambda s, d: provenance(s, d))


def provenance(spark, d):
    """The table of what was written for each data set, as csv with a header."""
    path = fresh_path(spark, "provenance")
    name = F.concat(F.lit("image-"), F.col("image_id"))
    found = scoring.decode(vres(spark, d)).groupBy("image_id", "class_id").agg(F.count("*").alias("n"))
    found.select(name.alias("data_set"), "class_id", F.concat(name, F.lit("--class"), "class_id", F.lit(".parquet")).alias("output"), "n").write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="data_set string, class_id long, output string, n long")


FEATURES = ["f0", "f1", "f2", "f3"]
query("s7_instance_files", f"WITH {INST} SELECT 'lines' AS dataset, CAST(label_id AS DOUBLE) AS label_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(f0, 6) AS f0, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3, class_id AS class, CASE class_id WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class_id FROM inst")(
    lambda s, d: through_arff(s, d)
)


def through_arff(spark, d):
    path = fresh_path(spark, "arff")
    rows = inst(spark, d).select(F.col("label_id").alias("Label_Id"), F.col("x").alias("Position_X"), F.col("y").alias("Position_Y"), *FEATURES, F.col("class_id").alias("class"))
    instances.write_arff(rows, path, "lines", FEATURES, ["Label_Id", "Position_X", "Position_Y"], ["A", "N", "R"])
    found = instances.read_arff(spark, path)
    return found.select("dataset", F.col("Label_Id").alias("label_id"), F.col("Position_X").alias("x"), F.col("Position_Y").alias("y"), *(F.get("features", i).alias(f) for i, f in enumerate(FEATURES)), "class", F.col("class_id").cast("int").alias("class_id"))


query("s8_metadata_columns", f"WITH {INST} SELECT label_id, x, f0, f1 + f2 AS total, class_id AS class FROM inst")(
    lambda s, d: instances.metadata_in(instances.metadata_out(inst(s, d).select(F.col("label_id").alias("Metadata_Label_Id"), F.col("x").alias("Metadata_Position_X"), *FEATURES, F.col("class_id").alias("class"))), FEATURES).select(F.col("Metadata_Label_Id").alias("label_id"), F.col("Metadata_Position_X").alias("x"), "f0", (F.col("f1") + F.col("f2")).alias("total"), "class")
)
query("n4_replaced_set", f"WITH {INST} SELECT 'set' || (label_id % 3) AS dataset, count(*) AS n, round(sum(CASE WHEN label_id % 3 = 1 THEN -f0 ELSE f0 END), 4) AS total FROM inst GROUP BY 1")(lambda s, d: replaced(s, d))


def replaced(spark, d):
    """Three sets are stored, then one of them is put again with other values."""
    path = fresh_path(spark, "sets")
    rows = inst(spark, d).select(F.concat(F.lit("set"), F.col("label_id") % 3).alias("dataset"), "label_id", "n", "f0")
    instances.put_set(rows, path)
    instances.put_set(rows.where("dataset = 'set1'").withColumn("f0", -F.col("f0")), path)
    return spark.read.parquet(path).groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.sum("f0"), 4).alias("total"))


query("n5_compatible_settings", "WITH p AS (SELECT p_partkey, p_size % 2 AS a1, p_size % 4 // 2 AS a2, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 END AS n1, CASE WHEN p_size % 3 > 0 THEN p_size % 3 END AS n2 FROM part) SELECT p_partkey, (a1 IS NOT DISTINCT FROM a2) AND (n1 IS NOT DISTINCT FROM n2) AS same FROM p")(
    lambda s, d: tables.table(s, d, "part").select("p_partkey", F.struct((F.col("p_size") % 2).alias("log"), F.nullif(F.col("p_partkey") % 3, F.lit(0).cast("long")).alias("depth")).alias("a"), F.struct(F.floor(F.col("p_size") % 4 / 2).alias("log"), F.nullif(F.col("p_size") % 3, F.lit(0)).alias("depth")).alias("b")).select("p_partkey", instances.compatible("a", "b", ["log", "depth"]).alias("same"))
)
query("n3_union_of_sets", f"WITH {INST} SELECT 'set' || (label_id % 5) AS dataset, count(*) AS n, count(DISTINCT class_id) AS classes FROM inst WHERE label_id % 5 IN (0, 2, 3) GROUP BY 1")(
    lambda s, d: instances.combined([inst(s, d).where(F.col("label_id") % 5 == k).withColumn("dataset", F.lit(f"set{k}")) for k in range(5)], ["set0", "set2", "set3"]).groupBy("dataset").agg(F.count("*").alias("n"), F.countDistinct("class_id").alias("classes"))
)
query("j15_sets_of_images", f"WITH {VOLS}, {INST} SELECT 'image-' || (label_id % 5) AS dataset, count(*) AS n, label_id % 5 IN (SELECT image_id FROM vols) AS shown FROM inst GROUP BY label_id % 5")(lambda s, d: shown(s, d))


def shown(spark, d):
    rows = inst(spark, d).withColumn("dataset", F.concat(F.lit("image-"), F.col("label_id") % 5))
    known = vols(spark, d).select(F.concat(F.lit("image-"), "image_id").alias("dataset")).distinct()
    return instances.of_image(rows, known).withColumn("shown", F.lit(True)).unionByName(instances.of_image(rows, known, False).withColumn("shown", F.lit(False))).groupBy("dataset", "shown").agg(F.count("*").alias("n"))


query("n15_class_dictionary", "WITH k AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS class_id FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT class_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'house' ELSE c_mktsegment END AS name, count(*) AS n FROM customer JOIN k USING (c_mktsegment) GROUP BY 1, 2")(
    lambda s, d: class_names(tables.table(s, d, "customer"), "c_mktsegment", {"BUILDING": "house"})
)


def class_names(rows, column: str, renamed: dict[str, str], most: int = 20):
    """Rows counted by class: classes are numbered by name, at most ``most``, some of them renamed."""
    names = rows.select(F.col(column).alias("own")).distinct().orderBy("own").limit(most + 1)  # the dictionary
    if names.count() > most:
        raise ValueError(f"more than {most} classes")
    numbered = names.withColumn("class_id", F.row_number().over(W.orderBy("own")) - 1)
    name = F.col("own")
    for old, new in renamed.items():
        name = F.when(F.col("own") == old, new).otherwise(name)
    return rows.join(numbered, rows[column] == F.col("own")).groupBy("class_id", name.alias("name")).agg(F.count("*").alias("n"))


# --- tiles and joins ------------------------------------------------------------------------------------------------

_BOUNDS = {"z": (0, 3), "y": (0, 63), "x": (0, 63)}
query("j1_tile_grid", f"WITH {VOLS} SELECT image_id, z // 19 AS tz, y // 19 AS ty, x // 19 AS tx, (y // 19) * 19 AS y0, least(63, (y // 19) * 19 + 18) AS y1, (x // 19) * 19 AS x0, least(63, (x // 19) * 19 + 18) AS x1, count(*) AS n FROM vols GROUP BY 1, 2, 3, 4")(
    lambda s, d: in_tiles(vols(s, d), _BOUNDS, {k: v for k, v in grid.tile_sizes(_BOUNDS, most_voxels=7000).items() if k != "t"}).select("image_id", "tz", "ty", "tx", "y0", "y1", "x0", "x1", "n")
)
query("j2_plane_tiles", f"WITH {VOLS} SELECT image_id, y // 22 AS ty, x // 22 AS tx, (y // 22) * 22 AS y0, least(63, (y // 22) * 22 + 21) AS y1, (x // 22) * 22 AS x0, least(63, (x // 22) * 22 + 21) AS x1, count(*) AS n FROM vols GROUP BY 1, 2, 3")(
    lambda s, d: in_tiles(vols(s, d), {"y": (0, 63), "x": (0, 63)}, {"y": -(-64 // 3), "x": -(-64 // 3)}).select("image_id", "ty", "tx", "y0", "y1", "x0", "x1", "n")
)


def in_tiles(vox, bounds, sizes):
    """The tile grid with the number of voxels of each image in each tile."""
    axes = list(bounds)
    number = [F.floor((F.col(a) - low) / sizes.get(a, high - low + 1)).alias(f"t{a}") for a, (low, high) in bounds.items()]
    counts = vox.groupBy("image_id", *number).agg(F.count("*").alias("n"))
    return counts.join(grid.tiles(bounds, sizes), [f"t{a}" for a in axes])


on_vols("j4_halo_exchange", "SELECT image_id, z, ty, tx, count(*) AS n, round(sum(val), 6) AS total FROM vols, (SELECT ty, tx FROM range(0, 4) a(ty), range(0, 4) b(tx)) WHERE y BETWEEN ty * 16 - 3 AND ty * 16 + 18 AND x BETWEEN tx * 16 - 3 AND tx * 16 + 18 GROUP BY 1, 2, 3, 4")(
    lambda v: grid.with_halo(v, 16, 3, {"y": 64, "x": 64}).groupBy("image_id", "z", "ty", "tx").agg(F.count("*").alias("n"), F.round(F.sum("val"), 6).alias("total"))
)
on_vols("j5_mirror_padding", "SELECT image_id, z, p AS py, q AS px, round(val, 6) AS val FROM range(-5, 69) r(p), range(-5, 69) s(q) JOIN vols ON x = CASE WHEN q < 0 THEN -q WHEN q > 63 THEN 126 - q ELSE q END AND y = CASE WHEN p < 0 THEN -p WHEN p > 63 THEN 126 - p ELSE p END")(
    lambda v: grid.padded(v, 5, {"y": 64, "x": 64}).select("image_id", "z", "py", "px", F.round("val", 6).alias("val"))
)
query("j6_label_features", f"WITH {VOLS}, {VLAB} SELECT label_id, n, l.class_id, l.image_id, l.z, l.y, l.x, round(val, 6) AS val FROM vlab l JOIN vols v ON l.image_id = v.image_id AND l.z = v.z AND l.y = v.y AND l.x = v.x")(
    lambda s, d: vlab(s, d).drop("t").join(vols(s, d).select(*PLACE, "val"), PLACE).select("label_id", "n", "class_id", *PLACE, F.round("val", 6).alias("val"))
)
on_vols("j11_local_candidates", ", s AS (SELECT image_id, z, y, x FROM vols WHERE val > 0.3), c AS (SELECT image_id, z, y, x, val FROM vols WHERE val < -0.2) SELECT s.image_id, s.z, s.y, s.x, count(*) AS n, round(min(val), 6) AS least FROM s JOIN c ON s.image_id = c.image_id AND s.z = c.z AND abs(s.y - c.y) <= 3 AND abs(s.x - c.x) <= 3 GROUP BY 1, 2, 3, 4")(
    lambda v: grid.candidates(v.where("val > 0.3"), v.where("val < -0.2"), 3).groupBy(*PLACE).agg(F.count("*").alias("n"), F.round(F.min("val"), 6).alias("least"))
)
_D2 = "(v.z - r.z) ** 2 + (v.y - r.y) ** 2 + (v.x - r.x) ** 2"
on_vols("j12_within_distance", f", ref AS (SELECT * FROM vols WHERE val > 0.35) SELECT DISTINCT v.image_id, v.z, v.y, v.x FROM vols v JOIN ref r ON v.image_id = r.image_id WHERE {_D2} <= 9")(lambda v: distance.within(v, v.where("val > 0.35"), 3).select(*PLACE))
on_vols("j13_ball_dilation", f", ref AS (SELECT * FROM vols WHERE val > 0.35), n AS (SELECT DISTINCT v.image_id, v.z, v.y, v.x FROM vols v JOIN ref r ON v.image_id = r.image_id WHERE {_D2} <= 4) SELECT image_id, z, y, x, CASE WHEN n.x IS NULL THEN 0 ELSE 255 END AS val FROM (SELECT image_id, z, y, x FROM vols) v LEFT JOIN n USING (image_id, z, y, x)")(
    lambda v: distance.nearest_distance(v, v.where("val > 0.35"), 2).select(*PLACE, F.when(F.col("d2").isNotNull(), 255).otherwise(0).alias("val"))
)
query("j14_mask_multiply", f"WITH {VRES} SELECT image_id, z, y, x, round(val * CASE WHEN code > 10 THEN 1 ELSE 0 END, 6) + 0.0 AS val FROM vols JOIN result USING (image_id, z, y, x)")(
    lambda s, d: grid.multiplied(vols(s, d), vres(s, d).select(*VOXEL, (F.col("code") > 10).cast("double").alias("val"))).select(*PLACE, (F.round("val", 6) + F.lit(0.0)).alias("val"))
)
on_vols("p8_thresholds", "SELECT image_id, z, y, x, CASE WHEN val > 0.1 THEN 255 ELSE 0 END AS above, CASE WHEN val >= 0.1 THEN 255 ELSE 0 END AS from_on, CASE WHEN val BETWEEN 0.1 AND 0.2 THEN 255 ELSE 0 END AS band FROM vols")(
    lambda v: v.select(*PLACE, grid.threshold(F.col("val"), above=0.1).alias("above"), grid.threshold(F.col("val"), low=0.1).alias("from_on"), grid.threshold(F.col("val"), low=0.1, high=0.2).alias("band"))
)

# --- kernels --------------------------------------------------------------------------------------------------------


def _at(o: int, column: str) -> str:
    p = "greatest(1, 2 * (n - 1))"
    r = f"(((i + {o}) % {p} + {p}) % {p})"
    return f"_{column}[CASE WHEN {r} < n THEN {r} ELSE {p} - {r} END + 1]"


def sql_line(name: str, src: str, axis: str, outs: dict, keep=("val",)) -> str:
    """A view ``name``: columns ``outs`` (name: column and weights by offset, or an expression of i and n) along an axis."""
    keys = ", ".join(k for k in PLACE if k != axis)
    used = list(dict.fromkeys([*keep, *(c for c, _ in outs.values())]))
    lists = ", ".join(f"list({c} ORDER BY {axis}) AS _{c}" for c in (axis, *used))

    def expression(c, f) -> str:
        return f if isinstance(f, str) else " + ".join(f"{w!r} * {_at(o, c)}" for o, w in f.items())

    new = ", ".join([f"unnest(_{axis}) AS {axis}", *(f"unnest(_{c}) AS {c}" for c in keep), *(f"unnest(list_transform(range(0, n), lambda i: {expression(c, f)})) AS {k}" for k, (c, f) in outs.items())])
    return f"{name} AS (SELECT {keys}, {new} FROM (SELECT {keys}, count(*) AS n, {lists} FROM {src} GROUP BY {keys}))"


def sql_smooth(prefix: str, src: str, sigmas: dict, columns=("val",)) -> tuple[list[str], str]:
    found = []
    for axis, sigma in sigmas.items():
        w = kernels.gaussian_weights(sigma)
        found.append(sql_line(f"{prefix}{axis}", src, axis, {c: (c, {i - len(w) // 2: x for i, x in enumerate(w)}) for c in columns}, ()))
        src = f"{prefix}{axis}"
    return found, src


def sql_derivatives(prefix: str, src: str, axes: list[str]) -> tuple[list[str], str]:
    found, kept, seen = [], ["val"], []
    for axis in axes:
        outs = {f"g{axis}": ("val", lines.FIRST), f"d{axis}{axis}": ("val", lines.SECOND)} | {f"d{a}{axis}": (f"g{a}", lines.FIRST) for a in seen}
        found.append(sql_line(f"{prefix}{axis}", src, axis, outs, kept))
        kept += outs
        seen.append(axis)
        src = f"{prefix}{axis}"
    return found, src


def sql_eigen(src: str, m: dict[tuple[str, str], str]) -> str:
    """Views ev (e0 >= e1 >= e2) of the symmetric 3 x 3 matrix of columns ``m``."""
    g = {k: f"{v}" for k, v in m.items()}
    return f""", ea AS (SELECT *, ({g['z', 'z']} + {g['y', 'y']} + {g['x', 'x']}) / 3 AS q FROM {src}),
eb AS (SELECT *, {g['z', 'z']} - q AS a_, {g['y', 'y']} - q AS b_, {g['x', 'x']} - q AS c_ FROM ea),
ec AS (SELECT *, sqrt((a_ * a_ + b_ * b_ + c_ * c_ + 2 * ({g['z', 'y']} ** 2 + {g['z', 'x']} ** 2 + {g['y', 'x']} ** 2)) / 6) AS p FROM eb),
ed AS (SELECT *, a_ * (b_ * c_ - {g['y', 'x']} ** 2) - {g['z', 'y']} * ({g['z', 'y']} * c_ - {g['y', 'x']} * {g['z', 'x']}) + {g['z', 'x']} * ({g['z', 'y']} * {g['y', 'x']} - b_ * {g['z', 'x']}) AS det FROM ec),
ee AS (SELECT *, acos(CASE WHEN p > 0 THEN greatest(-1.0, least(1.0, det / (2 * p * p * p))) ELSE 0.0 END) / 3 AS phi FROM ed),
ev AS (SELECT image_id, z, y, x, q + 2 * p * cos(phi) AS e0, 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3)) AS e1, q + 2 * p * cos(phi + 2 * pi() / 3) AS e2 FROM ee)"""


SIGMAS = {"z": 0.5, "y": 1.0, "x": 1.0}
AXES = ["z", "y", "x"]
_PAIRS = {(a, b): f"d{a}{b}" for i, a in enumerate(AXES) for b in AXES[i:]}
_SMOOTH, _LAST = sql_smooth("s", "vols", SIGMAS)
_SECOND, _END = sql_derivatives("k", _LAST, AXES)


def rounded(df, *columns: str, to: int = 5):
    return df.select(*PLACE, *((F.round(c, to) + F.lit(0.0)).alias(c) for c in columns))


on_vols("d5_normalise", "SELECT image_id, z, y, x, round((val - avg(val) OVER w) / CASE WHEN stddev_samp(val) OVER w > 0 THEN stddev_samp(val) OVER w ELSE 1 END, 6) AS val FROM vols WINDOW w AS (PARTITION BY image_id)")(
    lambda v: kernels.normalised(v).select(*PLACE, F.round("val", 6).alias("val"))
)
on_vols("d22_rescale01", "SELECT image_id, z, y, x, round((val - min(val) OVER w) / (max(val) OVER w - min(val) OVER w), 6) AS val FROM vols WINDOW w AS (PARTITION BY image_id)")(
    lambda v: objects.rescaled01(v).select(*PLACE, F.round("val", 6).alias("val"))
)
on_vols("d6_block_average_3d", "SELECT image_id, z // 2 AS z, y // 3 AS y, x // 3 AS x, round(avg(val), 6) AS val FROM vols GROUP BY 1, 2, 3, 4 HAVING max(y) - min(y) = 2 AND max(x) - min(x) = 2")(
    lambda v: kernels.blocks(v, *kernels.bins(3, 1.5, 4)[1:], kernels.bins(3, 1.5, 4)[0]).select(*PLACE, F.round("val", 6).alias("val"))
)
on_vols("d9_linear_rescale", ", " + sql_line("a", "vols", "y", {"w": ("val", {0: 0.5, 1: 0.5}), "n": ("val", "n")}) + ", b AS (SELECT image_id, z, y // 2 AS y, x, w AS val FROM a WHERE y % 2 = 0 AND y // 2 < n // 2), " + sql_line("e", "b", "x", {"w": ("val", {1: 1.0}), "n": ("val", "n")}) + " SELECT image_id, z, y, x // 3 AS x, round(w, 6) + 0.0 AS val FROM e WHERE x % 3 = 0 AND x // 3 < n // 3")(
    lambda v: rounded(lines.rescaled(v, {"z": 1, "y": 2, "x": 3}), "val", to=6)
)
on_vols("d9_cubic_rescale", ", " + sql_line("a", "vols", "x", {"w": ("val", {-1: -0.0625, 0: 0.5625, 1: 0.5625, 2: -0.0625}), "n": ("val", "n")}) + " SELECT image_id, z, y, x // 2 AS x, round(w, 6) + 0.0 AS val FROM a WHERE x % 2 = 0 AND x // 2 < n // 2")(
    lambda v: rounded(lines.rescaled(v, {"z": 1, "y": 1, "x": 2}, cubic=True), "val", to=6)
)
_PASS = "{0} AS (SELECT image_id, z, y, x, sum(s) OVER w AS s, sum(k) OVER w AS k FROM {1} WINDOW w AS (PARTITION BY image_id, {2} ORDER BY {3} RANGE BETWEEN {4} PRECEDING AND {4} FOLLOWING))"
on_vols("d11_box_mean", f", a AS (SELECT *, val AS s, 1 AS k FROM vols), {_PASS.format('b', 'a', 'z, y', 'x', 2)}, {_PASS.format('e', 'b', 'z, x', 'y', 1)}, {_PASS.format('f', 'e', 'y, x', 'z', 1)} SELECT image_id, z, y, x, round(s / k, 6) + 0.0 AS val FROM f")(
    lambda v: rounded(lines.box_mean(v, {"x": 2, "y": 1, "z": 1}), "val", to=6)
)
on_vols("d12_gaussian", f", {', '.join(_SMOOTH)} SELECT image_id, z, y, x, round(val, 6) + 0.0 AS val FROM {_LAST}")(lambda v: rounded(lines.gaussian(v, SIGMAS), "val", to=6))
on_vols("d13_hessian", f", {', '.join(_SMOOTH + _SECOND)} {sql_eigen(_END, _PAIRS)}, o AS (SELECT *, list_reverse_sort([abs(e0), abs(e1), abs(e2)]) AS l FROM ev) SELECT image_id, z, y, x, round(l[1], 5) + 0.0 AS e0, round(l[2], 5) + 0.0 AS e1, round(l[3], 5) + 0.0 AS e2 FROM o")(
    lambda v: rounded(lines.hessian(v, SIGMAS), "e0", "e1", "e2")
)
_PRODUCTS = "pr AS (SELECT image_id, z, y, x, " + ", ".join(f"g{a} * g{b} AS d{a}{b}" for a, b in _PAIRS) + f" FROM {_END})"
_BLURRED, _FINAL = sql_smooth("q", "pr", SIGMAS, tuple(_PAIRS.values()))
on_vols("d14_structure_tensor", f", {', '.join([*_SMOOTH, *_SECOND, _PRODUCTS, *_BLURRED])} {sql_eigen(_FINAL, _PAIRS)} SELECT image_id, z, y, x, round(e0, 5) + 0.0 AS e0, round(e1, 5) + 0.0 AS e1, round(e2, 5) + 0.0 AS e2 FROM ev")(
    lambda v: rounded(lines.structure(v, SIGMAS), "e0", "e1", "e2")
)
on_vols("d15_derivatives", f", {', '.join(_SMOOTH + _SECOND)} SELECT image_id, z, y, x, round(dzz + dyy + dxx, 5) + 0.0 AS laplacian, round(sqrt(gz * gz + gy * gy + gx * gx), 5) + 0.0 AS edge FROM {_END}")(
    lambda v: rounded(lines.laplacian_and_edges(v, SIGMAS), "laplacian", "edge")
)
on_vols("d15_mixed_derivative", ", " + sql_line("a", "vols", "y", {"v2": ("val", lines.SECOND)}) + ", " + sql_line("b", "a", "x", {"w": ("v2", lines.FIRST)}) + " SELECT image_id, z, y, x, round(w, 5) + 0.0 AS val FROM b")(
    lambda v: rounded(lines.derivative(v, {"y": 2, "x": 1}, {}), "val")
)


def sql_up(name: str, src: str, axis: str, b: int) -> str:
    keys = ", ".join(k for k in PLACE if k != axis)
    at = f"greatest(0.0, least(n - 1.0, (i - {(b - 1) / 2}) / {b}))"
    value = f"_v[CAST(floor({at}) AS BIGINT) + 1] * (1 - ({at} - floor({at}))) + coalesce(_v[CAST(floor({at}) AS BIGINT) + 2], 0) * ({at} - floor({at}))"
    return f"{name} AS (SELECT {keys}, unnest(range(0, n * {b})) AS {axis}, unnest(list_transform(range(0, n * {b}), lambda i: {value})) AS val FROM (SELECT {keys}, count(*) AS n, list(val ORDER BY {axis}) AS _v FROM {src} GROUP BY {keys}))"


on_vols("d17_up_sampling", ", a AS (SELECT image_id, z // 2 AS z, y // 4 AS y, x // 4 AS x, avg(val) AS val FROM vols GROUP BY 1, 2, 3, 4 HAVING max(y) - min(y) = 3 AND max(x) - min(x) = 3), " + ", ".join([sql_up("uz", "a", "z", 2), sql_up("uy", "uz", "y", 4), sql_up("ux", "uy", "x", 4)]) + " SELECT image_id, z, y, x, round(val, 6) + 0.0 AS val FROM ux SEMI JOIN vols USING (image_id, z, y, x)")(
    lambda v: rounded(lines.up_sampled(kernels.blocks(v, 4, 4, 2), {"z": 2, "y": 4, "x": 4}).join(v.select(*VOXEL), VOXEL, "left_semi"), "val", to=6)
)
_BOX3 = "SELECT v.image_id, v.z, v.y, v.x, round({0}(n.val), 6) AS {0}imum FROM vols v, range(-1, 2) a(dy), range(-1, 2) b(dx) JOIN vols n ON n.image_id = v.image_id AND n.z = v.z AND n.y = v.y + dy AND n.x = v.x + dx GROUP BY 1, 2, 3, 4"
on_vols("d21_erode_dilate", f", lo AS ({_BOX3.format('min')}), hi AS ({_BOX3.format('max')}) SELECT image_id, z, y, x, minimum AS eroded, maximum AS dilated FROM lo JOIN hi USING (image_id, z, y, x)")(
    lambda v: kernels.extremes(v, F.min).select(*VOXEL, F.round("val", 6).alias("eroded")).join(kernels.extremes(v, F.max).select(*VOXEL, F.round("val", 6).alias("dilated")), VOXEL).select(*PLACE, "eroded", "dilated")
)
on_vols("d23_distance_map", f", ref AS (SELECT * FROM vols WHERE val > 0.35) SELECT v.image_id, v.z, v.y, v.x, CAST(min({_D2}) AS BIGINT) AS d2 FROM vols v LEFT JOIN ref r ON v.image_id = r.image_id GROUP BY 1, 2, 3, 4")(
    lambda v: distance.distance_map(v, F.col("val") > 0.35).select(*PLACE, "d2")
)
on_vols("d24_rgb", "SELECT image_id, z, y, x, red, y * 4 AS green, x * 4 AS blue, red * 65536 + y * 1024 + x * 4 AS packed FROM (SELECT *, least(255, greatest(0, CAST(floor((val + 0.5) * 255) AS BIGINT))) AS red FROM vols)")(
    lambda v: split_rgb(v.withColumn("packed", images.merged_channels(F.floor((F.col("val") + 0.5) * 255), F.col("y") * 4, F.col("x") * 4)))
)


def split_rgb(v):
    red, green, blue = images.split_channels(F.col("packed"))
    return v.select(*PLACE, red.alias("red"), green.alias("green"), blue.alias("blue"), "packed")


query("d20_patch_components")(lambda s, d: kernels.patch_components(vols(s, d), 4, 2, 3))

# --- objects --------------------------------------------------------------------------------------------------------

_STEPS6, _STEPS4, _STEPS8 = "1, 1048576, 1099511627776", "1, 1048576", "1, 1048576, 1048577, 1048575"


def sql_components(name: str, where: str, steps: str, src: str = "vols") -> str:
    """A view ``name`` of voxels with object_id; the WITH that holds it is recursive."""
    return f"""{name}f AS (SELECT image_id, z, y, x, z * 1099511627776 + y * 1048576 + x AS id FROM {src} WHERE {where}),
{name}h AS (SELECT a.image_id, a.id AS a, b.id AS b FROM (SELECT *, unnest([{steps}]) AS o FROM {name}f) a JOIN {name}f b ON a.image_id = b.image_id AND b.id = a.id + a.o),
{name}e AS (SELECT * FROM {name}h UNION ALL SELECT image_id, b, a FROM {name}h),
{name}r AS (SELECT image_id, id, id AS label FROM {name}f UNION SELECT r.image_id, e.b, r.label FROM {name}r r JOIN {name}e e ON r.image_id = e.image_id AND r.id = e.a WHERE r.label < e.b),
{name} AS (SELECT f.image_id, f.z, f.y, f.x, l.object_id FROM {name}f f JOIN (SELECT image_id, id, min(label) AS object_id FROM {name}r GROUP BY 1, 2) l USING (image_id, id))"""


_COMP = f"WITH RECURSIVE {VOLS}, {sql_components('comp', 'val > 0.1', _STEPS6)}"
_OPEN = f"{_COMP}, big AS (SELECT * FROM comp WHERE (image_id, object_id) IN (SELECT (image_id, object_id) FROM comp GROUP BY image_id, object_id HAVING count(*) >= 3))"
_MEASURES = """count(*) AS volume, min(z) AS min_z, min(y) AS min_y, min(x) AS min_x, max(z) AS max_z, max(y) AS max_y, max(x) AS max_x,
round(avg(z), 6) AS mean_z, round(avg(y), 6) AS mean_y, round(avg(x), 6) AS mean_x, round(covar_pop(z, z), 6) + 0.0 AS cov_zz, round(covar_pop(y, y), 6) + 0.0 AS cov_yy, round(covar_pop(x, x), 6) + 0.0 AS cov_xx, round(covar_pop(z, y), 6) + 0.0 AS cov_zy, round(covar_pop(z, x), 6) + 0.0 AS cov_zx, round(covar_pop(y, x), 6) + 0.0 AS cov_yx"""


def found_objects(spark, d, neighbours: int = 6):
    v = vols(spark, d)
    return objects.components(v.where("val > 0.1"), neighbours)


def measured(spark, d):
    return objects.measures(objects.opened(found_objects(spark, d), 3))


query("h7_components", f"{_COMP} SELECT image_id, z, y, x, object_id FROM comp")(lambda s, d: found_objects(s, d).select(*PLACE, "object_id"))
query("h8_plane_components_4", f"WITH RECURSIVE {VOLS}, {sql_components('comp', 'val > 0.1', _STEPS4)} SELECT image_id, z, y, x, object_id FROM comp")(lambda s, d: found_objects(s, d, 4).select(*PLACE, "object_id"))
query("h8_plane_components_8", f"WITH RECURSIVE {VOLS}, {sql_components('comp', 'val > 0.1', _STEPS8)} SELECT image_id, z, y, x, object_id FROM comp")(lambda s, d: found_objects(s, d, 8).select(*PLACE, "object_id"))
query("h9_volume_opening", f"{_OPEN} SELECT image_id, z, y, x, object_id FROM big")(lambda s, d: objects.opened(found_objects(s, d), 3).select(*PLACE, "object_id"))
_BINNED = "bin AS (SELECT image_id, z, y // 2 AS y, x // 2 AS x, avg(CASE WHEN code BETWEEN 11 AND 20 THEN code - 11 ELSE 0 END) AS val FROM result GROUP BY 1, 2, 3, 4 HAVING max(y) - min(y) = 1 AND max(x) - min(x) = 1)"
query("h10_object_segmentation", f"WITH RECURSIVE {VRES}, {_BINNED}, {sql_components('comp', 'val >= 4', _STEPS6, 'bin')} SELECT image_id, object_id, count(*) AS volume, min(y) * 2 AS y0, max(y) * 2 + 1 AS y1 FROM comp GROUP BY 1, 2 HAVING count(*) >= 2")(
    lambda s, d: objects.segmented(vres(s, d), 1, (1, 2, 2), 4, 2).groupBy("image_id", "object_id").agg(F.count("*").alias("volume"), (F.min("y") * 2).alias("y0"), (F.max("y") * 2 + 1).alias("y1"))
)
query("h11_object_measures", f"WITH RECURSIVE {VOLS}, {sql_components('comp', 'val BETWEEN 0.1 AND 0.3', _STEPS6)}, m AS (SELECT image_id, object_id, {_MEASURES} FROM comp GROUP BY 1, 2 HAVING count(*) >= 3) SELECT * FROM m")(
    lambda s, d: plus_zero(objects.analyzed(vols(s, d), 0.1, 0.3, 3, channel=0, frame=0).drop("t", "c", "radius0", "radius1", "radius2", "azimuth", "elevation"))
)
query("h12_volumes", f"{_OPEN} SELECT image_id, object_id, count(*) AS volume FROM big GROUP BY 1, 2")(lambda s, d: measured(s, d).select("image_id", "object_id", "volume"))
query("h13_bounding_boxes", f"{_OPEN} SELECT image_id, object_id, min(z) AS min_z, max(z) AS max_z, min(y) AS min_y, max(y) AS max_y, min(x) AS min_x, max(x) AS max_x FROM big GROUP BY 1, 2")(
    lambda s, d: measured(s, d).select("image_id", "object_id", "min_z", "max_z", "min_y", "max_y", "min_x", "max_x")
)
_M = {("z", "z"): "cov_zz", ("y", "y"): "cov_yy", ("x", "x"): "cov_xx", ("z", "y"): "cov_zy", ("z", "x"): "cov_zx", ("y", "x"): "cov_yx"}
query("h14_inertia_ellipsoids", f"{_OPEN}, m AS (SELECT image_id, object_id AS z, 0 AS y, 0 AS x, {_MEASURES} FROM big GROUP BY 1, 2) {sql_eigen('m', _M)} SELECT image_id, z AS object_id, round(sqrt(5 * greatest(0, e0)), 3) AS radius0, round(sqrt(5 * greatest(0, round(e1, 6))), 2) AS radius1 FROM ev")(
    lambda s, d: objects.ellipsoids(measured(s, d)).select("image_id", "object_id", F.round("radius0", 3).alias("radius0"), F.round(F.sqrt(5 * F.greatest(F.lit(0.0), F.round(F.col("radius1") ** 2 / 5, 6))), 2).alias("radius1"))
)
query("h15_calibrated_volumes", f"{_OPEN} SELECT image_id, object_id, round(count(*) * 1.0 * 2 * 2 * 0.5 * 0.5 * 2.0, 6) AS calibrated FROM big GROUP BY 1, 2")(
    lambda s, d: objects.calibrated(measured(s, d), (1, 2, 2), (2.0, 0.5, 0.5)).select("image_id", "object_id", F.round("calibrated", 6).alias("calibrated"))
)
_VOLUMES = f"{_COMP}, v AS (SELECT image_id, object_id, count(*) AS volume, round(avg(z), 6) * 1 AS centre_z, round(avg(y), 6) * 2 AS centre_y, round(avg(x), 6) * 2 AS centre_x FROM comp GROUP BY 1, 2 HAVING count(*) > 5), p AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY volume DESC, object_id) AS place FROM v)"
query("h16_objects_by_volume", f"{_VOLUMES} SELECT image_id, object_id, volume, place FROM p")(lambda s, d: objects.by_volume(objects.measures(found_objects(s, d)), 5).select("image_id", "object_id", "volume", "place"))
query("h17_centroids", f"{_VOLUMES} SELECT image_id, object_id, round(centre_z, 6) AS centre_z, round(centre_y, 6) AS centre_y, round(centre_x, 6) AS centre_x, '#' || place || ' volume ' || volume AS name FROM p")(
    lambda s, d: objects.by_volume(objects.measures(found_objects(s, d)), 5, (1, 2, 2)).select("image_id", "object_id", *(F.round(f"centre_{a}", 6).alias(f"centre_{a}") for a in "zyx"), "name")
)
query("h18_approved_mask", f"{_VOLUMES}, ok AS (SELECT image_id, z, y, x FROM comp SEMI JOIN (SELECT image_id, object_id FROM p WHERE place % 2 = 1) USING (image_id, object_id)) SELECT v.image_id, v.z, v.y, v.x, CASE WHEN ok.x IS NULL THEN 0 ELSE 255 END AS mask FROM vols v LEFT JOIN ok USING (image_id, z, y, x)")(lambda s, d: approved(s, d))


def approved(spark, d):
    """Every second object by volume, as if a reviewer had kept those."""
    v, found = vols(spark, d), tables.written(found_objects(spark, d), "objects")
    kept = objects.by_volume(objects.measures(found), 5).where("place % 2 = 1").select(*objects.KEY, "object_id")
    return objects.drawn(v, found, kept).select(*PLACE, "mask")


_HOLES = f"""WITH RECURSIVE {VOLS}, {sql_components('fg', 'val > -0.1', _STEPS4)}, {sql_components('bg', 'NOT val > -0.1', _STEPS4)},
small AS (SELECT image_id, z, object_id FROM fg GROUP BY 1, 2, 3 HAVING count(*) < 4), ends AS (SELECT image_id, z, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM vols GROUP BY 1, 2),
hole AS (SELECT bg.image_id, bg.z, object_id FROM bg JOIN ends USING (image_id, z) GROUP BY 1, 2, 3 HAVING NOT bool_or(y = y0 OR y = y1 OR x = x0 OR x = x1)),
new AS (SELECT image_id, z, y, x, 0.0 AS v FROM fg SEMI JOIN small USING (image_id, z, object_id) UNION ALL SELECT image_id, z, y, x, 1.0 FROM bg SEMI JOIN hole USING (image_id, z, object_id))"""
query("h19_specks_and_holes", f"{_HOLES} SELECT image_id, z, y, x, round(coalesce(v, val), 6) AS val FROM vols LEFT JOIN new USING (image_id, z, y, x)")(
    lambda s, d: objects.without_specks(vols(s, d), -0.1, 4).select(*PLACE, F.round("val", 6).alias("val"))
)
query("h20_post_processing")(lambda s, d: objects.post_processed(vols(s, d), 1, 0.5, 4, binary=True).select(*PLACE, F.round("val", 6).alias("val")))


def plus_zero(df):
    return df.select(*((F.col(c) + F.lit(0.0)).alias(c) if c.startswith("cov_") else F.col(c) for c in df.columns))


# --- labels ---------------------------------------------------------------------------------------------------------

query("h21_label_keys", f"WITH {VLAB}, k AS (SELECT label_id, n, format('c{{}}-t{{}}-z{{}}-i{{}}', class_id, t + 1, z + 1, label_id) AS name, row_number() OVER (PARTITION BY image_id, class_id, t, z ORDER BY label_id, n) AS place FROM vlab) SELECT * FROM k")(
    lambda s, d: vlab(s, d).select("label_id", "n", scalars.label_key("class_id", "t", "z", "label_id").alias("name"), F.row_number().over(W.partitionBy("image_id", "class_id", "t", "z").orderBy("label_id", "n")).alias("place"))
)
query("h22_labels_of_plane", f"WITH {VLAB} SELECT image_id, label_id, n, x, y FROM vlab WHERE class_id = 'N' AND z = 2 AND t = 1")(
    lambda s, d: vlab(s, d).where("class_id = 'N' and z = 2 and t = 1").select("image_id", "label_id", "n", "x", "y")
)
query("o4_labels_by_plane", f"WITH {VLAB}, l AS (SELECT DISTINCT image_id, label_id, t, z FROM vlab) SELECT image_id, label_id, z, row_number() OVER (PARTITION BY image_id ORDER BY z, t, label_id) AS place FROM l")(
    lambda s, d: vlab(s, d).select("image_id", "label_id", "t", "z").distinct().select("image_id", "label_id", "z", F.row_number().over(W.partitionBy("image_id").orderBy("z", "t", "label_id")).alias("place"))
)
query("i3_correctness_image", f"WITH {VRES} SELECT image_id, z, y, x, CASE WHEN code = 0 THEN 0 WHEN (code - 1) // 10 = class_id THEN 10 + (code - 1) % 10 + 1 ELSE 10 - (code - 1) % 10 - 1 END AS val FROM gt JOIN result USING (image_id, z, y, x)")(
    lambda s, d: exported(correctness(s, d), "correctness", "image_id", "t").select(*PLACE, "val")
)


def correctness(spark, d):
    return tables.truth(vols(spark, d)).join(vres(spark, d), VOXEL).select(*VOXEL, "class_id", scoring.correctness(F.col("code"), F.col("class_id")).alias("val"))


query("n11_useful_pixels")(lambda s, d: sampling.useful_pixels(correctness(s, d), 5, 3).drop("t", "c"))
_SCORE = "CAST('0x' || substr(md5(concat(doc_id, ',', {0})), 1, 8) AS BIGINT) % 100"
query("i7_confusion", f"WITH s AS (SELECT quality, {_SCORE.format(1)} + 30 * quality AS score FROM labels) SELECT quality AS truth, CASE WHEN score >= 70 THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM s GROUP BY 1, 2")(
    lambda s, d: scoring.confusion(tables.table(s, d, "labels").select("quality", (sampling.draw("doc_id", F.lit(1)) % 100 + 30 * F.col("quality")).alias("score")), "quality", "score", 70)
)
query("i6_paired_t_test", f"""WITH s AS (SELECT CAST('0x' || substr(md5(concat(doc_id)), 1, 8) AS BIGINT) % 10 AS fold, quality, {_SCORE.format(1)} + 30 * quality AS a, {_SCORE.format(2)} + 20 * quality AS b FROM labels),
f AS (SELECT fold, avg(CASE WHEN (a >= 65) = (quality = 1) THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN (b >= 60) = (quality = 1) THEN 1.0 ELSE 0.0 END) AS diff FROM s GROUP BY 1)
SELECT count(*) AS folds, round(avg(diff), 6) + 0.0 AS mean, round(avg(diff) / sqrt((1.0 / count(*) + 1.0 / 9) * var_samp(diff)), 4) + 0.0 AS t FROM f""")(lambda s, d: compared(s, d))


def compared(spark, d):
    rows = tables.table(spark, d, "labels").select((sampling.draw("doc_id") % 10).alias("fold"), (F.col("quality") == 1).alias("truth"), (sampling.draw("doc_id", F.lit(1)) % 100 + 30 * F.col("quality") >= 65).alias("a"), (sampling.draw("doc_id", F.lit(2)) % 100 + 20 * F.col("quality") >= 60).alias("b"))
    found = scoring.corrected_t(rows.groupBy("fold").agg(*((F.avg((F.col(k) == F.col("truth")).cast("double"))).alias(k) for k in "ab")), 1 / 9)
    return found.select("folds", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), (F.round("t", 4) + F.lit(0.0)).alias("t"))
