"""Registered queries of the voxel engine: name -> function of (spark, sf_dir), and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxmill.functions import scalars
from voxmill.operators import grid, kernels, objects, sampling
from voxmill.plans import scoring
from voxmill.sources import tables
from voxmill.sources.tables import VOXEL

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

VOX = "vox AS (SELECT 0 AS image_id, 0 AS t, 0 AS c, vec_id // 64 AS z, vec_id % 64 AS y, i - 1 AS x, CAST(embedding[i] AS DOUBLE) AS val FROM embeddings, unnest(range(1, 65)) AS u(i))"
LAPSE = f"{VOX}, lapse AS (SELECT image_id, z // 4 AS t, 0 AS c, z % 4 AS z, y, x, val FROM vox UNION ALL SELECT image_id, z // 4, 1, z % 4, y, x, abs(val) FROM vox)"
RESULT = f"""{VOX}, means AS (SELECT z, y, x, round(avg(val) OVER (PARTITION BY z, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 9) AS m FROM vox),
result AS (SELECT z, y, x, CASE WHEN (z * 4096 + y * 64 + x) % 17 = 0 THEN 0 ELSE (CASE WHEN m > 0.02 THEN 1 ELSE 0 END) * 10 + 1 + CAST(floor(round(least(1.0, abs(m - 0.02) * 10) * 9, 7)) AS INT) END AS code FROM means),
gt AS (SELECT z, y, x, CASE WHEN val > 0.1 THEN 1 ELSE 0 END AS class_id FROM vox)"""
INST = "inst AS (SELECT l_orderkey AS label_id, l_linenumber AS n, l_returnflag AS class_id, l_partkey % 64 AS x, l_suppkey % 64 AS y, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3 FROM lineitem)"
FILES = "files AS (SELECT event_id AS file_id, format('/data/{}--W{:03d}--P{:02d}--Z{:03d}--T{:03d}--ch{}.tif', event_type, event_id % 96, event_id % 4, event_id % 16, event_id // 64, event_id % 2) AS path FROM events)"


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def on_vox(name: str, sql: str):
    """A query over the voxel table; ``sql`` goes on from the view vox."""

    def add(f: Callable) -> Callable:
        query(name, f"WITH {VOX} {sql}" if sql[:1] != "," else f"WITH {VOX}{sql}")(lambda spark, d: f(vox(spark, d)))
        return f

    return add


def vox(spark, d: str) -> DataFrame:
    return tables.voxels(tables.table(spark, d, "embeddings"))


def lapse(spark, d: str) -> DataFrame:
    return tables.time_lapse(vox(spark, d))


def result(spark, d: str) -> DataFrame:
    return tables.result(vox(spark, d))


def inst(spark, d: str) -> DataFrame:
    return tables.instances(tables.table(spark, d, "lineitem"))


def files(spark, d: str) -> DataFrame:
    return tables.file_names(tables.table(spark, d, "events"))


# --- scans, file names and scalar functions -------------------------------------------------------------------------


query("s6_data_sets", f"WITH {FILES} SELECT regexp_extract(path, '/([a-z_]+)--', 1) AS treatment, regexp_extract(path, '--W(\\d+)', 1) AS well, regexp_extract(path, '--P(\\d+)', 1) AS position, count(*) AS n_files, min(path) AS first_file FROM files GROUP BY 1, 2, 3")(
    lambda s, d: files(s, d).groupBy(*(F.regexp_extract("path", p, 1).alias(n) for n, p in (("treatment", "/([a-z_]+)--"), ("well", r"--W(\d+)"), ("position", r"--P(\d+)")))).agg(F.count("*").alias("n_files"), F.min("path").alias("first_file"))
)
query("f1_csv_and_lists", "SELECT p_partkey, CAST(list_sum(list_transform(string_split(concat(p_size, ',', p_partkey % 7), ','), lambda v: CAST(v AS INT) + 1)) AS INT) AS total, array_to_string(list_transform([p_size, p_partkey % 7], lambda v: v + 1), ',') AS csv FROM part")(
    lambda s, d: tables.table(s, d, "part").select("p_partkey", *scalars.csv_lists())
)
query("f2_remove_extension", f"WITH {FILES} SELECT file_id, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '') AS name FROM files")(lambda s, d: files(s, d).select("file_id", scalars.remove_extension(F.col("path")).alias("name")))
query("f3_simple_pattern", f"WITH {FILES} SELECT file_id, regexp_replace(regexp_replace(concat('--(', path, ').*--'), '\\.\\*|[()\\\\]|\\.tif', '', 'g'), '^(--)+|(--)+$', '', 'g') AS name FROM files")(
    lambda s, d: files(s, d).select("file_id", scalars.simple_pattern(F.concat(F.lit("--("), "path", F.lit(").*--"))).alias("name"))
)
query("f4_slice_label", f"WITH {FILES} SELECT file_id, concat(split_part(path, '.', 1), '-', file_id % 3) AS label FROM files")(lambda s, d: files(s, d).select("file_id", scalars.slice_label(F.col("path"), F.col("file_id") % 3).alias("label")))
query("f6_padded_names", f"WITH {FILES} SELECT file_id, format('classified--C01--T{{:05d}}--Z{{:05d}}', file_id % 16, file_id // 64) AS name FROM files")(
    lambda s, d: files(s, d).select("file_id", F.format_string("classified--C01--T%05d--Z%05d", F.col("file_id") % 16, F.floor(F.col("file_id") / 64)).alias("name"))
)
query("f7_channel_mask", "SELECT o_orderkey, o_orderkey % 256 AS mask, array_to_string(list_filter(range(0, 8), lambda b: (o_orderkey % 256) & (1 << b) > 0), ',') AS channels FROM orders")(
    lambda s, d: tables.table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 256).alias("mask"), scalars.channels(F.col("o_orderkey") % 256).alias("channels"))
)

# --- projections, filters, predicates -------------------------------------------------------------------------------

on_vox("p1_interval", "SELECT z, y, x, round(val, 6) AS val FROM vox WHERE z BETWEEN 1 AND 5 AND y BETWEEN 10 AND 40 AND x BETWEEN 3 AND 60")(
    lambda v: grid.interval(v, z=(1, 5), y=(10, 40), x=(3, 60)).select("z", "y", "x", F.round("val", 6).alias("val"))
)
query("p4_channels", f"WITH {LAPSE} SELECT c, t, count(*) AS n, round(sum(val), 6) AS total FROM lapse WHERE c IN (1) GROUP BY 1, 2")(lambda s, d: lapse(s, d).where(F.col("c").isin(1)).groupBy("c", "t").agg(F.count("*").alias("n"), F.round(F.sum("val"), 6).alias("total")))
query("p6_keep_attributes", "SELECT vec_id, round(CAST(embedding[4] AS DOUBLE), 6) AS a3, round(CAST(embedding[18] AS DOUBLE), 6) AS a17 FROM embeddings")(
    lambda s, d: tables.table(s, d, "embeddings").select("vec_id", *(F.round(F.get("embedding", i).cast("double"), 6).alias(f"a{i}") for i in (3, 17)))
)
query("p7_intensity_gate", f"WITH {RESULT} SELECT z, y, x, CASE WHEN code BETWEEN 11 AND 20 THEN code - 11 ELSE 0 END AS val FROM result")(lambda s, d: result(s, d).select("z", "y", "x", grid.gate(F.col("code"), 11, 20).alias("val")))
query("p9_two_class_image", f"WITH {RESULT} SELECT z, y, x, CASE WHEN code > 0 AND code <= 10 THEN 10 - code ELSE code END AS code FROM result")(lambda s, d: result(s, d).select("z", "y", "x", F.when((F.col("code") > 0) & (F.col("code") <= 10), 10 - F.col("code")).otherwise(F.col("code")).alias("code")))
on_vox("p10_background_tiles", "SELECT z, y // 16 AS ty, x // 16 AS tx FROM vox GROUP BY 1, 2, 3 HAVING max(val) <= 0.33")(
    lambda v: grid.with_tile(v, 16).groupBy("z", "ty", "tx").agg(F.max("val").alias("top")).where("top <= 0.33").select("z", "ty", "tx")
)
query("p11_background_foreground", f"WITH {INST} SELECT least(CASE class_id WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, 1) AS class_id, count(*) AS n FROM inst GROUP BY 1")(
    lambda s, d: inst(s, d).select(F.least(F.when(F.col("class_id") == "A", 0).when(F.col("class_id") == "N", 1).otherwise(2), F.lit(1)).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n"))
)
query("p12_reviewed_labels", f"WITH {INST} SELECT label_id, count(*) AS n FROM inst WHERE label_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")(
    lambda s, d: inst(s, d).join(tables.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("label_id")), "label_id", "left_anti").groupBy("label_id").agg(F.count("*").alias("n"))
)
query("p13_labels_to_compute", "SELECT o_orderkey AS label_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")(
    lambda s, d: tables.table(s, d, "orders").select(F.col("o_orderkey").alias("label_id")).join(tables.table(s, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("label_id")), "label_id", "left_anti")
)

# --- grid and joins -------------------------------------------------------------------------------------------------

query("j7_label_groups", f"WITH {INST} SELECT floor(ax / 18) AS gx, floor(ay / 18) AS gy, count(*) AS labels FROM (SELECT label_id, avg(x) AS ax, avg(y) AS ay FROM inst GROUP BY 1) GROUP BY 1, 2")(
    lambda s, d: inst(s, d).groupBy("label_id").agg(F.avg("x").alias("ax"), F.avg("y").alias("ay")).groupBy(F.floor(F.col("ax") / 18).cast("double").alias("gx"), F.floor(F.col("ay") / 18).cast("double").alias("gy")).agg(F.count("*").alias("labels"))
)
query("j8_label_boxes", f"WITH {INST} SELECT label_id, min(x) - 3 AS x0, max(x) + 3 AS x1, min(y) - 3 AS y0, max(y) + 3 AS y1 FROM inst GROUP BY 1")(
    lambda s, d: inst(s, d).groupBy("label_id").agg((F.min("x") - 3).alias("x0"), (F.max("x") + 3).alias("x1"), (F.min("y") - 3).alias("y0"), (F.max("y") + 3).alias("y1"))
)
query("j10_label_result_join", f"WITH {RESULT} SELECT class_id, code, count(*) AS n FROM gt JOIN result USING (z, y, x) GROUP BY 1, 2")(lambda s, d: tables.truth(vox(s, d)).join(result(s, d), VOXEL).groupBy("class_id", "code").agg(F.count("*").alias("n")))
query("j16_dense_grid", f"WITH {RESULT} SELECT z, y, x, coalesce(code, 0) AS code FROM (SELECT z, y, x FROM (SELECT DISTINCT z FROM vox), (SELECT unnest(range(0, 64)) AS y), (SELECT unnest(range(0, 64)) AS x)) g LEFT JOIN (SELECT * FROM result WHERE code > 10) USING (z, y, x)")(
    lambda s, d: vox(s, d).select("z").distinct().withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))).join(result(s, d).where("code > 10").select("z", "y", "x", "code"), ["z", "y", "x"], "left").fillna(0, ["code"])
)

# --- kernels --------------------------------------------------------------------------------------------------------

on_vox("d4_log_transform", "SELECT z, y, x, round(ln(abs(val) + 10) * 10000, 4) AS val FROM vox")(lambda v: v.select("z", "y", "x", F.round(F.ln(F.abs("val") + 10) * 10000, 4).alias("val")))
BLOCKS = "SELECT z, y // 3 AS y, x // 3 AS x, round({f}(val), 6) AS val FROM vox GROUP BY 1, 2, 3 HAVING count(*) = 9"
for _name, _f, _how in (("d6_block_average", "avg", F.avg), ("d7_block_maximum", "max", F.max), ("d8_block_minimum", "min", F.min)):
    on_vox(_name, BLOCKS.format(f=_f))(lambda v, how=_how: kernels.blocks(v, 3, 3, how=how).select("z", "y", "x", F.round("val", 6).alias("val")))
on_vox("d19_max_pool", ", k AS (SELECT z, y // 4 AS y, x // 4 AS x, max(val) AS val, arg_max((y % 4) * 4 + x % 4, val) AS place FROM vox GROUP BY 1, 2, 3) SELECT z, y, x, round(val, 6) AS val, place FROM k")(
    lambda v: v.groupBy("z", F.floor(F.col("y") / 4).alias("y"), F.floor(F.col("x") / 4).alias("x")).agg(F.round(F.max("val"), 6).alias("val"), F.max_by((v.y % 4) * 4 + v.x % 4, v.val).alias("place"))
)

# --- aggregates over labels and instances ---------------------------------------------------------------------------

query("a1_instances_per_class", f"WITH {INST} SELECT class_id, count(*) AS n FROM inst GROUP BY 1")(lambda s, d: inst(s, d).groupBy("class_id").agg(F.count("*").alias("n")))
query("a2_labels_per_class", f"WITH {INST} SELECT class_id, count(DISTINCT label_id) AS labels, count(*) AS pixels FROM inst GROUP BY 1")(lambda s, d: inst(s, d).groupBy("class_id").agg(F.countDistinct("label_id").alias("labels"), F.count("*").alias("pixels")))
query("a3_points_per_label", f"WITH {INST} SELECT round(avg(n), 6) AS points, greatest(1, CAST(floor(500 / avg(n)) AS INT)) AS batch_percent FROM (SELECT label_id, count(*) AS n FROM inst GROUP BY 1)")(
    lambda s, d: inst(s, d).groupBy("label_id").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("points"), F.greatest(F.lit(1), F.floor(500 / F.avg("n")).cast("int")).alias("batch_percent"))
)
query("a5_label_rows", f"WITH {INST} SELECT class_id, label_id, array_to_string(list_sort(list(n)), ',') AS numbers FROM inst GROUP BY 1, 2")(lambda s, d: inst(s, d).groupBy("class_id", "label_id").agg(F.array_join(F.array_sort(F.collect_list("n")), ",").alias("numbers")))
query("a8_sampling_density", f"WITH {INST} SELECT y, x, count(*) AS hits FROM inst GROUP BY 1, 2")(lambda s, d: inst(s, d).groupBy("y", "x").agg(F.count("*").alias("hits")))
query("a9_uncertain_regions", f"WITH {RESULT}, u AS (SELECT z, y // 16 AS ty, x // 16 AS tx, y, x, 10 - (code - 1) % 10 AS u FROM result WHERE code > 0) SELECT z, ty, tx, CAST(sum(u) AS BIGINT) AS total, max(u) AS top, round(avg(u), 6) AS mean, round(sum(u * y) / sum(u), 6) AS cy, round(sum(u * x) / sum(u), 6) AS cx FROM u GROUP BY 1, 2, 3")(
    lambda s, d: grid.with_tile(result(s, d).where("code > 0").withColumn("u", 10 - (F.col("code") - 1) % 10), 16).groupBy("z", "ty", "tx").agg(F.sum("u").alias("total"), F.max("u").alias("top"), F.round(F.avg("u"), 6).alias("mean"), *(F.round(F.sum(F.col("u") * F.col(a)) / F.sum("u"), 6).alias(f"c{a}") for a in "yx"))
)
on_vox("a10_stack_statistics", "SELECT z, round(avg(val), 6) AS mean, round(stddev_samp(val), 6) AS sd FROM vox GROUP BY 1")(lambda v: v.groupBy("z").agg(F.round(F.avg("val"), 6).alias("mean"), F.round(F.stddev("val"), 6).alias("sd")))

# --- instance sets and sampling -------------------------------------------------------------------------------------

query("n1_instance_table", f"WITH {INST} SELECT label_id, y, x, min(n) AS n FROM inst GROUP BY 1, 2, 3")(lambda s, d: inst(s, d).groupBy("label_id", "y", "x").agg(F.min("n").alias("n")))
_BAG = f"""WITH {INST}, bag AS (SELECT *, tree_id FROM inst, range(0, 3) r(tree_id) WHERE CAST('0x' || substr(md5(concat(label_id, ',', tree_id)), 1, 8) AS BIGINT) % 100 < 66),
s AS (SELECT tree_id, class_id, count(*) AS n FROM bag GROUP BY 1, 2)"""
query("n7_label_balanced_bag", f"{_BAG} SELECT tree_id, class_id, n, round(max(n) OVER (PARTITION BY tree_id) / n, 6) AS weight FROM s")(
    lambda s, d: sampling.label_bags(inst(s, d), 3, 66).groupBy("tree_id", "class_id").agg(F.count("*").alias("n"), F.round(F.first("weight"), 6).alias("weight"))
)
query("n12_correctness", f"WITH {RESULT} SELECT z, y, x, CASE WHEN code = 0 THEN 0 WHEN (code - 1) // 10 = class_id THEN 10 + (code - 1) % 10 + 1 ELSE 10 - (code - 1) % 10 - 1 END AS val FROM gt JOIN result USING (z, y, x)")(
    lambda s, d: tables.truth(vox(s, d)).join(result(s, d), VOXEL).select("z", "y", "x", scoring.correctness(F.col("code"), F.col("class_id")).alias("val"))
)

# --- decoding, objects ----------------------------------------------------------------------------------------------

query("h1_decode", f"WITH {RESULT} SELECT z, y, x, (code - 1) // 10 AS class_id, code - 10 * ((code - 1) // 10) AS certainty FROM result WHERE code > 0")(lambda s, d: scoring.decode(result(s, d)).select("z", "y", "x", "class_id", "certainty"))
query("h3_binned_class_image", f"WITH {RESULT} SELECT z, y // 2 AS y, x // 2 AS x, round(avg(CASE WHEN code BETWEEN 11 AND 20 THEN code - 11 ELSE 0 END), 6) AS val FROM result GROUP BY 1, 2, 3 HAVING count(*) = 4")(
    lambda s, d: kernels.blocks(result(s, d).withColumn("val", grid.gate(F.col("code"), 11, 20)), 2, 2).select("z", "y", "x", F.round("val", 6).alias("val"))
)
query("h4_bit_depth", f"WITH {RESULT} SELECT z, y, x, code * 25 AS byte_val, code * 6553 AS short_val FROM result")(lambda s, d: result(s, d).select("z", "y", "x", (F.col("code") * 25).alias("byte_val"), (F.col("code") * 6553).alias("short_val")))
query("h5_label_mask", f"WITH {RESULT} SELECT z, y, x, CAST(ceil(code / 10) AS BIGINT) AS label FROM result")(lambda s, d: result(s, d).select("z", "y", "x", F.ceil(F.col("code") / 10).alias("label")))

# --- evaluation -----------------------------------------------------------------------------------------------------

_ACC = f"WITH {RESULT}, j AS (SELECT class_id AS truth, (code - 1) // 10 AS seen FROM gt JOIN result USING (z, y, x) WHERE code > 0), k AS (SELECT unnest([truth, seen]) AS class_id, truth, seen, unnest([1, 0]) AS is_truth FROM j), a AS (SELECT class_id, count(*) FILTER (WHERE is_truth = 1) AS gt, count(*) FILTER (WHERE is_truth = 1 AND truth = seen) AS tp, count(*) FILTER (WHERE is_truth = 0 AND truth <> seen) AS fp, count(*) FILTER (WHERE is_truth = 1 AND truth <> seen) AS fn FROM k GROUP BY 1)"
query("i1_class_accuracies", f"{_ACC} SELECT class_id, gt, tp, fp, fn FROM a")(lambda s, d: scoring.accuracies(tables.truth(vox(s, d)), result(s, d)))
query("i2_percent_correct_jaccard", f"{_ACC} SELECT class_id, round(100.0 * tp / nullif(gt, 0), 6) AS percent_correct, round(100.0 * tp / nullif(tp + fp + fn, 0), 6) AS jaccard FROM a")(
    lambda s, d: scoring.accuracies(tables.truth(vox(s, d)), result(s, d)).select("class_id", F.round(100.0 * F.col("tp") / F.nullif("gt", F.lit(0).cast("long")), 6).alias("percent_correct"), F.round(100.0 * F.col("tp") / F.nullif(F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0).cast("long")), 6).alias("jaccard"))
)
query("i7_confusion", "SELECT quality AS truth, toxic AS prediction, count(*) AS n FROM labels GROUP BY 1, 2")(lambda s, d: tables.table(s, d, "labels").groupBy(F.col("quality").alias("truth"), F.col("toxic").alias("prediction")).agg(F.count("*").alias("n")))

_VOTES = f"""WITH v AS (SELECT vec_id AS row_id, tree_id, CAST('0x' || substr(md5(concat(vec_id, ',', tree_id)), 1, 8) AS BIGINT) % 100 * 0.006 + (vec_id % 10) * 0.04 AS p0 FROM embeddings, range(0, 50) r(tree_id)),
r AS (SELECT row_id, row_number() OVER w AS n, round(sum(p0) OVER w / row_number() OVER w, 9) AS mean, count(*) OVER (PARTITION BY row_id) AS trees FROM v WINDOW w AS (PARTITION BY row_id ORDER BY tree_id)),
k AS (SELECT *, greatest(mean, 1 - mean) AS p FROM r),
s AS (SELECT *, p >= 1 OR (2 * p - 1) ** 2 / (p * (1 - p) / n) > 16 AS sure FROM k)
SELECT DISTINCT ON (row_id) row_id, CASE WHEN mean >= 0.5 THEN 0 ELSE 1 END AS class_id, round(abs(2 * mean - 1), 6) AS certainty, n AS n_trees FROM s WHERE (n > 10 AND n % 10 = 1 AND sure) OR n = trees ORDER BY row_id, n"""
query("g7_vote_until_significant", _VOTES)(
    lambda s, d: sampling.until_significant(tables.table(s, d, "embeddings").select(F.col("vec_id").alias("row_id")).withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(49)))).withColumn("p0", sampling.draw("row_id", "tree_id") % 100 * 0.006 + (F.col("row_id") % 10) * 0.04))
)
