"""Registered queries over labels, instances, votes and streams; they join those of ``voxmill.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxmill.functions import scalars
from voxmill.operators import sampling
from voxmill.plans import scoring
from voxmill.queries import _VOTES, INST, QUERIES, RESULT, inst, query
from voxmill.sources import tables
from voxmill.streaming import jobs

# --- boxes and strokes ----------------------------------------------------------------------------------------------

query("p3_range_text", "WITH r AS (SELECT p_partkey, concat(p_size, ',', p_size + p_partkey % 9) AS txt FROM part) SELECT p_partkey, greatest(0, CAST(split_part(txt, ',', 1) AS INT) - 10) AS low, least(40, CAST(split_part(txt, ',', 2) AS INT) + 10) AS high FROM r")(
    lambda s, d: tables.table(s, d, "part").withColumn("txt", F.concat_ws(",", "p_size", F.col("p_size") + F.col("p_partkey") % 9)).select("p_partkey", *scalars.range_bounds(F.col("txt"), 10, 0, 40))
)
_BOXES = "SELECT label_id, min(x) - 3 AS x0, max(x) + 3 AS x1, min(y) - 3 AS y0, max(y) + 3 AS y1 FROM inst GROUP BY 1"


def boxes(s, d):
    return inst(s, d).groupBy("label_id").agg((F.min("x") - 3).alias("x0"), (F.max("x") + 3).alias("x1"), (F.min("y") - 3).alias("y0"), (F.max("y") + 3).alias("y1"))


query("j9_expanded_boxes", f"WITH {INST}, b AS ({_BOXES}) SELECT label_id, o AS bbox_offset, x0 - o AS x0, x1 + o AS x1, y0 - o AS y0, y1 + o AS y1 FROM b, (VALUES (0), (2), (5)) k(o)")(
    lambda s, d: boxes(s, d).withColumn("o", F.explode(F.array(*(F.lit(o) for o in (0, 2, 5))))).select("label_id", F.col("o").alias("bbox_offset"), *((F.col(c) - F.col("o") if c[1] == "0" else F.col(c) + F.col("o")).alias(c) for c in ("x0", "x1", "y0", "y1")))
)
query("f5_interval_text", f"WITH {INST}, b AS ({_BOXES}) SELECT label_id, concat_ws(',', x0, x1, y0, y1, 0, 0, label_id % 4, label_id % 4) AS box FROM b")(
    lambda s, d: boxes(s, d).select("label_id", F.concat_ws(",", "x0", "x1", "y0", "y1", F.lit("0"), F.lit("0"), F.col("label_id") % 4, F.col("label_id") % 4).alias("box"))
)
query("f10_thick_line", f"""WITH {INST}, p AS (SELECT label_id, n, x, y, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM inst WINDOW w AS (PARTITION BY label_id ORDER BY n, x, y)),
k AS (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM p WHERE dx IS NOT NULL)
SELECT label_id, n, i, CAST(floor(x - CASE WHEN len > 0 THEN i * dy / len ELSE 0 END + 0.5) AS BIGINT) AS px, CAST(floor(y + CASE WHEN len > 0 THEN i * dx / len ELSE 0 END + 0.5) AS BIGINT) AS py FROM k, (VALUES (-1), (0), (1)) o(i)""")(
    lambda s, d: sampling.thick_line(inst(s, d), 3)
)
query("n14_region_labels", f"WITH {INST} SELECT label_id, class_id, x + dx AS x, y + dy AS y FROM inst, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE n = 1 AND x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 63")(
    lambda s, d: sampling.rectangle_pixels(inst(s, d).where("n = 1").select("label_id", "class_id", (F.col("x") - 1).alias("x0"), (F.col("x") + 1).alias("x1"), (F.col("y") - 1).alias("y0"), (F.col("y") + 1).alias("y1")), 64).select("label_id", "class_id", "x", "y")
)
query("n2_rebuilt_labels", f"WITH {INST} SELECT label_id, class_id, y, x, n, row_number() OVER (PARTITION BY label_id, y, x ORDER BY n, class_id) - 1 AS bbox_index FROM inst")(
    lambda s, d: inst(s, d).select("label_id", "class_id", "y", "x", "n", (F.row_number().over(W.partitionBy("label_id", "y", "x").orderBy("n", "class_id")) - 1).alias("bbox_index"))
)

# --- classes and bags -----------------------------------------------------------------------------------------------

query("a4_distinct_labels", f"WITH {INST} SELECT count(DISTINCT label_id) AS labels, count(DISTINCT class_id) AS classes FROM inst")(
    lambda s, d: inst(s, d).groupBy("label_id", "class_id").agg(F.count("*").alias("n")).agg(F.countDistinct("label_id").alias("labels"), F.countDistinct("class_id").alias("classes"))
)
query("a6_label_ids_per_class", f"WITH {INST} SELECT DISTINCT class_id, label_id FROM inst")(lambda s, d: inst(s, d).select("class_id", "label_id").distinct())
query("a11_trees_used", f"SELECT round(avg(n_trees), 6) AS mean_trees, max(n_trees) AS most_trees FROM ({_VOTES})")(
    lambda s, d: QUERIES["g7_vote_until_significant"](s, d).agg(F.round(F.avg("n_trees"), 6).alias("mean_trees"), F.max("n_trees").alias("most_trees"))
)
_KEY = "CAST('0x' || substr(md5(concat({0})), 1, 8) AS BIGINT)"
query("n6_class_balance", f"""WITH {INST}, k AS (SELECT class_id, (SELECT count(*) FROM inst) / (SELECT count(DISTINCT class_id) FROM inst) / count(*) AS ratio FROM inst GROUP BY 1)
SELECT label_id, n, class_id, CAST(floor(ratio) + CASE WHEN {_KEY.format("label_id, ',', n")} % 1000000 < floor(round((ratio - floor(ratio)) * 1000000, 3)) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM inst JOIN k USING (class_id)""")(
    lambda s, d: sampling.balanced(inst(s, d)).select("label_id", "n", "class_id", "copies")
)
query("n9_in_bag", f"WITH {INST} SELECT label_id, n, tree_id, {_KEY.format("label_id, ',', tree_id")} % 100 < 66 AS in_bag FROM inst, range(0, 3) r(tree_id)")(
    lambda s, d: inst(s, d).withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("label_id", "n", "tree_id", (sampling.draw("label_id", "tree_id") % 100 < 66).alias("in_bag"))
)
query("n13_row_weights", f"WITH {INST}, k AS (SELECT class_id, round(max(count(*)) OVER () / count(*), 6) AS weight FROM inst GROUP BY 1) SELECT label_id, n, class_id, weight FROM inst JOIN k USING (class_id)")(
    lambda s, d: sampling.class_weighted(inst(s, d)).select("label_id", "n", "class_id", F.round("weight", 6).alias("weight"))
)
query("g10_majority_model", f"WITH {INST} SELECT class_id, round(count(*) / sum(count(*)) OVER (), 6) AS prob, row_number() OVER (ORDER BY count(*) DESC, class_id) AS place FROM inst GROUP BY 1")(
    lambda s, d: sampling.class_shares(inst(s, d)).select("class_id", F.round("prob", 6).alias("prob"), "place")
)

# --- votes, errors and curves ---------------------------------------------------------------------------------------

_P0 = f"{_KEY.format("vec_id, ',', tree_id")} % 100 * 0.006 + (vec_id % 10) * 0.04"


def votes(s, d):
    spread = tables.table(s, d, "embeddings").select("vec_id", "label").withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(49))))
    return spread.withColumn("p0", sampling.draw("vec_id", "tree_id") % 100 * 0.006 + (F.col("vec_id") % 10) * 0.04)


_MEAN = f"m AS (SELECT vec_id, round(avg(p0), 9) AS p FROM (SELECT vec_id, {_P0} AS p0 FROM embeddings, range(0, 50) r(tree_id)) GROUP BY 1)"
query("g8_average_vote", f"WITH {_MEAN} SELECT vec_id, CASE WHEN p >= 0.5 THEN 0 ELSE 1 END AS class_id, round(greatest(p, 1 - p), 6) AS prob FROM m")(
    lambda s, d: scoring.average_vote(votes(s, d)).select("vec_id", "class_id", F.round("prob", 6).alias("prob"))
)
query("g18_result_code", f"WITH {_MEAN} SELECT vec_id, CAST((CASE WHEN p >= 0.5 THEN 0 ELSE 1 END) * 10 + 1 + floor(round(abs(2 * p - 1) * 9, 7)) AS BIGINT) AS code FROM m")(
    lambda s, d: scoring.average_vote(votes(s, d)).select("vec_id", tables.code_of(F.col("class_id"), 2 * F.col("prob") - 1).cast("long").alias("code"))
)
query("i4_out_of_bag_error", f"""WITH v AS (SELECT vec_id, label >= 5 AS truth, {_P0} AS p0 FROM embeddings, range(0, 50) r(tree_id) WHERE {_KEY.format("vec_id, ',', tree_id + 100")} % 100 >= 66),
m AS (SELECT vec_id, truth, round(avg(p0), 9) < 0.5 AS seen FROM v GROUP BY 1, 2) SELECT count(*) AS n, round(avg(CASE WHEN truth = seen THEN 0.0 ELSE 1.0 END), 6) AS error FROM m""")(
    lambda s, d: votes(s, d).where(sampling.draw("vec_id", F.col("tree_id") + 100) % 100 >= 66).groupBy("vec_id", (F.col("label") >= 5).alias("truth")).agg((F.round(F.avg("p0"), 9) < 0.5).alias("seen")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("truth") == F.col("seen"), 0.0).otherwise(1.0)), 6).alias("error"))
)
query("i6_fold_auc", f"""WITH s AS (SELECT {_KEY.format("doc_id")} % 10 AS fold, {_KEY.format("doc_id, ',', 1")} % 100 + 30 * quality AS score, quality FROM labels),
h AS (SELECT fold, score, count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality = 0) AS neg FROM s GROUP BY 1, 2),
c AS (SELECT *, sum(neg) OVER (PARTITION BY fold ORDER BY score) - neg AS below FROM h)
SELECT fold, round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM c GROUP BY 1""")(
    lambda s, d: scoring.fold_auc(tables.table(s, d, "labels").select((sampling.draw("doc_id") % 10).alias("fold"), (sampling.draw("doc_id", F.lit(1)) % 100 + 30 * F.col("quality")).alias("score"), "quality")).select("fold", F.round("auc", 6).alias("auc"))
)

# --- streams --------------------------------------------------------------------------------------------------------

query("t1_score_arriving", f"WITH {RESULT} SELECT z, y, x, code FROM result")(
    lambda s, d: jobs.score_arriving(jobs.arriving(s, d, "embeddings"), lambda rows: tables.result(tables.voxels(rows)).select("z", "y", "x", "code"), jobs.place(s, "scored"))
)
query("t2_new_label_points", f"WITH {INST} SELECT DISTINCT label_id, y, x FROM inst")(lambda s, d: jobs.new_points(tables.instances(jobs.arriving(s, d, "lineitem")), ["label_id", "y", "x"], jobs.place(s, "points")))
