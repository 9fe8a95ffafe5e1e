"""Registered queries over images: exports, pyramids, derivatives, rescaling; they join those of ``voxmill.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.operators import grid, kernels
from voxmill.operators.entropy import entropy
from voxmill.queries import LAPSE, RESULT, lapse, on_vox, query, result, vox
from voxmill.sources import tables

# --- exports --------------------------------------------------------------------------------------------------------

on_vox("s16_pyramid", """, a AS (SELECT z, y // 2 AS y, x // 2 AS x, avg(val) AS val FROM vox GROUP BY 1, 2, 3 HAVING count(*) = 4), b AS (SELECT z, y // 2 AS y, x // 2 AS x, avg(val) AS val FROM a GROUP BY 1, 2, 3 HAVING count(*) = 4)
SELECT 0 AS level, z, y, x, round(val, 6) AS val FROM vox UNION ALL SELECT 1, z, y, x, round(val, 6) FROM a UNION ALL SELECT 2, z, y, x, round(val, 6) FROM b""")(
    lambda v: kernels.pyramid(v, 3).select("level", "z", "y", "x", F.round("val", 6).alias("val"))
)
query("s18_result_table", f"WITH {RESULT} SELECT 'embeddings' AS data_set, (code - 1) // 10 AS class_id, concat('embeddings--class', (code - 1) // 10, '.parquet') AS output, count(*) AS n FROM result WHERE code > 0 GROUP BY 2")(
    lambda s, d: result(s, d).where("code > 0").groupBy(F.floor((F.col("code") - 1) / 10).alias("class_id")).agg(F.count("*").alias("n")).select(F.lit("embeddings").alias("data_set"), "class_id", F.concat(F.lit("embeddings--class"), "class_id", F.lit(".parquet")).alias("output"), "n")
)
query("s19_result_region", f"WITH {RESULT} SELECT z, y, x, code FROM result WHERE z BETWEEN 2 AND 3 AND y BETWEEN 8 AND 23 AND x BETWEEN 8 AND 40")(
    lambda s, d: grid.interval(result(s, d), z=(2, 3), y=(8, 23), x=(8, 40)).select("z", "y", "x", "code")
)
query("h2_class_image", f"WITH {RESULT} SELECT z, y, x, CASE WHEN code BETWEEN 1 AND 10 THEN code - 1 ELSE 0 END AS val FROM result")(lambda s, d: grid.class_images(result(s, d), (0,)).select("z", "y", "x", "val"))
query("h6_export_selection", f"WITH {RESULT} SELECT z // 4 AS t, z % 4 AS z, y, x, code FROM result WHERE z // 4 BETWEEN 1 AND 1 AND code BETWEEN 11 AND 20")(
    lambda s, d: result(s, d).where((F.floor(F.col("z") / 4) == 1) & F.col("code").between(11, 20)).select(F.floor(F.col("z") / 4).alias("t"), (F.col("z") % 4).alias("z"), "y", "x", "code")
)
query("p14_masked_classes", f"WITH {RESULT} SELECT z, y, x, class_id FROM gt JOIN result USING (z, y, x) WHERE code > 10")(
    lambda s, d: tables.truth(vox(s, d)).join(result(s, d).where("code > 10").select(*tables.VOXEL), tables.VOXEL, "left_semi").select("z", "y", "x", "class_id")
)
query("o2_most_uncertain_region", f"WITH {RESULT}, u AS (SELECT z, y // 16 AS ty, x // 16 AS tx, round(avg(10 - (code - 1) % 10), 6) AS mean FROM result WHERE code > 0 GROUP BY 1, 2, 3) SELECT z, ty, tx, mean FROM u ORDER BY mean DESC, z, ty, tx LIMIT 5")(
    lambda s, d: grid.with_tile(result(s, d).where("code > 0"), 16).groupBy("z", "ty", "tx").agg(F.round(F.avg(10 - (F.col("code") - 1) % 10), 6).alias("mean")).orderBy(F.desc("mean"), "z", "ty", "tx").limit(5)
)

# --- grid and neighbourhoods ----------------------------------------------------------------------------------------

on_vox("d18_entropy", """, b AS (SELECT z, y + dy AS y, x + dx AS x, greatest(0, least(7, CAST(floor((val + 0.5) * 8) AS INT))) AS bin, dy = 0 AND dx = 0 AS own FROM vox, range(-2, 3) o(dy), range(-2, 3) p(dx) WHERE dy * dy + dx * dx <= 4),
h AS (SELECT z, y, x, bin, count(*) AS n, bool_or(own) AS own FROM b GROUP BY 1, 2, 3, 4), s AS (SELECT z, y, x, sum(n) AS total, sum(n * log2(n)) AS part, bool_or(own) AS own FROM h GROUP BY 1, 2, 3)
SELECT z, y, x, round(abs(log2(total) - part / total), 6) AS bits FROM s WHERE own""")(
    lambda v: entropy(v, 2, 8, -0.5, 0.5).select("z", "y", "x", F.round("bits", 6).alias("bits"))
)
on_vox("f8_arithmetic", "SELECT z, y, x, round(sqrt(abs(val)), 6) AS root, round(ln(abs(val) + 1), 6) AS log, round((val + 1) * 2 - val, 6) AS sum FROM vox")(
    lambda v: v.select("z", "y", "x", F.round(F.sqrt(F.abs("val")), 6).alias("root"), F.round(F.ln(F.abs("val") + 1), 6).alias("log"), F.round((F.col("val") + 1) * 2 - F.col("val"), 6).alias("sum"))
)
