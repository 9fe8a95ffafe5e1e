"""Decoding, accuracy tables and forests over instance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxmill.sources.tables import VOXEL


def decode(result: DataFrame) -> DataFrame:
    """Class and certainty (1..10) of coded voxels; unclassified ones (code 0) are left out."""
    found = result.where("code > 0").withColumn("class_id", F.floor((F.col("code") - 1) / 10))
    return found.withColumn("certainty", F.col("code") - 10 * F.col("class_id"))


def correctness(code: Column, class_id: Column) -> Column:
    """0 if unclassified; above 10 if right, below if wrong, the farther the surer."""
    seen, sure = F.floor((code - 1) / 10), (code - 1) % 10 + 1
    return F.when(code == 0, 0).when(seen == class_id, 10 + sure).otherwise(10 - sure).cast("int")


def accuracies(truth: DataFrame, result: DataFrame) -> DataFrame:
    """Ground truth, true and false positives and false negatives of each class. Counted per (truth, seen) pair before
    the small table is turned by class."""
    pairs = truth.join(decode(result).select(*VOXEL, F.col("class_id").alias("seen")), VOXEL).groupBy(F.col("class_id").cast("long").alias("truth"), "seen").agg(F.count("*").alias("n"))
    sides = pairs.select("truth", "seen", "n", F.explode(F.array(F.struct(F.col("truth").alias("class_id"), F.lit(True).alias("own")), F.struct(F.col("seen").alias("class_id"), F.lit(False).alias("own")))).alias("s")).select("truth", "seen", "n", "s.*")
    right = F.col("truth") == F.col("seen")

    def total(of) -> Column:
        return F.sum(F.when(of, F.col("n")).otherwise(0))

    return sides.groupBy("class_id").agg(total(F.col("own")).alias("gt"), total(F.col("own") & right).alias("tp"), total(~F.col("own") & ~right).alias("fp"), total(F.col("own") & ~right).alias("fn"))


def average_vote(votes: DataFrame) -> DataFrame:
    """Class and its probability from the mean over all trees of p0, the vote for class 0."""
    p = F.round(F.avg("p0"), 9)
    mean = votes.groupBy("vec_id").agg(p.alias("p"))
    return mean.select("vec_id", F.when(F.col("p") >= 0.5, 0).otherwise(1).alias("class_id"), F.greatest("p", 1 - F.col("p")).alias("prob"))


def fold_auc(rows: DataFrame, parts: int = 64) -> DataFrame:
    """Area under the curve of each fold (fold, score, quality 0/1), ties counted half; null if a fold has one class alone.

    Rows are counted per score. Scores are cut at approximate quantiles into ``parts`` ranges a fold; the sum of what lies
    below is that of the ranges before (a row each) and of the range's own scores, so no task holds a fold. Where the
    cuts fall does not change the result. Rows without a fold or a score count for nothing.
    """
    pos, neg = (F.count_if(F.col("quality") == q) for q in (1, 0))
    counts = rows.where("fold is not null and score is not null").groupBy("fold", "score").agg(pos.alias("pos"), neg.alias("neg"))
    marks = counts.groupBy("fold").agg(F.percentile_approx("score", [i / parts for i in range(1, parts)], 1000).alias("marks"))
    placed = counts.join(marks, "fold").withColumn("part", F.size(F.filter("marks", lambda m: m < F.col("score")))).drop("marks")
    sums = placed.groupBy("fold", "part").agg(F.sum("neg").alias("own"))
    before = sums.select("fold", "part", (F.sum("own").over(W.partitionBy("fold").orderBy("part")) - F.col("own")).alias("before"))  # parts rows a fold
    inside = F.sum("neg").over(W.partitionBy("fold", "part").orderBy("score")) - F.col("neg")
    below = placed.withColumn("inside", inside).join(before, ["fold", "part"]).withColumn("below", F.col("before") + F.col("inside"))
    won = F.col("pos") * (F.col("below") + F.col("neg") / 2)
    return below.groupBy("fold").agg((F.sum(won) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0).cast("long"))).alias("auc"))


def confusion(rows: DataFrame, truth: str, score: str, threshold: float) -> DataFrame:
    """Counts of truth (0 or 1) against score at a threshold (inclusive)."""
    return rows.groupBy(F.col(truth).alias("truth"), (F.col(score) >= threshold).cast("int").alias("prediction")).agg(F.count("*").alias("n"))


def corrected_t(folds: DataFrame, ratio: float, *more: Column) -> DataFrame:
    """Paired t statistic of columns a and b over folds, with the variance corrected for training sets that overlap
    (``ratio``: test rows over training rows), null if they do not vary; ``more``: further aggregates."""
    diff = F.col("a") - F.col("b")
    return folds.agg(F.count("*").alias("folds"), F.avg(diff).alias("mean"), (F.avg(diff) / F.nullif(F.sqrt((1 / F.count("*") + F.lit(ratio)) * F.var_samp(diff)), F.lit(0.0))).alias("t"), *more)
