"""Stupid-backoff scores of any documents under count tables of others, as joins of DataFrames.

``count_tables`` holds each n-gram of up to ``order`` words once, with its count and that of its history; ``backoff`` joins the
exploded n-grams of other documents to it. A word scores c(h w) / c(h) with the longest history h for which h w was counted, and ALPHA
for each word by which that is shorter than the ``order - 1`` words before it (fewer at a document's start); a word that was never
counted scores as half of one count would do without any history. ``lm.score`` is the same for documents that are themselves the
counted ones, where nothing is unseen, in less disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_key, written
from .lm import ALPHA

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a word that was never counted counts for.
UNSEEN = 0.5


def _words(text: Column) -> Column:
    """Words between ASCII white space, A-Z lowered; none of a null text."""
    split = F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(F.coalesce(split, F.array().cast("array<string>")), lambda w: w != "")


def _grams(docs: DataFrame, order: int, keep: list[str]) -> DataFrame:
    """A row for each word and each length of n-gram that ends there: ``keep``, place, most (the longest there can be), n, gram."""
    words = docs.select(*keep, _words(F.col("text").cast("string")).alias("words"))
    placed = words.select(*keep, "words", F.posexplode("words").alias("place", "word"))
    most = F.least(F.col("place") + 1, F.lit(order))
    spans = placed.select(*keep, "place", most.alias("most"), F.slice("words", F.col("place") + 2 - most, most).alias("span"))
    each = spans.select(*keep, "place", "most", "span", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("n"))
    return each.select(*keep, "place", "most", "n", F.array_join(F.slice("span", F.col("most") - F.col("n") + 1, F.col("n")), " ").alias("gram"))


def count_tables(docs: DataFrame, order: int = 3) -> DataFrame:
    """n, gram (its words joined by one space), c (its count) and h (the count of its first n - 1 words; for a word: all words),
    counted over all rows of ``docs`` (text), repeated ones each time. Null and empty texts count for nothing; an empty table
    gives no rows. Counts are summed map-side before n-grams meet by hash, so a frequent one is a row a task."""
    counts = written(_grams(docs, order, []).groupBy("n", "gram").agg(F.count("*").alias("c")), "ngrams")
    total = counts.where("n = 1").agg(F.sum("c")).first()[0] or 0
    history = F.regexp_replace("gram", " [^ ]*$", "")
    longer = counts.where("n > 1").withColumn("history", history).join(counts.where(F.col("n") < order).select(F.col("gram").alias("history"), F.col("c").alias("h")), "history")
    first = counts.where("n = 1").withColumn("h", F.lit(total).cast("long"))
    return written(first.select("n", "gram", "c", "h").union(longer.select("n", "gram", "c", "h")), "tables")


def backoff(docs: DataFrame, tables: DataFrame, order: int = 3, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, n_seen (words scored by an n-gram of two words or more) and score (mean natural log per word; null without
    words, and if the tables are empty) of each row of ``docs`` (doc_id, text) under ``count_tables`` of that order.

    Null, empty and white-space texts have no words. Repeated rows each come back; rows of one doc_id and different texts, and of
    null doc_ids, are rows of their own. Long texts are whole. Other columns are ignored; an empty table gives no rows. Each n-gram of a
    document is a row of the join; the rows of a frequent one are split by Spark's skew join (the table has one row for it).
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    rows = rows.groupBy("doc_id", "key").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    rows = written(rows.withColumn("row", F.xxhash64("doc_id", "key")), "rows")
    found = _grams(rows, order, ["row"]).join(tables.select("gram", "c", "h"), "gram", "left")
    total = tables.where("n = 1").agg(F.max("h")).first()[0]  # all words that were counted
    known = F.max(F.when(F.col("c").isNotNull(), F.struct("n", (F.col("c") / F.col("h")).alias("share"))))
    best = found.groupBy("row", "place", "most").agg(known.alias("best"))
    unseen = F.lit(UNSEEN / total if total else None).cast("double")
    gain = F.log(F.coalesce(F.col("best.share"), unseen)) + (F.col("most") - F.coalesce(F.col("best.n"), F.lit(1))) * F.log(F.lit(alpha))
    sums = best.groupBy("row").agg(F.count("*").alias("n_words"), F.count_if(F.col("best.n") > 1).alias("n_seen"), F.avg(gain).alias("score"))
    joined = rows.select("doc_id", "row", "copies").join(sums, "row", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return joined.select("doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_seen", F.lit(0)).cast("long").alias("n_seen"), "score")
