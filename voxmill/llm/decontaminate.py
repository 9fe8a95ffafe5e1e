"""Benchmark decontamination by winnowing, with DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import ascii_lower, table, text_key, written

#: What divides words once A-Z are lower-cased: all of ASCII but digits and small letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a k-gram. In a window of w words, the least of its w - KGRAM + 1 k-gram hashes is its fingerprint.
KGRAM = 4
#: Benchmark windows broadcast at once, in bytes of text; a larger benchmark is matched in several passes.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _fingerprint(hashes: Column, at: Column, size: int) -> Column:
    """The least k-gram hash of the window of ``size`` words from ``at`` (0-based)."""
    k = min(KGRAM, size)
    word = [F.get(hashes, at + j) for j in range(size)]
    grams = [F.xxhash64(*word[j : j + k]) for j in range(size - k + 1)]
    return F.least(*grams) if len(grams) > 1 else grams[0]


def _windows(texts: DataFrame, size: int, *columns: str) -> DataFrame:
    """Every window of ``size`` words: the columns named, words, at, fingerprint."""
    split = texts.where(F.size("words") >= size).select(*columns, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    placed = split.select(*columns, "words", "hashes", F.explode(F.sequence(F.lit(0), F.size("hashes") - size)).alias("at"))
    return placed.select(*columns, "words", "at", _fingerprint(F.col("hashes"), F.col("at"), size).alias("fingerprint"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, at, size, passage) of each occurrence in ``docs``, and (passage, item_id).

    Each benchmark window's fingerprint (its least k-gram hash, as winnowing keeps it) is joined to the fingerprints of
    the documents' windows; a match is extended to all its words before it counts. As equal windows have equal
    fingerprints, every shared span of ``window`` words is found. The benchmark's windows are broadcast in blocks of
    BROADCAST_BYTES at most; documents are never shuffled.
    """
    items = benchmark.select(F.col("item_id"), words(F.col("text").cast("string")).alias("words")).where("item_id is not null and size(words) > 0")
    sizes = [r.size for r in items.select(F.least(F.size("words"), F.lit(window)).alias("size")).distinct().collect()]  # at most ``window`` values
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"), words(F.col("text")).alias("words"))
    found, named = None, None
    for size in sorted(sizes, reverse=True):
        of_size = items if size == window else items.where(F.size("words") == size)
        cut = _windows(of_size, size, "item_id").select("item_id", "fingerprint", F.slice("words", F.col("at") + 1, size).alias("span"))
        cut = written(cut.withColumn("passage", F.sha2(F.array_join("span", " "), 256)), "windows")
        distinct = cut.select("passage", "fingerprint", "span").dropDuplicates(["passage"])
        total = distinct.agg(F.coalesce(F.sum(F.octet_length(F.array_join("span", " ")) + 64), F.lit(0))).first()[0]
        blocks = max(1, math.ceil(total / BROADCAST_BYTES))
        for block in range(blocks):
            part = distinct.where(F.pmod("fingerprint", F.lit(blocks)) == block) if blocks > 1 else distinct
            own = _windows(split, size, "doc_id", "text_key").alias("d").join(F.broadcast(part.alias("b")), "fingerprint").where(F.slice("words", F.col("at") + 1, size) == F.col("span"))
            own = own.select("doc_id", "text_key", "at", F.lit(size).alias("size"), "passage")
            found = own if found is None else found.union(own)
        own = cut.select("passage", "item_id").distinct()
        named = own if named is None else named.union(own)
    if found is None:
        spark = docs.sparkSession
        found = spark.createDataFrame([], "doc_id long, text_key long, at int, size int, passage string")
        named = benchmark.select(F.lit("").alias("passage"), "item_id").limit(0)
    return found, named


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items (sorted array of item_ids as strings), contaminated, for each row of ``docs``.

    A document word is hit if it lies in an occurrence of ``window`` consecutive words of a benchmark item, or of a
    whole item that has fewer words. Words are lower-cased (A-Z) runs of digits, letters and all non-ASCII characters.
    Null texts have no words; items of null text, without words or with a null id match nothing. Repeated rows and
    repeated or null doc_ids are judged row by row on their own text. Other columns are ignored; an empty table gives
    no rows, an empty benchmark no hits.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, named = hits(docs, benchmark, window)
    found, named = written(found.distinct(), "hits"), written(named, "named")

    key = ["doc_id", "text_key"]
    before = F.max(F.col("at") + F.col("size")).over(W.partitionBy(*key).orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    spans = found.groupBy(*key, "at").agg(F.max("size").alias("size"))
    counted = spans.withColumn("before", before).groupBy(*key).agg(F.sum(F.greatest(F.lit(0), F.col("at") + F.col("size") - F.greatest("at", F.coalesce("before", F.lit(0))))).alias("n_hit"))
    items = found.select(*key, "passage").distinct().join(named, "passage").groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hit = counted.alias("c").join(items.alias("i"), F.expr("c.doc_id <=> i.doc_id and c.text_key = i.text_key")).select("c.doc_id", "c.text_key", "n_hit", "items")

    rows = docs.select("doc_id", text_key("text").alias("text_key"), F.coalesce(F.size(words(F.col("text"))), F.lit(0)).cast("long").alias("n_words"))
    rows = rows.withColumn("n_words", F.greatest("n_words", F.lit(0)))
    joined = rows.alias("r").join(hit.alias("h"), F.expr("r.doc_id <=> h.doc_id and r.text_key = h.text_key"), "left")
    return joined.select("r.doc_id", "r.text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark words of every document; see ``contamination``."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, list_slice(w, i, i + least(len(w), 10) - 1) AS span
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS span
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
hits AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.span = bw.span),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
