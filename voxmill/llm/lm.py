"""Stupid-backoff scores of documents under a word n-gram model counted over the same corpus.

A word after the history h scores c(h w) / c(h), with the ``order - 1`` words before it (fewer at a document's start) as h; if
c(h w) were under LEAST_COUNT it would score ALPHA times what it does after the shorter history, down to c(w) / N. Every
n-gram of the scored documents is counted and LEAST_COUNT is 1, so no word is ever left to the shorter history, and the
scores of a document's first words, c(w1) / N, c(w1 w2) / c(w1) and so on, multiply to the count of its first ``order - 1``
words / N. So the tables of the highest order and of its histories give every score; those below are counted for
documents of under ``order - 1`` words alone.

n-grams are counted exactly, by a 64-bit hash of the history and 32 bits of the word that follows it (the same history and
the same 32 bits: the same n-gram), in tables partitioned by the history's hash and joined to the documents' n-grams there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_filter, maybe_in, partitions, table, text_key, text_slices, written

ALPHA, LEAST_COUNT = 0.4, 1
#: Words of the n-grams of the query.
ORDER = 3
#: An n-gram or history that makes up one in HOT of all is counted beforehand; there can be 2 HOT of each at most.
HOT = 2000
#: Words of the corpus for each bucket of the join, which one task holds.
PER_BUCKET = 4_000_000
#: Words whose n-grams a task holds before it sends them.
AT_ONCE = 1_000_000
#: What an n-gram of a document stands for: one with a history scored before it, its first, its end (counted as a history
#: alone), and a document that is one history long.
INNER, FIRST, END, WHOLE = range(4)
#: Kinds of rows of the first counts; a document of j < order - 1 words is of kind SHORT + j.
GRAM, HISTORY, WORDS, SHORT = range(4)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, its document, its place there). Words: ASCII white space, A-Z lowered."""
    h = xxhash.xxh3_64_intdigest
    split = [(t or "").encode().lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    words = np.fromiter((h(w) for own in split for w in own), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(split)), sizes)
    return words, doc, np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def grams_of(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n words that end at each word (without meaning where the document has fewer)."""
    found = np.zeros(len(words), np.uint64)
    for k in range(n - 1, -1, -1):
        found = (found ^ np.concatenate((np.zeros(min(k, len(words)), np.uint64), words[: max(len(words) - k, 0)]))) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(32)
        found *= np.uint64(0xD6E8FEB86659FD93)
        found ^= found >> np.uint64(29)
    return found


def _items(texts: list[str | None], order: int):
    """(document, role, history, word, n-gram) of each item of the documents of ``order - 1`` words and more; words a document."""
    words, doc, place = words_of(texts)
    sizes = np.bincount(doc, minlength=len(texts))
    history, gram = grams_of(words, order - 1), grams_of(words, order)
    at = np.flatnonzero(place >= order - 1)
    last = np.flatnonzero((place == sizes[doc] - 1) & (place >= order - 2))
    role = np.concatenate((np.where(place[at] == order - 1, FIRST, INNER), np.where(place[last] == order - 2, WHOLE, END)))
    both = np.concatenate((at, last))
    return doc[both], role, np.concatenate((history[at - 1], history[last])), words[both] >> np.uint64(32), gram[both], words, doc, place, sizes


def _rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["kind", "key", "n"])


def _shorts(words: np.ndarray, place: np.ndarray, last: np.ndarray | None, order: int):
    """(kind, keys) of the n-grams of under ``order - 1`` words: all, or of documents of that length alone."""
    for j in range(1, order - 1):
        yield SHORT + j, grams_of(words, j)[place >= j - 1 if last is None else last & (place == j - 1)]


def _count(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task: its words, its own frequent n-grams and histories, and its short documents."""
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0), 6 * AT_ONCE // 4):
                _, role, history, _, gram, words, doc, place, sizes = _items(texts, order)
                yield _rows(WORDS, np.zeros(1, np.uint64), np.array([len(words)]))
                for kind, keys in ((GRAM, gram[role < END]), (HISTORY, history)):
                    keys, counts = np.unique(keys, return_counts=True)
                    often = counts >= max(2, counts.sum() // HOT)
                    yield _rows(kind, keys[often], counts[often])
                for kind, keys in _shorts(words, place, place == sizes[doc] - 1, order):
                    yield _rows(kind, *np.unique(keys, return_counts=True))

    return count


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted table, is it there)"""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return place, table[place] == keys


def _exact(order: int, hot: list[np.ndarray]):
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task: how often each frequent n-gram and history occurs, and each n-gram of short documents' lengths."""
        total = [np.zeros(len(x), np.int64) for x in hot]
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0), 6 * AT_ONCE):
                _, role, history, _, gram, words, _, place, _ = _items(texts, order)
                for k, keys in ((GRAM, gram[role < END]), (HISTORY, history)):
                    at, known = _find(hot[k], keys)
                    total[k] += np.bincount(at[known], minlength=len(hot[k]))
                for kind, keys in _shorts(words, place, None, order):
                    yield _rows(kind, *np.unique(keys, return_counts=True))
        for k in (GRAM, HISTORY):
            yield _rows(k, hot[k], total[k])

    return exact


def _settled(role, gram, history, hot: list[np.ndarray]):
    """Which items the frequent ones' counts settle, and which have a frequent history; their places in ``hot``."""
    (g, is_gram), (h, is_history) = _find(hot[GRAM], gram), _find(hot[HISTORY], history)
    return is_history & (is_gram | (role >= END)), is_history, g, h


def _base(order: int, hot: list[np.ndarray], logs: list[np.ndarray], log_n: float):
    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each document: its words, what frequent n-grams give to its score, and the n-gram that a short one is."""
        for batch in batches:
            for a, b, texts in text_slices(batch.column(2), 6 * AT_ONCE // 4):
                own, role, history, _, gram, words, doc, place, sizes = _items(texts, order)
                done, _, g, h = _settled(role, gram, history, hot)
                own, role, g, h = own[done], role[done], g[done], h[done]
                gain = np.zeros(len(own))
                gain[role < END] = logs[GRAM][g[role < END]]
                gain[role == INNER] -= logs[HISTORY][h[role == INNER]]
                gain[role == WHOLE] = logs[HISTORY][h[role == WHOLE]]
                scores = np.bincount(own, gain, minlength=b - a) - log_n * (sizes > 0)
                kinds, keys = np.zeros(b - a, np.int32), np.zeros(b - a, np.uint64)
                for j in range(1, order - 1):
                    ends = (sizes[doc] == j) & (place == j - 1)
                    kinds[doc[ends]], keys[doc[ends]] = SHORT + j, grams_of(words, j)[ends]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes), pa.array(scores), pa.array(kinds), pa.array(keys.view(np.int64))], ["doc_id", "row", "n_words", "base", "kind", "key"])

    return base


def _send(order: int, hot: list[np.ndarray], labels: np.ndarray):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Items with their documents, packed by the bucket of the history's hash (a frequent history's by the n-gram's)."""
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for a, b, texts in text_slices(batch.column(1), 6 * AT_ONCE):
                for c in range(a, b, 16_000):  # documents are numbered with 14 bits, below two for the role
                    d = min(b, c + 16_000)
                    own, role, history, word, gram, *_ = _items(texts[c - a : d - a], order)
                    done, frequent, _, _ = _settled(role, gram, history, hot)
                    left = np.flatnonzero(~done)
                    bucket = ((np.where(frequent, gram, history)[left] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % len(labels)
                    left, ends = left[np.argsort(bucket, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=len(labels)))))
                    out = []
                    for k in np.flatnonzero(np.diff(ends)).tolist():
                        part = left[ends[k] : ends[k + 1]]
                        docs, local = np.unique(own[part], return_inverse=True)
                        out.append((int(labels[k]), history[part].tobytes(), word[part].astype("<u4").tobytes(), (local << 2 | role[part]).astype("<u2").tobytes(), rows[c:d][docs].tobytes()))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["bucket", "histories", "words", "docs", "rows"])

    return send


def _join(hot: list[np.ndarray], logs: list[np.ndarray], labels: np.ndarray):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a bucket: the counts of n-grams and histories, joined to the items of each document, summed per document,
        and packed by the part that the document falls to: one row a part, not one a document."""
        found = []
        for batch in batches:
            for i in range(batch.num_rows):
                history, word, local, own = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in ((1, np.uint64), (2, "<u4"), (3, "<u2"), (4, np.int64)))
                found.append((history, word, (local & 3).astype(np.uint8), own[local >> 2]))
        if not found:
            return
        history, word, role, rows = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        order = np.lexsort((word, role >= END, history))
        history, word, role, rows = history[order], word[order], role[order], rows[order]
        new = np.concatenate(([True], history[1:] != history[:-1]))
        counts = np.diff(np.append(np.flatnonzero(new), len(new)))
        start = history[new]
        at, known = _find(hot[HISTORY], start)
        log_history = np.log(counts)
        log_history[known] = logs[HISTORY][at[known]]
        log_history = np.repeat(log_history, counts)
        new |= np.concatenate(([True], (word[1:] != word[:-1]) | ((role[1:] >= END) != (role[:-1] >= END))))
        counts = np.diff(np.append(np.flatnonzero(new), len(new)))
        gain = np.where(role < END, np.repeat(np.log(counts), counts), 0.0) - np.where(role == INNER, log_history, 0.0) + np.where(role == WHOLE, log_history, 0.0)
        docs, at = np.unique(rows, return_inverse=True)
        sums = np.bincount(at, gain, minlength=len(docs))
        part = (docs.view(np.uint64) % np.uint64(len(labels))).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(len(labels) + 1))
        out = [(int(labels[k]), *(x[order[ends[k] : ends[k + 1]]].tobytes() for x in (docs, sums))) for k in np.flatnonzero(np.diff(ends)).tolist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "docs", "gains"])

    return join


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part of the documents: the sums of all buckets."""
    found = [(np.frombuffer(d, np.int64), np.frombuffer(g, np.float64)) for batch in batches for d, g in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True)]
    if found:
        docs, at = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
        gain = np.bincount(at, np.concatenate([x[1] for x in found]))
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(gain)], ["row", "gain"])


def _labels(spark, n: int) -> np.ndarray:
    """For each of n partitions an integer that repartition(n, ...) deals to it, so that buckets fall out evenly."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    rows = spark.range(0, 40 * n + 1000, 1, 1).groupBy(place.alias("p")).agg(F.min("id").alias("label")).collect()
    return np.array(sorted(r.label for r in rows), np.int64)


def score(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, n_words, n_seen (words scored by the count of an n-gram of two words or more) and score (mean natural log
    per word; null without words) for each row of ``docs`` (doc_id, text), under a model of n-grams of ``order`` words (2 or more).

    Every word of every document is counted. Null, empty and white-space texts have no words. Repeated rows count as
    often as they occur and each come back; repeated or null doc_ids are rows of their own. Very long texts are whole;
    a task holds a slice of rows, one long text at least. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text_key(text)).alias("row"), text.alias("text"))

    shape = "kind int, key long, n long"
    counted = written(rows.select("text").mapInArrow(_count(order), shape).groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    total = counted.where(F.col("kind") == WORDS).agg(F.sum("n")).first()[0] or 0
    floor = max(2, total // HOT)
    # One this frequent is frequent in some batch; half its count is there, or more.
    few = [counted.where((F.col("kind") == k) & (F.col("n") >= floor // 2)).orderBy(F.desc("n"), "key").limit(2 * HOT).toPandas() for k in (GRAM, HISTORY)]
    hot = [np.sort(x["key"].to_numpy(np.int64).view(np.uint64)) for x in few]

    every = rows.select("text").mapInArrow(_exact(order, hot), shape).withColumn("id", F.col("key"))
    wanted = counted.where(F.col("kind") > SHORT).select(F.col("key").alias("id"))
    exact = maybe_in(every, id_filter(wanted)).where((F.col("kind") < SHORT) | F.col("maybe"))
    exact = written(exact.groupBy("kind", "key").agg(F.sum("n").alias("n")), "exact")
    logs = [np.zeros(len(x)) for x in hot]
    for r in exact.where(F.col("kind") < SHORT).toPandas().itertuples():  # 4 HOT rows at most
        logs[r.kind][np.searchsorted(hot[r.kind], np.array([r.key], np.int64).view(np.uint64))] = np.log(max(r.n, 1))
    log_n = float(np.log(max(total, 1)))

    base = rows.mapInArrow(_base(order, hot, logs, log_n), "doc_id long, row long, n_words long, base double, kind int, key long")
    base = written(base, "base")
    short = base.where(F.col("kind") > SHORT).join(exact, ["kind", "key"]).select("doc_id", "row", "n_words", (F.col("base") + F.log("n")).alias("score"))
    known = base.where(F.col("kind") == 0).select("doc_id", "row", "n_words", F.col("base").alias("score")).union(short)
    n = max(partitions(spark), -(-total // PER_BUCKET))  # a bucket holds a bounded part of the words
    labels = _labels(spark, n)
    sent = rows.select("row", "text").mapInArrow(_send(order, hot, labels), "bucket int, histories binary, words binary, docs binary, rows binary")
    summed = sent.repartition(n, "bucket").mapInArrow(_join(hot, logs, labels), "bucket int, docs binary, gains binary")
    summed = summed.repartition(n, "bucket").mapInArrow(_sum, "row long, gain double")
    # Rows that are wholly alike share a key: each takes its part of the sum.
    alike = known.groupBy("doc_id", "row").agg(F.count("*").alias("m"), F.first("n_words").alias("n_words"), F.first("score").alias("score"))
    joined = alike.join(summed, "row", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m"))))
    total = F.col("score") + F.coalesce(F.col("gain") / F.col("m"), F.lit(0.0))
    return joined.select("doc_id", "n_words", F.greatest(F.col("n_words") - 1, F.lit(0)).cast("long").alias("n_seen"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("score"))


def op7_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents under the trigram model of the same documents; see ``score``."""
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), ORDER)
