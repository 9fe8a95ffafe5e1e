"""Substring dedup by recompression: words under windows that a document with a smaller doc_id has too are removed.

Documents become sequences of symbols that equal passages share; Spark rounds name pairs of symbols over all documents and
keep the names that several documents have, until those reveal which windows can be repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import discard, drained, id_filter, maybe_in, table, text_key, text_slices, written
from .recompress import Words, contained, index, mix, whole_windows, window_hashes

#: Bytes of text that are handled at once in a task.
AT_ONCE = 800_000


def _words(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    for a, b, texts in text_slices(batch.column(column), AT_ONCE):
        yield a, b, [(t or "").encode().split() for t in texts]


#: Spark rounds of pairing at most; symbols have 8 words or more, so few pairs of pairs fit in a window.
ROUNDS = 6


def _symbols(window: int):
    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lowest symbols of each document with the words that fix each."""
        for batch in drained(batches):
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, split in _words(batch, 2):
                words = Words.of(split)
                name, left, right = index(words, window)
                doc = np.searchsorted(words.last, left, side="right")
                first = words.first[doc]
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(ids[a:b][doc], pa.int64()), pa.array(keys[a:b][doc], pa.int64()), pa.array((left - first).astype(np.int32)), pa.array((right - first).astype(np.int32))], ["name", "id", "text_key", "left", "right"])

    return symbols


def _lists(column) -> list[np.ndarray]:
    """A list column as one array per row; null is empty."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _candidates(window: int):
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows that hold no symbol of a single document, each with two hashes of its words."""
        for batch in drained(batches):
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            shared, copied, alone = (_lists(batch.column(i)) for i in (3, 4, 5))
            for a, b, split in _words(batch, 2):
                split = [[] if keys[i] in copied[i] else own for i, own in zip(range(a, b), split, strict=True)]
                words = Words.of(split)
                name, left, right = index(words, window)
                doc = np.searchsorted(words.last, left, side="right")
                # (document, name) pairs against the shared ones of each document
                own = np.concatenate([mix(shared[i].view(np.uint64)) + np.uint64(i - a) for i in range(a, b)]) if b > a else np.zeros(0, np.uint64)
                single = ~np.isin(mix(name) + doc.astype(np.uint64), own)
                # Ranges of higher symbols that no other document has.
                high = [(alone[i] >> 32) + words.first[i - a] for i in range(a, b) if len(split[i - a])]
                ends = [(alone[i] & 0x7FFFFFFF) + words.first[i - a] for i in range(a, b) if len(split[i - a])]
                left, right = np.concatenate([left[single], *high]), np.concatenate([right[single], *ends])
                ok = whole_windows(words, window) & ~contained(left, right, window, len(words.hashes))
                at = np.flatnonzero(ok)
                doc = np.searchsorted(words.last, at, side="right")
                h = window_hashes(words.hashes, window)[at]
                check = window_hashes(mix(words.hashes), window)[at]
                place = (at - words.first[doc]) | ((keys[a:b][doc] & 0x7FFFFFFF) << 32)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(check.view(np.int64)), pa.array(ids[a:b][doc], pa.int64()), pa.array(place)], ["h", "check", "id", "place"])

    return candidates


def _kept(window: int, inside: int | None):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``inside``: the text's place in the row; None if it has a column of its own."""
        for batch in drained(batches):
            row, keys, places, copied = batch.column(4), batch.column(1).to_numpy(), _lists(batch.column(2)), _lists(batch.column(3))
            for a, b, texts in text_slices(batch.column(5) if inside is None else row.field(inside), AT_ONCE):
                totals, removed, out = [], [], []
                for key, text, place, copies in zip(keys[a:b], texts, places[a:b], copied[a:b], strict=True):
                    words = (text or "").encode().split()
                    if len(words) >= window and key in copies:
                        left = []
                    elif len(own := place[(place >> 32) == (key & 0x7FFFFFFF)] & 0xFFFFFFFF):
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, own, 1)
                        np.add.at(change, own + window, -1)
                        left = [w for w, c in zip(words, np.cumsum(change).tolist(), strict=False) if not c]
                    else:
                        left = words
                    totals.append(len(words))
                    removed.append(len(words) - len(left))
                    out.append(b" ".join(left).decode())
                same = [batch.column(i).slice(a, b - a) for i in (0, 1, 4)]
                yield pa.RecordBatch.from_arrays([*same[:2], pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string()), same[2]], ["id", "text_key", "n_words", "n_removed", "kept", "row"])

    return kept


def _shared(symbols: DataFrame) -> DataFrame:
    """``symbols`` with ``shared``: true where two documents or more have the name, else null. The table of names is one
    aggregate, joined back."""
    names = symbols.groupBy("name").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("name", F.lit(True).alias("shared"))
    return symbols.join(written(names, "names"), "name", "left")


def named_rounds(items: DataFrame, window: int) -> tuple[DataFrame, list[DataFrame]]:
    """(id, text_key, left, right) of the symbols above ``items`` that one document alone has, and the written tables.

    Each round names the pairs of symbols that follow each other in a document and fit in a window, as (name, name,
    distance): the words of a pair's range fix both. Pairs that two documents have are the symbols of the next round. A
    round's join marks both kinds, so the lone ones need no join of their own.
    """
    follow = W.partitionBy("id", "text_key").orderBy("left", "right", "name")
    single, tables, made = None, [], ["id", "text_key", "left", "right"]
    for _ in range(ROUNDS):
        ahead = items.select("*", *(F.lead(c).over(follow).alias(f"next_{c}") for c in ("left", "right", "name"))).where("next_name is not null")
        left, right = F.least("left", "next_left"), F.greatest("right", "next_right")
        pairs = ahead.where(right - left <= window).select("id", "text_key", left.alias("left"), right.alias("right"), F.xxhash64("name", "next_name", F.col("next_left") - F.col("left")).alias("name"))
        pairs = written(pairs, "pairs")
        tables.append(pairs)
        if not pairs.limit(1).count():
            break
        marked = written(_shared(pairs), "marked")
        tables.append(marked)
        items = marked.where("shared").select(*made, "name")
        lone = marked.where("shared is null").select(*made)
        single = lone if single is None else single.union(lone)
    return pairs.select(*made).limit(0) if single is None else single, tables


def remove_repeats(docs: DataFrame, window: int = 50, whole: bool = True) -> DataFrame:
    """id (the doc_id), text_key, n_words, n_removed, kept (the kept words, one space between) and row (a struct of all
    input columns) for each row of ``docs``, which needs doc_id and text.

    A word goes if a window of ``window`` consecutive words that covers it also starts in a document with a smaller
    doc_id; all windows are judged on the input. Words are what ASCII white space divides.

    (Tables of firsts are written before they are joined back: a join of two plain shuffles is one whose hot keys Spark
    can split.)

    How: documents are recompressed. Runs of words and pairs up to 8 words are named inside a task, by hashes that are the
    same everywhere; from there on a round is a Spark job (``named_rounds``): neighbouring symbols become a pair, pairs are
    named over all documents, and the names that one document alone has are ruled out. A symbol without a second document
    proves that no window around it is repeated; what windows are left (few beside the true repeats) are settled by 128 bits
    of two independent hashes of their words. Whole copies of a text are settled by its SHA-256 before.

    Null text has no words. A null doc_id is neither smaller nor larger than any: such rows come back whole. Rows that
    repeat a doc_id count as the same document for "smaller" and are cleaned each for itself. A very long text is whole in
    one task. Input columns of any names come back inside ``row``. An empty table gives no rows.

    Without ``whole``, rows that surely keep every word come back with n_removed 0, and null n_words and kept: their texts
    do not go through Python.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_key(text).alias("text_key"), text.alias("text"), F.struct(*docs.columns).alias("row"))
    texts = rows.where("id is not null and text is not null").select("id", "text_key", "text")
    empty = F.array().cast("array<long>")

    digests = written(texts.select("id", "text_key", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    least = written(digests.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most"), "firsts")
    copies = digests.join(least, "digest").where("id > least").groupBy("id").agg(F.collect_set("text_key").alias("copied"))
    copies = written(copies, "copies")

    key = ["id", "text_key"]
    symbols = written(texts.mapInArrow(_symbols(window), "name long, id long, text_key long, left int, right int"), "symbols")
    items = written(_shared(symbols).where("shared").select("id", "text_key", "left", "right", "name"), "items")
    # Of rows alike in both keys one is enough. The distinct reads the written table: right above the join it would use the
    # join's partitions, and Spark could not split a name that very many documents have.
    alone, tables = named_rounds(items.distinct(), window)
    lists = items.groupBy(*key).agg(F.collect_set("name").alias("shared"))
    dead = alone.groupBy(*key).agg(F.collect_set(F.shiftleft(F.col("left").cast("long"), 32).bitwiseOR(F.col("right").cast("long"))).alias("alone"))
    lists = lists.join(dead, key, "left").select(*key, "shared", F.coalesce("alone", empty).alias("alone"))
    lists = written(lists.join(copies, "id", "left").select(*key, "shared", "alone", F.coalesce("copied", empty).alias("copied")), "shared")

    known = lists.select(F.xxhash64(*key).alias("id")).distinct()
    suspects = maybe_in(texts.withColumnRenamed("id", "doc").withColumn("id", F.xxhash64("doc", "text_key")), id_filter(known)).where("maybe").drop("id").withColumnRenamed("doc", "id")
    suspects = suspects.join(lists, key).select("id", "text_key", "text", "shared", "copied", "alone")
    windows = written(suspects.mapInArrow(_candidates(window), "h long, check long, id long, place long"), "windows")
    discard(symbols, items, *tables)
    least = written(windows.groupBy("h", "check").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most"), "firsts")
    repeated = windows.join(least, ["h", "check"]).where("id > least").select("id", "place")
    places = repeated.groupBy("id").agg(F.collect_list("place").alias("places"))
    cuts = written(places.join(copies, "id", "full").select("id", F.coalesce("places", empty).alias("places"), F.coalesce("copied", empty).alias("copied")), "cuts")
    discard(digests, copies, lists, windows)

    # A text goes out once, in its row, if it is a string there.
    string = docs.schema["text"].dataType.typeName() == "string"
    split, own = maybe_in(rows, id_filter(cuts)), [] if string else ["text"]
    same = split.where("not maybe")
    cut = split.where("maybe").join(cuts, "id", "left").select("id", "text_key", F.coalesce("places", empty).alias("places"), F.coalesce("copied", empty).alias("copied"), "row", *own)
    if whole:
        cut = same.select("id", "text_key", empty.alias("places"), empty.alias("copied"), "row", *own).union(cut)
    kind = next(f.dataType for f in rows.schema if f.name == "row").simpleString()
    found = cut.mapInArrow(_kept(window, docs.columns.index("text") if string else None), f"id long, text_key long, n_words long, n_removed long, kept string, row {kind}")
    if whole:
        return found
    none = F.lit(None)
    return same.select("id", "text_key", none.cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), none.cast("string").alias("kept"), "row").union(found)


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    """Words removed from every document, and a digest of what is kept; see ``remove_repeats``."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
