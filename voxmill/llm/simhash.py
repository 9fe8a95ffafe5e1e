"""SimHash near-duplicates: deletion-variant signatures, equality join, verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drained, id_filter, maybe_in, row_key, table, text_key, written
from .graph import connected_components

#: Fingerprints that one task compares with each other (or with as many of another block).
BLOCK = 1024


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over the word shingles of ``text``; a bit is 1 if it is set in over half the hashes."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space alone
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([h(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts[: 1 - shingle].tolist() if shingle > 1 else starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255):  # counts of up to 255 rows fit in bytes
        counts += np.unpackbits(hashes[i : i + 255].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_key, fp (the fingerprint as a signed long) of each row of ``docs`` (doc_id, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in drained(batches):
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "text_key", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text_key(text).alias("text_key"), text).mapInArrow(of, "doc_id long, text_key long, fp long")


def variant_keys(fp, segments: int = 2):
    """Array of keys of a 64-bit fingerprint: for each segment, the segment with one of its bits blanked.

    A key holds the segment's number, the blanked bit and the other bits, so equal keys mean equal variants. Two
    fingerprints that differ in under ``2 * segments`` bits have a segment that differs in one bit at most, and so
    share a key.
    """
    width = 64 // segments
    keys = []
    for s in range(segments):
        part = F.shiftrightunsigned(fp, width * s).bitwiseAND(F.lit((1 << width) - 1)) if s or width < 64 else fp
        keys += [part.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << b))).bitwiseOR(F.lit((s * width + b) << width)) for b in range(width)]
    return F.array(*keys)


def _forest(a: np.ndarray, b: np.ndarray | None, most: int) -> list[tuple[int, int]]:
    """Edges that span the linked groups among ``a``, or of the links between ``a`` and ``b``."""
    whole = a if b is None else np.concatenate([a, b])
    side = np.zeros(len(whole), bool)
    side[len(a) :] = True
    left, edges = np.ones(len(whole), bool), []
    for i in range(len(whole)):
        if not left[i]:
            continue
        left[i], stack = False, [i]
        while stack:
            j = stack.pop()
            near = left & (np.bitwise_count(whole ^ whole[j]) <= most)
            if b is not None:
                near &= side != side[j]
            for k in np.flatnonzero(near).tolist():
                edges.append((int(whole[i]), int(whole[k])))
                stack.append(k)
            left &= ~near
    return edges


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that span every group linked by ``most`` or fewer differing bits.

    Each distinct fingerprint is indexed under its one-wildcard segment variants. A key of two fingerprints is verified
    in place by XOR and bit count; of a key with more, the members are cut into blocks and each pair of blocks is
    compared in a group of its own, which returns a spanning forest of its links, not all its pairs.
    """
    segments = most // 2 + 1
    indexed = fps.select("fp", F.explode(variant_keys(F.col("fp"), segments)).alias("key"))
    sizes = indexed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    sizes = written(sizes, "keys")
    pairs = sizes.where("n = 2").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most).select("u", "v")

    busy = sizes.where("n > 2").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = indexed.join(busy, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    members = members.select("key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.select("key", "fp", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def span(key, pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(pdf["fp"].to_numpy()[(pdf["block"] == key[1]).to_numpy()]).view(np.uint64)
        other = None if key[1] == key[2] else np.sort(pdf["fp"].to_numpy()[(pdf["block"] == key[2]).to_numpy()]).view(np.uint64)
        edges = np.array(_forest(fp, other, most), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": edges[:, 0], "v": edges[:, 1]})

    return pairs.union(members.groupBy("key", "low", "high").applyInPandas(span, "u long, v long")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """doc_id, text_key, fp, root (the group), component_id of each row of ``docs`` (doc_id, text).

    Rows link when their fingerprints differ in ``most`` or fewer bits; component_id is the smallest doc_id of the
    linked group. Texts without words (null, empty, white space) have fingerprint zero and link like any other. A null
    doc_id gets the group's smallest non-null doc_id, and null if it has none. Repeated rows each come back. Copies
    collapse into one fingerprint before the index, so a large group of copies costs one entry. Very long texts are
    read whole, one at a time. Other columns are ignored; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, shingle), "prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = written(distinct, "distinct")
    roots = written(connected_components(links(distinct.select("fp"), most)), "roots")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    ids = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = written(rooted.join(ids, "root").select("fp", "root", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest doc_id (nulls last), then the smallest text key.
    Rows alike in both are one. Columns stay as they are."""
    return keep_first(docs, near_duplicates(docs, shingle, most))


def keep_first(docs: DataFrame, groups_of: DataFrame) -> DataFrame:
    """``keep_one`` for any groups: ``groups_of`` has doc_id, text_key and root of each row of ``docs``."""
    found = written(groups_of, "near")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    groups = found.groupBy("root").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("root", "first")
    groups = written(groups, "groups")
    grouped = found.join(groups, "root").select(F.xxhash64("doc_id", "text_key").alias("id"), (place == F.col("first")).alias("stays")).distinct()
    grouped = written(grouped, "grouped")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), row_key().alias("id"))
    split = maybe_in(rows, id_filter(grouped))
    judged = split.where("maybe").join(grouped, "id", "left")
    stay = split.where("not maybe").select("row").union(judged.where("stays is null").select("row"))
    return stay.union(judged.where("stays").dropDuplicates(["id"]).select("row")).select("row.*")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document; see ``near_duplicates``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
