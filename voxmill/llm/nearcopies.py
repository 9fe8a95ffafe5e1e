"""Near copies by the Jaccard similarity of word shingles: SimHash fingerprints, indexed under deletion variants of their
segments and joined by equality, give candidates; bit counts thin them out and the shingles decide."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, drained, id_filter, maybe_in, row_key, shuffles_removed, text_key, text_slices, written
from .graph import connected_components
from .simhash import keep_first

#: Rows link when 10 J >= TENTHS.
SHINGLE, TENTHS = 5, 8
#: The share of bits in which fingerprints of two sets of J = 0.8 differ (equal sizes, the worst case), and with what probability
#: such a pair may share no key.
DIFFER, MISS = math.acos(2 * 0.8 / 1.8) / math.pi, 5e-4
#: A segment has so many blocks; a variant keeps two of them and deletes the others.
BLOCKS = 4
_KEPT = list(itertools.combinations(range(BLOCKS), 2))
#: Bits of a node's sketch (two longs), and in how many of them candidates may differ. Two sets of J = 0.8 differ
#: in 19.4 on average (sd 4.1), unlike ones in 64 (sd 5.7). The first long goes with each key, with a bound of its own.
SKETCH, SKETCH_MOST, FIRST_MOST = 128, 40, 24
#: Segments whose keys are shuffled at once, at most: what lies on disk at a time grows with the rows, not with the number of segments.
ROUND = 16
#: Members of a key that are joined with each other as rows; of more, tasks compare blocks of CELL_BLOCK.
CELL, CELL_BLOCK = 8, 1024
#: Shingles of a block: a task compares one block with itself or with another.
BLOCK = 1 << 19
_FLIP = np.random.default_rng(8).integers(0, 1 << 64, 1024, np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    return np.unique(np.array([h(joined[a:b]) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def plan(rows: int) -> tuple[int, int]:
    """(bits of a block, segments) for so many rows: keys of two blocks tell them apart, and a pair of J = 0.8 misses all
    variants of all segments with a probability of MISS at most. Both grow with the logarithm and a small power of ``rows``."""
    width = max(8, math.ceil((math.log2(max(rows, 2)) + 2) / 2))
    good = (1 - DIFFER) ** width
    hit = 1 - (1 - good) ** BLOCKS - BLOCKS * good * (1 - good) ** (BLOCKS - 1)
    return width, math.ceil(math.log(MISS) / math.log1p(-hit))


def fingerprint(found: np.ndarray, words: int) -> bytes:
    """SimHash of 64 x ``words`` bits over a set of shingles: a bit is 1 if it is set in over half the hashes."""
    counts = np.zeros(64 * words, np.int64)
    for i in range(0, len(found), 255):  # counts of up to 255 rows fit in bytes
        x = (found[i : i + 255, None] ^ _FLIP[:words]) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        counts += np.unpackbits((x ^ (x >> np.uint64(29))).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(found)).tobytes()


def _set_hash(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def _small_keys(found: np.ndarray) -> list[int]:
    """Sets of 4 and 5 shingles are too small for a bound on bits: they meet under the smaller set itself."""
    if len(found) == 5:
        return [_set_hash(np.delete(found, i)) for i in range(5)]
    return [_set_hash(found)] if len(found) == 4 else []


def _prints(words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each row: its node (a hash of its set of shingles), the size of the set, its fingerprint and keys of small sets."""
        for batch in drained(batches):
            for a, b, texts in text_slices(batch.column(3), 1 << 22):
                sets = [shingles(t) for t in texts]
                own = pa.array([_set_hash(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32())
                prints = pa.array([fingerprint(x, words) for x in sets], pa.binary()), pa.array([_small_keys(x) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), *own, *prints], ["doc_id", "text_key", "id", "node", "n", "fp", "small"])

    return of


def _matrix(prints: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(len(prints), -1)


def _keys(width: int, first: int, last: int):
    powers = (1 << np.arange(width)[::-1]).astype(np.float32)
    start, stop = (SKETCH + i * BLOCKS * width for i in (first, last))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, node, root, s0: half the sketch) under each variant of the segments ``first`` to ``last`` of each fingerprint (node,
        fp, small, root); the first segment brings the keys of small sets."""
        for batch in drained(batches):
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                prints, nodes, roots = _matrix(part.column(1)), part.column(0).to_numpy(), part.column(3).to_numpy()
                sketch = np.ascontiguousarray(prints[:, :8]).view(np.int64).ravel()
                bits = np.unpackbits(prints[:, start // 8 : -(-stop // 8)], axis=1)[:, start % 8 :][:, : stop - start]
                value = (bits.reshape(len(nodes), last - first, BLOCKS, width).astype(np.float32) @ powers).astype(np.int64)
                base = np.arange(first, last) * len(_KEPT)
                keys = [(base + k << 2 * width) | (value[:, :, i] << width) | value[:, :, j] for k, (i, j) in enumerate(_KEPT)]
                keys = np.concatenate(keys, axis=1)
                rows, keys = np.repeat(np.arange(len(nodes)), keys.shape[1]), keys.ravel()
                if not first:
                    more = np.array([len(x) for x in part.column(2).to_pylist()], np.int64)
                    rows = np.concatenate([rows, np.repeat(np.arange(len(nodes)), more)])
                    keys = np.concatenate([keys, part.column(2).flatten().to_numpy()])
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(x[rows]) for x in (nodes, roots, sketch))], ["key", "node", "root", "s0"])

    return of


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in drained(batches):
        sketch = np.ascontiguousarray(_matrix(batch.column(1))[:, : SKETCH // 8]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(sketch[:, i].copy()) for i in range(2))], ["node", "s0", "s1"])


def _alike(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges that span the groups of nodes of a key whose sketches are near; of two blocks, those between the two. Two roots that
    are one already need no edge, and two others one alone."""
    pdf = pdf.sort_values("node", ignore_index=True)
    nodes, sketch, roots = pdf["node"].to_numpy(), pdf[["s0", "s1"]].to_numpy(), pdf["root"].to_numpy()
    side = None if key[1] == key[2] else (pdf["block"] == key[2]).to_numpy()
    left, edges = np.full(len(nodes), len(np.unique(roots)) > 1), {}
    for i in range(len(nodes)):
        stack = [i] if left[i] else []
        left[i] = False
        while stack and left.any():
            j = stack.pop()
            near = left & (np.bitwise_count((sketch ^ sketch[j]).view(np.uint64)).sum(axis=1) <= SKETCH_MOST)
            if side is not None:
                near &= side != side[j]
            for k in np.flatnonzero(near).tolist():
                edges.setdefault((roots[j], roots[k]), (j, k))
                stack.append(k)
            left &= ~near
    ends = np.array([e for (a, b), e in edges.items() if a != b], np.int64).reshape(-1, 2)
    return pd.DataFrame({"u": nodes[ends[:, 0]], "uroot": roots[ends[:, 0]], "v": nodes[ends[:, 1]], "vroot": roots[ends[:, 1]]})


def candidates(distinct: DataFrame, width: int, segments: int) -> DataFrame:
    """Edges (u, v) between nodes (node, n, fp, small) that share a key and whose sketches are near; they span the groups of each key.

    The first segment's keys tie each node to the smallest one of its key where the two are near, and so most of a large group of
    near copies together. All segments then go in rounds of ROUND; keys whose nodes are tied already are left out there, others
    give one edge for two groups left apart, and none inside a group: edges grow with the nodes, not with nodes x keys.
    """
    distinct = distinct.where("n > 0")
    sketches = written(distinct.select("node", "fp").mapInArrow(_sketches, "node long, s0 long, s1 long"), "sketches")
    start = written(_tied(_indexed(distinct.withColumn("root", F.col("node")), width, 0, 1), sketches), "tied")
    roots = written(connected_components(start), "roots")
    root = F.coalesce("root", "node").alias("root")
    rooted = written(sketches.join(roots, "node", "left").select("node", "s0", "s1", root), "sketches")
    known = written(distinct.join(roots, "node", "left").select("node", "fp", "small", root), "rooted")
    found = [_meet(known, rooted, width, int(part[0]), int(part[-1]) + 1) for part in np.array_split(np.arange(segments), -(-segments // ROUND))]
    found = functools.reduce(DataFrame.union, found)
    discard(sketches, known)
    pair = F.least("uroot", "vroot").alias("a"), F.greatest("uroot", "vroot").alias("b")
    found = found.groupBy(*pair).agg(F.min(F.struct("u", "v")).alias("edge")).select("edge.u", "edge.v")
    return start.union(found)


def _indexed(distinct: DataFrame, width: int, first: int, last: int) -> DataFrame:
    return distinct.select("node", "fp", "small", "root").mapInArrow(_keys(width, first, last), "key long, node long, root long, s0 long")


def _near(x0, x1):
    return F.bit_count(x0) + F.bit_count(x1) <= SKETCH_MOST


def _tied(indexed: DataFrame, sketches: DataFrame) -> DataFrame:
    """Edges (u, v) from the nodes of each key to its smallest, where their sketches are near: one row a node and key at most."""
    least = indexed.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("u")).where("m > 1").drop("m")
    edges = indexed.select("key", F.col("node").alias("v")).join(least, "key").where("u <> v").select("u", "v").distinct()
    for x in "uv":
        edges = edges.join(sketches.select(*(F.col(c).alias(x + c) for c in ("node", "s0", "s1"))), F.col(x) == F.col(f"{x}node"))
    return edges.where(_near(F.col("us0").bitwiseXOR(F.col("vs0")), F.col("us1").bitwiseXOR(F.col("vs1")))).select("u", "v")


def _meet(distinct: DataFrame, sketches: DataFrame, width: int, first: int, last: int) -> DataFrame:
    """Edges (u, uroot, v, vroot) by the keys of the segments ``first`` to ``last`` between near nodes of different roots (node, s0,
    s1, root).

    A key whose nodes have one root gives none, and two nodes of a key are told apart in place by the XOR of half their sketches.
    Of what is left, up to CELL members are joined with each other, and more of them compared in blocks (``_blocks``), which give spanning edges.
    """
    indexed = _indexed(distinct, width, first, last)
    # Hardly a key has two rows in a task, so rows are not summed before they move.
    cells = indexed.select("key", "root", "s0").repartition("key").groupBy("key")
    cells = cells.agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor("s0").alias("x0"))
    busy = cells.where("low <> high").where((F.col("m") > 2) | (F.bit_count("x0") <= FIRST_MOST))
    busy = written(busy.select(F.col("key").alias("id"), "m"), "cells")
    members = maybe_in(indexed.select(F.col("key").alias("id"), "node"), id_filter(busy)).where("maybe").join(busy, "id")
    members = written(members.join(sketches, "node").select(F.col("id").alias("key"), "node", "s0", "s1", "root", "m"), "members")

    few, other = (members.where(F.col("m") <= CELL).select("key", *(F.col(c).alias(x + c) for c in ("node", "s0", "s1", "root"))) for x in "uv")
    few = few.join(other, "key").where("unode < vnode and uroot <> vroot")
    few = few.where(_near(F.col("us0").bitwiseXOR(F.col("vs0")), F.col("us1").bitwiseXOR(F.col("vs1"))))
    many = _blocks(members.where(F.col("m") > CELL)).groupBy("key", "low", "high").applyInPandas(_alike, "u long, uroot long, v long, vroot long")
    found = written(few.select(F.col("unode").alias("u"), "uroot", F.col("vnode").alias("v"), "vroot").union(many), "candidates")
    discard(busy, members)
    return found


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` (key, node, s0, s1, root) in blocks of CELL_BLOCK, under each two blocks (low, high) that are to be compared.

    A key's most frequent root makes blocks of its own, whose nodes meet those of the other roots, not each other. So a large
    group that is tied already goes out once for each block of others, commonly one.
    """
    main = members.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("m"))
    main = main.select("key", F.col("main.root").alias("main"), *(F.ceil(x / CELL_BLOCK).cast("int").alias(c) for x, c in ((F.col("main.c"), "mains"), (F.col("m") - F.col("main.c"), "others"))))
    dealt = members.select("key", "node", "s0", "s1", "root").join(main, "key")
    columns, place = ("key", "node", "s0", "s1", "root"), F.xxhash64("node")
    largest = dealt.where("root = main").select(*columns, F.pmod(place, F.col("mains")).cast("int").alias("block"), F.col("mains").alias("start"), "mains", "others")
    rest = dealt.where("root <> main").select(*columns, (F.col("mains") + F.pmod(place, F.col("others"))).cast("int").alias("block"), F.lit(0).alias("start"), "mains", "others")
    to = F.sequence("start", F.col("mains") + F.col("others") - 1)
    sent = largest.where("others = 1").withColumn("other", F.col("mains")).unionByName(largest.where("others > 1").unionByName(rest).withColumn("other", F.explode(to)))
    return sent.select(*columns, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in drained(batches):
        for a, b, texts in text_slices(batch.column(4), 1 << 22):
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(4)), pa.array([shingles(t).tobytes() for t in texts], pa.binary())], ["root", "node", "blocks", "block", "found"])


def _forest(sets: list[np.ndarray], side: np.ndarray | None) -> list[tuple[int, int]]:
    """Edges (as places) that span the groups linked by similarity; with ``side``, by links between the two sides."""
    sizes = np.array([len(x) for x in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    left, edges = np.ones(len(sets), bool), []
    for i in range(len(sets)):
        if not left[i]:
            continue
        left[i], stack = False, [i]
        while stack:
            j = stack.pop()
            open_ = left if side is None else left & (side != side[j])
            if not open_.any():
                continue
            a, b = np.searchsorted(values, sets[j], "left"), np.searchsorted(values, sets[j], "right")
            at = np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a) + np.arange((b - a).sum())
            both = np.bincount(owner[at], minlength=len(sets))
            near = open_ & ((10 + TENTHS) * both >= TENTHS * (sizes + sizes[j]))
            for k in np.flatnonzero(near).tolist():
                edges.append((j, k))
                stack.append(k)
            left &= ~near
    return edges


def _span(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node", ignore_index=True)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["found"]]
    edges = _forest(sets, None if key[1] == key[2] else (pdf["block"] == key[2]).to_numpy())
    nodes, ends = pdf["node"].to_numpy(), np.array(edges, np.int64).reshape(-1, 2)
    return pd.DataFrame({"u": nodes[ends[:, 0]], "v": nodes[ends[:, 1]]})


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, root (the group) of each row of ``docs`` (doc_id, text): the components of the pairs of rows
    whose sets of shingles have a Jaccard similarity of TENTHS / 10 or more.

    Rows of one set are one node. Nodes of near fingerprints that share a key are candidates (``candidates``); each component of
    candidates is compared in full, by the sets, in blocks of about BLOCK shingles. So no link is wrong, and one is missed only
    where neither a key nor a chain of candidates ties the two (``plan`` bounds that).
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("text_key"), row_key().alias("id"), text.alias("text"))
    with shuffles_removed(docs.sparkSession):
        return _grouped(rows, *plan(docs.count()))


def _grouped(rows: DataFrame, width: int, segments: int) -> DataFrame:
    """``near_copies`` of rows (doc_id, text_key, id, text)."""
    words = -(-(SKETCH + segments * BLOCKS * width) // 64)
    prints = written(rows.mapInArrow(_prints(words), "doc_id long, text_key long, id long, node long, n int, fp binary, small array<long>"), "prints")
    distinct = written(prints.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("small").alias("small")), "distinct")
    nodes = written(prints.select("doc_id", "text_key", "node"), "nodes")
    discard(prints)
    maybe = written(connected_components(candidates(distinct, width, segments)), "maybe")

    members = distinct.select("node", "id", "n").join(maybe, "node")
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    members = written(members.join(blocks, "root").select("root", "node", "id", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "members")
    # Rows alike in doc_id and text share an id: one of them is enough.
    wanted = maybe_in(rows.select("id", "text"), id_filter(members)).where("maybe").select("id", "text").dropDuplicates(["id"])
    sets = wanted.join(members, "id").select("root", "node", "blocks", "block", "text").mapInArrow(_sets, "root long, node long, blocks int, block int, found binary")
    sets = sets.select("root", "node", "block", "found", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sets = sets.select("root", "node", "block", "found", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    edges = written(sets.groupBy("root", "low", "high").applyInPandas(_span, "u long, v long"), "links")
    roots = written(connected_components(edges), "roots")
    discard(distinct)
    return nodes.join(roots, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of ``near_copies``, as ``simhash.keep_one`` picks it."""
    return keep_first(docs, near_copies(docs))
