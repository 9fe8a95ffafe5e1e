"""Alignment of two tokenizers: the token streams of a text are merged in lockstep, all documents of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, drained, sub_batches, table, written
from .tokens import byte_table, encoder, piece_encoder, piece_table, vocabulary

#: Bytes of text whose streams a task merges at once.
BATCH_BYTES = 1_500_000
#: A document of more tokens is merged in several lanes, cut where both streams have a token end.
LANE_TOKENS = 1024
#: Id pairs whose counts are broadcast at once, on average; more take further rounds over the links.
ROUND_PAIRS = 1_000_000

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary"


def _lane_starts(end_a: np.ndarray, end_b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Tokens of A at which lanes start: every document's first, and in long ones the first after each LANE_TOKENS that
    follows a common end."""
    stops = np.append(first[1:], len(end_a))
    steps = (stops - first - 1) // LANE_TOKENS
    at = np.repeat(first, steps) + LANE_TOKENS * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1)
    moving = np.arange(len(at))
    while len(moving):  # up to a token whose end is an end in B too; a document's end is one
        ends = end_a[at[moving] - 1]
        moving = moving[end_b[np.searchsorted(end_b, ends)] != ends]
        at[moving] += 1
    return np.unique(np.concatenate([first, at[at < len(end_a)]]))


def merge(end_a: np.ndarray, end_b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A's token and B's token of each link, whether each token of A and of B ends a group).

    ``end_a`` and ``end_b`` are the byte ends of both streams over all documents in a row, ``first`` the documents' first
    tokens in A. Pointers of all lanes advance in one step: each emits the link it stands on, then the stream whose token ends
    first moves on, both where they end alike, which is a cut. Lanes that are through are taken out.
    """
    a = _lane_starts(end_a, end_b, first)
    stop = np.append(a[1:], len(end_a))
    b = np.where(a > 0, np.searchsorted(end_b, end_a[a - 1]) + 1, 0)
    link_a, link_b = np.empty(len(end_a) + len(end_b), np.int64), np.empty(len(end_a) + len(end_b), np.int64)
    cut_a, cut_b, n = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool), 0
    while len(a):
        link_a[n : n + len(a)], link_b[n : n + len(a)] = a, b
        n += len(a)
        ahead = end_a[a] - end_b[b]
        cut = ahead == 0
        cut_a[a[cut]] = cut_b[b[cut]] = True
        a, b = a + (ahead <= 0), b + (ahead >= 0)
        if cut.any() and (live := a < stop).sum() < len(a):
            a, b, stop = a[live], b[live], stop[live]
    return link_a[:n], link_b[:n], cut_a, cut_b


def code_type(size: int) -> str:
    """How a link (a * size + b) is stored."""
    return "<u4" if size * size <= 1 << 32 else "<u8"


class Aligner:
    """Both encoders of a worker and what their ids stand for."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = encoder(a_path, True, False), piece_encoder(b_path)
        self.a_bytes, self.b_bytes = byte_table(self.a), piece_table(self.b)
        self.size = max(len(self.a_bytes), len(self.b_bytes))
        self.shown = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(self.size)], pa.large_string())

    def _spelt(self, table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the tokens in a row, where each starts and the last ends)."""
        found = table.take(pa.array(ids))
        return np.frombuffer(found.buffers()[2] or b"", np.uint8), np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1]

    def align(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """For each text: tokens of A and of B, groups, the groups as text, and its links as codes a * size + b."""
        ids_a, sizes_a = self.a.flat(texts, led=True)
        ids_b, sizes_b = self.b.flat(texts)
        (data_a, at_a), (data_b, at_b) = self._spelt(self.a_bytes, ids_a), self._spelt(self.b_bytes, ids_b)
        stop_a, stop_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        good = np.zeros(len(texts), bool)
        for i, text in enumerate(texts.to_pylist()):
            if text:
                said = np.frombuffer(b" " + text.encode(), np.uint8)
                good[i] = np.array_equal(said, data_a[at_a[stop_a[i] - sizes_a[i]] : at_a[stop_a[i]]]) and np.array_equal(said, data_b[at_b[stop_b[i] - sizes_b[i]] : at_b[stop_b[i]]])
        keep_a, keep_b = np.repeat(good, sizes_a), np.repeat(good, sizes_b)
        ids_a, ids_b, end_a, end_b = ids_a[keep_a], ids_b[keep_b], np.cumsum(np.diff(at_a)[keep_a]), np.cumsum(np.diff(at_b)[keep_b])
        sizes_a, sizes_b = sizes_a * good, sizes_b * good
        a_ends, b_ends = np.cumsum(sizes_a), np.cumsum(sizes_b)

        link_a, link_b, cut_a, cut_b = merge(end_a, end_b, (a_ends - sizes_a)[good])
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        # A link's place in its text: each step moves one stream on, a cut both.
        codes = np.empty(len(link_a), code_type(self.size))
        codes[link_a + link_b - group_a[link_a]] = ids_a[link_a].astype(np.int64) * self.size + ids_b[link_b]
        # The groups as text: A's tokens of a group, then B's.
        b_before, a_through = np.append(0, np.flatnonzero(cut_b) + 1), np.flatnonzero(cut_a) + 1
        place = np.empty(len(ids_a) + len(ids_b), np.int64)
        place[np.arange(len(ids_a)) + b_before[group_a]] = ids_a + cut_a * self.size
        place[np.arange(len(ids_b)) + a_through[group_b] if len(ids_b) else []] = ids_b + cut_b * 2 * self.size
        data, at = self._spelt(self.shown, place)
        groups = np.diff(np.append(0, np.append(0, np.cumsum(cut_a))[a_ends]))
        return sizes_a, sizes_b, groups, [data[at[x - n] : at[x] - 1].tobytes().decode() if n else "" for x, n in zip(a_ends + b_ends, sizes_a + sizes_b, strict=True)], codes


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """ALIGNED rows, one for each row of ``docs`` (doc_id, text): numbers of tokens and groups, the groups as text
    (`a1,a2|b1;a3|b2,b3`: decimal ids of A and B), and the links in text order as codes a * size + b (`code_type`; size: of the larger vocabulary).

    A is the byte-level vocabulary of ``a_path`` over a space and the text, B the piece vocabulary of ``b_path``, which adds the space itself;
    special tokens in a text are plain text. Null and empty texts, and texts that the tokens of A or B do not spell, have no
    tokens: zeros and empty values. Repeated rows and null doc_ids stay rows of their own; very long texts are encoded whole, one
    at a time, and merged in several lanes; other columns are ignored; an empty table gives no rows.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (a_path, b_path)
        aligner = _ALIGNERS[key] = _ALIGNERS.get(key) or Aligner(*key)
        for batch in drained(batches):
            for x, y in sub_batches(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), BATCH_BYTES):
                n_a, n_b, groups, shown, codes = aligner.align(batch.column(1).slice(x, y - x))
                ends = np.cumsum(n_a + n_b - groups) * codes.itemsize
                codes = codes.tobytes()
                links = [codes[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(n_a), pa.array(n_b), pa.array(groups), pa.array(shown, pa.string()), pa.array(links, pa.binary())], ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, ALIGNED)


def _codes(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), code_type(size))


def link_counts(links: DataFrame, size: int) -> DataFrame:
    """(pair, n, best) of every id pair of ``links`` (links binary): in how many links it stands, and whether no other
    pair of its B id stands in more. Counted in tasks first."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0

        def flush():
            sums = pd.concat(held).groupby(level=0).sum()
            return pa.RecordBatch.from_arrays([pa.array(sums.index.to_numpy()), pa.array(sums.to_numpy())], ["pair", "n"])

        for batch in drained(batches):
            for x, y in sub_batches(pc.binary_length(batch.column(0)).to_pylist(), 4_000_000):
                found, n = np.unique(_codes(batch.column(0).slice(x, y - x), size), return_counts=True)
                held.append(pd.Series(n, found.astype(np.int64)))
                size_held += len(found)
                if size_held > 2_000_000:
                    yield flush()
                    held, size_held = [], 0
        if held:
            yield flush()

    counts = written(links.select("links").mapInArrow(of, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    most = counts.groupBy((F.col("pair") % size).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, F.col("pair") % size == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(links: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """``links`` (with a column links) and, for each row, n_best and count_sum over its links by ``counts`` of
    ``link_counts``; links with a pair that has no counts add nothing.

    The counts go to the tasks in rounds of about ROUND_PAIRS pairs, each round one pass over the links: what is broadcast
    does not grow with the corpus, and no link is shuffled.
    """
    spark = links.sparkSession
    counts = written(counts, "counts")
    rounds = max(1, -(-counts.count() // ROUND_PAIRS))
    links = links.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for i in range(rounds):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(rounds)) == i).toArrow()
        sent = spark.sparkContext.broadcast(tuple(part.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
        place = links.columns.index("links")

        def of(batches: Iterator[pa.RecordBatch], sent=sent, place=place) -> Iterator[pa.RecordBatch]:
            pairs, n, best = sent.value
            index = pd.Index(pairs)
            n, best = np.append(n, 0), np.append(best, False).astype(np.int64)  # the last for a pair that is not there
            for batch in drained(batches):
                for x, y in sub_batches(pc.binary_length(batch.column(place)).to_pylist(), 4_000_000):
                    part = batch.slice(x, y - x)
                    codes = _codes(part.column(place), size)
                    at = index.get_indexer(codes.astype(np.int64))
                    ends = np.cumsum(pc.binary_length(part.column(place)).to_numpy(zero_copy_only=False)) // codes.itemsize
                    columns = part.columns
                    for k, values in (("n_best", best), ("count_sum", n)):
                        sums = np.append(0, np.cumsum(values[at]))[np.append(0, ends)]
                        columns[part.schema.get_field_index(k)] = pc.add(part.column(k), pa.array(np.diff(sums)))
                    yield pa.RecordBatch.from_arrays(columns, part.schema.names)

        links = links.mapInArrow(of, links.schema)
        if i + 1 < rounds:
            links = written(links, "links")
    return links


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document between the two public vocabularies; see ``aligned``."""
    a_path, b_path = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    found = aligned(table(spark, sf_dir, "documents"), a_path, b_path)
    n_links = F.col("n_a") + F.col("n_b") - F.col("n_groups")
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = written(found.select("doc_id", "n_a", "n_b", "n_groups", n_links.alias("n_links"), sha.alias("groups_sha256"), "links"), "aligned")
    size = max(len(byte_table(encoder(a_path, True, False))), len(piece_table(piece_encoder(b_path))))
    return with_counts(found, link_counts(found, size), size).drop("links")
