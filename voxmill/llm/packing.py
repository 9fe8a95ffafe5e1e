"""Best-fit-decreasing packing of token ids into windows of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drained, sub_batches, table
from .tokens import encoder, vocabulary, with_ends

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """A segment tree over the capacities 0..size: node counts say where windows with that much room are open."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of ``need`` or more: (room, window)."""
        node = self.leaves + need
        while not self.count[node]:
            while node & 1:  # a right child: go up until there is a right neighbour
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not self.count[node]:
                node += 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.at[room].pop()


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; pieces go in by falling length, ties in input order."""
    windows, offsets, rooms, opened = [0] * len(lengths), [0] * len(lengths), OpenWindows(size), 0
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = rooms.tightest(lengths[i])
        if found is None:
            found, opened = (size, opened), opened + 1
        room, windows[i] = found
        offsets[i] = size - room
        if room > lengths[i]:
            rooms.add(room - lengths[i], windows[i])
    return windows, offsets


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, spaces: bool = True, at_once: int = 6_000_000) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``size`` ids.

    Each document's ids end with ``end_id``. Every full window of an overlong document is a sequence of its own; what
    remains (under ``size`` ids) is packed by best-fit decreasing among the remainders of the same input partition, so
    there is no shuffle and a task holds only its own partition's remainders. Sequence ids are unique over partitions.
    Texts of about ``at_once`` bytes are encoded together: words that repeat are looked up once, at the price of memory.

    Null text counts as empty (one piece: the end id). Repeated rows and repeated or null doc_ids are documents of
    their own. An empty table gives no rows. Other columns are ignored.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, spaces).flat
        first = TaskContext.get().partitionId() << 36
        used, rest, rows, held = 0, [], [], 0
        for batch in drained(batches):
            doc_ids = batch.column(0).to_pylist()
            for a, b in sub_batches(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), at_once):
                every, sizes = with_ends(*encode(batch.column(1).slice(a, b - a)), end_id)
                every, at = every.tobytes(), 0
                for doc_id, n in zip(doc_ids[a:b], sizes.tolist(), strict=True):
                    ids, start = every[4 * at : 4 * (at + n)], 0
                    at += n
                    while n - start >= size:
                        rows.append((doc_id, start, size, ids[4 * start : 4 * (start + size)], n, first + used, 0))
                        used, start, held = used + 1, start + size, held + size
                    if n > start:
                        rest.append((doc_id, start, n - start, ids[4 * start :], n))
                    if held > 1_000_000:
                        yield _emit(rows)
                        rows, held = [], 0
        if rows:
            yield _emit(rows)
        windows, offsets = best_fit([x[2] for x in rest], size)
        for a, b in sub_batches([x[2] for x in rest], 1_000_000):
            yield _emit([(*rest[i], first + used + windows[i], offsets[i]) for i in range(a, b)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, PIECE)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids; see ``pack_documents``."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return digest(pieces)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with their ids' CRC in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
