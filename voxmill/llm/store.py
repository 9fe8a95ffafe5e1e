"""A content-addressed store of token ids.

``write_store`` writes three Parquet folders under a path:

* ``blocks/kind=chunk``: each unique chunk once (hash, ids packed as little-endian unsigned integers of ``width`` bytes);
* ``recipes``: one row for each document in ascending doc_id order, with its chunk hashes and their Merkle root;
* ``manifest``: for each part of ``recipes`` the Merkle tree over its documents, with documents and ids below each node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import drained, fresh_path, partitions, sub_batches, table, text_key
from .tokens import encoder, vocabulary, with_ends

#: Chunk lengths in ids, and the ids that the rolling hash sees.
LEAST, MEAN, MOST, SPAN = 64, 256, 1024, 16
HASH_BYTES = 16

_GEAR = np.random.default_rng(20240101).integers(0, 2**64, 1 << 16, dtype=np.uint64)


def chunk_hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=HASH_BYTES).digest()


def merkle_root(hashes: list[bytes]) -> bytes:
    """Pairs of neighbours are hashed until one is left; an odd one moves up as it is."""
    level = hashes or [chunk_hash(b"")]
    while len(level) > 1:
        level = [chunk_hash(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cut_points(ids: np.ndarray, bounds: list[int]) -> list[list[int]]:
    """Ends of the chunks of each document; ``bounds`` are the documents' ends in ``ids``.

    A chunk ends after an id where the rolling hash of the last SPAN ids has its low bits zero, not before LEAST ids
    and at MOST ids at the latest. As LEAST exceeds SPAN, no hash that reaches into the document before is used.
    """
    gear = _GEAR[ids & 0xFFFF]
    rolling = gear.copy()
    for j in range(1, min(SPAN, len(ids))):
        rolling[j:] += gear[:-j] << np.uint64(j)
    marks = np.flatnonzero((rolling >> np.uint64(20)) & np.uint64(MEAN - 1) == 0) + 1
    out, start = [], 0
    for end in bounds:
        own, at = [], start
        while end - at > LEAST:
            k = np.searchsorted(marks, at + LEAST)
            nxt = int(marks[k]) if k < len(marks) else end
            at = min(nxt, at + MOST, end)
            own.append(at)
        if at < end or not own:
            own.append(end)
        out.append(own)
        start = end
    return out


BLOCK = "kind string, hash binary, ids binary, doc_id long, text_key long, n_tokens long"
#: Hashes that a task keeps to send a chunk once, and children of a Merkle node over documents.
SEEN, FAN = 1_000_000, 256
#: Bytes of text that are encoded at once: words that repeat in a slice are looked up once for it.
SLICE = 6_000_000


def _block(kind: str, hashes: list[bytes], ids: list[bytes], *own) -> pa.RecordBatch:
    numbers = [pa.array(x, pa.int64()) for x in own] or [pa.nulls(len(hashes), pa.int64())] * 3
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(hashes), pa.string()), pa.array(hashes, pa.binary()), pa.array(ids, pa.binary()), *numbers], ["kind", "hash", "ids", "doc_id", "text_key", "n_tokens"])


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, spaces: bool = False, width: int = 2) -> None:
    """Encode ``docs`` (doc_id, text), each with ``end_id`` after it, into the store at ``path``.

    One pass over the texts and one shuffle: a task sends each chunk it meets once, keyed by hash (so a chunk that a
    third of all documents share costs a row per task), beside one thin recipe row per document. Null text counts as
    empty. Repeated rows and repeated or null doc_ids stay documents of their own (nulls first, then by text hash). Very
    long texts are cut into chunks in one task; other columns are ignored; an empty table gives an empty store.
    """
    spark = docs.sparkSession
    dtype = {2: "<u2", 4: "<u4"}[width]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(tokenizer_path, spaces).flat
        seen: set[bytes] = set()
        for batch in drained(batches):
            doc_ids, keys = (batch.column(i).to_pylist() for i in range(2))
            for a, b in sub_batches(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist(), SLICE):
                ids, sizes = with_ends(*encode_texts(batch.column(2).slice(a, b - a)), end_id)
                if width == 2 and int(ids.max()) > 0xFFFF:
                    raise ValueError("an id needs more than 2 bytes: call with width=4")
                data, start, chunks, recipes = ids.astype(dtype).tobytes(), 0, {}, []
                for cuts in cut_points(ids, np.cumsum(sizes).tolist()):
                    own = []
                    for at in cuts:
                        piece = data[width * start : width * at]
                        own.append(h := chunk_hash(piece))
                        if h not in seen:
                            chunks[h] = piece
                        start = at
                    recipes.append((merkle_root(own), b"".join(own)))
                if len(seen) > SEEN:
                    seen.clear()  # a chunk sent twice is dropped behind the shuffle
                seen.update(chunks)
                yield _block("chunk", list(chunks), list(chunks.values()))
                yield _block("recipe", [r for r, _ in recipes], [own for _, own in recipes], doc_ids[a:b], keys[a:b], sizes)

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for kind, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(kind == "recipe" or h not in seen)
                if kind == "chunk":
                    seen.add(h)
            yield batch.filter(pa.array(keep))

    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text").cast("string")), F.col("text").cast("string")).mapInArrow(encode, BLOCK)
    #: A recipe's place hangs on its document too: a third of all documents may be alike.
    rows.repartition(n, "hash", "doc_id").mapInArrow(unique, BLOCK).write.partitionBy("kind").parquet(f"{path}/blocks")

    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    recipes = blocks.where("kind = 'recipe'").select("doc_id", "text_key", "n_tokens", F.col("ids").alias("hashes"), F.col("hash").alias("root"))
    recipes.repartitionByRange(n, "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{path}/recipes")

    _tree(spark, path).write.parquet(f"{path}/manifest")


MANIFEST = "part int, level int, node long, docs long, tokens long, hash string"


def _tree(spark: SparkSession, path: str) -> DataFrame:
    """The Merkle tree over each part's documents in their order: a leaf is SHA-256 of a document's row, id, size and root;
    a node hashes the FAN nodes below it in order. The highest level of a part is one node, its root."""
    place = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    leaf = F.sha2(F.concat_ws(",", place.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("n_tokens").cast("string"), F.hex("root")), 256)
    level = _recipes(spark, path).select("part", place.alias("node"), F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"), leaf.alias("hash"))
    most = level.agg(F.max("node")).first()[0] or 0
    levels, k = [], 1
    while True:
        below = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"])
        level = level.groupBy("part", F.floor(F.col("node") / FAN).alias("parent")).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.sha2(F.array_join(below, ","), 256).alias("hash"))
        level = level.withColumnRenamed("parent", "node")
        levels.append(level.select("part", F.lit(k).alias("level"), "node", "docs", "tokens", "hash"))
        most, k = most // FAN, k + 1
        if not most:
            break
    return reduce(DataFrame.union, levels)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def merkle_proof(spark: SparkSession, path: str, part: int, place: int) -> list[tuple[int, int, str]]:
    """(level, node, hash) of the nodes over one document (``place`` in its part): what has to fit if it is unchanged."""
    nodes = _manifest(spark, path).where(F.col("part") == part).where(F.col("node") == F.floor(F.lit(place) / F.pow(F.lit(float(FAN)), "level")))
    return [(r.level, r.node, r.hash) for r in nodes.orderBy("level").collect()]  # a row a level


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, text_key long, n_tokens long, hashes binary, root binary, part int, row long").parquet(f"{path}/recipes")


def _uses(spark: SparkSession, path: str) -> DataFrame:
    """One row for each chunk of each document: (row, seq, hash). A recipe's Merkle root is checked on the way."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seqs, hashes = [], [], []
            for row, data, root in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = [data[i : i + HASH_BYTES] for i in range(0, len(data), HASH_BYTES)]
                if merkle_root(own) != root:
                    raise ValueError(f"recipe {row}: its Merkle root does not fit its chunks")
                rows += [row] * len(own)
                seqs += range(len(own))
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(seqs, pa.int32()), pa.array(hashes, pa.binary())], ["row", "seq", "hash"])

    return _recipes(spark, path).select("row", "hashes", "root").mapInArrow(split, "row long, seq int, hash binary")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(f"{path}/blocks").where("kind = 'chunk'").select("hash", "ids")


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raises if the Merkle trees of the recipes differ from the manifest's; compares one row for FAN documents."""
    now, said = _tree(spark, path), _manifest(spark, path)
    if now.exceptAll(said).union(said.exceptAll(now)).limit(1).count():
        raise ValueError("the recipes do not fit the manifest")


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """Each document with the number of ids before it: sums by part first, then a running sum inside each part."""
    recipes = _recipes(spark, path).select("row", "doc_id", "n_tokens", "part")
    sums = _manifest(spark, path).where("level = 1").groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = sums.select("part", (F.sum("tokens").over(W.orderBy("part")) - F.col("tokens")).alias("before"))
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return recipes.withColumn("inside", inside).join(F.broadcast(before), "part").select("row", "doc_id", "n_tokens", (F.col("before") + F.col("inside")).alias("start"))


def read_store(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """The documents again: doc_id, start, n_tokens, ids (array of ids, whole)."""
    check_manifest(spark, path)
    dtype = {2: "<u2", 4: "<u4"}[width]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in own), dtype).astype(np.int64) for own in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "n_tokens", "ids"])

    whole = _uses(spark, path).join(_chunks(spark, path), "hash").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("own"))
    return _starts(spark, path).join(whole, "row").select("doc_id", "start", "n_tokens", "own").mapInArrow(join, "doc_id long, start long, n_tokens long, ids array<long>")


def store_digest(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from the files alone.

    Each unique chunk is read once, held against its hash, and its CRC taken; a document's CRC follows from its chunks'
    CRCs and lengths, so no ids are shuffled.
    """
    check_manifest(spark, path)
    dtype = {2: "<u2", 4: "<u4"}[width]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes, crcs = batch.column(0).to_pylist(), [], []
            for h, data in zip(hashes, batch.column(1).to_pylist(), strict=True):
                if chunk_hash(data) != h:
                    raise ValueError(f"chunk {h.hex()} does not fit its hash")
                sizes.append(len(data) // width)
                crcs.append(zlib.crc32(np.frombuffer(data, dtype).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64())], ["hash", "n", "crc"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros = bytes(4 * MOST)
        for batch in batches:
            rows, sizes, crcs = batch.column(0).to_pylist(), [], []
            for own in batch.column(1).to_pylist():
                crc, total = 0, 0
                for x in own:  # appending n ids shifts the sum so far by their zero bytes
                    crc = zlib.crc32(zeros[: 4 * x["n"]], crc ^ 0xFFFFFFFF) ^ 0xFFFFFFFF ^ x["crc"]
                    total += x["n"]
                sizes.append(total)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["row", "n", "crc"])

    chunks = _chunks(spark, path).mapInArrow(sums, "hash binary, n int, crc long")
    own = _uses(spark, path).join(chunks, "hash").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "crc"))).alias("own"))
    whole = own.mapInArrow(combine, "row long, n long, crc long")
    return _starts(spark, path).drop("n_tokens").join(whole, "row").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op10_store(spark, sf_dir: str) -> DataFrame:
    """All documents written to a store, and their digests read back from its files; see ``write_store``."""
    path = fresh_path(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return store_digest(spark, path)
