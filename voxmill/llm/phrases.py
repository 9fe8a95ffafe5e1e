"""Phrase collocations by dynamic itemset counting: shards of the documents are scanned in a cycle, and phrases of all
lengths are counted side by side, each from the step after both its subphrases have reached the threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, drained, small_batches, sub_batches, table, written

#: Parts into which the documents are dealt; a full cycle is as many scans.
SHARDS = 2
#: Slots of the table of reached subphrases that each scan gets: one byte each, whatever their number.
SLOTS = 1 << 24
#: Bytes of text (or coded words) whose phrases a task combines before it sends them on, and rows that it sends at once.
BLOCK_BYTES, BLOCK_WORDS, SENT_ROWS = 10_000_000, 2_000_000, 250_000
#: Bytes of an Arrow batch from Spark to Python, about; by default it is 10,000 rows, tens of MB of long texts or codes.
BATCH_BYTES = 4_000_000

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: Rows of the scans of the cycle: a phrase's 64-bit hash (with its language) and its count there.
HASHED = "hash long, k int, born int, n long"
#: Rows of the last scan, which counts by the phrases themselves.
COUNTED = "lang string, phrase string, k int, born int, n long"
#: Texts of a shard as codes: the hashes of their distinct words, each word's place among those, and bits of ``follows``.
CODED = "shard int, words binary, ids binary, follows binary"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of ``texts`` in a row as binary, whether each is followed by a word of the same piece)."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    kind = _KIND[data]
    inside = kind == 0
    fresh = np.zeros(len(data) + 1, bool)
    fresh[ends - ends[0]] = True  # a text's first byte
    first = inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:-1]
    starts = np.flatnonzero(first)
    breaks = np.flatnonzero((kind == 2) | fresh[:-1])
    piece = np.searchsorted(breaks, starts, "right")
    kept = np.flatnonzero(inside)
    offsets = np.append(np.searchsorted(kept, starts), len(kept))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LOWER[data[kept]])])
    follows = np.zeros(len(starts), bool)
    follows[:-1] = piece[1:] == piece[:-1]
    return words, follows


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    lead, h = lang.encode() + b"\t", xxhash.xxh3_64_intdigest
    return np.array([h(lead + w) for w in words], np.uint64)


def _longer_hash(head: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its first words and its last word."""
    mixed = (head ^ (head >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + last * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(32))


def slot_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes & np.uint64(slots - 1)).astype(np.int64)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the hashes' places in a bitmap (bytes) are set."""
    place = slot_of(hashes, 8 * len(bits))
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _places(hashes: np.ndarray, follows: np.ndarray, reached: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, places where a phrase of k words starts whose two subphrases have reached the threshold, the steps of their births,
    their hashes) for k = 2 to ``longest``.

    ``reached`` has, by slot, the step in which a phrase reached the threshold (0: not yet). A phrase is born in the later
    step of those of its first and its last ``k - 1`` words, a word in step 0.
    A slot may have been reached by another phrase before a phrase that shares it was born; for that one, its own birth counts,
    as no scan has met its longer phrases before.
    """
    level = reached[slot_of(hashes, len(reached))]
    at = np.flatnonzero(follows[:-1] & (level[:-1] > 0) & (level[1:] > 0))
    born, head = np.maximum(level[at], level[at + 1]), hashes[at]
    for k in range(2, longest + 1):
        if not len(at):
            return
        whole = _longer_hash(head, hashes[at + k - 1])
        yield k, at, born, whole
        if k == longest:
            return
        level = reached[slot_of(whole, len(reached))]
        level = np.where(level > 0, np.maximum(level, born), 0)
        both = np.flatnonzero((at[1:] == at[:-1] + 1) & (level[1:] > 0) & (level[:-1] > 0))
        born = np.maximum(level[both], level[both + 1])
        at, head = at[both], whole[both]


def count_hashes(hashes: np.ndarray, follows: np.ndarray, reached: np.ndarray, open_after: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of a block of word hashes that are open (born after ``open_after``), as HASHED; see ``_places``."""

    def counted(k: int, born: int, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = np.sort(found)
        new = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        found, n = found[new].view(np.int64), np.diff(np.append(new, len(found)))
        for i in range(0, len(n), SENT_ROWS):
            size = len(n[i : i + SENT_ROWS])
            yield pa.RecordBatch.from_arrays([pa.array(found[i : i + size]), pa.array(np.full(size, k, np.int32)), pa.array(np.full(size, born, np.int32)), pa.array(n[i : i + size])], ["hash", "k", "born", "n"])

    if open_after < 0 and len(hashes):
        yield from counted(1, 0, hashes)
    for k, _, born, whole in _places(hashes, follows, reached, longest):
        for step in range(max(open_after, 0) + 1, int(born.max()) + 1):
            if (now := born == step).any():
                yield from counted(k, step, whole[now])


def count_block(lang: str, words: pa.Array, follows: np.ndarray, reached: np.ndarray, open_after: int, longest: int, kept: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of a block that are open (born after ``open_after``), as COUNTED; see ``_places``. With ``kept``
    (a bitmap by hash), of those alone that are set there."""
    coded = words.dictionary_encode()
    ids, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def batch(columns: list[np.ndarray], born: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        parts = [known.take(pa.array(c)) for c in columns]
        phrase = (pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if len(parts) > 1 else parts[0]).cast(pa.binary()).cast(pa.string())
        size = len(phrase)
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(size, np.int64))), phrase, pa.array(np.full(size, len(parts), np.int32)), pa.array(born.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "phrase", "k", "born", "n"])

    word_hash, size = _word_hashes(lang, known.to_pylist()), len(known)
    if open_after < 0:
        n, own = np.bincount(ids, minlength=size), np.arange(size)
        own = own if kept is None else own[_has(kept, word_hash)]
        yield batch([own], np.zeros(len(own)), n[own])
    for k, at, born, whole in _places(word_hash[ids], follows, reached, longest):
        is_open = born.astype(np.int64) > open_after
        is_open = np.flatnonzero(is_open if kept is None else is_open & _has(kept, whole))
        if len(is_open):  # phrases are numbered in the block where they are open, nowhere else
            code = ids[at[is_open]]
            for j in range(1, k):
                number = code if j == 1 else np.unique(code, return_inverse=True)[1]
                code = number * size + ids[at[is_open] + j]
            by = np.argsort(code, kind="stable")
            order, code = is_open[by], code[by]
            new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            one = order[new]
            yield batch([ids[at[one] + j] for j in range(k)], born[one], np.diff(np.append(new, len(order))))


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[tuple, tuple[pa.Array, np.ndarray]]]:
    """Of blocks of about BLOCK_BYTES of rows (shard, lang, text): ``words_of`` the texts of each (shard, lang)."""
    held: dict[tuple, list] = {}
    size = 0
    joined = lambda: {k: (pa.concat_arrays([w for w, _ in parts]), np.concatenate([f for _, f in parts])) for k, parts in held.items()}
    for batch in drained(batches):
        for key in {*zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}:
            texts = batch.column(2).filter(pc.and_(pc.equal(batch.column(0), key[0]), pc.equal(batch.column(1), key[1])))
            for a, b in sub_batches(pc.binary_length(texts).to_pylist(), 1_000_000):
                part = texts.slice(a, b - a)
                held.setdefault(key, []).append(words_of(part))
                size += part.nbytes
                if size > BLOCK_BYTES:
                    yield joined()
                    held.clear()
                    size = 0
    yield joined()


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, lang, text) as CODED."""
    for block in _by_language(batches):
        for (shard, lang), (words, follows) in block.items():
            coded = words.dictionary_encode()
            parts = _word_hashes(lang, coded.dictionary.to_pylist()), coded.indices.to_numpy().astype(np.int32), np.packbits(follows)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["shard", "words", "ids", "follows"])


def _scan(shard: DataFrame, reached, open_after: int, longest: int) -> DataFrame:
    """HASHED rows of a shard (CODED), combined by blocks of its tasks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            if held:
                yield from count_hashes(np.concatenate([h for h, _ in held]), np.concatenate([f for _, f in held]), reached.value, open_after, longest)
                held.clear()

        for batch in drained(batches):
            for row in range(batch.num_rows):
                words, ids, follows = (np.frombuffer(batch.column(i)[row].as_py(), kind) for i, kind in enumerate((np.uint64, np.int32, np.uint8)))
                held.append((words[ids], np.unpackbits(follows, count=len(ids)).astype(bool)))
                size += len(ids)
                if size > BLOCK_WORDS:
                    yield from flush()
                    size = 0
        yield from flush()

    return shard.select("words", "ids", "follows").mapInArrow(of, HASHED)


def _exact(docs: DataFrame, reached, kept, longest: int) -> DataFrame:
    """COUNTED rows of the phrases of documents (lang, text) that are set in ``kept``, and as phrases of no words each
    language's number of words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _by_language(batches):
            for (_, lang), (words, follows) in block.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([len(words)])], ["lang", "phrase", "k", "born", "n"])
                yield from count_block(lang, words, follows, reached.value, -1, longest, kept.value)

    return docs.select(F.lit(0).alias("shard"), "lang", "text").mapInArrow(of, COUNTED)


def _reached_slots(phrases: DataFrame, kept: np.ndarray, slots: int, longest: int) -> np.ndarray:
    """The slots of ``phrases`` (hash, k) of fewer than ``longest`` words; all of them are set in the bitmap ``kept``. At
    most 2 rows for each 64 bits of it come to the driver."""
    place = F.col("hash").bitwiseAND(F.lit(8 * len(kept) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    rows = phrases.groupBy((F.col("k") >= longest).alias("full"), F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    shorter = np.zeros(slots // 64, np.uint64)
    for full in (False, True):
        own = rows.filter(pc.equal(rows["full"], full))
        word, bits = own["word"].to_numpy(), own["bits"].to_numpy().view(np.uint64)
        kept.view(np.uint64)[word] |= bits
        if not full:
            np.bitwise_or.at(shorter, word & (slots // 64 - 1), bits)
    return np.flatnonzero(np.unpackbits(shorter.view(np.uint8), bitorder="little"))


def count_phrases(docs: DataFrame, least: int = 30, longest: int = 4, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, n) of every phrase of up to ``longest`` words that occurs ``least`` times or more in a language,
    (lang, words): all its word occurrences). Counts are exact.

    ``docs`` has text and lang; a null lang is ``und``, null and empty texts have no words. Documents are dealt into
    ``shards`` written shards, and step t scans shard t modulo their number. A phrase is born in the step in which the later of
    its two subphrases (all words but the last, all but the first) reaches ``least``; it is counted in the ``shards`` scans
    after its birth, one full cycle, and then complete. The scans end when a whole cycle has brought nothing over the threshold.

    The cycle counts by 64-bit hashes over coded shards, so phrases that share a hash are counted as one: its counts are never
    too small, and what reaches ``least`` there holds every phrase that does. A last scan over the texts counts those phrases
    by themselves, so results are exact whatever the hashes.

    Which subphrases have been reached is told by a table of ``slots`` bytes (a power of two, 64 at least) addressed by hash: two that share a slot may let a
    phrase be counted early or in vain, never miss it. State is kept in
    written tables; phrases that complete under the threshold are dropped there. Repeated rows count each; very long texts
    are read whole; other columns are ignored; an empty table gives no rows. ``docs`` is read twice.
    """
    with small_batches(docs.sparkSession, BATCH_BYTES):
        return _counted(docs, least, longest, shards, slots)


def _counted(docs: DataFrame, least: int, longest: int, shards: int, slots: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    deal = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard")
    dealt = written(texts.select(deal, "lang", "text").mapInArrow(_coded, CODED), "shards", "shard")
    levels, kept, last, step, state = np.zeros(slots, np.uint8), np.zeros(slots, np.uint8), 0, 0, None
    while step < shards or step - last < shards:
        step += 1
        sent = spark.sparkContext.broadcast(levels)
        counted = _scan(dealt.where(F.col("shard") == (step - 1) % shards), sent, step - 1 - shards, longest).withColumn("before", F.lit(0).cast("long"))
        if (before := state) is not None:
            counted = counted.unionByName(before.where(F.col("born") >= step - shards).select("hash", "k", "born", "n", F.col("n").alias("before")))
        # Hardly a phrase has two rows in a task, so rows are not summed before they move.
        summed = counted.repartition("hash").groupBy("hash", "k", "born").agg(F.sum("n").alias("n"), F.sum("before").alias("before"))
        summed = summed.select("hash", "k", "born", "n", ((F.col("n") >= least) & (F.col("before") < least)).alias("fresh"))
        state = written(summed.where(F.col("fresh") | (F.col("born") > step - shards)), "phrases")
        sent.destroy()
        if before is not None:
            discard(before)
        shorter = _reached_slots(state.where("fresh"), kept, slots, longest)
        if len(shorter):
            last = step
            levels = np.where((levels == 0) & np.bincount(shorter, minlength=slots).astype(bool), np.uint8(step), levels)
    sent, held = spark.sparkContext.broadcast(levels), spark.sparkContext.broadcast(kept)
    exact = _exact(texts, sent, held, longest).repartition("lang", "phrase").groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"))
    found = written(exact.where((F.col("n") >= least) & (F.col("k") > 0) | (F.col("k") == 0) & (F.col("n") > 0)), "counted")
    sent.destroy()
    held.destroy()
    discard(dealt, state)
    return found.where("k > 0"), found.where("k = 0").select("lang", F.col("n").alias("words"))


#: Ranked phrases of a language that a task of the first round of the top-k report passes on come from one of so many parts.
PARTS = 64


def _top(rows: DataFrame, most: int) -> DataFrame:
    """Each language's first ``most`` rows, with their rank. Parts of a language are cut to ``most`` rows each, in two rounds,
    before one task ranks what is left: at most 8 x ``most`` rows a language, however many phrases it has."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for cut in (F.col("part"), F.pmod("part", F.lit(8))):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", cut).orderBy(*order))).where(F.col("rank") <= most)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most).drop("part")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, most: int = 2000, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``most`` phrases of 2 to ``longest`` words.

    a is the phrase's count (``least`` or more), n the language's words. A cut after the first k words gives l and r, the counts of
    its two parts, and the score floor(2000000 a / (l + r)), in exact decimals; a phrase takes its lowest-scoring cut, ties to
    the smallest k. A phrase inside a longer one (as contiguous words) that occurs 4/5 as often or more is dropped. Order:
    score, a (both falling), phrase in UTF-8 order. See ``count_phrases`` for nulls, repeated rows and the rest; a language of
    no phrases has no rows.
    """
    counts, totals = count_phrases(docs, least, longest, shards)
    phrases = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")

    size = F.col("k")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: part(i, n))))
    inner = phrases.where("k > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a")
    inside = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    phrases = phrases.join(inside, ["lang", "phrase"], "left").where("longer is null or 5 * longer < 4 * a").drop("longer")

    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"), "words", "k")
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, size - F.col("cut")).alias("rest"))
    for name, side in (("l", "head"), ("r", "rest")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("best")).select("lang", "phrase", "best.*").drop("cut")
    ranked = _top(written(best, "scored"), most)
    return ranked.join(totals.withColumnRenamed("words", "n"), "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations of the documents; see ``collocations``."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
with docs as (
    select row_number() over () as row, coalesce(lang, 'und') as lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), pieces as (
    select lang, row, generate_subscripts(p, 1) as piece, unnest(p) as text
    from (select lang, row, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') as p from docs)
), words as (
    select lang, row, piece, list_filter(regexp_split_to_array(text, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
), spans as (
    select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, range(1, 5) t(k) where len(w) >= k
), counts as (
    select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as n from spans group by 1, 2, 3
), totals as (
    select lang, sum(n)::bigint as n from counts where k = 1 group by lang
), often as (
    select lang, k, phrase, n, string_split(phrase, ' ') as w from counts where n >= 30
), inside as (
    select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, max(n) as longer
    from (select lang, n, w, m, unnest(range(1, k - m + 2)) as i from often, range(2, 4) t(m) where m < k) group by 1, 2
), cuts as (
    select o.lang, o.phrase, o.n as a, c, array_to_string(o.w[1 : c], ' ') as head, array_to_string(o.w[c + 1 : o.k], ' ') as rest
    from often o left join inside i using (lang, phrase), range(1, 4) t(c)
    where o.k > 1 and c < o.k and (i.longer is null or 100 * i.longer < 80 * o.n)
), scored as (
    select cuts.lang, cuts.phrase, a, x.n as l, y.n as r, ((2000000 * a::hugeint) // (x.n + y.n))::bigint as score, c
    from cuts join often x on x.lang = cuts.lang and x.phrase = head join often y on y.lang = cuts.lang and y.phrase = rest
), best as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, t.n, score
from best join totals t using (lang) qualify rank <= 2000
"""
