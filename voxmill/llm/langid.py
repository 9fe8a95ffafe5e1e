"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import drained, table, text_slices

#: The bounded training sample: documents of each language, and characters from the middle of each.
SAMPLE_DOCS, SAMPLE_CHARS = 160, 1500
LEVEL = 9
#: Bytes of texts that a task holds as Python values at once.
AT_ONCE = 4_000_000
_LETTER = regex.compile(r"\p{L}")
_NO_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """What is encoded: letters in lower case, one space for all between them. Marks and capitals tell no language."""
    return _NO_LETTERS.sub(" ", text.lower()).encode()


def coder(data: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False)


def margin(sizes: list[int]) -> float:
    """How much smaller the smallest is than the next, as a part of that."""
    best, *rest = sorted(sizes)
    return 1 - best / rest[0] if rest else 1.0


def _dictionaries(pieces: dict[str, list[bytes]]) -> dict[str, bytes]:
    return {lang: b"\n".join(own) for lang, own in pieces.items()}


def _trusted(pieces: dict[str, list[bytes]]) -> dict[str, list[bytes]]:
    """Without the pieces that the other half of the sample assigns to another language: wrong labels would teach."""
    halves = [{lang: own[i::2] for lang, own in pieces.items()} for i in (0, 1)]
    kept: dict[str, list[bytes]] = {lang: [] for lang in pieces}
    for own, other in (halves, halves[::-1]):
        coders = [(lang, coder(d)) for lang, d in _dictionaries(other).items() if d]
        for lang, texts in own.items():
            for text in texts:
                sizes = {name: len(c.compress(text)) for name, c in coders}
                if lang not in sizes or sizes[lang] == min(sizes.values()):
                    kept[lang].append(text)
    return {lang: kept[lang] or own for lang, own in pieces.items()}


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """A raw-content dictionary of each language of ``labelled`` (doc_id, text, lang); rows with a null are left out.

    From each language a fixed hash of doc_id picks SAMPLE_DOCS documents at most; languages come by falling number of
    documents, ties by name. The sample alone reaches the driver: (languages x SAMPLE_DOCS x SAMPLE_CHARS) characters.
    """
    rows = labelled.where("doc_id is not null and text is not null and lang is not null and length(text) > 0")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # Hash fractions first, so that ranking sees a few hundred rows of each language, not all of them.
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.lit(1.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 4.0 * SAMPLE_DOCS / n))).otherwise(share)
    middle = F.expr(f"substring(text, greatest(1, cast((length(text) - {SAMPLE_CHARS}) / 2 as int)), {SAMPLE_CHARS})")
    few = rows.select("lang", "doc_id", draw.alias("draw"), middle.alias("piece")).where(F.col("draw") < share)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id", "piece"))).where(F.col("rank") <= SAMPLE_DOCS)
    pieces: dict[str, list[bytes]] = {}
    for r in ranked.orderBy("lang", "rank").select("lang", "piece").collect():
        pieces.setdefault(r.lang, []).append(plain(r.piece))
    order = sorted(pieces, key=lambda x: (-counts[x], x))
    return _dictionaries(_trusted({lang: pieces[lang] for lang in order}))


def identify(texts: DataFrame, dictionaries: dict[str, bytes], least_margin: float = 0.0) -> DataFrame:
    """``texts`` with lang_pred and score; its columns may be any, but for ``text`` which is read.

    score is the margin: by what part the smallest encoding is smaller than the second smallest (0 to 1; 1 if there is
    one language alone). lang_pred is ``und`` for null texts, texts without a letter (Unicode category L), a score under
    ``least_margin`` at any length, or when nothing was learned. Ties go to the language with more documents. Whole texts
    are encoded, each for itself, so very long ones cost their length and no memory beyond it. Repeated rows each come
    back alike; an empty table gives no rows. Input columns named lang_pred or score are replaced.
    """
    kept = [c for c in texts.columns if c not in ("lang_pred", "score")]
    at, inside = kept.index("text"), texts.schema["text"].dataType.typeName() == "string"  # a string goes out once, in its row

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [(lang, coder(data)) for lang, data in dictionaries.items()]
        for batch in drained(batches):
            row = batch.column(0)
            for a, b, own in text_slices(row.field(at) if inside else batch.column(1), AT_ONCE):
                langs, scores = [], []
                for text in own:
                    lang, score = "und", 0.0
                    if coders and text and _LETTER.search(text):
                        data = plain(text)
                        sizes = [len(c.compress(data)) for _, c in coders]
                        score = margin(sizes)
                        if score >= least_margin:
                            lang = coders[sizes.index(min(sizes))][0]
                    langs.append(lang)
                    scores.append(score)
                yield pa.RecordBatch.from_arrays([row.slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    rows = texts.select(F.struct(*(texts[c] for c in kept)).alias("row"), *([] if inside else [F.col("text").cast("string").alias("text")]))
    return rows.mapInArrow(predict, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double").select("row.*", "lang_pred", "score")


def held_out(doc_id="doc_id"):
    """True for a quarter of all documents, which no training may see; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out; see ``identify``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), dictionaries).select("doc_id", "held_out", "lang_pred", "score")
