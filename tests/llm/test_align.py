"""Cross-tokenizer alignment against a plain two-pointer merge, and the cached encoders against their libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from voxmill.llm import align
from voxmill.llm.tokens import Encoder, PieceEncoder, byte_table, piece_table, vocabulary

SF = "/root/testdata/sf0.001"
A_PATH, B_PATH = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    spell_a = byte_table(Encoder(A_PATH, True, False)).to_pylist()
    spell_b = piece_table(PieceEncoder(B_PATH)).to_pylist()
    return a, b, spell_a, spell_b


def brute(libraries, text):
    """(a ids, b ids, groups as text, links) of a text by two pointers."""
    a, b, spell_a, spell_b = libraries
    if not text:
        return [], [], "", []
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if not b"".join(spell_a[i] for i in ia) == b"".join(spell_b[i] for i in ib) == (" " + text).encode():
        return [], [], "", []
    groups, links, i, j, ea, eb, ga, gb = [], [], 0, 0, len(spell_a[ia[0]]), len(spell_b[ib[0]]), [ia[0]], [ib[0]]
    while True:
        links.append((ia[i], ib[j]))
        move_a, move_b = ea <= eb, eb <= ea
        if ea == eb:
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            ga, gb = [], []
            if i + 1 == len(ia):
                return ia, ib, ";".join(groups), links
        if move_a:
            i += 1
            ea += len(spell_a[ia[i]])
            ga.append(ia[i])
        if move_b:
            j += 1
            eb += len(spell_b[ib[j]])
            gb.append(ib[j])


def odd_texts():
    rng = random.Random(11)
    parts = ["alpha", "Beta's", "naïve", "日本語", "<|endoftext|>", "<s>", "</s>", "<0x41>", "x=1;", "...", "▁", "\U0001f600", "\x00", "\r\n", "\n", "\n\n", " ", "  ", "\t", " ", "12345", "́", "don't", "e.g.", "​"]
    texts = [None, "", " ", "\n", "a", "  a", "a  ", "\ta", "a▁b", "word " * 3000, "x" * 5000, "\n".join(["line one", "", "two  ", " three"]), "a \n b"]
    return texts + ["".join(rng.choice(parts) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randrange(1, 30))) for _ in range(400)]


def test_cached_encoders_equal_their_libraries(libraries):
    a, b, *_ = libraries
    texts = [t for t in odd_texts() if t]
    for flat, plain in ((lambda x: Encoder(A_PATH, True, False).flat(x, led=True), lambda t: a.encode(" " + t, add_special_tokens=False).ids), (PieceEncoder(B_PATH).flat, b.encode)):
        ids, sizes = flat(pa.array(texts))
        ends = np.cumsum(sizes)
        for text, start, end in zip(texts, ends - sizes, ends, strict=True):
            assert ids[start:end].tolist() == plain(text), repr(text)


def test_alignment_equals_two_pointers(spark, libraries, monkeypatch):
    monkeypatch.setattr(align, "LANE_TOKENS", 50)
    monkeypatch.setattr(align, "ROUND_PAIRS", 100)  # several rounds of counts
    texts = odd_texts()
    rows = [(i, t, "en", 5) for i, t in enumerate(texts)] + [(None, "a b c", "en", 1), (3, texts[20], "en", 2), (3, texts[20], "en", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string, n_a int")
    found = align.aligned(docs, A_PATH, B_PATH).collect()
    want = sorted(((r[0] is None, r[0] or 0, len(x), len(y), g.count(";") + bool(g), g) for r in rows for x, y, g, _ in [brute(libraries, r[1])]))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.groups) for r in found) == want
    assert any(w[2] > 1000 for w in want) and any(t and not w[2] for t, w in zip(texts, want, strict=False))

    count = Counter(link for r in rows for link in brute(libraries, r[1])[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    size = max(len(libraries[2]), len(libraries[3]))
    table = align.aligned(docs, A_PATH, B_PATH).select("doc_id", "links")
    got = align.with_counts(table, align.link_counts(table, size), size).collect()
    want = sorted((r[0] is None, r[0] or 0, sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links)) for r in rows for links in [brute(libraries, r[1])[3]])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_best, r.count_sum) for r in got) == want


def test_no_rows_and_no_links(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.aligned(empty, A_PATH, B_PATH).count() == 0
    nothing = align.aligned(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A_PATH, B_PATH)
    got = align.with_counts(nothing, align.link_counts(nothing, 60_000), 60_000).collect()
    assert sorted((r.doc_id, r.n_a, r.n_groups, r.n_best, r.count_sum) for r in got) == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0)]


def test_query_over_documents(spark, libraries):
    found = {r.doc_id: r for r in align.op12_alignment(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    count = Counter()
    every = {d.doc_id: brute(libraries, d.text) for d in docs}
    for *_, links in every.values():
        count.update(links)
    for doc_id, (ia, ib, groups, links) in every.items():
        r = found[doc_id]
        assert (r.n_a, r.n_b, r.n_links, r.count_sum) == (len(ia), len(ib), len(links), sum(count[x] for x in links))
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
