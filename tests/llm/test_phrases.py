"""Collocations by dynamic itemset counting against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from voxmill.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
        yield [w for w in re.split("[\x20\x09]+", piece) if w]


def counts_of(rows, longest=4):
    found, totals = Counter(), Counter()
    for text, lang in rows:
        for words in pieces_of(text):
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    found[lang or "und", tuple(words[i : i + k])] += 1
    return found, totals


def brute(rows, least, longest, most):
    counts, totals = counts_of(rows, longest)
    often = {k: n for k, n in counts.items() if n >= least}
    longer = {}
    for (lang, p), n in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                key = lang, p[i : i + m]
                longer[key] = max(longer.get(key, 0), n)
    found = []
    for (lang, p), a in often.items():
        if len(p) > 1 and not 100 * longer.get((lang, p), 0) >= 80 * a:
            score, _, left, rest = min((2_000_000 * a // (often[lang, p[:k]] + often[lang, p[k:]]), k, often[lang, p[:k]], often[lang, p[k:]]) for k in range(1, len(p)))
            found.append((lang, -score, -a, " ".join(p).encode(), left, rest))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, rest in sorted(found):
        rank[lang] += 1
        if rank[lang] <= most:
            out.append((lang, rank[lang], phrase.decode(), -a, left, rest, totals[lang], -score))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    vocab = ["w%d" % i for i in range(12)] + ["É", "é", "New", "new", "YORK", "\x85", "a\xa0b", "\x00"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    out = []
    for lang in ("en", "de", None, "und"):
        for _ in range(60):
            words = rng.choices(vocab, weights, k=rng.randrange(0, 60))
            out.append(("".join(w + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "\x0b "]) for w in words), lang))
    out += [(None, "en"), ("", "fr"), (" .,\n", "fr"), ("solo", None)] + [("of the people by the people", "en")] * 9
    out += [("x y z " * 2000, "de")]
    return out


@pytest.mark.parametrize("block", [32_000_000, 500])
def test_counts(spark, rows, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    docs = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n int, phrase string").repartition(5)
    found, totals = phrases.count_phrases(docs, least=5, longest=5, shards=3)
    want, sums = counts_of(rows, 5)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.n for r in found.collect()} == {k: n for k, n in want.items() if n >= 5}
    assert {r.lang: r.words for r in totals.collect()} == dict(+sums)


def test_collocations(spark, rows):
    docs = spark.createDataFrame(rows, "text string, lang string")
    for most in (2000, 3):
        got = [tuple(r) for r in phrases.collocations(docs, least=4, most=most).collect()]
        assert sorted(got) == sorted(brute(rows, 4, 4, most))


def test_slots_that_clash_change_nothing(spark, rows, monkeypatch):
    """With eight slots nearly every phrase seems reached; what counts is decided by the phrases."""
    monkeypatch.setattr(phrases, "SLOTS", 64)
    import numpy as np

    words, follows = phrases.words_of(pa.array([t for t, lang in rows if lang == "de"]))
    batches = list(phrases.count_block("de", words, follows, np.ones(64, np.uint8), 0, 4))
    got = {tuple(p.split(" ")): n for b in batches for p, n in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True)}
    want, _ = counts_of([r for r in rows if r[1] == "de"])
    assert got == {p: n for (_, p), n in want.items() if len(p) > 1}


@pytest.mark.parametrize("slots", [64, 1024])
def test_counts_are_whole_where_slots_clash(spark, slots):
    """A slot reached early by another phrase must not shorten the cycle of phrases that hold a word reached later."""
    rng = random.Random(3)
    rows = []
    for i in range(300):  # dealt in turn: some words occur in one shard alone, or become frequent late
        vocab = ["c%d" % k for k in range(8)] + ["s%d-%d" % (i % 3, k) for k in range(25)]
        rows.append((" ".join(rng.choices(vocab, [1 / (k + 1) for k in range(len(vocab))], k=60)), "en"))
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    found, _ = phrases.count_phrases(docs, least=5, longest=4, shards=3, slots=slots)
    want, _ = counts_of(rows)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.n for r in found.collect()} == {k: n for k, n in want.items() if n >= 5}


def test_words_of_equals_plain_splitting(rows):
    texts = [t for t, _ in rows]
    words, follows = phrases.words_of(pa.array(texts))
    pieces = [p for t in texts for p in pieces_of(t) if p]
    assert [w.decode() for w in words.to_pylist()] == [w for p in pieces for w in p]
    assert follows.tolist() == [i + 1 < len(p) for p in pieces for i in range(len(p))]
    sliced = pa.array(["skip me", *texts]).slice(1)
    assert phrases.words_of(sliced)[0].equals(words)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("one", "en")], "text string, lang string")).count() == 0


def test_phrases_are_numbered_only_where_open(monkeypatch):
    words, follows = phrases.words_of(pa.array(["a b c a b c a b c d"]))
    reached = np.ones(64, np.uint8)
    of = lambda open_after: {(r["phrase"], r["born"]): r["n"] for b in phrases.count_block("en", words, follows, reached, open_after, 4) for r in b.to_pylist()}
    assert of(0)["a b c", 1] == 3 and of(0)["b c a b", 1] == 2 and of(0)["a b c d", 1] == 1
    monkeypatch.setattr(np, "unique", None)
    assert of(1) == {}


def test_scans_send_hashes_and_no_count_falls_short(rows):
    """The cycle's rows are numbers alone; the hash of a phrase stands for all its occurrences, whatever its language's neighbours."""
    want, _ = counts_of(rows)
    reached, kept, hashes, follows = np.ones(64, np.uint8), np.zeros(64, bool), [], []
    kept[::3] = True
    for lang in ("en", "de"):
        words, after = phrases.words_of(pa.array([t for t, own in rows if own == lang]))
        hashes, follows = [*hashes, phrases._word_hashes(lang, words.to_pylist())], [*follows, after]
    got = Counter()
    for batch in phrases.count_hashes(np.concatenate(hashes), np.concatenate(follows), reached, -1, 4):
        assert batch.schema.names == ["hash", "k", "born", "n"] and all(pa.types.is_integer(t) for t in batch.schema.types)
        for r in batch.to_pylist():
            got[r["k"], r["hash"] & (1 << 64) - 1] += r["n"]
    expected = Counter()
    for (lang, p), n in want.items():
        if lang in ("en", "de"):
            value = phrases._word_hashes(lang, [p[0].encode()])
            for w in p[1:]:
                value = phrases._longer_hash(value, phrases._word_hashes(lang, [w.encode()]))
            expected[len(p), int(value[0])] += n
            want[lang, p] = n, bool(kept[phrases.slot_of(value, 64)[0]])
    assert got == expected
    words, follows = phrases.words_of(pa.array([t for t, own in rows if own == "de"]))
    exact = {tuple(r["phrase"].split(" ")): r["n"] for b in phrases.count_block("de", words, follows, reached, -1, 4, np.packbits(kept, bitorder="little")) for r in b.to_pylist()}
    assert exact == {p: n[0] for (lang, p), n in want.items() if lang == "de" and n[1]}
