"""Stupid backoff of documents that were not counted, against plain loops."""

import math
from collections import Counter

import pytest

from voxmill.llm import backoff, lm


@pytest.fixture(scope="module")
def counted(spark):
    texts = ["the cat sat on the mat", "The dog sat on the log", "a cat and a dog", None, "", "  \t ", "on", "the cat sat on the mat", "über alles Über"]
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, gram string"), texts


def plain(texts, other, order):
    """(words, words scored by two and more, mean log) of each text of ``other``."""

    def words(t):
        return [w.decode() for w in (t or "").encode().lower().split()]

    counts = Counter()
    for own in map(words, texts):
        counts.update(tuple(own[i - n : i]) for n in range(1, order + 1) for i in range(n, len(own) + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    for t in other:
        own, score, seen = words(t), 0.0, 0
        for i in range(len(own)):
            most = min(order, i + 1)
            for n in range(most, 0, -1):
                gram = tuple(own[i - n + 1 : i + 1])
                if gram in counts or n == 1:
                    share = counts[gram] / (counts[gram[:-1]] if n > 1 else total) if gram in counts else backoff.UNSEEN / total
                    score += math.log(share) + (most - n) * math.log(lm.ALPHA)
                    seen += n > 1
                    break
        yield len(own), seen, score / len(own) if own else None


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_other_documents_back_off(spark, counted, order):
    docs, texts = counted
    tables = backoff.count_tables(docs, order)
    other = ["the dog sat on the mat", "a mat sat on a cat", "zebra the zebra", "cat", None, "", "on the " * 4000, "the dog sat on the mat"]
    found = backoff.backoff(spark.createDataFrame(list(enumerate(other)), "doc_id long, text string"), tables, order)
    got = {r.doc_id: (r.n_words, r.n_seen, r.score) for r in found.collect()}
    for i, want in enumerate(plain(texts, other, order)):
        assert got[i][:2] == want[:2] and (got[i][2] == pytest.approx(want[2]) if want[2] is not None else got[i][2] is None)
    if order > 1:
        assert got[1][1] < got[1][0] - 1  # some words were left to the shorter history


def test_counted_documents_score_as_under_the_query(spark, counted):
    docs, _ = counted
    for order in (2, 3):
        want = {r.doc_id: (r.n_words, r.n_seen, r.score) for r in lm.score(docs, order).collect()}
        for r in backoff.backoff(docs, backoff.count_tables(docs, order), order).collect():
            assert want[r.doc_id][:2] == (r.n_words, r.n_seen)
            assert r.score == want[r.doc_id][2] or r.score == pytest.approx(want[r.doc_id][2])


def test_repeated_rows_null_ids_and_empty_tables(spark, counted):
    docs, _ = counted
    tables = backoff.count_tables(docs)
    rows = spark.createDataFrame([(1, "the cat"), (1, "the cat"), (1, "a dog"), (None, "the cat"), (None, None)], "doc_id long, text string")
    found = backoff.backoff(rows, tables).collect()
    assert len(found) == 5 and sorted(r.n_words for r in found) == [0, 2, 2, 2, 2]
    assert len({r.score for r in found if r.n_words}) == 2
    none = docs.where("doc_id < 0")
    assert backoff.count_tables(none).count() == 0 and backoff.backoff(none, tables).count() == 0
    assert {r.score for r in backoff.backoff(rows, backoff.count_tables(none)).collect()} == {None}
