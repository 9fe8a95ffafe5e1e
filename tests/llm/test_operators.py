"""The training-data operators against brute force, on small tables with nulls, empty and repeated rows."""

import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxmill.llm import decontaminate, html, langid, lm, nearcopies, neighbours, packing, queries, simhash, store, substrings, urls
from voxmill.llm.dom import FEATURES, Page
from voxmill.llm.recompress import Words, contained, index, whole_windows
from voxmill.llm.tokens import Encoder, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Words from a small vocabulary, so that passages repeat; null, empty, blank, repeated and clashing rows."""
    rng = random.Random(3)
    passage = " ".join(rng.choice("abcdefghij") * 3 for _ in range(80))
    rows = [(i, " ".join(rng.choice(["x%d" % k for k in range(400)]) for _ in range(rng.randint(1, 200)))) for i in range(40)]
    rows += [(50 + i, rows[i][1] + "\n" + passage + " tail%d" % i) for i in range(8)]
    rows += [(70, None), (71, ""), (72, " \t\n"), (None, passage), (None, None), (73, rows[0][1]), (73, rows[0][1]), (74, "w " * 500), (75, "w " * 300), (76, passage), (76, passage + " more")]
    return spark.createDataFrame([(d, t, "en", 1, 2) for d, t in rows], "doc_id long, text string, lang string, id int, kept int")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    said = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF).select(said.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, said.fetchall()))


def brute_components(fps):
    keys = sorted(set(fps))
    group = {k: k for k in keys}
    for a, b in itertools.combinations(keys, 2):
        if (a ^ b).bit_count() <= 3 and group[a] != group[b]:
            old, new = group[b], group[a]
            group = {k: new if g == old else g for k, g in group.items()}
    return group


def test_simhash(spark, odd):
    def fp(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = texts(odd)
    group = brute_components([fp(t) for _, t in rows])
    least = {}
    for d, t in rows:
        if d is not None:
            g = group[fp(t)]
            least[g] = min(least.get(g, d), d)
    said = sorted(((d, fp(t), least.get(group[fp(t)])) for d, t in rows), key=str)
    found = simhash.near_duplicates(odd).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found), key=str) == said
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(group.values()))


def test_links_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng, base = random.Random(5), 0x123456789ABCDEF0
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    group, said = {k: k for k in fps}, brute_components(fps)
    for e in edges:
        a, b = group[e.u % 2**64], group[e.v % 2**64]
        group = {k: a if g == b else g for k, g in group.items()}
    assert len(set(group.values())) == len(set(said.values()))


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 400)
    rng, rows = random.Random(6), []
    for g in range(12):
        base = ["w%d" % rng.randint(0, 3000) for _ in range(rng.randint(30, 200))]
        for _ in range(6):
            own = list(base)
            for k in rng.sample(range(len(own)), rng.randint(0, len(own) // 25)):
                own[k] = "v%d" % rng.randint(0, 3000)
            rows.append((len(rows), " ".join(own)))
    rows += [(100, None), (101, " "), (102, "a b"), (103, "A  b"), (None, rows[0][1]), (0, rows[0][1]), (104, "a")]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            group = [group[a] if g == group[b] else g for g in group]
    firsts = {}
    for (d, _), g in zip(rows, group):
        firsts[g] = min(firsts.get(g, 999), 999 if d is None else d)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert 20 < len(firsts) < 60
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs).collect()) == sorted(firsts.values())
    import corpus_pipeline

    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == sorted(firsts.values())


@pytest.mark.parametrize("cell", [8, 3])
def test_near_copies_come_from_fingerprints(spark, monkeypatch, cell):
    """Pairs of J = 0.8 meet in the index of SimHash variants, also where many share a key; far ones are no candidates."""
    monkeypatch.setattr(nearcopies, "CELL", cell)
    monkeypatch.setattr(nearcopies, "CELL_BLOCK", 8)
    rng, rows, pairs = np.random.default_rng(5), [], []
    width, segments = nearcopies.plan(400)
    words = -(-(nearcopies.SKETCH + segments * 4 * width) // 64)
    for common, more in [(4, (0, 1)), (8, (1, 1)), (12, (0, 3)), (40, (5, 5)), (400, (50, 50)), (400, (0, 100))] * 20:
        base = rng.integers(0, 1 << 64, common, np.uint64)
        pairs.append((len(rows), len(rows) + 1))
        rows += [np.sort(np.concatenate([base, rng.integers(0, 1 << 64, n, np.uint64)])) for n in more]
    rows += [np.sort(np.append(rows[-1][:-1], np.uint64(k))) for k in range(30)]
    plain = [int.from_bytes(nearcopies.fingerprint(x, words), "big") for x in rows]
    data = [(k, len(x), plain[k].to_bytes(8 * words, "big"), nearcopies._small_keys(x)) for k, x in enumerate(rows)]
    distinct = spark.createDataFrame(data, "node long, n int, fp binary, small array<long>").repartition(3)
    found = {(r.u, r.v) for r in nearcopies.candidates(distinct, width, segments).collect()}
    assert all(bin((plain[u] ^ plain[v]) >> 64 * words - nearcopies.SKETCH).count("1") <= nearcopies.SKETCH_MOST for u, v in found)
    group = list(range(len(rows)))
    for u, v in found:
        group = [group[u] if g == group[v] else g for g in group]
    assert all(group[u] == group[v] for u, v in pairs) and len({group[k] for k in range(238, len(rows))}) == 1
    assert len(set(group)) == 120


def test_substrings(spark, odd):
    first, rows = {}, texts(odd)
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    said = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        said.append((str(d), len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    found = substrings.remove_repeats(odd).collect()
    assert sorted((str(r.id), r.n_words, r.n_removed, r.kept) for r in found) == sorted(said)


def test_whole_texts_stay_out_of_python_in_the_pipeline(spark, odd):
    every = {(str(r.id), r.text_key, r.n_removed, r.n_removed and r.kept, str(r.row)) for r in substrings.remove_repeats(odd).collect()}
    found = substrings.remove_repeats(odd, whole=False)
    rows = found.collect()
    assert {(str(r.id), r.text_key, r.n_removed, r.n_removed and r.kept, str(r.row)) for r in rows} == every and len(rows) == odd.count()
    assert sum(r.n_words is None for r in rows) > 30
    # a text goes to Python once, in its row
    sent = found._jdf.queryExecution().optimizedPlan().toString()
    call = next(line for line in sent.splitlines() if "MapInArrow" in line)
    assert call.count("text#") == 0 and call.count("row#") == 2, call
    numbers = odd.select("doc_id", F.length("text").alias("text"))
    assert sorted(r.n_words for r in substrings.remove_repeats(numbers).collect()) == sorted(int(t is not None) for _, t in texts(odd))


def test_every_window_holds_a_symbol_and_equal_windows_the_same():
    rng = random.Random(9)
    common = [b"%d" % rng.randint(0, 50) for _ in range(120)]
    docs = [[b"%d" % rng.randint(0, 500) for _ in range(150)] + common + [b"z%d" % k] * 90 for k in range(4)]
    words = Words.of(docs)
    name, left, right = index(words, 50)
    inside = contained(left, right, 50, len(words.hashes))
    assert inside[whole_windows(words, 50)].all()
    at = [d.index(common[0], 150) + words.first[k] for k, d in enumerate(docs)]
    seen = [{(int(n), int(a - s)) for n, a, b in zip(name, left, right) if a >= s and b <= s + 120} for s in at]
    assert all(x == seen[0] for x in seen) and seen[0]


def test_packing(spark, odd):
    enc = Encoder(vocabulary("byte_bpe_50k.json"), True)
    rows = packing.pack_documents(odd, vocabulary("byte_bpe_50k.json"), size=64).collect()
    windows = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    plain = sorted(np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for _, t in texts(odd))
    assert sum(r.length for r in rows) == sum(len(x) // 4 for x in plain)
    whole = sorted(r.ids for r in rows if r.start == 0 and r.length == r.doc_tokens)
    assert all(x in plain for x in whole) and whole


def test_best_fit_is_tightest():
    rng = random.Random(1)
    lengths = [rng.randint(1, 63) for _ in range(300)]
    windows, _ = packing.best_fit(lengths, 64)
    rooms, said = [], {}
    for i in sorted(range(300), key=lambda k: -lengths[k]):
        fits = [r for r in rooms if r >= lengths[i]]
        room = min(fits) if fits else 64
        if fits:
            rooms.remove(room)
        rooms.append(room - lengths[i])
    said = sum(rooms)
    assert 64 * (max(windows) + 1) - sum(lengths) == said


def test_encoder_equals_the_library():
    odd_texts = ["", "  a  b \n\n c\t d ", " x", "x ", "it's  we're \n 12 34<|endoftext|> x", "é Σας \x1c b\x85 c", "\n", "\n \n a", "Le\nMot, dit: Été! ÜBER", "a\nb\n\nc"]
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        enc = Encoder(vocabulary(name), spaces)
        for _ in range(2):
            assert enc.encode(odd_texts) == [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd_texts]


def test_encoder_meets_a_word_once_in_lower_case(monkeypatch):
    encode, seen = Encoder(vocabulary("word_bpe_49k.json"), False), []
    unit = encode._unit
    monkeypatch.setattr(encode, "_unit", lambda text: seen.append(text) or unit(text))
    rows = ["Word word. WORD,\nWord\n'word stra\u00dfe) Stra\u00dfe", "\u00c4hre \u00e4hre.\nword<|endoftext|> \u0130a \u0391\u03a3.\n\u0301e", None, ""]
    found = encode.encode(rows)
    assert sorted(seen) == sorted(["word", "stra\u00dfe", "\u00e4hre", ".", ",", ")"])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [encode.tokenizer.encode(x or "", add_special_tokens=False).ids for x in rows]


def test_store_round_trip(spark, odd, tmp_path):
    path = str(tmp_path / "store")
    store.write_store(odd, path, vocabulary("word_bpe_49k.json"))
    enc = Encoder(vocabulary("word_bpe_49k.json"), False)
    said = sorted([*np.frombuffer(x, "<u4").tolist(), 2] for x in enc.encode([t for _, t in texts(odd)]))
    back = store.read_store(spark, path).collect()
    assert sorted(r.ids for r in back) == said
    digest = {(r.start, r.n_tokens, r.ids_crc32) for r in store.store_digest(spark, path).collect()}
    assert digest == {(r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in back}
    ends = sorted((r.start, r.start + r.n_tokens) for r in back)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    ids = [r.doc_id for r in sorted(back, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)
    hashes = [bytes(r.hash) for r in spark.read.parquet(f"{path}/blocks").where("kind = 'chunk'").collect()]
    assert len(hashes) == len(set(hashes))


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.held_out()
    found = langid.identify(docs.withColumn("held", held), langid.learn(docs.where(~held))).where("held and lang is not null")
    n, good = found.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert good / n > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "the and of that")], "doc_id long, text string")
    r = {x.doc_id: x.lang_pred for x in langid.identify(odd, {"en": b"the and of that", "fr": b"les des que dans"}).collect()}
    assert r == {1: "und", 2: "und", 3: "und", 4: "en"}


def test_lm(spark, odd):
    found = lm.score(odd).collect()
    words = [(t or "").encode().lower().split() for _, t in texts(odd)]
    cell = lambda w: xxhash.xxh3_64_intdigest(w) >> 46
    from collections import Counter

    single, pairs = Counter(cell(w) for own in words for w in own), Counter(p for own in words for p in zip(own, own[1:]))
    total, said = sum(single.values()), []
    for (d, _), own in zip(texts(odd), words):
        score = 0.0
        for i, w in enumerate(own):
            known = i and pairs[own[i - 1], w] >= lm.LEAST_COUNT
            score += np.log(pairs[own[i - 1], w] / single[cell(own[i - 1])]) if known else np.log((lm.ALPHA if i else 1) * single[cell(w)] / total)
        said.append((str(d), len(own), round(score / len(own), 6) if own else None))
    assert sorted(((str(r.doc_id), r.n_words, None if r.score is None else round(r.score, 6)) for r in found), key=str) == sorted(said, key=str)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_against_counts_of_the_words(spark, odd, order, monkeypatch):
    from collections import Counter

    # Words that share 32 or 18 bits of their hash with others would merge in cells or short keys; 30,000 words do in cells.
    many = spark.createDataFrame([(1000 + i, " ".join("q%d" % (i * 100 + k) for k in range(100))) for i in range(300)] + [(2000, "q7"), (2001, "q7 q8"), (2002, "Q7 q8 q9")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(many)
    for hot in (2000, 3):
        monkeypatch.setattr(lm, "HOT", hot)
        found = lm.score(docs, order).collect()
        words = [(t or "").encode().lower().split() for _, t in texts(docs)]
        count = Counter(tuple(own[i : i + n]) for own in words for n in range(1, order + 1) for i in range(len(own) - n + 1))
        total, said = sum(map(len, words)), []
        for (d, _), own in zip(texts(docs), words):
            score = 0.0
            for i in range(len(own)):
                n, factor = min(i + 1, order), 1.0
                while n > 1 and not count[tuple(own[i + 1 - n : i + 1])]:
                    n, factor = n - 1, factor * lm.ALPHA
                gram = tuple(own[i + 1 - n : i + 1])
                score += np.log(factor * count[gram] / (count[gram[:-1]] if n > 1 else total))
            said.append((str(d), len(own), max(len(own) - 1, 0), round(score / len(own), 6) + 0.0 if own else None))
        assert sorted(((str(r.doc_id), r.n_words, r.n_seen, None if r.score is None else round(r.score, 6) + 0.0) for r in found), key=str) == sorted(said, key=str)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).round(2).tolist()) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(60)]
    bad = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] * 8), (905, [float("inf")] * 8), (None, [1.0] * 8), (300, [0.5] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    x = np.array([v for _, v in rows])
    for q in range(0, 360, 20):
        s = np.add.accumulate(x * x[q], axis=1)[:, -1]
        s[q] = -np.inf
        assert found[q] == np.lexsort((np.arange(360), -s))[:5].tolist()


def test_neighbours_of_many_equal_vectors():
    import pandas as pd

    rng = np.random.default_rng(4)
    for trial in range(60):
        width, n = int(rng.integers(20, 130)), int(rng.integers(400, 1500))
        x = rng.standard_normal((n, width))
        x[rng.choice(n, 61, replace=False)] = x[0]
        q = np.concatenate([x[:1] + 0.1 * rng.standard_normal((60, width)), x[:1]])
        rows, asks = pd.DataFrame({"vec_id": rng.permutation(n), "v": list(x)}), pd.DataFrame({"vec_id": n + np.arange(len(q)), "v": list(q)})
        found = neighbours._best(asks, rows, width, 20).groupby("query_id")["vec_id"].apply(set)
        for i, v in enumerate(q):
            s = np.add.accumulate(x * v, axis=1)[:, -1]
            assert found[n + i] == set(rows["vec_id"].to_numpy()[np.lexsort((rows["vec_id"], -s))[:20]].tolist()), trial


def test_html(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html.learn(pages)
    source = """<html><body><header><p>Site of many things and words</p></header><nav><ul><li><a href=1>Home</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies, as all do, you know.</p></div><div class="wrapper"><main><h1>The head&amp;line</h1>
    <p>First  <b>bold</b> words of the real text, which goes on for a while here.<p>Second&nbsp;part of the real text, with more words in it.</p></main>
    <aside class="sidebar"><p>Other stories that you may like to read today.</p></aside></div><div id="comments"><h3>Comments</h3><p>I like this text very much, thank you.</p></div>
    <form action="/s"><p>Search for it</p><input></form><footer><p>All rights reserved by us.</p></footer></body></html>"""
    rows = spark.createDataFrame([(1, "u", source, "t"), (2, None, None, None), (3, "", "", ""), (4, "v", "<p>unclosed <b>and <i>broken", "")], "page_id long, url string, html string, text string")
    found = {r.page_id: r for r in html.extract(rows, model).collect()}
    assert found[1].text == "The head&line\nFirst bold words of the real text, which goes on for a while here.\nSecond part of the real text, with more words in it."
    assert found[2].text == "" and found[3].n_chars == 0
    whole = {r.page_id: r.text for r in html.extract(pages, model).select("page_id", "text").collect()}
    for r in pages.limit(50).collect():
        inner = Page(re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1])
        assert whole[r.page_id] == inner.main_text(np.ones(len(inner.elements), bool))


def test_features_of_many_siblings_and_of_blank_runs():
    page = Page("<div>" + "".join(f"<p>{'x' * (i + 1)}</p>" for i in range(60)) + "</div>")
    found, left, right = page.features(), FEATURES.index("text left"), FEATURES.index("text right")
    for i in range(60):  # elements: html, div, then the paragraphs
        assert found[2 + i, left] == np.log1p(i) and found[2 + i, right] == (np.log1p(i + 2) if i < 59 else 0)
    blank, tight = Page(f"<div>{' ' * 100}<p>a b{chr(10) * 100}c</p>{' ' * 100}</div>"), Page("<div><p>abc</p></div>")
    assert [(e.own, e.link) for e in blank.elements] == [(e.own, e.link) for e in tight.elements] == [(0, 0), (0, 0), (3, 0)]
    assert (blank.features() == tight.features()).all()


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.COM/en/77?x"), (4, "http://example.com"), (5, "http://notexample.com/en/7"), (6, "ftp://x.net/de/1#y"), (7, "http://my-casino.org/")]
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.HOST_RULES, urls.WORD_RULES).collect()}
    assert found[1] == found[2] == ("", "", None, "allow")
    assert found[3] == ("a.example.com", "/en/77", "example.com/en/7", "allow")
    assert found[4][3] == "allow" and found[5][2] == "com/en/" and found[6][2] == "net/de/" and found[7][3] == "block"


def test_decontamination_of_short_items_and_nulls(spark):
    docs = spark.createDataFrame([(1, "One TWO three four"), (2, None), (3, "x " * 30), (None, "two three"), (1, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "two three"), (10, "Two, three!"), (8, None), (9, " ")], "item_id long, text string")
    found = {(r.doc_id, r.n_words): (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert found == {(1, 4): (2, ["10", "7"]), (2, 0): (0, []), (3, 30): (0, []), (None, 2): (2, ["10", "7"]), (1, 1): (0, [])}
    assert decontaminate.contamination(docs, items.limit(0)).count() == 5


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0 and lm.score(none).count() == 0
    assert packing.pack_documents(none, vocabulary("byte_bpe_50k.json")).count() == 0
    assert langid.identify(none, langid.learn(none)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 100
    assert decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
    pieces = pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == seen[-1]


def test_pipeline_stages_get_small_batches(spark):
    import pyarrow as pa

    import corpus_pipeline as pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    probe = pipeline._in_small_batches(lambda spark, docs, _: docs.mapInArrow(sizes, "n long").agg(F.max("n"), F.sum("n")))
    docs = spark.range(0, 9000, 1, 1).select("id", F.repeat(F.lit("ab "), 1000).alias("text"))
    try:
        most, total = probe(spark, docs, SF).first()
        assert most < 1.5 * pipeline.BATCH_BYTES < total
        spark.conf.set(key, "1m")
        assert probe(spark, docs, SF).first()[0] < 1_600_000
    finally:
        spark.conf.set(key, before)


def test_tokens_equal_the_plain_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    bits = ["a", "the", "Été", "it's", " ", "  ", "\n", "\t", "<|endoftext|>", "<|startoftext|>", "12", ".", "!?", "’", "\xa0", "\r\n", "中文", "WORD", "İ", "🙂", " and"]
    texts_ = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        said = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(vocabulary(name)).encode_batch(texts_, add_special_tokens=False)]
        enc = Encoder(vocabulary(name), spaces)
        assert [x for i in range(0, 3000, 500) for x in enc.encode(texts_[i : i + 500])] == said


def test_texts_without_a_letter_and_ties_are_undecided(spark):
    rows = spark.createDataFrame([(1, "²½①Ⅳ"), (2, "zz qq"), (3, "the and of that the and"), (3, "the and of that the and")], "doc_id long, text string")
    known = {"en": b"the and of that", "fr": b"les des que dans"}
    found = sorted((r.doc_id, r.lang_pred) for r in langid.identify(rows, known, 0.002).collect())
    assert found == [(1, "und"), (2, "und"), (3, "en"), (3, "en")]


def test_recall_of_the_curves(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q, own in got.items():
        s = x @ x[q]
        s[q] = -9
        hit += len({v for _, v, _ in own} & set(np.argpartition(-s, 20)[:20].tolist()))
        assert [k for k, _, _ in sorted(own)] == list(range(1, 21)) and all(abs(s[v] - score) < 1e-12 for _, v, score in own)
    print("recall of the curves", hit / (20 * 300))
    assert len(got) == 300 and hit / (20 * 300) >= 0.9


def test_merkle_proof_tells_a_changed_document(spark, tmp_path):
    import hashlib

    docs = spark.createDataFrame([(i, "word%d and more " % i * (i % 7)) for i in range(600)], "doc_id long, text string")
    path = str(tmp_path / "store")
    store.write_store(docs, path, vocabulary("word_bpe_49k.json"))
    store.check_manifest(spark, path)
    part = spark.read.parquet(f"{path}/recipes").where("part = 0").orderBy("row").collect()
    leaf = [hashlib.sha256(f"{k},{r.doc_id},{r.n_tokens},{bytes(r.root).hex().upper()}".encode()).hexdigest() for k, r in enumerate(part)]
    proof = store.merkle_proof(spark, path, 0, 5)
    assert proof[0][2] == hashlib.sha256(",".join(leaf[:256]).encode()).hexdigest()
    spark.read.parquet(f"{path}/recipes").withColumn("n_tokens", F.when(F.col("doc_id") == 3, 1).otherwise(F.col("n_tokens")).cast("long")).write.parquet(f"{path}/other")
    import shutil

    shutil.rmtree(f"{path}/recipes")
    shutil.move(f"{path}/other", f"{path}/recipes")
    with pytest.raises(ValueError):
        store.check_manifest(spark, path)


def test_registered_queries_return_their_columns(spark):
    """Digests of the registered queries against plain computation on the smallest tables."""
    import hashlib

    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = {r.doc_id: r for r in queries.QUERIES["op10_store"](spark, SF).collect()}
    library, at = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0
    for d in sorted(docs):
        ids = np.array([*library.encode(docs[d] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (found[d].start, found[d].n_tokens, found[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in docs.items()}
    pieces, windows = {}, {}
    for r in queries.QUERIES["op4_packing"](spark, SF).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, own in pieces.items():
        assert sum(n for _, n in own) == len(ids[d]) and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:]))
    assert set(pieces) == set(docs)
    fill = [sum(n for _, n in own) for own in windows.values()]
    assert max(fill) <= 1024 and sum(fill) / (1024 * len(fill)) > 0.9
    prints = {r.doc_id: r for r in queries.QUERIES["op2_simhash"](spark, SF).collect()}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        assert prints[d].fingerprint == "%016x" % sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert prints[d].component_id <= d
    first, removed = {}, {r.doc_id: r for r in queries.QUERIES["op8_substrings"](spark, SF).collect()}
    words = {d: (t or "").encode().split() for d, t in docs.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), d)
    for d, w in words.items():
        gone = {k for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for k in range(i, i + 50)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (removed[d].n_words, removed[d].n_removed, removed[d].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert queries.QUERIES["op6_langid"](spark, SF).columns == ["doc_id", "held_out", "lang_pred", "score"]
    scores = queries.QUERIES["op7_lm"](spark, SF)
    assert {"doc_id", "score"} <= set(scores.columns) and scores.count() == len(docs)
