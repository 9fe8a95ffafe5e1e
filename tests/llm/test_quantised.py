"""Near-duplicate vectors by product quantisation against all pairs."""

import random

import numpy as np
import pytest

from voxmill.llm import quantised

SF = "/root/testdata/sf0.001"


def brute(rows, least=0.93):
    """(vec_id, links, component) of (vec_id, vector, label) rows by all pairs."""
    good = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    units = {k: np.array(rows[k][1], np.float64) / np.linalg.norm(np.array(rows[k][1], np.float64)) for k in good}
    near = {k: set() for k in range(len(rows))}
    for i in good:
        for j in good:
            if i < j and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
                near[i].add(j)
                near[j].add(i)
    group = {}
    for k in range(len(rows)):
        if k not in group:
            members, stack = {k}, [k]
            while stack:
                new = near[stack.pop()] - members
                members |= new
                stack += new
            ids = [rows[m][0] for m in members if rows[m][0] is not None]
            group.update(dict.fromkeys(members, min(ids) if ids else None))
    return [(rows[k][0], len(near[k]), group[k], rows[k][0] is not None and rows[k][0] == group[k]) for k in range(len(rows))]


def cloud(rng, n, spread, size=24, groups=30):
    centres = rng.normal(size=(groups, size))
    return [(centres[rng.integers(groups)] + rng.normal(size=size) * spread).tolist() for _ in range(n)]


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("block", [1024, 16])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(quantised, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(i, v, i % 3) for i, v in enumerate(cloud(rng, 300, 0.15))]
    hot = rows[5][1]
    rows += [(1000 + i, hot, rows[5][2]) for i in range(50)] + [(2000, [2 * x for x in hot], rows[5][2]), (2001, hot, None), (None, hot, rows[5][2]), (7, rows[7][1], rows[7][2])]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 24, 1), (3003, [None] + hot[1:], 1), (3004, [float("nan")] + hot[1:], 1), (3005, [float("inf")] + hot[1:], 1), (3006, hot[:8], rows[5][2]), (3007, hot[:8], rows[5][2]), (3008, hot * 3, 1), (None, None, None), (None, rng.normal(size=24).tolist(), 2)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n int")
    found = [tuple(r) for r in quantised.near_vectors(table).collect()]
    assert ordered(found) == ordered(brute(rows))


def test_probes_of_few_lists_reach_most_links(spark, monkeypatch):
    """Evenly spread vectors with near copies: recall of links over 0.99, none too many."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(3000, 64))
    near = base[rng.integers(0, 3000, 1000)] + rng.normal(size=(1000, 64)) * 0.3
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, near]))]
    units = np.array([r[1] for r in rows])
    units /= np.linalg.norm(units, axis=1)[:, None]
    want = ((units @ units.T) >= 0.93).sum(axis=1) - 1
    seen = []
    fit = quantised.fit
    monkeypatch.setattr(quantised, "fit", lambda *a: seen.append(fit(*a)) or seen[-1])
    found = {r.vec_id: r.n_links for r in quantised.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    got = np.array([found[i] for i in range(len(rows))])
    assert (got <= want).all() and want.sum() > 1000
    assert got.sum() / want.sum() > 0.99
    assert seen[0].reach < seen[0].radius  # fewer probes than the guarantee takes


def test_table_look_up_loses_no_pair():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(500, 30))
    rows = np.concatenate([rows, rows + rng.normal(size=rows.shape) * 0.2])
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    index = quantised.Quantiser(rows, 12, float(np.sqrt(2 - 2 * 0.93)))
    own, codes, errors = index.encode(rows)
    near = rows @ rows.T >= 0.93
    for at in range(12):
        inside = np.flatnonzero(own == at)
        candidates = index.candidates(index.tables(rows, at), codes[inside], errors[inside])
        assert (candidates | ~near[:, inside]).all()
        assert candidates.mean() < 0.9
    # a partner in another list lies beyond the plane between both centres
    margins = index.margins(rows, own)
    a, b = np.nonzero(near)
    assert (margins[a, own[b]] <= index.radius + 1e-9).all()


def test_no_rows(spark):
    assert quantised.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    nothing = spark.createDataFrame([(1, None, 1), (2, [1.0], None)], "vec_id long, embedding array<float>, label int")
    assert ordered(map(tuple, quantised.near_vectors(nothing).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_query_over_embeddings(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = ordered(tuple(r) for r in quantised.op13_near_vectors(spark, SF).collect())
    want = ordered(brute(rows))
    links = sum(w[1] for w in want)
    assert len(found) == len(want) and (links == 0 or sum(f[1] for f in found) / links >= 0.95)
