import itertools
import os
import time

import numpy as np

from voxmill.llm import nearcopies
from voxmill.llm._common import shuffles_removed, written


def test_edges_of_a_large_group_grow_with_its_nodes(spark):
    """Keys after the first segment add no edge inside a group that is tied together already."""
    rng, width_segments = np.random.default_rng(3), nearcopies.plan(100_000)
    words = -(-(nearcopies.SKETCH + width_segments[1] * 4 * width_segments[0]) // 64)
    base, rows = rng.integers(0, 1 << 64, 200, np.uint64), []
    for _ in range(200):
        own = base.copy()
        own[rng.choice(200, 10, replace=False)] = rng.integers(0, 1 << 64, 10, np.uint64)
        rows.append(np.sort(own))
    data = [(k, len(x), nearcopies.fingerprint(x, words), []) for k, x in enumerate(rows)]
    distinct = spark.createDataFrame(data, "node long, n int, fp binary, small array<long>").repartition(3)
    edges = {(r.u, r.v) for r in nearcopies.candidates(distinct, *width_segments).collect()}
    group = list(range(200))
    for u, v in edges:
        group = [group[u] if g == group[v] else g for g in group]
    assert len(set(group)) == 1
    assert len({tuple(sorted(e)) for e in edges}) < 20 * 200


def test_a_tied_group_goes_out_once_for_each_block_of_others(spark, monkeypatch):
    """Rows of a key grow with its nodes, not with their square; nodes of two roots meet in a block, or two."""
    monkeypatch.setattr(nearcopies, "CELL_BLOCK", 50)
    for size, others in ((1000, 5), (2000, 5), (200, 120)):
        data = [(7, k, 0, 0, -1 if k < size else k % 40) for k in range(size + others)] + [(8, k, 0, 0, k % 2) for k in range(9)]
        rows = nearcopies._blocks(spark.createDataFrame(data, "key long, node long, s0 long, s1 long, root long")).collect()
        if others < 50:
            assert len([r for r in rows if r.key == 7]) == size + others * (size // 50 + 1)
        for key, nodes in ((7, range(size + others)), (8, range(9))):
            root, met = {k: r for x, k, _, _, r in data if x == key}, set()
            for pair in {(r.low, r.high) for r in rows if r.key == key}:
                both = [[r.node for r in rows if r.key == key and (r.low, r.high) == pair and r.block == b] for b in pair]
                met |= {frozenset(x) for x in itertools.product(*both)}
            assert all(frozenset((u, v)) in met for u, v in itertools.combinations(nodes, 2) if root[u] != root[v])


def _shuffle_files(spark) -> int:
    top = spark.sparkContext.getConf().get("spark.local.dir")
    return sum(f.startswith("shuffle_") for _, _, files in os.walk(top) for f in files)


def test_shuffle_files_go_with_their_job(spark):
    before, key = _shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    with shuffles_removed(spark):
        assert written(spark.range(1000).repartition(7, "id"), "any").count() == 1000
    assert spark.conf.get(key) == setting
    for _ in range(50):
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before
