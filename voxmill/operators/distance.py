"""Exact Euclidean distances to reference voxels: along each axis the lower envelope of parabolas, linear in a line's length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.sources.tables import VOXEL

IMAGE = ["image_id", "t", "c"]
#: Cells of the lines that one task holds at once.
CELLS = 1 << 19


def envelope(d: np.ndarray) -> np.ndarray:
    """min over j of d[:, j] + (i - j) ** 2 at each place i of each line; infinite where a line has nothing.

    All lines advance together: each keeps a stack of the parabolas that are lowest somewhere and where each of them begins; a
    new one takes off those that it hides. A parabola goes on and comes off once, so the work is linear in a line's length.
    """
    n_lines, n = d.shape
    at, begins, top = np.zeros((n_lines, n), np.int64), np.full((n_lines, n + 1), np.inf), np.full(n_lines, -1)
    for q in range(n):
        new = np.flatnonzero(np.isfinite(d[:, q]))
        start, left = np.full(n_lines, -np.inf), new
        while len(left := left[top[left] >= 0]):
            k = top[left]
            p = at[left, k]
            meet = (d[left, q] + q * q - d[left, p] - p * p) / (2 * (q - p))
            hidden = meet <= begins[left, k]
            start[left[~hidden]] = meet[~hidden]
            left = left[hidden]
            top[left] -= 1
        top[new] += 1
        at[new, top[new]], begins[new, top[new]] = q, start[new]
    found, now, lines = np.full((n_lines, n), np.inf), np.zeros(n_lines, np.int64), np.flatnonzero(top >= 0)
    for i in range(n):
        moving = lines
        while len(moving := moving[(now[moving] < top[moving])]) and len(moving := moving[begins[moving, now[moving] + 1] <= i]):
            now[moving] += 1
        p = at[lines, now[lines]]
        found[lines, i] = d[lines, p] + (i - p) ** 2
    return found


def _pass(found: DataFrame, axis: str, edges: dict[str, int], most: int | None) -> DataFrame:
    """``found`` (VOXEL, d2, box) after the pass along ``axis``: a row for every place of its lines in the box. Bundles of
    neighbouring lines meet in one task, fewer the longer they are."""
    others = [a for a in ("z", "y", "x") if a != axis]
    side = max(1, int((CELLS / max(1, edges[axis])) ** 0.5))
    keys = [F.floor(F.col(a) / side).alias(f"b{a}") for a in others]

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = int(pdf["box"].iloc[0][axis][0]), int(pdf["box"].iloc[0][axis][1])
        lines, line = np.unique(pdf[others].to_numpy(np.int64), axis=0, return_inverse=True)
        d = np.full((len(lines), high - low + 1), np.inf)
        d[line.reshape(-1), pdf[axis].to_numpy(np.int64) - low] = pdf["d2"]
        d = envelope(d)
        row, place = np.nonzero(np.isfinite(d) if most is None else d <= most)
        out = {k: np.full(len(row), pdf[k].iloc[0]) for k in IMAGE} | {axis: place + low, "d2": d[row, place].astype(np.int64)}
        return pd.DataFrame(out | {a: lines[row, i] for i, a in enumerate(others)} | {"box": [pdf["box"].iloc[0]] * len(row)})

    shape = ", ".join(f"{k} {found.schema[k].dataType.simpleString()}" for k in [*VOXEL, "d2", "box"])
    return found.groupBy(*IMAGE, *keys).applyInPandas(lambda pdf: spread(pdf)[[*VOXEL, "d2", "box"]], shape)


def squared_distances(vox: DataFrame, reference: DataFrame, most: int | None = None) -> DataFrame:
    """(VOXEL, d2): the squared distance from each place of an image's box to the nearest voxel of ``reference`` in the same
    image, frame and channel; only those up to ``most``, if given. Without a reference an image has no rows.

    The box is what ``vox`` and ``reference`` together span, and lines run over all of it, so a voxel that an image lacks hides no
    reference behind it. References alone enter the first pass. A null coordinate takes no part; repeated voxels count once.
    """
    axes = ("z", "y", "x")
    every = vox.select(*VOXEL).union(reference.select(*VOXEL))
    bounds = every.groupBy(*IMAGE).agg(*(f(a).cast("long").alias(f"{a}{i}") for a in axes for i, f in enumerate((F.min, F.max))))
    edges = bounds.agg(*(F.max(F.col(f"{a}1") - F.col(f"{a}0") + 1).alias(a) for a in axes)).first().asDict()
    box = F.struct(*(F.array(f"{a}0", f"{a}1").alias(a) for a in axes))
    found = reference.select(*VOXEL).dropna().distinct().join(bounds.select(*IMAGE, box.alias("box")), IMAGE).withColumn("d2", F.lit(0).cast("long"))
    for axis in reversed(axes):
        found = _pass(found, axis, {a: n or 1 for a, n in edges.items()}, most)
    return found.select(*VOXEL, "d2")


def distance_map(vox: DataFrame, reference: Column) -> DataFrame:
    """``d2`` of every voxel: squared distance to the nearest voxel of its image, frame and channel for which ``reference``
    holds, at any distance; null where there is none."""
    return vox.select(*VOXEL).join(squared_distances(vox, vox.where(reference)), VOXEL, "left")


def within(vox: DataFrame, reference: DataFrame, radius: int) -> DataFrame:
    """Voxels with a reference voxel of the same image, frame and channel within ``radius``."""
    return vox.join(squared_distances(vox, reference, radius * radius).select(*VOXEL), VOXEL, "left_semi")


def nearest_distance(vox: DataFrame, reference: DataFrame, radius: int) -> DataFrame:
    """``vox`` with ``d2``: squared distance to the nearest reference voxel of the same image, frame and channel within
    ``radius``, else null."""
    return vox.join(squared_distances(vox, reference, radius * radius), VOXEL, "left")
