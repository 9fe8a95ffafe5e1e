"""Entropy of the values around each voxel, by histograms that slide along the lines of a tile."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from voxmill.operators import tiles


def sliding_bits(at: np.ndarray, there: np.ndarray, radius: int, bins: int) -> np.ndarray:
    """Shannon bits of the bins ``at`` (z, y, x) in a disc in y and x, of voxels that are ``there``.

    All lines of the block keep a histogram each. A step along x adds what the disc's right edge meets and takes off what its
    left edge leaves: two voxels a row of the disc, however many bins and voxels it holds.
    """
    nz, ny, nx = at.shape
    slots = np.full((nz, ny + 2 * radius, nx), bins)  # the last slot takes what is missing and is not read
    slots[:, radius : radius + ny][there] = at[there]
    half = {dy: math.isqrt(radius * radius - dy * dy) for dy in range(-radius, radius + 1)}
    counts = np.zeros((nz * ny, bins + 1), np.int64)
    line = np.arange(nz * ny)

    def move(x: int, dy: int, by: int) -> None:
        if 0 <= x < nx:
            counts[line, slots[:, radius + dy : radius + dy + ny, x].ravel()] += by

    n = np.arange((2 * radius + 1) ** 2 + 1, dtype=float)
    weighted = n * np.log2(np.maximum(n, 1))
    bits = np.zeros((nz, ny, nx))
    for dy, w in half.items():
        for x in range(w):
            move(x, dy, 1)
    for x in range(nx):
        for dy, w in half.items():
            move(x + w, dy, 1)
            move(x - w - 1, dy, -1)
        seen = counts[:, :bins]
        total = np.maximum(seen.sum(axis=1), 1)
        bits[:, :, x] = np.abs(np.log2(total) - weighted[seen].sum(axis=1) / total).reshape(nz, ny)
    return bits


def entropy(vox: DataFrame, radius: int, bins: int, low: float, high: float, edge: int = tiles.EDGE) -> DataFrame:
    """VOXEL, bits: Shannon bits of the histogram in a disc of ``radius`` around each voxel, in its plane.

    ``bins`` bins of equal width from ``low`` to ``high``; values beyond count in the outer ones. Missing voxels do not count; a
    null or not-a-number value counts as 0; of repeated voxels one is taken; an empty table gives no rows.
    """

    def recipe(a: np.ndarray, block: tiles.Block) -> dict[str, np.ndarray]:
        at = np.floor((np.where(np.isnan(a), 0.0, a) - low) / (high - low) * bins)
        return {"bits": sliding_bits(np.clip(at, 0, bins - 1).astype(int), block.there, radius, bins)}

    return tiles.derived(vox, ["bits"], recipe, {"y": radius, "x": radius}, edge)
