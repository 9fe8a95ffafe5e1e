"""Kernels over tiles: every voxel goes to the few tiles whose grown box holds it, in one shuffle, and all images that a recipe
derives from a tile are made there together.

Lines of a tile end where an image's voxels end and are mirrored there, the edge not repeated; a voxel that is missing inside a
line takes the value before it. Values next to a tile's outer border are of no use and are cut off with it, so what is
returned does not hang on the tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators.kernels import gaussian_weights
from voxmill.sources.tables import VOXEL

AXES = ("z", "y", "x")
#: Edge of a tile along each axis: 262,144 voxels and their border in one task.
EDGE = 64


class Block:
    """The voxels of a tile with its border: ``low`` is its first place, ``there`` says which voxels exist."""

    def __init__(self, low: np.ndarray, there: np.ndarray):
        self.low, self.there = low, there
        self._lines: dict[int, tuple] = {}

    def _ends(self, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, length, value's place for each place) of each line along an axis, as arrays that broadcast."""
        if axis not in self._lines:
            n = self.there.shape[axis]
            first = self.there.argmax(axis)
            last = n - 1 - np.flip(self.there, axis).argmax(axis)
            place = np.arange(n).reshape([-1 if i == axis else 1 for i in range(3)])
            own = np.maximum.accumulate(np.where(self.there, place, -1), axis)
            first, last = np.expand_dims(first, axis), np.expand_dims(last, axis)
            self._lines[axis] = first, last - first + 1, np.where(own < 0, first, own)
        return self._lines[axis]

    def taps(self, a: np.ndarray, axis: int, weights: dict[int, float]) -> np.ndarray:
        """Weighted sum of the values at fixed offsets along an axis."""
        first, n, own = self._ends(axis)
        place = np.arange(a.shape[axis]).reshape([-1 if i == axis else 1 for i in range(3)]) - first
        period = np.maximum(1, 2 * (n - 1))
        whole = (n == a.shape[axis]).all() and self.there.all()
        total = np.zeros_like(a)
        for offset, w in weights.items():
            at = (place + offset) % period
            at = np.where(at < n, at, period - at)
            if whole:  # every line is the tile's edge long
                total += w * np.take(a, at.reshape(-1) if at.size == a.shape[axis] else np.moveaxis(at, axis, 0)[:, 0, 0], axis)
            else:
                at = np.take_along_axis(own, np.broadcast_to(np.clip(at + first, 0, a.shape[axis] - 1), a.shape), axis)
                total += w * np.take_along_axis(a, at, axis)
        return total

    def smooth(self, a: np.ndarray, sigmas: dict[str, float]) -> np.ndarray:
        for axis, sigma in sigmas.items():
            if sigma > 0:
                w = gaussian_weights(sigma)
                a = self.taps(a, AXES.index(axis), {i - len(w) // 2: x for i, x in enumerate(w)})
        return a

    def sums(self, a: np.ndarray, axis: str, radius: int) -> np.ndarray:
        """Sums of what lies inside the image within ``radius`` along an axis."""
        k = AXES.index(axis)
        total = np.concatenate([np.zeros_like(np.take(a, [0], k)), np.cumsum(np.where(self.there, a, 0), k)], k)
        place = np.arange(a.shape[k])
        return np.take(total, np.minimum(place + radius + 1, a.shape[k]), k) - np.take(total, np.maximum(place - radius, 0), k)


def reach_of(sigmas: dict[str, float], more: int = 0) -> dict[str, int]:
    """Border that smoothing and ``more`` steps of a difference need along each axis."""
    return {a: (len(gaussian_weights(s)) // 2 if s > 0 else 0) + more for a, s in sigmas.items()}


def derived(vox: DataFrame, outs: Iterable[str], recipe: Callable[[np.ndarray, Block], dict[str, np.ndarray]], reach: dict[str, int], edge: int = EDGE) -> DataFrame:
    """VOXEL and the columns ``outs`` (double) that ``recipe`` makes from the values of a block (double, 0 where a voxel is
    missing), for the voxels of ``vox`` (VOXEL, val).

    One shuffle, whatever the recipe; a voxel goes to the tiles that lie within ``reach`` of it. A null val counts as 0; of
    repeated voxels one is taken; an empty table gives no rows.
    """
    outs, inner = list(outs), {f"t{a}": a for a in AXES}
    rows = vox.select(*VOXEL, F.coalesce(F.col("val").cast("double"), F.lit(0.0)).alias("val"))
    for t, a in inner.items():
        r = reach.get(a, 0)
        low, high = F.floor((F.col(a) - r) / edge), F.floor((F.col(a) + r) / edge)
        rows = rows.withColumn(t, F.explode(F.sequence(low, high)) if r else low)

    def compute(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[list(AXES)].to_numpy(np.int64)
        start = np.array(key[3:], np.int64) * edge
        own = ((at >= start) & (at < start + edge)).all(axis=1)
        if not own.any():  # a tile beyond the image's voxels
            return pd.DataFrame({k: [] for k in [*VOXEL, *outs]})
        low = at.min(axis=0)
        there = np.zeros(at.max(axis=0) - low + 1, bool)
        values = np.zeros(there.shape)
        place = tuple((at - low).T)
        there[place], values[place] = True, pdf["val"]
        made = recipe(values, Block(low, there))
        at = np.unique(at[own], axis=0)
        found = {k: np.full(len(at), key[i]) for i, k in enumerate(("image_id", "t", "c"))} | {a: at[:, i] for i, a in enumerate(AXES)}
        return pd.DataFrame(found | {o: made[o][tuple((at - low).T)] for o in outs})[[*VOXEL, *outs]]

    shape = ", ".join([*(f"{k} {vox.schema[k].dataType.simpleString()}" for k in VOXEL), *(f"{o} double" for o in outs)])
    return rows.groupBy("image_id", "t", "c", *inner).applyInPandas(compute, shape)
