"""Kernels along the lines of an image: derivatives, smoothing, eigenvalues in tiles; rescaling one axis after the other.

For rescaling, a line (all voxels that differ in one coordinate alone) is held as one array, bounded by the image's edge.
Beyond its ends a line is mirrored, the edge not repeated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.operators import tiles
from voxmill.sources.tables import VOXEL

#: Offsets and weights of central differences.
FIRST, SECOND = {-1: -0.5, 1: 0.5}, {-1: 1.0, 0: -2.0, 1: 1.0}


def mirrored(i: Column, n: Column) -> Column:
    """Place inside 0..n-1 that the place i shows."""
    period = F.greatest(F.lit(1), 2 * (n - 1))
    r = F.pmod(i, period)
    return F.when(r < n, r).otherwise(period - r)


def taps(weights: dict[int, float]) -> Callable[[Column, Column, Column], Column]:
    """Weighted sum of the values at fixed offsets."""

    def at(values: Column, i: Column, n: Column) -> Column:
        return sum((F.get(values, mirrored(i + o, n)) * w for o, w in weights.items()), F.lit(0.0))

    return at


def _field(name: str) -> Callable[[Column], Column]:
    return lambda p: p[name]


def along(vox: DataFrame, axis: str, outs: dict[str, tuple[str, Callable]], keep: Iterable[str] = ("val",)) -> DataFrame:
    """``vox`` with columns ``outs`` (name: source column and f(values of the line, place, length)) beside those of ``keep``."""
    keys, keep = [k for k in VOXEL if k != axis], list(keep)
    sources = list(dict.fromkeys([*keep, *(c for c, _ in outs.values())]))
    line = vox.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(axis, *sources))).alias("line"))
    line = line.select(*keys, *(F.transform("line", _field(c)).alias(f"_{c}") for c in (axis, *sources)))
    n = F.size(f"_{axis}")
    fields = F.transform(f"_{axis}", lambda p, i: F.struct(p.alias(axis), *(F.get(f"_{c}", i).alias(c) for c in keep), *(f(F.col(f"_{c}"), i, n).alias(name) for name, (c, f) in outs.items())))
    return line.select(*keys, F.inline(fields)).select(*VOXEL, *keep, *outs)


def gaussian(vox: DataFrame, sigmas: dict[str, float]) -> DataFrame:
    """Smoothed along each axis with its sigma (0: left as it is)."""
    return tiles.derived(vox, ["val"], lambda a, block: {"val": block.smooth(a, sigmas)}, tiles.reach_of(sigmas))


def box_mean(vox: DataFrame, radii: dict[str, int]) -> DataFrame:
    """Mean over the part of a box that lies inside the image; sum and count go along one axis after the other."""

    def recipe(a: np.ndarray, block: tiles.Block) -> dict[str, np.ndarray]:
        weight = np.ones_like(a)
        for axis, radius in radii.items():
            kept = block.there
            a, weight = block.sums(a, axis, radius), block.sums(weight, axis, radius)
            a, weight = np.where(kept, a, 0), np.where(kept, weight, 0)
        return {"val": a / np.maximum(weight, 1)}

    return tiles.derived(vox, ["val"], recipe, radii)


def _derivatives(a: np.ndarray, block: tiles.Block, axes: list[str]) -> dict[str, np.ndarray]:
    """``g{a}`` and, for each pair of axes in the given order, ``d{a}{b}``."""
    number = {axis: tiles.AXES.index(axis) for axis in axes}
    found = {f"g{axis}": block.taps(a, number[axis], FIRST) for axis in axes}
    for i, axis in enumerate(axes):
        found[f"d{axis}{axis}"] = block.taps(a, number[axis], SECOND)
        found |= {f"d{before}{axis}": block.taps(found[f"g{before}"], number[axis], FIRST) for before in axes[:i]}
    return found


def eigenvalues(entries: dict[tuple[str, str], Column], axes: list[str]) -> list[Column]:
    """Eigenvalues of a symmetric 2 x 2 or 3 x 3 matrix, largest first, in closed form."""
    a, b = axes[0], axes[1]
    if len(axes) == 2:
        half, root = (entries[a, a] + entries[b, b]) / 2, F.sqrt(((entries[a, a] - entries[b, b]) / 2) ** 2 + entries[a, b] ** 2)
        return [half + root, half - root]
    c = axes[2]
    q = (entries[a, a] + entries[b, b] + entries[c, c]) / 3
    x, y, z = entries[a, a] - q, entries[b, b] - q, entries[c, c] - q
    d, e, f = entries[a, b], entries[a, c], entries[b, c]
    p = F.sqrt((x * x + y * y + z * z + 2 * (d * d + e * e + f * f)) / 6)
    det = x * (y * z - f * f) - d * (d * z - f * e) + e * (d * f - y * e)
    r = F.when(p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))).otherwise(0.0)
    phi = F.acos(r) / 3
    first, last = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return [first, 3 * q - first - last, last]


def hessian(vox: DataFrame, sigmas: dict[str, float]) -> DataFrame:
    """Absolute eigenvalues ``e0 >= e1 (>= e2)`` of the second derivatives at a scale; the axes are those of ``sigmas``."""
    axes = list(sigmas)
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    d = tiles.derived(vox, [f"d{a}{b}" for a, b in pairs], lambda a, block: _derivatives(block.smooth(a, sigmas), block, axes), tiles.reach_of(sigmas, 1))
    values = eigenvalues({(a, b): F.col(f"d{a}{b}") for a, b in pairs}, axes)
    return d.withColumn("e", F.sort_array(F.array(*(F.abs(v) for v in values)), asc=False)).select(*VOXEL, *(F.get("e", i).alias(f"e{i}") for i in range(len(axes))))


def structure(vox: DataFrame, sigmas: dict[str, float]) -> DataFrame:
    """Eigenvalues, largest first, of the smoothed products of gradients (gradient and integration at the same scale)."""
    axes = list(sigmas)
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]

    def recipe(a: np.ndarray, block: tiles.Block) -> dict[str, np.ndarray]:
        a = block.smooth(a, sigmas)
        g = {axis: block.taps(a, tiles.AXES.index(axis), FIRST) for axis in axes}
        return {f"p{a}{b}": block.smooth(g[a] * g[b], sigmas) for a, b in pairs}

    reach = {axis: 2 * r + 1 for axis, r in tiles.reach_of(sigmas).items()}
    smooth = tiles.derived(vox, [f"p{a}{b}" for a, b in pairs], recipe, reach)
    values = eigenvalues({(a, b): F.col(f"p{a}{b}") for a, b in pairs}, axes)
    return smooth.select(*VOXEL, *(v.alias(f"e{i}") for i, v in enumerate(values)))


def laplacian_and_edges(vox: DataFrame, sigmas: dict[str, float]) -> DataFrame:
    """Sum of the second derivatives, and length of the gradient, at a scale."""
    axes = list(sigmas)

    def recipe(a: np.ndarray, block: tiles.Block) -> dict[str, np.ndarray]:
        d = _derivatives(block.smooth(a, sigmas), block, axes)
        return {"laplacian": sum(d[f"d{x}{x}"] for x in axes), "edge": np.sqrt(sum(d[f"g{x}"] ** 2 for x in axes))}

    return tiles.derived(vox, ["laplacian", "edge"], recipe, tiles.reach_of(sigmas, 1))


def derivative(vox: DataFrame, orders: dict[str, int], sigmas: dict[str, float]) -> DataFrame:
    """Mixed derivative of any order along each axis, at a scale."""

    def recipe(a: np.ndarray, block: tiles.Block) -> dict[str, np.ndarray]:
        a = block.smooth(a, sigmas)
        for axis, order in orders.items():
            for k in [2] * (order // 2) + [1] * (order % 2):
                a = block.taps(a, tiles.AXES.index(axis), SECOND if k == 2 else FIRST)
        return {"val": a}

    reach = tiles.reach_of(sigmas)
    return tiles.derived(vox, ["val"], recipe, {a: reach.get(a, 0) + (orders.get(a, 0) + 1) // 2 for a in {*reach, *orders}})


def rescaled(vox: DataFrame, factors: dict[str, int], cubic: bool = False) -> DataFrame:
    """Values at a grid ``factors`` times coarser, by linear (2 taps an axis) or cubic (4 taps) interpolation at the centre
    of each coarse voxel; voxels that are cut off at the end of an axis go."""
    for axis, b in factors.items():
        if b == 1:
            continue
        at = (b - 1) / 2
        low, part = math.floor(at), at - math.floor(at)
        if cubic:  # Catmull-Rom
            t = part
            weights = {-1: -t / 2 + t * t - t**3 / 2, 0: 1 - 2.5 * t * t + 1.5 * t**3, 1: t / 2 + 2 * t * t - 1.5 * t**3, 2: -t * t / 2 + t**3 / 2}
        else:
            weights = {0: 1 - part, 1: part}
        f = taps({low + o: w for o, w in weights.items() if w})
        whole = along(vox, axis, {"val_": ("val", f), "n": ("val", lambda v, i, n: n)}, ())
        place = F.floor(F.col(axis) / b)
        vox = whole.where((F.col(axis) % b == 0) & (place < F.floor(F.col("n") / b))).withColumn(axis, place).select(*VOXEL, F.col("val_").alias("val"))
    return vox


def up_sampled(coarse: DataFrame, factors: dict[str, int]) -> DataFrame:
    """Values of a coarse image at each place of a fine one, linear along each axis: at (p - (b - 1) / 2) / b, kept between the
    first and the last coarse voxel."""
    for axis, b in factors.items():
        if b == 1:
            continue
        keys = [k for k in VOXEL if k != axis]
        line = coarse.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(axis, "val"))).alias("line"))
        line = line.select(*keys, F.transform("line", lambda p: p["val"]).alias("v"))
        at = F.greatest(F.lit(0.0), F.least((F.size("v") - 1).cast("double"), (F.col("p") - (b - 1) / 2) / b))
        base = F.floor(at).cast("int")
        value = F.get("v", base) * (1 - (at - base)) + F.coalesce(F.get("v", base + 1), F.lit(0.0)) * (at - base)
        places = line.withColumn("p", F.explode(F.sequence(F.lit(0), F.size("v") * b - 1)))
        coarse = places.select(*keys, F.col("p").cast("long").alias(axis), value.alias("val")).select(*VOXEL, "val")
    return coarse
