"""The feature pyramid: a plan of names made from settings, computed level by level over tiles that swap their borders, and
scored."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators.kernels import bins, gaussian_weights, next_anisotropy
from voxmill.plans import forest as forests
from voxmill.sources.tables import VOXEL, written


@dataclass
class Settings:
    """What features there are. ``factors``: binning of each level, the last of which smooths instead."""

    factors: list[int] = field(default_factory=lambda: [1, 2, 3, 3])
    depth: int = 3
    scales: list[int] = field(default_factory=lambda: [1])
    planes: int = 1
    anisotropy: float = 1.0
    gaussian: bool = False
    only_differences: bool = False
    subset: list[str] | None = None

    @property
    def letters(self) -> str:
        return "LM" if self.planes == 1 else "LMS"


def depth_of(name: str) -> int:
    """How many filters deep a feature is: the highest number among its CD tags."""
    return max((int(x) for x in re.findall(r"CD(\d+)_", name)), default=0)


def filtered_names(name: str, settings: Settings) -> list[tuple[str, str, int]]:
    """(name, filter, scale) of what is computed from an image: a tag of its depth, the eigenvalue's letter, the filter."""
    found, deep = [], depth_of(name) + 1
    if deep > settings.depth:
        return found
    for s in settings.scales:
        number = "" if s == 1 else str(s)
        for kind in ("He", "St"):
            found += [(f"CD{deep}_{letter}{kind}{number}_{name}", kind, s) for letter in settings.letters]
        if settings.gaussian:
            found.append((f"CD{deep}_Ga{number}_{name}", "Ga", s))
    return found


def plan(settings: Settings, channel: int = 0) -> list[list[tuple[str, str | None, str, int, tuple[int, int, int]]]]:
    """Of each level the steps in order: (name, name it is made from, what, scale, factors). All images of a level are
    binned (at the last level smoothed) from all of the level before, then filtered up to the depth."""
    levels, anisotropy, before = [], settings.anisotropy, [f"Orig_ch{channel}"]
    for i, b in enumerate(settings.factors):
        f = bins(b, anisotropy, settings.planes)
        anisotropy = next_anisotropy(anisotropy, f)
        last = i == len(settings.factors) - 1 and i > 0
        tag = f"Mean{f[2]}_{f[1]}_{f[0]}" if last else f"Bin{f[2]}x{f[1]}x{f[0]}"
        steps = [(f"{tag}_{name}", name, "mean" if last else "bin", 0, f) for name in before]
        for name, *_ in list(steps):
            steps += [(new, name, kind, s, f) for new, kind, s in filtered_names(name, settings)]
        levels.append(steps)
        before = [s[0] for s in steps]
    return levels


def feature_names(settings: Settings, channel: int = 0) -> list[str]:
    """The features in order, projected to the wanted ones."""
    names = [s[0] for level in plan(settings, channel) for s in level]
    if settings.only_differences:
        names = [n for n in names if "CD" in n]
    return [n for n in names if n in set(settings.subset)] if settings.subset is not None else names


def needed_steps(settings: Settings, channel: int = 0) -> list[list[tuple]]:
    """The plan without steps that no wanted feature is made from."""
    levels, wanted = plan(settings, channel), set(feature_names(settings, channel))
    for level in reversed(levels):
        for name, source, *_ in reversed(level):
            if name in wanted:
                wanted.add(source)
    return [[s for s in level if s[0] in wanted] for level in levels]


def level_reach(level: list[tuple], planes: int) -> tuple[int, int, int]:
    """Voxels of a level around a tile, along z, y and x, that its images can hang on: the filters between each of them and
    what the level begins with, and the window of the last level's mean."""
    reach = {}
    for name, source, what, scale, f in level:
        radius = len(gaussian_weights(scale)) // 2 if scale else 0
        if what in ("bin", "mean"):
            reach[name] = np.array([-(-(b - 1) // 2) for b in f] if what == "mean" else [0, 0, 0])
        else:
            step = {"Ga": radius, "He": radius + 1, "St": 2 * radius + 1}[what]
            reach[name] = reach[source] + np.array([step if planes > 1 else 0, step, step])
    return tuple(int(x) for x in np.max([*reach.values(), np.zeros(3, int)], axis=0))


def _smooth(a: np.ndarray, axis: int, w: list[float]) -> np.ndarray:
    r = len(w) // 2
    if a.shape[axis] == 1:
        return a
    n, period = a.shape[axis], 2 * (a.shape[axis] - 1)
    at = np.arange(-r, n + r) % period
    wide = np.take(a, np.where(at < n, at, period - at), axis)
    return sum(x * np.take(wide, np.arange(i, i + n), axis) for i, x in enumerate(w))


def _difference(a: np.ndarray, axis: int, w: dict[int, float]) -> np.ndarray:
    return _smooth(a, axis, [w.get(k, 0.0) for k in (-1, 0, 1)])


def eigen_images(a: np.ndarray, kind: str, scale: float, axes: list[int]) -> list[np.ndarray]:
    """Eigenvalues of the Hessian (absolute) or of the structure tensor at a scale, largest first."""
    w = gaussian_weights(scale)

    def blur(v: np.ndarray) -> np.ndarray:
        for axis in axes:
            v = _smooth(v, axis, w)
        return v

    first, second = {-1: -0.5, 1: 0.5}, {-1: 1.0, 0: -2.0, 1: 1.0}
    g = blur(a)
    d = [_difference(g, axis, first) for axis in axes]
    k = len(axes)
    m = np.zeros((*a.shape, k, k))
    for i in range(k):
        for j in range(i, k):
            v = blur(d[i] * d[j]) if kind == "St" else (_difference(g, axes[i], second) if i == j else _difference(d[i], axes[j], first))
            m[..., i, j] = m[..., j, i] = v
    e = np.linalg.eigvalsh(m)
    e = np.sort(np.abs(e) if kind == "He" else e, axis=-1)[..., ::-1]
    return [e[..., i] for i in range(k)]


def _binned(a: np.ndarray, f: tuple[int, int, int]) -> np.ndarray:
    """Averages of blocks; blocks cut off at the end of an axis average what is there."""
    for axis, b in enumerate(f):
        if b > 1:
            starts = np.arange(0, a.shape[axis], b)
            sizes = np.diff(np.append(starts, a.shape[axis])).reshape([-1 if i == axis else 1 for i in range(3)])
            a = np.add.reduceat(a, starts, axis) / sizes
    return a


def _mean(a: np.ndarray, f: tuple[int, int, int]) -> np.ndarray:
    for axis, b in enumerate(f):
        r = -(-(b - 1) // 2)
        if r:
            sums = np.concatenate([np.zeros_like(np.take(a, [0], axis)), np.cumsum(a, axis)], axis)
            low, high = np.maximum(np.arange(a.shape[axis]) - r, 0), np.minimum(np.arange(a.shape[axis]) + r + 1, a.shape[axis])
            a = (np.take(sums, high, axis) - np.take(sums, low, axis)) / (high - low).reshape([-1 if i == axis else 1 for i in range(3)])
    return a


def _fine(a: np.ndarray, low: np.ndarray, box: np.ndarray, factors: np.ndarray, start: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Linear values, at the full resolution from ``start`` on, of a coarse image of which ``a`` begins at ``low``; kept
    between the first and the last coarse voxel of ``box``."""
    for axis in range(3):
        b = factors[axis]
        at = np.clip((start[axis] + np.arange(shape[axis]) - (b - 1) / 2) / b, box[0, axis], box[1, axis] - 1)
        base = np.floor(at).astype(int)
        part = (at - base).reshape([-1 if i == axis else 1 for i in range(3)])
        first, last = base - low[axis], np.minimum(base + 1, box[1, axis] - 1) - low[axis]
        a = np.take(a, first, axis) * (1 - part) + np.take(a, last, axis) * part if b > 1 else np.take(a, first, axis)
    return a


def level_images(before: dict[str, np.ndarray], level: list[tuple], planes: int) -> dict[str, np.ndarray]:
    """The images of a level from those of the level before, over the same part of an image."""
    now: dict[str, np.ndarray] = {}
    axes = [i for i in range(3) if planes > 1 or i > 0]
    whole: dict[tuple, list[np.ndarray]] = {}
    for name, source, what, scale, f in level:
        if what == "bin":
            now[name] = _binned(before[source], f)
        elif what == "mean":
            now[name] = _mean(before[source], f)
        elif what == "Ga":
            v = now[source]
            for axis in axes:
                v = _smooth(v, axis, gaussian_weights(scale))
            now[name] = v
        else:
            if (source, what, scale) not in whole:
                whole[source, what, scale] = eigen_images(now[source], what, scale, axes)
            now[name] = whole[source, what, scale]["LMS".index(re.match(r"CD\d+_([LMS])", name)[1])]
    return now


IMAGE, TILE = ["image_id", "t", "c"], ["tz", "ty", "tx"]
#: A part of one image of a level: the image's number in it, the part's first place and shape, the image's box (first and one after
#: the last place of each axis, in the level's voxels), and the values. A row holds one image, since Parquet and a sort
#: hold a hundred rows and more at a time.
BLOCK = ["level", "number", "low", "shape", "box", "data"]
#: Bytes of rows that a task hands on at once, and of a row group of the written blocks.
AT_ONCE, GROUP = 1 << 22, 1 << 24


def _schema(vox: DataFrame) -> str:
    own = [f"{k} {vox.schema[k].dataType.simpleString()}" for k in IMAGE]
    return ", ".join([*own, *(f"{k} long" for k in TILE), "level int, number int, low array<long>, shape array<long>, box array<long>, data binary"])


def _row(key, tile, level: int, number: int, low, box, data: np.ndarray) -> tuple:
    return (*key, *(int(x) for x in tile), level, number, [int(x) for x in low], [int(x) for x in data.shape], [int(x) for x in np.ravel(box)], np.ascontiguousarray(data, np.float64).tobytes())


def _parts(pdf: pd.DataFrame):
    for r in pdf[BLOCK].itertuples(index=False):
        shape = [int(x) for x in r.shape]
        yield int(r.level), int(r.number), np.array(r.low), np.array(r.box).reshape(2, 3), np.frombuffer(r.data).reshape(shape)


def _gathered(parts: list, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """An image from ``low`` to ``high`` of its parts; what no part holds is 0."""
    out = np.zeros(high - low)
    for _, _, at, _, data in parts:
        a, b = np.maximum(at, low), np.minimum(at + data.shape, high)
        if (a < b).all():
            out[tuple(slice(x, y) for x, y in zip(a - low, b - low, strict=True))] = data[tuple(slice(x, y) for x, y in zip(a - at, b - at, strict=True))]
    return out


def _by_image(pdf: pd.DataFrame) -> dict[int, dict[int, list]]:
    """Parts by level and number."""
    found: dict[int, dict[int, list]] = {}
    for part in _parts(pdf):
        found.setdefault(part[0], {}).setdefault(part[1], []).append(part)
    return found


def _sent(blocks: DataFrame, edge: np.ndarray, wanted) -> DataFrame:
    """Each block cut to the tiles of edge ``edge`` that need some of it. ``wanted(level)`` gives functions of places: the
    voxels of the tiles' grid that need the block from low to high, and the block's voxels that the grid's from low to high need."""
    columns = blocks.columns

    def cut(batches):
        for pdf in batches:
            rows, held = [], 0
            keys = pdf[IMAGE].itertuples(index=False, name=None)
            for key, (level, number, at, box, data) in zip(keys, _parts(pdf), strict=True):
                users, needs = wanted(level)
                first, last = users(at, at + data.shape, box)
                for tile in np.stack(np.meshgrid(*(np.arange(a // e, (b - 1) // e + 1) for a, b, e in zip(first, last, edge, strict=True)), indexing="ij"), -1).reshape(-1, 3):
                    low, high = needs(tile * edge, (tile + 1) * edge)
                    a, b = np.maximum(at, low), np.minimum(at + data.shape, high)
                    if (a < b).all():
                        rows.append(_row(key, tile, level, number, a, box, data[tuple(slice(x, y) for x, y in zip(a - at, b - at, strict=True))]))
                        held += len(rows[-1][-1])
                if held > AT_ONCE:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return blocks.mapInPandas(cut, blocks.schema)


def _level(blocks: DataFrame, number: int, level: list[tuple], names: list[str], planes: int, edge: np.ndarray, schema: str) -> DataFrame:
    """The blocks of a level from those of the level before (images ``names``): its tiles swap the level's own border."""
    f = np.array(level[0][4] if level[0][2] == "bin" else (1, 1, 1))
    reach = np.array(level_reach(level, planes))

    def wanted(_):
        def users(low, high, box):
            return np.maximum(low // f - reach, box[0] // f), np.minimum(-(-high // f) + reach, -(-box[1] // f))

        return users, lambda low, high: ((low - reach) * f, (high + reach) * f)

    def compute(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts, tile = next(iter(_by_image(pdf).values())), np.array(key[3:])
        box = next(iter(parts.values()))[0][3]
        low, high = np.maximum((tile * edge - reach) * f, box[0] // f * f), np.minimum(((tile + 1) * edge + reach) * f, box[1])
        now = level_images({n: _gathered(parts.get(i, []), low, high) for i, n in enumerate(names)}, level, planes)
        box = np.stack([box[0] // f, -(-box[1] // f)])
        first, last = np.maximum(tile * edge, box[0]), np.minimum((tile + 1) * edge, box[1])
        inner = tuple(slice(x, y) for x, y in zip(first - low // f, last - low // f, strict=True))
        return pd.DataFrame([_row(key[:3], tile, number, i, first, box, now[s[0]][inner]) for i, s in enumerate(level)], columns=[*IMAGE, *TILE, *BLOCK])

    return _sent(blocks, edge, wanted).groupBy(*IMAGE, *TILE).applyInPandas(compute, schema)


def tile_features(vox: DataFrame, settings: Settings, tile: int = 64, keep: DataFrame | None = None, nodes: DataFrame | None = None, classes: int = 2, channel: int = 0, planes: int = 8) -> DataFrame:
    """Voxels with ``features`` (array of float), or, with the ``nodes`` of a forest, with class, probabilities and code.

    An image whose box is no larger than a tile of ``planes`` x ``tile`` x ``tile`` voxels goes whole to one task, which makes all
    levels and reads them off; nothing is written between. Of larger images each level is a stage over such tiles of its own
    resolution: a tile gets the part of the level before under it and the border of this level alone, makes all images of the level,
    and they are written. A last stage brings the parts of all levels under a tile of the full resolution together and reads them off
    there. So a task holds a tile's images of one level, or a tile's features, whatever the size of the image, and a border is a few
    voxels of its level.

    Bins lie on global coordinates, so the values do not hang on the tile's size. ``keep``: voxels (VOXEL) whose features are wanted;
    images without any are not computed. Voxels that an image's box has and the image lacks count as 0 and get no row; a null
    val counts as 0; of repeated voxels one is taken; an empty table gives no rows.
    """
    edge, schema = np.array([planes, tile, tile]), _schema(vox)
    axes = ["z", "y", "x"]
    if keep is not None:
        keep = keep.select(*VOXEL).distinct()
        vox = vox.join(keep.select(*IMAGE).distinct(), IMAGE, "left_semi")
    bounds = written(vox.groupBy(*IMAGE).agg(F.array(*(F.min(a) for a in axes), *(F.max(a) + 1 for a in axes)).cast("array<long>").alias("box")), "bounds")
    extent = [F.get("box", i + 3) - F.get("box", i) for i in range(3)]
    is_whole = extent[0] * extent[1] * extent[2] <= int(edge.prod())
    rows = vox.select(*VOXEL, F.coalesce(F.col("val").cast("double"), F.lit(0.0)).alias("val"))
    rows = rows.join(keep.withColumn("wanted", F.lit(1.0)), VOXEL, "left") if keep is not None else rows.withColumn("wanted", F.lit(1.0))

    wanted_names, levels, factors, scale = feature_names(settings, channel), needed_steps(settings, channel), {-1: np.array([1, 1, 1])}, np.array([1, 1, 1])
    levels = levels[: next((i for i, level in enumerate(levels) if not level), len(levels))]
    for i, level in enumerate(levels):
        if level[0][2] == "bin":
            scale = scale * np.array(level[0][4])
        factors[i] = scale
    place = {n: i for i, n in enumerate(wanted_names)}
    trees = forests.packed(nodes) if nodes is not None else None
    own = ", ".join(f"{k} {vox.schema[k].dataType.simpleString()}" for k in VOXEL)
    shape = own + (", class_id int, prob double, second_id int, second_prob double, n_trees int, code int" if trees is not None else ", features array<float>")
    outs = [x.split()[0] for x in shape.split(", ")]

    def first_values(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The first place, and values and wanted voxels from there on."""
        at = pdf[axes].to_numpy(np.int64)
        low = at.min(axis=0)
        data = np.zeros((2, *(at.max(axis=0) - low + 1)))
        where = tuple((at - low).T)
        data[0][where], data[1][where] = pdf["val"], pdf["wanted"].fillna(0)
        return low, data

    def nothing() -> pd.DataFrame:
        return pd.DataFrame({k: pd.Series([], dtype=object) for k in outs})

    def told(key: tuple, at: np.ndarray, found: np.ndarray) -> pd.DataFrame:
        out = {k: np.full(len(at), key[i]) for i, k in enumerate(IMAGE)} | {a: at[:, i] for i, a in enumerate(axes)}
        if trees is None:
            return pd.DataFrame({**out, "features": list(found)})[outs]
        first, p, second, q, used = forests.until_significant(trees, found.astype(float), classes)
        return pd.DataFrame({**out, "class_id": first, "prob": p, "second_id": second, "second_prob": q, "n_trees": used, "code": forests.result_codes(first, p, q)})[outs]

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start, data = first_values(pdf)
        if not (real := data[1] > 0).any():
            return nothing()
        images, box = {f"Orig_ch{channel}": data[0]}, np.stack([start, start + real.shape])
        found = np.zeros((int(real.sum()), len(wanted_names)), np.float32)
        for number, level in enumerate(levels):
            f = np.array(level[0][4] if level[0][2] == "bin" else (1, 1, 1))
            before = [(int(n), 0) for n in box[0] % f]  # a bin that begins before the image
            images = level_images({n: np.pad(a, before) for n, a in images.items()} if (box[0] % f).any() else images, level, settings.planes)
            box = np.stack([box[0] // f, -(-box[1] // f)])
            for name in images:
                if name in place:
                    found[:, place[name]] = _fine(images[name], box[0], box, factors[number], start, real.shape)[real]
        return told(key, np.argwhere(real) + start, found)

    result = rows.join(bounds.where(is_whole).select(*IMAGE), IMAGE, "left_semi").groupBy(*IMAGE).applyInPandas(whole, shape)
    bounds = bounds.where(~is_whole)
    if bounds.isEmpty():
        return result

    def first_blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, data = first_values(pdf)
        return pd.DataFrame([_row(key[:3], key[3:], -1, i, low, [], a) for i, a in enumerate(data)], columns=[*IMAGE, *TILE, *BLOCK])

    rows = rows.select("*", *(F.floor(F.col(a) / int(e)).alias(t) for t, a, e in zip(TILE, axes, edge, strict=True)))
    rows = rows.join(bounds.select(*IMAGE), IMAGE, "left_semi")
    raw = rows.groupBy(*IMAGE, *TILE).applyInPandas(first_blocks, schema).drop("box").join(bounds, IMAGE)
    tables, names = [written(raw.select(*IMAGE, *TILE, *BLOCK), "blocks", GROUP)], [f"Orig_ch{channel}", "wanted"]
    for i, level in enumerate(levels):
        tables.append(written(_level(tables[-1], i, level, names, settings.planes, edge, schema), "blocks", GROUP))
        names = [s[0] for s in level]

    def under(level: int):
        b = factors[level]

        def users(low, high, box):
            return np.maximum((low - 1) * b, box[0] * b), np.minimum((high + 1) * b, box[1] * b)

        return users, lambda low, high: (low // b - 1, -(-high // b) + 1)

    parts = tables[0]
    for more in tables[1:]:
        parts = parts.union(more)

    def read_off(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        by_level = _by_image(pdf)
        start, stop = np.array(key[3:]) * edge, (np.array(key[3:]) + 1) * edge
        if -1 not in by_level:  # a tile beside the image
            return nothing()
        box = by_level[-1][1][0][3]
        start, stop = np.maximum(start, box[0]), np.minimum(stop, box[1])
        if (start >= stop).any() or not (real := _gathered(by_level[-1][1], start, stop) > 0).any():
            return nothing()
        found = np.zeros((int(real.sum()), len(wanted_names)), np.float32)
        for number, level in enumerate(levels):
            b, box = factors[number], next(iter(by_level[number].values()))[0][3]
            low, high = np.maximum(start // b - 1, box[0]), np.minimum(-(-stop // b) + 1, box[1])
            for k, step in enumerate(level):
                if step[0] in place:
                    found[:, place[step[0]]] = _fine(_gathered(by_level[number][k], low, high), low, box, b, start, real.shape)[real]
        return told(key, np.argwhere(real) + start, found)

    return result.unionByName(_sent(parts, edge, under).groupBy(*IMAGE, *TILE).applyInPandas(read_off, shape))


def name_table(spark, settings: Settings, channels: Iterable[int] = (0,)) -> DataFrame:
    """level, place, feature, depth, source of all features of a setting."""
    rows = [(i, n, s[0], depth_of(s[0]), s[1]) for c in channels for i, level in enumerate(plan(settings, c)) for n, s in enumerate(level)]
    return spark.createDataFrame(rows, "level int, place int, feature string, depth int, source string")
