"""Kernels, objects, pyramids and forests against numpy and plain loops, on small made-up images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill import queries, queries_models, queries_volumes
from voxmill.operators import distance, grid, kernels, lines, objects, pyramid, sampling, tiles
from voxmill.plans import brain, forest
from voxmill.sources import images, instances, tables
from voxmill.sources.tables import VOXEL

SCHEMA = "image_id long, t int, c int, z long, y long, x long, val double"


def image(spark, *volumes):
    rows = [(i, 0, 0, z, y, x, float(v)) for i, a in enumerate(volumes) for (z, y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, SCHEMA)


def array(df, shape, column="val", image_id=0):
    out = np.full(shape, np.nan)
    for r in df.where(F.col("image_id") == image_id).collect():
        out[r.z, r.y, r.x] = np.nan if r[column] is None else r[column]
    return out


@pytest.fixture(scope="module")
def volume():
    return np.random.default_rng(5).normal(size=(3, 9, 8))


def test_gaussian_and_eigenvalues_equal_numpy(spark, volume):
    v, sigmas = image(spark, volume), {"z": 0.6, "y": 1.0, "x": 1.0}
    smooth = volume
    for axis, sigma in enumerate(sigmas.values()):
        w = kernels.gaussian_weights(sigma)
        r = len(w) // 2
        wide = np.pad(smooth, [(r, r) if i == axis else (0, 0) for i in range(3)], mode="reflect") if smooth.shape[axis] > r else None
        if wide is None:
            n, period = smooth.shape[axis], 2 * (smooth.shape[axis] - 1)
            at = np.arange(-r, n + r) % period
            wide = np.take(smooth, np.where(at < n, at, period - at), axis)
        smooth = sum(x * np.take(wide, np.arange(i, i + smooth.shape[axis]), axis) for i, x in enumerate(w))
    assert np.allclose(array(lines.gaussian(v, sigmas), volume.shape), smooth)
    for kind, f in (("He", lines.hessian), ("St", lines.structure)):
        found = f(v, {"z": 1.0, "y": 1.0, "x": 1.0}).cache()
        said = pyramid.eigen_images(volume, kind, 1.0, [0, 1, 2])
        for i in range(3):
            assert np.allclose(array(found, volume.shape, f"e{i}"), said[i], atol=1e-7)
        flat = f(v, {"y": 1.0, "x": 1.0})
        assert np.allclose(array(flat, volume.shape, "e0"), pyramid.eigen_images(volume, kind, 1.0, [1, 2])[0], atol=1e-7)


def test_images_do_not_meet(spark):
    a, b = np.zeros((1, 4, 4)), np.zeros((1, 4, 4))
    a[0, 1, 1], b[0, 1, 2] = 1, 1
    v = image(spark, a, b)
    on = v.where("val > 0")
    assert objects.components(on).select("image_id", "object_id").distinct().count() == 2
    assert distance.within(v, on.where("image_id = 0"), 3).where("image_id = 1").count() == 0
    assert distance.nearest_distance(v, on.where("image_id = 0"), 2).where("image_id = 1 and d2 is not null").count() == 0
    assert grid.candidates(on.where("image_id = 0"), on.where("image_id = 1"), 3).count() == 0
    assert array(distance.distance_map(v, F.col("val") > 0), (1, 4, 4), "d2", 1)[0, 1, 1] == 1


def test_tiles_end_with_the_image_and_blocks_are_whole(spark):
    v = image(spark, np.arange(2 * 10 * 7, dtype=float).reshape(2, 10, 7))
    tiles = {(r.ty, r.tx) for r in grid.with_halo(v, 4, 3, {"y": 10, "x": 7}).select("ty", "tx").distinct().collect()}
    assert tiles == {(y, x) for y in range(3) for x in range(2)}
    assert kernels.blocks(v, 3, 3, 2).count() == 6
    assert kernels.bins(3, 1.5, 4) == (2, 3, 3) and kernels.bins(3, 0.125, 1) == (1, 3, 3) and kernels.next_anisotropy(1.0, (1, 3, 3)) == pytest.approx(1 / 3)


def test_distance_without_any_reference_is_null_and_else_reaches_everywhere(spark):
    a = np.zeros((2, 6, 12))
    a[0, 0, 0] = 1
    v = image(spark, a, np.zeros((1, 2, 2)))
    d = array(distance.distance_map(v, F.col("val") > 0), a.shape, "d2")
    assert (d == np.add.outer(np.arange(2) ** 2, np.add.outer(np.arange(6) ** 2, np.arange(12) ** 2))).all()
    assert np.isnan(array(distance.distance_map(v, F.col("val") > 0), (1, 2, 2), "d2", 1)).all()


def brute_distances(there, on):
    """Squared distance from each place of ``there`` to the nearest of ``on``, by all pairs."""
    return {p: min((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in on), default=None) for p in there}


@pytest.mark.parametrize("cells", [1 << 19, 1])
def test_distances_see_past_missing_voxels(spark, monkeypatch, cells):
    """Images with holes, whole planes of them too, against all pairs; bundles of one line as well."""
    monkeypatch.setattr(distance, "CELLS", cells)
    rng = np.random.default_rng(8)
    a = rng.random((4, 7, 9))
    v = image(spark, a, rng.random((2, 3, 30))).where("not (image_id = 0 and (z = 1 or y = 4 or (x > 5 and z = 2) or val < 0.2))")
    for most, bar in ((None, 0.95), (5, 0.9), (0, 0.5)):
        on = v.where(F.col("val") > bar)
        found = {(r.image_id, r.z, r.y, r.x): r.d2 for r in (distance.distance_map(v, F.col("val") > bar) if most is None else distance.nearest_distance(v, on, int(most**0.5))).collect()}
        reach = most if most is None else int(most**0.5) ** 2
        for i in (0, 1):
            there = [(r.z, r.y, r.x) for r in v.where(F.col("image_id") == i).collect()]
            said = brute_distances(there, [(r.z, r.y, r.x) for r in on.where(F.col("image_id") == i).collect()])
            for p, d in said.items():
                assert found[i, *p] == (d if d is None or reach is None or d <= reach else None)
    assert distance.within(v, v.where("val > 2"), 3).count() == 0
    assert distance.distance_map(v.limit(0), F.col("val") > 0).count() == 0


def test_envelope_equals_all_pairs():
    rng = np.random.default_rng(3)
    d = np.where(rng.random((200, 40)) < 0.3, rng.integers(0, 400, (200, 40)).astype(float), np.inf)
    d[0] = np.inf
    i = np.arange(40)
    assert np.array_equal(distance.envelope(d), (d[:, None, :] + (i[:, None] - i) ** 2).min(axis=2))


@pytest.mark.parametrize("edge", [4, 7, 64])
def test_kernels_do_not_hang_on_tiles(spark, volume, edge, monkeypatch):
    """Any edge of tiles, with lines that end early: the same as along whole lines."""
    monkeypatch.setattr(tiles.derived, "__defaults__", (edge,))
    v = image(spark, volume, np.random.default_rng(4).normal(size=(1, 5, 30))).where("not (image_id = 0 and z = 2 and y > 4) and not (image_id = 1 and y = 4 and x > 20)")
    sigmas = {"z": 0.6, "y": 1.0, "x": 0.7}
    said = v
    for axis, sigma in sigmas.items():
        w = kernels.gaussian_weights(sigma)
        said = lines.along(said, axis, {"val_": ("val", lines.taps({i - len(w) // 2: x for i, x in enumerate(w)}))}, ()).withColumnRenamed("val_", "val")
    found = {(r.image_id, r.z, r.y, r.x): r.val for r in lines.gaussian(v, sigmas).collect()}
    want = {(r.image_id, r.z, r.y, r.x): r.val for r in said.collect()}
    assert found.keys() == want.keys() and np.allclose([found[k] for k in want], list(want.values()))
    if edge == 4:
        a = {(r.image_id, r.z, r.y, r.x): (r.e0, r.e2) for r in lines.structure(v, sigmas).collect()}
        b = {(r.image_id, r.z, r.y, r.x): r.val for r in lines.box_mean(v, {"x": 2, "y": 1}).collect()}
        monkeypatch.setattr(tiles.derived, "__defaults__", (64,))
        more = {(r.image_id, r.z, r.y, r.x): (r.e0, r.e2) for r in lines.structure(v, sigmas).collect()}
        assert np.allclose([a[k] for k in more], list(more.values()))
        assert np.allclose([b[r.image_id, r.z, r.y, r.x] for r in lines.box_mean(v, {"x": 2, "y": 1}).collect()], [r.val for r in lines.box_mean(v, {"x": 2, "y": 1}).collect()])


def test_one_exchange_a_recipe(spark, volume):
    for df in (lines.hessian(image(spark, volume), {"z": 1.0, "y": 1.0, "x": 1.0}), lines.structure(image(spark, volume), {"z": 1.0, "y": 1.0, "x": 1.0})):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_padding_wider_than_the_image(spark):
    found = grid.padded(image(spark, np.array([[[1.0, 2.0, 3.0]]])), 7, {"x": 3, "y": 1})
    rows = {(r.py, r.px): r.val for r in found.collect()}
    assert len(rows) == found.count() == 15 * 17
    for (_, x), val in rows.items():
        assert val == [1, 2, 3, 2][x % 4]


def test_colours_do_not_run_into_each_other(spark):
    df = spark.createDataFrame([(-7, 300, 5), (1, 2, 3)], "r long, g long, b long")
    packed = df.select(images.merged_channels(F.col("r"), F.col("g"), F.col("b")).alias("p"))
    assert [tuple(r) for r in packed.select(*images.split_channels(F.col("p"))).collect()] == [(0, 255, 5), (1, 2, 3)]


HEADER = """% a comment
@RELATION "two words"
@attribute Metadata_Name {'a b',"c,d",e}
@attribute 'first feature' numeric
@attribute kind {low, 'very high'}
@attribute class {N,Y}
@data
"""


def test_instance_files_lose_no_line(spark, tmp_path):
    good = ["'a b',1.5,low,N", '"c,d", -2 , \'very high\',Y', "e,?,?,?", "e,1e3,low,Y,{5}", "  'a b',0,low,N , { 0.5 }  "]
    bad = ["e,1,low", "e,1,low,N,7", "e,one,low,N", "e,1,middle,N", "f,1,low,N", "e,1,low,N,{heavy}", "{1 2}", "e,1,low,M"]
    (tmp_path / "a.arff").write_text(HEADER + "\n".join([*good[:2], "", "% none", *good[2:]]) + "\n")
    (tmp_path / "b.arff").write_text(HEADER + good[0] + "\n")
    assert instances.arff_header(spark, str(tmp_path)) == ("two words", [("Metadata_Name", ["a b", "c,d", "e"]), ("first feature", None), ("kind", ["low", "very high"]), ("class", ["N", "Y"])])
    found = [(r.dataset, r.Name, r.features, r["class"], r.class_id, r.weight) for r in instances.read_arff(spark, str(tmp_path)).collect()]
    want = [(0.0, [1.5, 0.0], "N", 0, 1.0)] * 2 + [(1.0, [-2.0, 1.0], "Y", 1, 1.0), (2.0, [None, None], None, None, 1.0), (2.0, [1000.0, 0.0], "Y", 1, 5.0), (0.0, [0.0, 0.0], "N", 0, 0.5)]
    assert sorted(map(str, found)) == sorted(str(("two words", *w)) for w in want)
    for i, line in enumerate(bad):
        folder = tmp_path / f"bad{i}"
        folder.mkdir()
        (folder / "x.arff").write_text(HEADER + "\n".join([good[0], line]) + "\n")
        with pytest.raises(Exception, match="not an instance"):
            instances.read_arff(spark, str(folder)).select("class_id").collect()
        kept = instances.read_arff(spark, str(folder), "keep").collect()
        assert sorted((r.rejected is None, r.features is None) for r in kept) == [(False, True), (True, False)]
        assert [r.rejected for r in kept if r.rejected] == [line]


@pytest.mark.parametrize("tile, planes", [(5, 2), (8, 3), (64, 64)])
def test_pyramid_equals_whole_images(spark, tile, planes):
    """Tiles cut along every axis give what whole arrays give, in two images of one job; one has a hole."""
    rng = np.random.default_rng(12)
    whole = [rng.normal(size=(5, 13, 11)), rng.normal(size=(3, 4, 17))]
    settings = pyramid.Settings([1, 2, 3], depth=2, planes=5, anisotropy=1.0, gaussian=True)
    v = image(spark, *whole).where("not (image_id = 0 and z > 3 and y > 9)")
    whole[0][4, 10:] = 0
    names = pyramid.feature_names(settings)
    keep = v.where("(image_id + z + y + x) % 3 > 0")
    found = {(r.image_id, r.z, r.y, r.x): r.features for r in pyramid.tile_features(v, settings, tile, keep, planes=planes).collect()}
    assert found.keys() == {(r.image_id, r.z, r.y, r.x) for r in keep.collect()}
    for i, a in enumerate(whole):
        before, scale, said = {"Orig_ch0": a}, np.array([1, 1, 1]), {}
        for level in pyramid.plan(settings):
            now = pyramid.level_images(before, level, settings.planes)
            if level[0][2] == "bin":
                scale = scale * np.array(level[0][4])
            for name, b in now.items():
                said[name] = pyramid._fine(b, np.zeros(3, int), np.array([[0, 0, 0], b.shape]), scale, np.zeros(3, int), a.shape)
            before = now
        for (k, z, y, x), values in found.items():
            if k == i:
                assert np.allclose(values, [said[n][z, y, x] for n in names], atol=1e-5)


def test_small_images_stay_in_a_task_and_rows_of_larger_ones_hold_one_image(spark, monkeypatch):
    a = np.random.default_rng(12).normal(size=(5, 20, 23))
    v, settings, kept = image(spark, a), pyramid.Settings([1, 2], depth=1, planes=5), []
    monkeypatch.setattr(pyramid, "written", lambda df, name, *more: kept.append((name, found := tables.written(df, name, *more))) or found)
    whole = {(r.z, r.y, r.x): r.features for r in pyramid.tile_features(v, settings, 24, planes=5).collect()}
    assert [name for name, _ in kept] == ["bounds"]
    tiled = {(r.z, r.y, r.x): r.features for r in pyramid.tile_features(v, settings, 8, planes=5).collect()}
    longest = [df.agg(F.max(F.length("data"))).first()[0] for name, df in kept if name == "blocks"]
    assert len(longest) == 3 and max(longest) == 5 * 8 * 8 * 8  # one image of a tile a row
    assert whole.keys() == tiled.keys() and len(whole) == a.size
    assert all(np.allclose(whole[k], tiled[k], atol=1e-5) for k in whole)


@pytest.mark.parametrize("neighbours", [6, 4, 8])
def test_components_do_not_hang_on_tiles(spark, neighbours):
    on = image(spark, np.random.default_rng(1).random((3, 24, 24))).where("val > 0.45")
    seen = [sorted(map(tuple, objects.components(on, neighbours, tile).collect())) for tile in (5, 64)]
    assert seen[0] == seen[1] and len({r[-1] for r in seen[0]}) > 3


def test_moments_do_not_hang_on_the_order_of_voxels(spark):
    """Of 16 voxels a covariance has halves in the seventh place; a running sum lands on either side of them."""
    from fractions import Fraction

    rng, rows, want = np.random.default_rng(4), [], {}
    for k in range(400):
        at = rng.integers(0, 2000, (16, 3))
        at[0] += (0, 0, 1)
        rows += [(k, 0, 0, *map(int, p), 1) for p in at]
        mean = [Fraction(int(v), 16) for v in at.sum(axis=0)]
        m = sum((int(p[0]) - mean[0]) * (int(p[2]) - mean[2]) for p in at) / 16 * 10**6
        want[k] = (-1 if m < 0 else 1) * ((2 * abs(m) + 1) // 2) / 10**6
    voxels = spark.createDataFrame(rows, "image_id long, t int, c int, z int, y int, x int, object_id long").repartition(7)
    assert {r.image_id: r.cov_zx for r in objects.measures(voxels).collect()} == {k: float(v) for k, v in want.items()}


def test_ellipsoid_of_a_bar_points_along_it(spark):
    a = np.zeros((1, 20, 20))
    a[0, 5, 2:18] = 1
    r = objects.ellipsoids(objects.measures(objects.components(image(spark, a).where("val > 0")))).first()
    assert r.radius0 > 10 and r.radius1 < 1 and abs(abs(r.azimuth) % 180) < 1e-6 and abs(r.elevation) < 1e-6


def test_specks_go_and_holes_are_filled(spark):
    a = np.zeros((1, 12, 12))
    a[0, 2:8, 2:8] = 1
    a[0, 4, 4], a[0, 10, 10] = 0, 1
    found = array(objects.without_specks(image(spark, a), 0.5, 2), a.shape)
    said = np.zeros_like(a)
    said[0, 2:8, 2:8] = 1
    assert (found == said).all()
    cleaned = array(objects.post_processed(image(spark, a), 1, 0.4, 2, binary=True, sigma=0.6), a.shape)
    assert set(np.unique(cleaned)) <= {0.0, 1.0} and cleaned[0, 4, 4] == 1 and cleaned[0, 0, 0] == 0


def test_patch_components_are_the_singular_vectors(spark, volume):
    found = kernels.patch_components(image(spark, volume), 3, 2, 2).toPandas()
    patches = np.array([volume[z, y : y + 3, x : x + 3].ravel() for z in range(3) for y in range(0, 7, 2) for x in range(0, 6, 2)])
    _, s, vt = np.linalg.svd(patches, full_matrices=False)
    for c in range(2):
        own = found[found.component == c].sort_values("place")
        v = vt[c] * np.sign(vt[c][np.argmax(np.abs(vt[c]))])
        assert np.allclose(own.weight, v, atol=1e-4) and own.value.iloc[0] == pytest.approx(s[c], abs=1e-3)


def test_pyramid_names():
    assert [len(x) for x in pyramid.plan(pyramid.Settings())] == [5, 25, 125, 369]
    assert [len(x) for x in pyramid.plan(pyramid.Settings([1, 2, 3], planes=30))] == [7, 49, 343]
    assert all("CD" in n for n in pyramid.feature_names(pyramid.Settings(only_differences=True)))
    one = pyramid.Settings(subset=["CD2_LHe_Bin2x2x1_CD1_MSt_Bin1x1x1_Orig_ch0"])
    assert sum(map(len, pyramid.needed_steps(one))) == 4
    assert pyramid.depth_of(one.subset[0]) == 2


def test_pyramid_does_not_hang_on_tiles(spark):
    a = np.random.default_rng(2).normal(size=(1, 70, 66))
    v, settings = image(spark, a), pyramid.Settings([1, 2, 2], depth=2)
    small, large = ({(r.y, r.x): r.features for r in pyramid.tile_features(v, settings, tile).collect()} for tile in (16, 128))
    assert len(small) == len(large) == a.size and len(small[0, 0]) == len(pyramid.feature_names(settings))
    assert all(np.allclose(small[k], large[k], atol=1e-5) for k in small)
    names = pyramid.feature_names(settings)
    he = [i for i, n in enumerate(names) if n.startswith(("CD1_LHe_Bin1", "CD1_MHe_Bin1"))]
    assert all(f[he[0]] >= f[he[1]] >= 0 for f in large.values())


@pytest.fixture(scope="module")
def grown(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 5))
    y = np.where(x[:, 1] > 0.3, 1, np.where(x[:, 3] > 0, 2, 0))
    rows = spark.createDataFrame([(i, i // 3, int(y[i]), [float(v) for v in x[i]]) for i in range(900)], "row_id long, label_id long, class_id int, features array<double>")
    return rows, tables.written(forest.train(rows, 3, 5, trees=12, depth=6, n_bins=24, k=3), "nodes")


def test_forest_learns_and_shows_what_it_uses(spark, grown):
    rows, nodes = grown
    found = forest.scored(rows.withColumnRenamed("class_id", "truth"), nodes, 3, ["row_id", "truth"]).toPandas()
    assert (found.truth == found.class_id).mean() > 0.95
    assert ((found.prob >= found.second_prob) & (found.prob + found.second_prob <= 1 + 1e-9)).all()
    assert (found.code == found.class_id * 10 + 1 + np.floor(np.round((found.prob - found.second_prob) * 9, 7))).all()
    used = {r.feature: r.relative for r in forest.usage(nodes, 5).collect()}
    assert min(used[1], used[3]) > max(used.get(k, 0) for k in (0, 2, 4))
    assert forest.out_of_bag(rows, nodes, 3, 12, 66).first().error < 0.1
    rise = {r.feature: r.rise for r in forest.importance(rows, nodes, 3, 5, 12, 66).collect()}
    assert min(rise[1], rise[3]) > 0.1 and max(abs(rise[k]) for k in (0, 2, 4)) < 0.05
    again, kept = forest.two_passes(rows, 3, 5, 1.0, trees=5, depth=3, n_bins=16, k=3)
    assert kept == [1, 3] and {r.feature for r in again.where("feature is not null").select("feature").distinct().collect()} <= {1, 3}
    shapes = forest.shapes(nodes).collect()
    assert len(shapes) == 12 and all(r.leaves == r.decisions + 1 and r.depth <= 6 for r in shapes)


def test_walk_by_joins_and_in_tasks_agree(spark, grown):
    rows, nodes = grown
    leaves = forest.walked(rows, nodes, 6).join(nodes.select("tree_id", "node_id", "probs"), ["tree_id", "node_id"])
    mean = {r.row_id: r.p for r in leaves.groupBy("row_id").agg(F.avg(F.get("probs", 1)).alias("p")).collect()}
    votes = {r.row_id: r.p for r in forest.votes(rows, nodes, 3, ["row_id"]).groupBy("row_id").agg(F.avg(F.get("probs", 1)).alias("p")).collect()}
    assert len(mean) == 900 and all(abs(mean[k] - votes[k]) < 1e-9 for k in mean)


def test_missing_values_go_both_ways_and_probabilities_sum_to_one(spark, grown):
    rows, _ = grown
    gaps = rows.withColumn("features", F.transform("features", lambda v, i: F.when((i != 1) | (F.col("row_id") % 4 > 0), v)))
    nodes = forest.train(gaps, 3, 5, trees=5, depth=4, n_bins=16, k=3)
    for r in forest.votes(gaps, nodes, 3, ["row_id"]).collect():
        assert sum(r.probs) == pytest.approx(1)


def test_bags_hold_labels_as_a_whole(spark, grown):
    bag = forest.bags(grown[0], 6, 66).toPandas()
    assert bag.groupby(["tree_id", "label_id"]).in_bag.nunique().max() == 1
    assert 0.55 < bag.in_bag.mean() < 0.77
    sums = bag[bag.in_bag].groupby(["tree_id", "class_id"]).weight.sum().unstack()
    assert np.allclose(sums.max(axis=1), sums.min(axis=1))
    loose = forest.bags(grown[0].withColumn("label_id", F.lit(-1).cast("long")), 2, 66).toPandas()
    assert 0.5 < loose.in_bag.mean() < 0.8


def test_votes_stop_when_the_lead_is_clear():
    tree = lambda p: {1: (None, None, None, np.array(p))}
    sure, unsure = {i: tree([1.0, 0.0]) for i in range(40)}, {i: tree([0.5, 0.5]) for i in range(40)}
    assert forest.until_significant(sure, np.zeros((1, 1)), 2)[4][0] == 11
    first, p, second, q, used = forest.until_significant(unsure, np.zeros((1, 1)), 2)
    assert (first[0], second[0], used[0]) == (0, 1, 40)


def test_useful_pixels_are_wrong_and_have_partners(spark):
    rng = np.random.default_rng(8)
    rows = [(0, 0, 0, 0, y, x, int(rng.integers(0, 2)), int(rng.integers(0, 21))) for y in range(40) for x in range(40)]
    seen = spark.createDataFrame(rows, "image_id long, t int, c int, z long, y long, x long, class_id int, val int")
    value = {(r[4], r[5]): (r[6], r[7]) for r in rows}
    found = sampling.useful_pixels(seen, 6, 3).collect()
    assert len(found) == 12
    for r in found:
        own, v = value[r.y, r.x]
        assert own == r.class_id and 0 < v < 10
        other, _ = value[r.partner_y, r.partner_x]
        assert other != own and (not r.near or max(abs(r.y - r.partner_y), abs(r.x - r.partner_x)) <= 3)


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_neighbours_go_as_in_a_pass_in_order(spark, radius):
    rng = np.random.default_rng(radius)
    rows = [(p, y, x, int(rng.integers(0, 6))) for p in range(2) for y in range(25) for x in range(20) if rng.random() < 0.5]
    found = sampling.without_neighbours(spark.createDataFrame(rows, "plane int, y long, x long, val int"), ["plane"], radius, ["val", "y", "x"])
    said = []
    for p, y, x, v in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2])):
        if all(q != p or max(abs(y - b), abs(x - a)) > radius for q, b, a, _ in said):
            said.append((p, y, x, v))
    assert sorted(tuple(r) for r in found.collect()) == sorted(said)
    assert sampling.without_neighbours(found.limit(0), ["plane"], radius, ["val", "y", "x"]).count() == 0


def test_a_wrong_region_goes_before_a_wrong_speck(spark):
    seen = np.full((1, 30, 30), 15.0)
    seen[0, 5:12, 5:12], seen[0, 22, 22] = 6.0, 1.0
    v = image(spark, seen).withColumn("class_id", F.when(F.col("x") < 15, 0).otherwise(F.when(F.col("y") == 22, 0).otherwise(1)))
    blurred = [r for r in sampling.useful_pixels(v, 1, 2).collect() if r.class_id == 0]
    plain = [r for r in sampling.useful_pixels(v, 1, 2, 0).collect() if r.class_id == 0]
    assert [(r.y, r.x) for r in blurred] == [(8, 8)] and [(r.y, r.x) for r in plain] == [(22, 22)]


SF = "/root/testdata/sf0.001"


def test_most_used_features(spark):
    nodes = queries_models.trained(spark, SF)[1].collect()
    counts = {}
    for r in nodes:
        if r.feature is not None:
            counts[r.feature] = counts.get(r.feature, 0) + 1
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:2]
    assert [tuple(r) for r in queries.QUERIES["o1_most_used_features"](spark, SF).collect()] == want


def test_batch_scores_every_matching_image(spark, monkeypatch):
    """The resumable result of the folder has the codes that the images get one by one."""
    nodes = queries_models.voxel_forest(spark, SF)
    monkeypatch.setattr(queries_models, "voxel_forest", lambda *a: nodes)
    found = {(r.image_id, r.z, r.class_id): r.n for r in queries.QUERIES["g17_batch_apply"](spark, SF).collect()}
    want = {}
    v = queries_volumes.vols(spark, SF).withColumn("val", F.floor((F.col("val") + 0.5) * 60000) / 60000 - 0.5)
    for (i,) in v.select("image_id").distinct().collect():
        for r in pyramid.tile_features(v.where(F.col("image_id") == i), queries_models.SETTINGS, 16, nodes=nodes).collect():
            key = i, r.z, (r.code - 1) // 10
            want[key] = want.get(key, 0) + 1
    assert found == want


def test_second_stage_uses_the_distance(spark):
    """Rows whose class is told by the distance to the foreground alone: the added feature is the one that splits most."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(1, 32, 32)) * 0.01
    a[0, :, :4] += 5
    v, settings = image(spark, a), pyramid.Settings([1], depth=0)
    names = pyramid.feature_names(settings)
    rows = pyramid.tile_features(v, settings, 16).select(F.xxhash64(*VOXEL).alias("row_id"), F.lit(-1).cast("long").alias("label_id"), F.when(F.col("x") < 4, 1).when(F.col("x") < 14, 0).otherwise(2).alias("class_id"), *VOXEL, "features")
    two = rows.withColumn("class_id", F.when(F.col("class_id") == 2, 0).otherwise(F.col("class_id")))
    found = brain.two_stages(two.withColumn("class_id", F.when(F.col("x") < 14, F.col("class_id")).otherwise(F.lit(0))), v, settings).collect()
    assert {r.feature for r in found if r.distance} <= {len(names)} and all((r.feature == len(names)) == r.distance for r in found)
    far = distance.distance_map(v, F.col("x") < 4)
    assert {r.x: r.d2 for r in far.collect()} == {x: max(0, x - 3) ** 2 for x in range(32)}
    by_distance = brain.two_stages(rows.withColumn("class_id", F.when(F.col("x").between(4, 13), 1).otherwise(F.when(F.col("x") < 4, 1).otherwise(0))).where("x < 4 or x > 6"), v, settings).collect()
    assert sum(r.usage for r in by_distance) > 0


def test_data_sets_measure_the_scored_foreground(spark, monkeypatch):
    seen = []
    keep = tables.written
    monkeypatch.setattr(queries_models.tables, "written", lambda df, name: seen.append((name, keep(df, name))) or seen[-1][1])
    found = queries.QUERIES["g22_data_set_pipeline"](spark, SF).collect()
    coded = next(df for name, df in seen if name == "coded")
    sums = {}
    for r in coded.collect():
        key = r.image_id, r.z, r.y // 2, r.x // 2
        total, n = sums.get(key, (0, 0))
        sums[key] = total + (r.code - 11 if 11 <= r.code <= 20 else 0), n + 1
    left = {k for k, (total, n) in sums.items() if n == 4 and total / 4 >= 1}
    volumes = []
    while left:
        stack, members = [left.pop()], []
        while stack:
            i, z, y, x = stack.pop()
            members.append((i, z, y, x))
            for p in ((i, z + 1, y, x), (i, z - 1, y, x), (i, z, y + 1, x), (i, z, y - 1, x), (i, z, y, x + 1), (i, z, y, x - 1)):
                if p in left:
                    left.remove(p)
                    stack.append(p)
        if len(members) >= 2:
            volumes.append((f"image-{members[0][0]}", len(members), min(m[1] for m in members), max(m[3] for m in members)))
    assert sorted((r.data_set, r.volume, r.min_z, r.max_x) for r in found) == sorted(volumes)


def test_training_loop_gets_better(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(1, 32, 32)) * 0.1
    a[0, 8:24, 8:24] += 1
    v = image(spark, a)
    truth = v.select(*VOXEL, ((F.col("y").between(8, 23)) & F.col("x").between(8, 23)).cast("int").alias("class_id"))
    right = [r.right / r.n for r in brain.iterate(v, truth, pyramid.Settings([1, 2], depth=1), 2, 30).orderBy("round").collect()]
    assert right[-1] > 0.9 > right[0]


def test_files_there_and_back(spark, tmp_path, volume):
    v = image(spark, np.round(volume * 100), np.round(volume * 50))
    path = str(tmp_path / "planes")
    images.write_planes(v, path, F.col("val") + 500)
    back = images.read_planes(spark, path)
    assert np.allclose(array(back, volume.shape, image_id=1), np.round(volume * 50) + 500)
    assert images.list_files(spark, path, "part.*", "image--I00001.*").select("path").count() >= 3
    result = v.select(*VOXEL, F.col("z").cast("int").alias("code"))
    out = str(tmp_path / "result")
    planes = result.select("image_id", "t", "z").distinct()
    assert images.missing_planes(planes, spark, out).count() == 6
    images.write_result(result.where("z = 0"), out)
    assert images.missing_planes(planes, spark, out).count() == 4
    images.write_result(result.withColumn("code", F.lit(7)).where("image_id = 0 and z = 0"), out)
    assert images.read_result(spark, out, {"z": (0, 0)}).groupBy("image_id").agg(F.max("code").alias("m")).orderBy("image_id").collect() == [(0, 7), (1, 0)]


def test_instance_file_of_several_headers_and_gaps(spark, tmp_path):
    (tmp_path / "a.arff").write_text("@relation 'cells one'\n\n@attribute Metadata_Label_Id numeric\n@attribute f numeric\n@attribute class {bg,fg}\n\n@data\n% remark\n3,0.5,fg\n4,?,bg\n\n")
    found = instances.read_arff(spark, str(tmp_path)).orderBy("Label_Id").collect()
    assert [tuple(r) for r in found] == [("cells one", 3.0, [0.5], "fg", 1, 1.0), ("cells one", 4.0, [None], "bg", 0, 1.0)]


def test_gaussian_of_a_line_of_one(spark):
    v = image(spark, np.ones((1, 1, 3)))
    assert np.allclose(array(lines.gaussian(v, {"z": 1.0, "y": 2.0, "x": 1.0}), (1, 1, 3)), 1)
    assert lines.gaussian(v.limit(0), {"y": 1.0}).count() == 0


def plain_tree(x, y, w, node, tree, k, depth, seed=1):
    """A recursive learner that tries each midpoint of each feature in turn: {node_id: (feature, split)}."""
    import hashlib
    import math

    def entropy(own):
        sums = [sum(w[i] for i in own if y[i] == c) for c in set(y)]
        return -sum(s / sum(sums) * math.log2(s / sum(sums)) for s in sums if s > 0)

    def grow(node, own, found):
        best, good, place = None, False, 0
        order = sorted(range(len(x[0])), key=lambda f: int(hashlib.md5(f"{tree},{node},{f},{seed}".encode()).hexdigest()[:8], 16))
        for f in order if math.log2(node) + 1e-9 < depth and len({y[i] for i in own}) > 1 else []:
            values = sorted({x[i][f] for i in own})
            if len(values) < 2:
                continue
            place += 1
            for low, high in zip(values, values[1:], strict=False):
                left, right = ([i for i in own if (x[i][f] <= low) == side] for side in (True, False))
                weight = [sum(w[i] for i in part) for part in (left, right)]
                after = round((weight[0] * entropy(left) + weight[1] * entropy(right)) / sum(weight), 9)
                if best is None or (after, f, low) < best[0]:
                    best = ((after, f, low), (low + high) / 2, left, right)
                good |= entropy(own) - after > 0.01
            if place >= k and good:
                break
        if best is None or entropy(own) - best[0][0] <= 0.01:
            found[node] = (None, None)
            return
        found[node] = (best[0][1], best[1])
        grow(2 * node, best[2], found)
        grow(2 * node + 1, best[3], found)

    found = {}
    grow(node, range(len(x)), found)
    return found


def test_trees_equal_a_plain_recursive_learner(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(240, 4)), 1)  # ties in plenty
    y = np.where(x[:, 0] * x[:, 2] > 0, 1, np.where(rng.random(240) < 0.2, 2, 0))
    rows = spark.createDataFrame([(i, -1, int(y[i]), [float(v) for v in x[i]]) for i in range(240)], "row_id long, label_id long, class_id int, features array<double>")
    bag = forest.bags(rows, 3, 66).where("in_bag").toPandas()
    found = forest.train(rows, 3, 4, trees=3, k=2).toPandas()
    for tree in range(3):
        own = bag[bag.tree_id == tree].sort_values("row_id")
        want = plain_tree(x[own.row_id].tolist(), own.class_id.tolist(), own.weight.tolist(), 1, tree, 2, 61)
        got = {r.node_id: (None, None) if np.isnan(r.feature) else (int(r.feature), r.split) for r in found[found.tree_id == tree].itertuples()}
        assert got.keys() == want.keys() and len(got) > 20
        assert all(got[n][0] == want[n][0] and (want[n][0] is None or got[n][1] == pytest.approx(want[n][1])) for n in got)


def test_large_nodes_split_from_histograms_and_then_end_in_tasks(spark, grown, monkeypatch):
    rows, _ = grown
    whole = forest.train(rows, 3, 5, trees=4, k=5)
    large = forest.train(rows, 3, 5, trees=4, k=5, n_bins=2000, cells=1000)  # nodes of over 200 rows by bins, a value each
    key = ["tree_id", "node_id", "feature", "n"]
    assert sorted(map(tuple, whole.select(*key).fillna(-1).collect())) == sorted(map(tuple, large.select(*key).fillna(-1).collect()))
    monkeypatch.setattr(forest, "SENT", 1)
    monkeypatch.setattr(forest, "LEAST_SENT", 1)  # a tree at a time
    few = forest.train(rows, 3, 5, trees=4, k=5)
    assert sorted(map(str, few.collect())) == sorted(map(str, whole.collect()))
    stumps = forest.train(rows, 3, 5, trees=2, depth=1, cells=100)  # leaves that are large
    assert stumps.groupBy("tree_id").count().where("count = 3").count() == 2
    part = forest.train(rows, 3, 5, trees=2, features=[1, 3], cells=1000, n_bins=16)
    assert {r.feature for r in part.select("feature").distinct().collect()} == {None, 1, 3}


def test_gaps_in_large_nodes_keep_their_weight(spark, grown):
    rows, _ = grown
    gaps = rows.withColumn("features", F.transform("features", lambda v, i: F.when((i != 1) | (F.col("row_id") % 4 > 0), v)))
    nodes = forest.train(gaps, 3, 5, trees=3, k=5, cells=1500)
    for r in forest.votes(gaps, nodes, 3, ["row_id"]).collect():
        assert sum(r.probs) == pytest.approx(1)


def test_odd_rows_of_a_forest(spark):
    shape = "row_id long, label_id long, class_id int, features array<double>"
    assert forest.train(spark.createDataFrame([], shape), 2, 2, trees=3).count() == 0
    rows = [(i, i, i % 2, [1.0, None]) for i in range(9)] + [(10, 10, None, [1.0, 2.0]), (11, 11, 0, None)]
    found = forest.train(spark.createDataFrame(rows, shape), 2, 2, trees=3, percent=100).collect()
    assert [(r.node_id, r.feature, r.n) for r in found] == [(1, None, 9)] * 3


def test_scoring_by_runs_of_trees_equals_all_at_once(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    x[::7, 0] = np.nan
    y = np.nan_to_num(x[:, 0]) + 0.7 * rng.normal(size=400) > 0
    rows = spark.createDataFrame([(i, -1, int(y[i]), [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(400)], "row_id long, label_id long, class_id int, features array<double>")
    nodes = tables.written(forest.train(rows, 2, 3, trees=25, depth=5), "nodes")
    largest = max(r["count"] for r in nodes.groupBy("tree_id").count().collect())
    assert len(forest.blocks(nodes, 4 * largest)) > 4
    same = [sorted(map(str, forest.scored(rows, nodes, 2, ["row_id"], most).collect())) for most in (None, 4 * largest)]
    assert same[0] == same[1]
    assert {r.n_trees for r in forest.scored(rows, nodes, 2, ["row_id"], 4 * largest).collect()} >= {11, 25}
    one, many = (sorted(map(str, forest.votes(rows, nodes, 2, ["row_id"], most).collect())) for most in (None, largest))
    assert one == many
    with pytest.raises(ValueError, match="less depth"):
        forest.blocks(nodes, 1)


def test_cross_validation_of_two_learners(spark):
    from voxmill.plans import compare

    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(150, 3)), 1)
    y = np.where(x[:, 0] + 0.6 * rng.normal(size=150) > 0, 1, np.where(x[:, 1] > 1, 2, 0))
    label = np.arange(150) // 2
    shape = "row_id long, label_id long, class_id int, features array<double>"
    rows = spark.createDataFrame([(i, int(label[i]), int(y[i]), [float(v) for v in x[i]]) for i in range(150)], shape)
    runs, folds, trees = 2, 3, 3
    dealt = tables.written(compare.with_folds(rows, runs, folds), "folds")
    own = {r.row_id: list(r.folds) for r in dealt.collect()}
    held = compare.in_models(dealt, runs, folds, trees, 66).collect()
    mass = {}
    for r in held:
        for e in r["at"]:
            model = e.tree_id // trees
            assert own[r.row_id][model // (2 * folds)] != model // 2 % folds  # no model sees what it is tested on
            mass.setdefault(e.tree_id, {}).setdefault(r.class_id, []).append(e.weight)
            assert model % 2 == compare.BALANCED or e.weight in range(1, 7)
    assert sorted(mass) == list(range(runs * folds * 2 * trees))
    for tree, classes in mass.items():
        if tree // trees % 2 == compare.BALANCED:
            assert np.ptp([sum(w) for w in classes.values()]) < 1e-9
    nodes = tables.written(forest.grow(compare.in_models(dealt, runs, folds, trees, 66), 3, 3, runs * folds * 2 * trees, k=2), "nodes")
    packed = forest.packed(nodes)
    scores = {(r.run, r.fold, r.learner): r for r in compare.cross_validated(rows, 3, 3, runs, folds, trees, k=2).collect()}
    assert len(scores) == runs * folds * 2
    differences = []
    for (run, fold, learner), r in scores.items():
        test = [i for i in range(150) if own[i][run] == fold]
        model = (run * folds + fold) * 2 + learner
        p = np.round(np.mean([forest.tree_probs(packed[model * trees + t], x[test], 3) for t in range(trees)], axis=0), 9)
        assert r.n == len(test) and r.accuracy == pytest.approx(np.mean(p.argmax(axis=1) == y[test]))
        area = share = 0
        for c in range(3):
            good, bad = p[y[test] == c, c], p[y[test] != c, c]
            if len(good) and len(bad):
                area += len(good) * np.mean((good[:, None] > bad) + (good[:, None] == bad) / 2)
                share += len(good)
        assert r.auc == pytest.approx(area / share)
    for run in range(runs):
        differences += [scores[run, f, 0].auc - scores[run, f, 1].auc for f in range(folds)]
    line = {r.measure: r for r in compare.compared(spark.createDataFrame(list(scores.values())), folds).collect()}["auc"]
    assert line.folds == 6 and line.t == pytest.approx(np.mean(differences) / np.sqrt((1 / 6 + 1 / 2) * np.var(differences, ddof=1)))


def test_learners_that_never_differ_have_no_t(spark):
    from voxmill.plans.scoring import corrected_t

    line = corrected_t(spark.createDataFrame([(0.5, 0.5), (0.7, 0.7), (0.9, 0.9)], "a double, b double"), 0.5).first()
    assert (line.folds, line["mean"], line.t) == (3, 0, None)


def test_a_row_goes_once_to_a_task_with_all_its_trees():
    import pyarrow as pa

    few = [(t, 1, 50) for t in range(40)]
    bundles = forest._bundles(few, 2, forest.CELLS, 100, 2)
    assert bundles.max() + 1 <= 7 and (np.diff(bundles) >= 0).all()
    inside = np.random.default_rng(3).random((100, 40)) < 0.5
    rows = [{"class_id": i % 2, "features": [float(i), -1.0], "at": [{"tree_id": t, "node_id": 1, "weight": float(i + t)} for t in np.flatnonzero(inside[i]).tolist()]} for i in range(100)]
    kind = pa.schema([("class_id", pa.int32()), ("features", pa.list_(pa.float64())), ("at", pa.list_(pa.struct([("tree_id", pa.int32()), ("node_id", pa.int64()), ("weight", pa.float64())])))])
    sent = [r for b in forest._dealt(few, bundles)(pa.Table.from_pylist(rows, kind).to_batches()) for r in b.to_pylist()]
    assert len(sent) == len({(r["bundle"], r["features"][0]) for r in sent}) <= 700
    assert sorted((r["features"][0], e["place"], e["weight"]) for r in sent for e in r["at"]) == sorted((float(i), t, float(i + t)) for i, t in np.argwhere(inside).tolist())
    assert forest._bundles(few, 2, 120, 10**6, 2).tolist() == list(range(40))  # a large table: no more rows in a task than ``cells`` values


def test_importance_within_buckets_equals_joins(spark, grown, monkeypatch):
    rows, nodes = grown
    rows = rows.withColumn("label_id", F.when(F.col("row_id") % 3 == 0, -1).otherwise(F.col("label_id")))
    joined = {r.feature: r.rise for r in forest.importance(rows, nodes, 3, 5, 12, 66, cells=0).collect()}
    monkeypatch.setattr(forest, "out_of_bag", None)
    monkeypatch.setattr(forest, "scrambled", None)  # no join of rows with their votes
    assert {r.feature: r.rise for r in forest.importance(rows, nodes, 3, 5, 12, 66).collect()} == pytest.approx(joined, abs=1e-12)
