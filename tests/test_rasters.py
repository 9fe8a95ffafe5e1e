"""PNG planes, sliding entropy, pyramids of classes, and jobs over what arrives."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators.entropy import entropy
from voxmill.sources import images, rasters
from voxmill.streaming import jobs

VOX = "image_id long, t int, c int, z long, y long, x long, val double"


def filtered(image, kinds, bits, colour):
    """A PNG whose rows are stored with the given filters, byte by byte as the format is defined."""
    raw = np.ascontiguousarray(image.astype(">u2" if bits == 16 else np.uint8)).view(np.uint8).reshape(len(image), -1)
    step, lines = rasters.SAMPLES[colour] * bits // 8, b""
    for y, kind in enumerate(kinds):
        line = bytearray([kind])
        for x in range(raw.shape[1]):
            a = int(raw[y, x - step]) if x >= step else 0
            b = int(raw[y - 1, x]) if y else 0
            c = int(raw[y - 1, x - step]) if y and x >= step else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((int(raw[y, x]) - [0, a, b, (a + b) // 2, near][kind]) & 255)
        lines += bytes(line)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], bits, colour, 0, 0, 0)
    packed = zlib.compress(lines)
    return rasters.SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("bits", "colour"), [(8, 0), (16, 0), (8, 2), (16, 6), (8, 4)])
def test_every_filter_is_undone(bits, colour):
    rng = np.random.default_rng(bits + colour)
    image = rng.integers(0, 1 << bits, (11, 7, rasters.SAMPLES[colour]))
    assert (rasters.decode(filtered(image, rng.integers(0, 5, 11), bits, colour)) == image).all()
    assert (rasters.decode(filtered(image[:1, :1], [4], bits, colour)) == image[:1, :1]).all()


def test_own_files_and_damaged_ones():
    image = np.arange(35).reshape(5, 7) * 1871
    data = rasters.encode(image)
    assert (rasters.decode(data)[:, :, 0] == image).all()
    for bad in (b"", data[:40], data[:-20], data.replace(b"IDAT", b"IDAX"), b"GIF" + data):
        with pytest.raises((ValueError, zlib.error)):
            rasters.decode(bad)


def test_planes_there_and_back(spark, tmp_path):
    rows = [(i, t, 0, z, y, x, float(i * 1000 + t * 500 + z * 100 + y * 10 + x)) for i in (0, 1) for t in (0, 1) for z in (0, 1, 2) for y in range(4) for x in range(5)]
    vox = spark.createDataFrame(rows + rows[:3], VOX)
    at = f"file:{tmp_path}/planes"
    assert rasters.write_pngs(vox, at, F.col("val")) == 12
    (tmp_path / "planes" / "notes.txt").write_text("not a plane")
    found = rasters.read_pngs(spark, at)
    assert sorted(map(tuple, found.collect())) == sorted(rows)
    assert sorted(map(tuple, found.where("z = 1 and t > 0 and image_id in (1, 7) and y < 2").collect())) == [r for r in rows if r[0] == 1 and r[1] == 1 and r[3] == 1 and r[4] < 2]
    for file in (tmp_path / "planes").glob("*.png"):  # a filter on planes opens no other file
        if "Z00002" not in file.name:
            file.write_bytes(b"damaged")
    assert rasters.read_pngs(spark, at).where("z = 2").count() == 80
    with pytest.raises(Exception, match="no PNG signature"):
        rasters.read_pngs(spark, at).count()
    assert rasters.read_pngs(spark, at).where("z = 9").count() == 0


def test_gaps_nulls_and_colours(spark, tmp_path):
    at = str(tmp_path / "odd")
    rasters.write_pngs(spark.createDataFrame([(0, 0, 0, 0, 1, 2, 7.0), (0, 0, 0, 0, 0, 0, None), (0, 0, 0, 0, 1, 1, 70000.0), (0, 0, 0, 0, 0, 1, -3.0)], VOX), at, F.col("val"))
    assert [r.val for r in rasters.read_pngs(spark, at).orderBy("y", "x").collect()] == [0, 0, 0, 0, 65535, 7]
    assert rasters.write_pngs(spark.createDataFrame([], VOX), at, F.col("val")) == 0
    image = np.arange(12).reshape(2, 2, 3)
    (tmp_path / "odd" / "z4.png").write_bytes(filtered(image, [1, 3], 8, 2))
    found = rasters.read_pngs(spark, at, r"z(?P<z>\d+)")
    assert {(r.z, r.c, r.y, r.x): r.val for r in found.collect()} == {(4, c, y, x): image[y, x, c] for c in range(3) for y in range(2) for x in range(2)}
    assert found.where("c = 1").count() == 4


@pytest.mark.parametrize("edge", [4, 64])
def test_entropy_equals_counting(spark, edge):
    rng = np.random.default_rng(3)
    there = rng.random((2, 9, 11)) < 0.85
    values = rng.normal(0, 0.6, there.shape)
    vox = spark.createDataFrame([(5, 0, 0, *map(int, p), float(values[tuple(p)])) for p in np.argwhere(there)], VOX)
    found = {(r.z, r.y, r.x): r.bits for r in entropy(vox, 3, 6, -1, 1, edge).collect()}
    assert set(found) == set(map(tuple, np.argwhere(there)))
    at = np.clip(np.floor((values + 1) / 2 * 6), 0, 5)
    for z, y, x in found:
        near = [at[z, b, a] for b in range(9) for a in range(11) if there[z, b, a] and (b - y) ** 2 + (a - x) ** 2 <= 9]
        p = np.unique(near, return_counts=True)[1] / len(near)
        assert abs(found[z, y, x] - abs((p * np.log2(p)).sum())) < 1e-9


def test_odd_voxels_have_entropy(spark):
    assert entropy(spark.createDataFrame([], VOX), 2, 4, 0, 1).count() == 0
    rows = [(0, 0, 0, 0, 0, 0, None), (0, 0, 0, 0, 0, 1, float("nan")), (0, 0, 0, 0, 0, 2, float("inf")), (0, 0, 0, 0, 0, 2, float("inf"))]
    found = {r.x: r.bits for r in entropy(spark.createDataFrame(rows, VOX), 1, 4, 0, 1).collect()}
    assert found == {0: 0.0, 1: pytest.approx(0.9182958), 2: 1.0}


def test_pyramids_of_classes(spark, tmp_path):
    rng = np.random.default_rng(9)
    val, code = rng.random((5, 9)), rng.integers(0, 21, (5, 9))
    raw = spark.createDataFrame([(3, 0, c, 1, y, x, float(val[y, x] + c)) for c in (0, 1) for y in range(5) for x in range(9)], VOX)
    result = spark.createDataFrame([(3, 0, 0, 1, y, x, int(code[y, x])) for y in range(5) for x in range(9)], VOX.replace("val double", "code int"))
    images.write_pyramids(raw, result, (0, 1), str(tmp_path / "p"), 3)
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.is_dir()) == ["data_set=class-0", "data_set=class-1", "data_set=raw"]
    found = {(r.data_set, r.level, r.c, r.y, r.x): r.val for r in images.read_pyramid(spark, str(tmp_path / "p")).collect()}
    want = {}
    for name, c, a in [("raw", 0, val), ("raw", 1, val + 1), *((f"class-{k}", 0, np.where((code > k * 10) & (code <= k * 10 + 10), code - k * 10 - 1, 0)) for k in (0, 1))]:
        for level in range(3):
            want |= {(name, level, c, y, x): a[y, x] for y, x in np.ndindex(a.shape)}
            h, w = a.shape[0] // 2, a.shape[1] // 2
            a = a[: h * 2, : w * 2].reshape(h, 2, w, 2).mean(axis=(1, 3))
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_each_point_once_over_batches_and_restarts(spark, tmp_path, monkeypatch):
    def arrive(n, rows):
        spark.createDataFrame(rows, "a long, b string, other int").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))

    def run():
        stream = spark.readStream.schema("a long, b string, other int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        return sorted(map(tuple, jobs.new_points(stream, ["a", "b"], str(tmp_path / "out")).collect()), key=str)

    (tmp_path / "in").mkdir()
    arrive(0, [(1, "p", 0), (1, "p", 1), (2, None, 0)])
    arrive(1, [(2, None, 5), (3, "q", 0), (1, "p", 9)])
    first = [(1, "p"), (2, None), (3, "q")]
    assert run() == first and run() == first
    arrive(2, [(4, "r", 0), (3, "q", 0)])
    from pyspark.sql.readwriter import DataFrameWriter

    plain, calls = DataFrameWriter.parquet, []

    def cut_off(self, path, *rest, **more):
        plain(self, path, *rest, **more)
        calls.append(path)
        raise RuntimeError("lost after writing")

    monkeypatch.setattr(DataFrameWriter, "parquet", cut_off)
    with pytest.raises(Exception, match="lost after writing"):
        run()
    monkeypatch.undo()
    assert len(calls) == 1 and calls[0].endswith("batch=2")
    assert run() == [*first, (4, "r")]
    arrive(3, [(5, "s", 0)])
    assert run() == [*first, (4, "r"), (5, "s")]
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 5


def test_nothing_arrived(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("a long").parquet(str(tmp_path / "in"))
    assert jobs.new_points(stream, ["a"], str(tmp_path / "out")).count() == 0
