"""PNG planes as a source and a sink: a plane is a file, its name says image, channel, frame and plane.

The source plans its tasks from the names alone: filters on image_id, t, c and z choose files before any is opened. Files are
reached through pyarrow's file systems, so a path may be local or that of a shared store.
"""

from __future__ import annotations

import operator
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from voxmill.sources.images import NAME

SCHEMA = "image_id long, t int, c int, z long, y long, x long, val double"
#: Groups of a plane's name, without its ending.
PATTERN = r"image--I(?P<image_id>\d+)--C(?P<c>\d+)--T(?P<t>\d+)--Z(?P<z>\d+)"
#: A task's files hold about this many bytes, or are one file.
TASK_BYTES = 16 << 20
#: Voxels of a batch that leaves a reader.
BATCH = 1 << 18
# Fixed values of the file format: signature, and samples a pixel by colour type (grey, colours, grey and alpha, colours and alpha).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _unfiltered(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Bytes of an image from their differences. A byte hangs on those to its left, above, and above left, so all bytes of an
    antidiagonal (in steps of a pixel) are found at once, whatever the kinds of their rows."""
    height, width = rows.shape[0], rows.shape[1] // step
    out = np.zeros((height + 1, width + 1, step), np.int16)
    coded, kinds = rows.reshape(height, width, step).astype(np.int16), kinds[:, None]
    for k in range(height + width - 1):
        y = np.arange(max(0, k - width + 1), min(height, k + 1))
        x = k - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        far = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
        guess = np.choose(kinds[y], [np.zeros_like(left), left, up, (left + up) >> 1, nearest])
        out[y + 1, x + 1] = (coded[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, -1)


def decode(data: bytes) -> np.ndarray:
    """(rows, columns, samples) of a PNG of 8 or 16 bits a sample, not interlaced, without a palette; others are refused."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size]):
            raise ValueError(f"chunk {kind!r} is cut off or damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("no header")
    width, height, bits, colour, _, _, interlaced = head
    if not width or not height:
        raise ValueError("no pixels")
    if bits not in (8, 16) or colour not in SAMPLES or interlaced:
        raise ValueError(f"{bits} bits, colour type {colour}, interlacing {interlaced} are not read")
    step = SAMPLES[colour] * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if raw.size != height * (width * step + 1):
        raise ValueError(f"{raw.size} bytes of samples, {height * (width * step + 1)} expected")
    lines = raw.reshape(height, width * step + 1)
    kinds, rows = lines[:, 0], lines[:, 1:]
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown filter")
    rows = np.ascontiguousarray(rows) if not kinds.any() else _unfiltered(rows, kinds, step)
    return rows.view(">u2" if bits == 16 else np.uint8).reshape(height, width, SAMPLES[colour]).astype(np.uint16)


def encode(grey: np.ndarray) -> bytes:
    """A grey image of 16 bits; rows are stored as differences to the row above."""
    rows = np.ascontiguousarray(grey.astype(">u2")).view(np.uint8).reshape(len(grey), -1)
    lines = np.full((rows.shape[0], rows.shape[1] + 1), 2, np.uint8)
    lines[:, 1:] = np.diff(rows, axis=0, prepend=np.zeros((1, rows.shape[1]), np.uint8))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 16, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


#: What a filter asks of a number in a name.
TESTS = {EqualTo: operator.eq, In: lambda own, values: own in values, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, dict[str, int]]]):
        self.files = files


class PlaneReader(DataSourceReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self.wanted = path, pattern, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            # the channel of a coloured file is not in its name alone, so filters on c stay with Spark
            if type(f) in TESTS and f.attribute[0] in ("image_id", "t", "z"):
                self.wanted.append(f)
            else:
                yield f

    def _chosen(self, place: dict[str, int]) -> bool:
        return all(TESTS[type(f)](place.get(f.attribute[0], 0), f.value) for f in self.wanted)

    def partitions(self) -> list[InputPartition]:
        store, root = _place(self.path)
        found, size = [[]], 0
        for info in sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            named = info.type == fs.FileType.File and re.fullmatch(self.pattern + r"\.png", info.base_name)
            place = {k: int(v) for k, v in named.groupdict().items() if v} if named else None
            if place is None or not self._chosen(place):
                continue
            if found[-1] and size + info.size > TASK_BYTES:
                found.append([])
                size = 0
            found[-1].append((info.path, place))
            size += info.size
        return [_Files(files) for files in found]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = _place(self.path)
        for path, place in partition.files:
            with store.open_input_stream(path) as f:
                data = f.read()
            try:
                image = decode(data)
            except (ValueError, zlib.error) as error:
                raise ValueError(f"{path}: {error}") from error
            many = max(1, BATCH // image.shape[1])
            for channel in range(image.shape[2]):
                for first in range(0, len(image), many):
                    part = image[first : first + many, :, channel]
                    y, x = np.indices(part.shape)
                    same = {k: np.full(part.size, place.get(k, 0) + (channel if k == "c" else 0), kind) for k, kind in (("image_id", np.int64), ("t", np.int32), ("c", np.int32), ("z", np.int64))}
                    columns = [*same.values(), y.ravel() + first, x.ravel(), part.ravel().astype(float)]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in columns], names=[*same, "y", "x", "val"])


class Planes(DataSource):
    """``spark.read.format("png_planes")``: options ``path`` (searched with its subfolders) and ``pattern``, whose named groups
    image_id, t, c and z are numbers (0 if absent); it has to fit a name as a whole, without ``.png``."""

    @classmethod
    def name(cls) -> str:
        return "png_planes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlaneReader:
        return PlaneReader(self.options["path"], self.options.get("pattern", PATTERN))


def read_pngs(spark: SparkSession, path: str, pattern: str = PATTERN) -> DataFrame:
    """Voxels of all PNG files below ``path`` whose name fits. Samples of a coloured file are further channels from its c on.

    Filters on image_id, t and z choose files by name. A file that cannot be read is an error that names it; other names are
    passed over; no file, no rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Planes)
    return spark.read.format("png_planes").option("path", path).option("pattern", pattern).load()


def write_pngs(vox: DataFrame, path: str, value: Column, name: str = NAME) -> int:
    """One grey file of 16 bits for each plane of ``vox`` (VOXEL); returns how many.

    ``value``: a whole number, clipped to 0..65535. A plane is put together in one task, from place 0 to its last voxel; what
    is missing or null is 0; of repeated voxels one is taken. A file appears whole, under a name that hangs on nothing else, so a
    task that runs again replaces its own. Existing files of other planes stay.
    """

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        store, root = _place(path)
        file, kept = pdf["file"].iloc[0], pdf[pdf["v"].notna()]
        grey = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), np.uint16)
        grey[kept["y"], kept["x"]] = kept["v"].clip(0, 65535)
        data = encode(grey)
        part = f"{root}/.{file}-{np.random.default_rng().integers(1 << 62)}"
        with store.open_output_stream(part) as f:
            f.write(data)
        store.move(part, f"{root}/{file}")
        return pd.DataFrame({"file": [file], "bytes": [len(data)]})

    store, root = _place(path)
    store.create_dir(root, recursive=True)
    rows = vox.select(F.concat(F.format_string(name, "image_id", "c", "t", "z"), F.lit(".png")).alias("file"), "y", "x", value.cast("double").alias("v"))
    return rows.groupBy("file").applyInPandas(save, "file string, bytes long").count()
