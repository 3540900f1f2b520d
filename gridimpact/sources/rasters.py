"""Rasters as a Spark data source: a scan for the blocks (strips or tiles) of each file.

Planning reads headers only: they tell where the blocks of a file lie and what part of the map each covers. Blocks are dealt into partitions
of about `partition_bytes`, so that one large file is read by many tasks, each of which reads and decodes its own bytes. Comparisons of lon, lat, row, col
and tile with constants are pushed down, and blocks that cannot hold such pixels are not planned; Spark applies the filter itself afterwards.

Read are single-band GeoTIFF files, plain or deflated, from any place that pyarrow can open: local and shared folders, and the object stores it knows.
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "tile string, row int, col int, lon double, lat double, value double"
_SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
Read = Callable[[int, int], bytes]  # place and number of bytes


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    dtype: str
    packed: bool
    differences: bool  # rows hold differences of neighbours
    block: tuple[int, int]  # columns and rows
    places: tuple[int, ...]
    sizes: tuple[int, ...]
    west: float
    dx: float
    north: float
    dy: float
    nodata: float | None

    @classmethod
    def of(cls, read: Read) -> Header:
        start = read(0, 8)
        order = "<" if start[:2] == b"II" else ">"
        magic, at = struct.unpack_from(order + "HI", start, 2)
        if magic != 42:
            raise ValueError("not a classic TIFF file")
        (n,) = struct.unpack(order + "H", read(at, 2))
        entries, t = read(at + 2, 12 * n), {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", entries, 12 * k)
            form = order + _SIZES.get(kind, "B") * count
            size = struct.calcsize(form)
            raw = entries[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else read(struct.unpack_from(order + "I", entries, 12 * k + 8)[0], size)
            t[tag] = struct.unpack(form, raw)
        width, height, packing = t[256][0], t[257][0], t.get(259, (1,))[0]
        if packing not in (1, 8, 32946) or t.get(277, (1,))[0] != 1:
            raise ValueError("only single-band rasters, plain or deflated")
        tiled = 322 in t
        block = (t[322][0], t[323][0]) if tiled else (width, min(height, t.get(278, (height,))[0]))
        scale, tie = t[33550], t[33922]
        nodata = b"".join(t[42113]).split(b"\0")[0] if 42113 in t else b""
        return cls(
            width, height, f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[t.get(339, (1,))[0]]}{t[258][0] // 8}", packing != 1, t.get(317, (1,))[0] == 2, block,
            t[324 if tiled else 273], t[325 if tiled else 279], tie[3] - tie[0] * scale[0], scale[0], tie[4] + tie[1] * scale[1], scale[1], float(nodata) if nodata.strip() else None,
        )

    def extent(self, k: int) -> tuple[int, int, int, int]:
        """First row and column of a block, and the rows and columns that it has inside the raster."""
        w, h = self.block
        across = -(-self.width // w)
        top, left = k // across * h, k % across * w
        return top, left, min(h, self.height - top), min(w, self.width - left)

    def pixels(self, k: int, raw: bytes) -> dict[str, np.ndarray]:
        """Places and values of a block's pixels that have a value."""
        top, left, rows, cols = self.extent(k)
        block = np.frombuffer(zlib.decompress(raw) if self.packed else raw, self.dtype).reshape(-1, self.block[0])
        if self.differences:
            block = np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
        part = block[:rows, :cols].astype(float)
        row, col = np.nonzero(np.isfinite(part) & (part != self.nodata if self.nodata is not None else True))
        value, row, col = part[row, col], row + top, col + left
        return {"row": row, "col": col, "lon": self.west + (col + 0.5) * self.dx, "lat": self.north - (row + 0.5) * self.dy, "value": value}


@dataclass
class Blocks(InputPartition):
    """Some blocks of a file, and what a task must know of its header."""

    path: str
    header: Header
    numbers: list[int]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*.tif*")
        self.bytes = int(options.get("partition_bytes", 4 << 20))
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}
        self.tile: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo, LessThan, LessThanOrEqual)) and len(f.attribute) == 1:
                (name,) = f.attribute
                if name in ("lon", "lat", "row", "col") and isinstance(f.value, (int, float)):
                    if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                        self.low[name] = max(f.value, self.low.get(name, f.value))
                    if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                        self.high[name] = min(f.value, self.high.get(name, f.value))
                elif name == "tile" and isinstance(f, EqualTo):
                    self.tile = f.value
            yield f  # blocks hold other pixels too

    def wanted(self, h: Header, k: int) -> bool:
        top, left, rows, cols = h.extent(k)
        reach = {
            "row": (top, top + rows - 1), "col": (left, left + cols - 1),
            "lon": tuple(sorted((h.west + (left + 0.5) * h.dx, h.west + (left + cols - 0.5) * h.dx))), "lat": tuple(sorted((h.north - (top + rows - 0.5) * h.dy, h.north - (top + 0.5) * h.dy))),
        }
        return all(b >= self.low.get(c, b) and a <= self.high.get(c, a) for c, (a, b) in reach.items())

    def partitions(self) -> list[Blocks]:
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern) and self.tile in (None, f.base_name))
        out = []
        for name in names:
            with system.open_input_file(name) as file:
                header = Header.of(lambda at, n: file.read_at(n, at))  # noqa: B023
            part, size = [], 0
            for k in range(len(header.places)):
                if self.wanted(header, k):
                    if part and size + header.sizes[k] > self.bytes:
                        out.append(Blocks(name, header, part))
                        part, size = [], 0
                    part.append(k)
                    size += header.sizes[k]
            if part:
                out.append(Blocks(name, header, part))
        return out

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        tile, h = partition.path.rsplit("/", 1)[-1], partition.header
        with system.open_input_file(partition.path) as file:
            for k in partition.numbers:
                found = h.pixels(k, file.read_at(h.sizes[k], h.places[k]))
                n = len(found["value"])
                columns = [pa.array([tile] * n, pa.string()), *(pa.array(found[c].astype(np.int32)) for c in ("row", "col")), *(pa.array(found[c]) for c in ("lon", "lat", "value"))]
                yield pa.RecordBatch.from_arrays(columns, ["tile", "row", "col", "lon", "lat", "value"])


class RasterSource(DataSource):
    """Format `raster_blocks`; options pattern (names of files, *.tif* by default) and partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "raster_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(dict(self.options))


def geotiff(spark: SparkSession, path: str, pattern: str = "*.tif*", partition_bytes: int = 4 << 20) -> DataFrame:
    """tile (file name), row, col, lon, lat (of the pixel's centre) and value of every pixel that has one."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    return spark.read.format("raster_blocks").option("pattern", pattern).option("partition_bytes", partition_bytes).load(path)
