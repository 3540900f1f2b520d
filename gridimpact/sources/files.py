"""Vector files as tables. Spark reads the bytes, so any store it knows will do; each file is decoded in one task."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def wkb_rings(data: bytes) -> list[list[tuple[float, float]]]:
    """Rings of a polygon or multipolygon in well-known binary; other kinds have none."""
    at = 0

    def geometry() -> list:
        nonlocal at
        order = "<" if data[at] else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        extra = 2 + (kind // 1000 in (1, 3)) + (kind // 1000 in (2, 3)) if kind < 4000 else 2
        if kind % 1000 == 6:
            (n,) = struct.unpack_from(order + "I", data, at)
            at += 4
            return [ring for _ in range(n) for ring in geometry()]
        if kind % 1000 != 3:
            return []
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        rings = []
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", data, at)
            points = np.frombuffer(data, order + "f8", m * extra, at + 4).reshape(m, extra)
            at += 4 + 8 * m * extra
            rings.append([(float(x), float(y)) for x, y in points[:, :2]])
        return rings

    return geometry() if data else []


def geopackage(spark: SparkSession, path: str, layer: str, columns: list[str], geometry: str | None = "geom") -> DataFrame:
    """Attribute columns (as text) of a layer, and the rings of its polygons unless geometry is None."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                names = ", ".join(f'"{c}"' for c in [*columns, *([geometry] if geometry else [])])
                cursor = db.execute(f'SELECT {names} FROM "{layer}"')
                while found := cursor.fetchmany(1000):
                    out = pd.DataFrame({c: [None if r[k] is None else str(r[k]) for r in found] for k, c in enumerate(columns)})
                    if geometry:
                        out["rings"] = [[[{"x": x, "y": y} for x, y in ring] for ring in _packaged(r[-1])] for r in found]
                    yield out
                db.close()

    schema = ", ".join(f"`{c}` string" for c in columns) + (f", rings {RINGS}" if geometry else "")
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def _packaged(blob: bytes | None) -> list:
    """Rings of a GeoPackage geometry: a header with an optional envelope, then well-known binary."""
    if not blob:
        return []
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7]
    return wkb_rings(blob[8 + envelope :])


def merged_parts(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """All rings of a group as one polygon, for parts that do not overlap; `operators.union` makes the union of those that may."""
    return polygons.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.flatten(F.collect_list("rings")).alias("rings"))
