"""A Python data source for shapefiles: points, lines and polygons with their attributes.

`spark.read.format("shapefile").load(path)`: one row per shape with its number in the file, gtype, parts (arrays of points),
attributes, a map of text in the fields' order, and crs, the text of the .prj file. A path is one .shp file or a folder of
them; .dbf and .prj stand beside it. Each file is one partition."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.deploy import ship

SCHEMA = "file string, no long, gtype string, parts array<array<struct<x:double,y:double>>>, attributes map<string,string>, crs string"
# Shape types of the format, with and without Z and M.
POINT, LINE, POLYGON, MULTI = (1, 11, 21), (3, 13, 23), (5, 15, 25), (8, 18, 28)


def shapes(data: bytes) -> Iterator[tuple[str, list[list[tuple[float, float]]]] | None]:
    """The shapes of a .shp file's bytes; None for a null shape. Other types are an error."""
    at = 100
    while at + 8 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + size]
        kind = struct.unpack("<i", body[:4])[0]
        if kind == 0:
            yield None
        elif kind in POINT:
            yield "point", [[struct.unpack("<2d", body[4:20])]]
        elif kind in MULTI:
            n = struct.unpack("<i", body[36:40])[0]
            yield "point", [[struct.unpack("<2d", body[40 + 16 * i : 56 + 16 * i])] for i in range(n)]
        elif kind in LINE + POLYGON:
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            rows = list(zip(xy[::2], xy[1::2], strict=True))
            yield "line" if kind in LINE else "polygon", [rows[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        else:
            raise ValueError(f"shape type {kind} is not supported")
        at += 8 + size


def records(data: bytes) -> Iterator[dict[str, str]]:
    """The rows of a .dbf file's bytes as text."""
    n, head, size = struct.unpack("<iHH", data[4:12])
    fields, at, k = [], 1, 32
    while data[k] != 0x0D:
        length = data[k + 16]
        fields.append((data[k : k + 11].split(b"\0")[0].decode("latin-1").strip(), at, length))
        at, k = at + length, k + 32
    for i in range(n):
        row = data[head + i * size : head + (i + 1) * size]
        yield {name: row[a : a + length].decode("latin-1").strip() for name, a, length in fields}


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        top = Path(self.path)
        return [InputPartition(str(p)) for p in ([top] if top.suffix == ".shp" else sorted(top.glob("*.shp")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        shp = Path(partition.value)
        rows = list(records(shp.with_suffix(".dbf").read_bytes())) if shp.with_suffix(".dbf").exists() else []
        crs = shp.with_suffix(".prj").read_text() if shp.with_suffix(".prj").exists() else None
        for i, shape in enumerate(shapes(shp.read_bytes())):
            if shape is not None:
                yield shp.name, i, shape[0], [[{"x": x, "y": y} for x, y in part] for part in shape[1]], rows[i] if i < len(rows) else {}, crs


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Shapefile)
