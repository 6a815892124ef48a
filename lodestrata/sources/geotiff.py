"""GeoTIFF rasters, classic or big: strips or tiles, raw, PackBits, LZW or deflate, with predictors, 8 to 64 bit numbers. Of
several bands, interleaved or apart, the first is read.

`read` gives Meta and the cells (r, c, v): the driver reads the directory alone, and a Python data source gives each
partition a range of blocks, whose bytes it reads from the file and decodes. `write` makes a float32 file of a grid: strips
are compressed on executors and the driver only joins their bytes. Parquet is the format for larger grids.

Paths are local ones that all machines share, or URIs that pyarrow opens."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from lodestrata.deploy import ship
from lodestrata.functions import crs
from lodestrata.operators.grid import SENTINEL, Meta

# Field types, tags and compressions of the format.
CLASSIC, BIG = 42, 43
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANES, PREDICTOR, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 339
SUBFILE = 254
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
SCALE, TIE, KEYS, NODATA = 33550, 33922, 34735, 42113
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NONE = -9999.0
#: Cells of blocks that a partition reads.
CELLS = 4_000_000


def place(path: str) -> tuple[FileSystem, str]:
    """The file system and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return FileSystem.from_uri(path if "://" in path else "file://" + path)


def tags(f, nth: int = 0) -> tuple[str, dict[int, tuple]]:
    """Byte order and a directory's fields of an open file; none where there are fewer directories."""
    f.seek(0)
    head = f.read(16)
    end = "<" if head[:2] == b"II" else ">"
    version = struct.unpack(end + "H", head[2:4])[0]
    if version not in (CLASSIC, BIG):
        raise ValueError("not a TIFF file")
    count_of, word, start = ("Q", "Q", head[8:]) if version == BIG else ("H", "I", head[4:8])
    room, number = len(start), struct.Struct(end + word)
    entry, counted = struct.Struct(f"{end}HH{word}{room}s"), struct.Struct(end + count_of)

    def at(offset: int, size: int) -> bytes:
        f.seek(offset)
        return f.read(size)

    (first,) = number.unpack(start)
    out: dict[int, tuple] = {}
    for _ in range(nth):
        (n,) = counted.unpack(at(first, counted.size))
        (first,) = number.unpack(at(first + counted.size + n * entry.size, number.size))
        if not first:
            return end, out
    (n,) = counted.unpack(at(first, counted.size))
    for tag, kind, count, own in entry.iter_unpack(at(first + counted.size, n * entry.size)):
        code = TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize(end + code) * count
        data = own[:size] if size <= room else at(number.unpack(own)[0], size)
        out[tag] = (data,) if code == "s" else struct.unpack(f"{end}{count}{code}" if len(code) == 1 else f"{end}{2 * count}I", data)
    return end, out


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; 256 clears the table and 257 ends."""
    out, table, width, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
    bits = have = 0
    for byte in data:
        bits, have = (bits << 8) | byte, have + 8
        if have < width:
            continue
        have -= width
        code, bits = bits >> have, bits & ((1 << have) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = table[:258], 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


@dataclass(frozen=True)
class Layout:
    """How a file's blocks hold its cells."""

    path: str
    kind: str
    packed: int
    predictor: int
    nodata: float | None
    height: int
    width: int
    block_h: int
    block_w: int
    bands: int  # interleaved in each block

    def decode(self, data: bytes, rows: int) -> np.ndarray:
        """The first band of a block's bytes as rows x block_w numbers; what is masked is NaN."""
        raw = {RAW: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}[self.packed](data)
        kind = np.dtype(self.kind)
        shape = rows, self.block_w, self.bands
        n = rows * self.block_w * self.bands
        if self.predictor == 3:  # bytes of one weight together, the highest first, as differences along a row
            planes = np.frombuffer(raw, np.uint8)[: n * kind.itemsize].reshape(rows, -1, self.bands)
            planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, -1)
            a = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)
        else:
            a = np.frombuffer(raw, kind, count=n).reshape(shape)
            if self.predictor == 2:
                a = np.cumsum(a, axis=1, dtype=kind.newbyteorder("="))
        a = a[:, :, 0]
        a = a.astype(float)
        return np.where(~np.isfinite(a) | (np.abs(a) >= SENTINEL) | (a == self.nodata), np.nan, a)


#: First and last row, first and last column.
Window = tuple[int, int, int, int]


def within(layout: Layout, blocks: list[tuple[int, int, int, int]], window: Window) -> list[tuple[int, int, int, int]]:
    """The blocks that hold cells of a window."""
    r0, r1, c0, c1 = window
    return [b for b in blocks if b[0] <= r1 and b[0] + layout.block_h > r0 and b[1] <= c1 and b[1] + layout.block_w > c0]


class _Reader(DataSourceReader):
    def __init__(self, layout: Layout, blocks: list[tuple[int, int, int, int]], window: Window):
        self.layout, self.blocks, self.window = layout, blocks, window

    def partitions(self) -> list[InputPartition]:
        each = max(1, CELLS // (self.layout.block_h * self.layout.block_w))
        return [InputPartition(self.blocks[i : i + each]) for i in range(0, len(self.blocks), each)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        own, (ra, rb, ca, cb) = self.layout, self.window
        fs, name = place(own.path)
        with fs.open_input_file(name) as f:
            for r0, c0, offset, size in partition.value:
                f.seek(offset)
                rows = own.block_h if own.block_w < own.width or own.height >= r0 + own.block_h else own.height - r0
                a = own.decode(f.read(size), rows)[: own.height - r0, : own.width - c0]
                top, left = max(0, ra - r0), max(0, ca - c0)
                a = a[top : max(top, rb - r0 + 1), left : max(left, cb - c0 + 1)]
                r, c = np.nonzero(~np.isnan(a))
                r0, c0 = r0 + top, c0 + left
                yield pa.RecordBatch.from_arrays([pa.array((r + r0).astype(np.int32)), pa.array((c + c0).astype(np.int32)), pa.array(a[r, c])], names=["r", "c", "v"])


class _PushingReader(_Reader):
    """For sessions that push filters into Python sources; others refuse a reader that takes some."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ranges of r and c narrow the window; as cells are cut to it, they need no test afterwards."""
        low = {"r": self.window[0], "c": self.window[2]}
        high = {"r": self.window[1], "c": self.window[3]}
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if name not in low or not isinstance(value, int):
                if not (isinstance(f, IsNotNull) and name in ("r", "c", "v")):  # no cell is NULL
                    yield f
            elif isinstance(f, EqualTo):
                low[name], high[name] = max(low[name], value), min(high[name], value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                low[name] = max(low[name], value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                high[name] = min(high[name], value - isinstance(f, LessThan))
            else:
                yield f
        self.window = low["r"], high["r"], low["c"], high["c"]
        self.blocks = within(self.layout, self.blocks, self.window)


class GeoTiffCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff_cells"

    def schema(self) -> str:
        return "r int, c int, v double"

    def reader(self, schema) -> _Reader:
        meta, layout, blocks = _layout(self.options["path"], int(self.options.get("overview", "0")))
        named = self.options.get("window")
        window = tuple(int(x) for x in named.split(",")) if named else (0, meta.h - 1, 0, meta.w - 1)
        kind = _PushingReader if self.options.get("push") == "true" else _Reader
        return kind(layout, within(layout, blocks, window), window)


def _layout(path: str, overview: int = 0) -> tuple[Meta, Layout, list[tuple[int, int, int, int]]]:
    """Meta, layout and the blocks (first row, first column, offset, size) of a file, or of one of its overviews."""
    fs, name = place(path)
    with fs.open_input_file(name) as f:
        end, t = tags(f)
        if overview:
            whole, t = t, tags(f, overview)[1]
            # An overview has the whole's place; its cells are as much larger as they are fewer.
            t |= {k: whole[k] for k in (TIE, KEYS, NODATA) if k in whole}
            sx, sy, sz = whole.get(SCALE, (1.0, 1.0, 0.0))
            t[SCALE] = sx * whole[WIDTH][0] / t[WIDTH][0], sy * whole[HEIGHT][0] / t[HEIGHT][0], sz
    w, h = t[WIDTH][0], t[HEIGHT][0]
    sx, sy, _ = t.get(SCALE, (1.0, 1.0, 0.0))
    tie, keys = t.get(TIE, (0.0,) * 6), t.get(KEYS, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] in (3072, 2048)), 0)
    meta = Meta(h, w, tie[3] - tie[0] * sx, tie[4] + tie[1] * sy, sx, -sy, f"EPSG:{epsg}" if epsg else "", any(keys[i] == 1024 and keys[i + 3] == 2 for i in range(4, len(keys), 4)))
    packed, predictor = t.get(COMPRESSION, (RAW,))[0], t.get(PREDICTOR, (1,))[0]
    if packed not in (RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or predictor not in (1, 2, 3):
        raise ValueError(f"compression {packed} or predictor {predictor} is not supported")
    bands, apart = t.get(SAMPLES, (1,))[0], t.get(PLANES, (1,))[0] == 2
    tiled = TILE_OFFSETS in t
    bh, bw = (t[TILE_HEIGHT][0], t[TILE_WIDTH][0]) if tiled else (min(t.get(ROWS, (h,))[0], h), w)
    across = -(-w // bw)
    places = list(zip(t[TILE_OFFSETS if tiled else OFFSETS], t[TILE_COUNTS if tiled else COUNTS], strict=True))[: across * -(-h // bh)]  # the first band's, where bands are apart
    nodata = float(t[NODATA][0].split(b"\0")[0]) if NODATA in t else None
    kind = end + {1: "u", 2: "i", 3: "f"}[t.get(FORMAT, (1,))[0]] + str(t[BITS][0] // 8)
    return meta, Layout(path, kind, packed, predictor, nodata, h, w, bh, bw, 1 if apart else bands), [(i // across * bh, i % across * bw, o, n) for i, (o, n) in enumerate(places) if n]


def read(spark: SparkSession, path: str, window: Window | None = None, overview: int = 0) -> tuple[Meta, DataFrame]:
    """Meta and cells (r, c, v) of a raster, or of a window of it: its blocks alone are read. Where Spark pushes filters into Python
    sources (spark.sql.python.filterPushdown.enabled), ranges of r and c become a window too."""
    ship(spark)
    spark.dataSource.register(GeoTiffCells)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    rows = spark.read.format("geotiff_cells").option("overview", overview).option("push", push)
    if window:
        rows = rows.option("window", ",".join(map(str, window)))
    return _layout(path, overview)[0], rows.load(path)


def overviews(path: str) -> list[tuple[int, int, int]]:
    """Directory, rows and columns of each overview that a file holds, the largest first."""
    fs, name = place(path)
    out = []
    with fs.open_input_file(name) as f:
        while t := tags(f, len(out) + 1)[1]:
            out.append((len(out) + 1, t[HEIGHT][0], t[WIDTH][0], t.get(SUBFILE, (0,))[0] == 1))
    return sorted(((i, h, w) for i, h, w, reduced in out if reduced), key=lambda x: -x[1])


def load(spark: SparkSession, path: str, crop: str = "full", most: int = 0) -> tuple[Meta, DataFrame]:
    """An elevation raster as the grid of an analysis: decimated by area to `most` cells on its longest side (0: as it is),
    then its middle half if crop is "center"."""
    from lodestrata.operators import grid

    longest = lambda h, w: most and max(h, w) >= most
    enough = [i for i, h, w in overviews(path) if longest(h, w)]
    overview = enough[-1] if enough else 0  # the smallest that still has as many cells
    meta, cells = read(spark, path, overview=overview)
    if crop == "center":
        # The rows and columns that the middle half of the decimated grid is made of, and one more on each side.
        scale = min(1.0, most / max(meta.h, meta.w)) if most else 1.0
        cut = lambda n, m: (max(0, int(m // 4 * n / m) - 1), min(n - 1, -int(-(m // 4 + m // 2) * n // m) + 1))
        side = lambda n: max(1, round(n * scale))
        cells = read(spark, path, (*cut(meta.h, side(meta.h)), *cut(meta.w, side(meta.w))), overview)[1]
    cells, meta = grid.limited(cells, meta, most)
    if crop == "center":
        cells, meta = grid.center_crop(cells, meta)
    return meta, cells


def load_aligned(spark: SparkSession, path: str, target: Meta) -> DataFrame | None:
    """A raster resampled bilinearly to target's cells, whatever its projection; None where it does not overlap."""
    from lodestrata.operators import grid

    meta = _layout(path)[0]
    # Where the target's border lies in the file bounds what of it is needed.
    border = (F.col("r") == 0) | (F.col("r") == target.h - 1) | (F.col("c") == 0) | (F.col("c") == target.w - 1)
    x, y = grid.pixel_to_world(target, F.col("r"), F.col("c"))
    x, y = crs.convert(x, y, target.code(), meta.code())
    at = grid.cells(spark, target).filter(border).select(((y - meta.y0) / meta.dy).alias("r"), ((x - meta.x0) / meta.dx).alias("c")).filter("NOT isnan(r) AND NOT isnan(c)")
    r0, r1, c0, c1 = at.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    if r0 is None or r1 < -1 or c1 < -1 or r0 > meta.h or c0 > meta.w:
        return None
    clip = lambda v, n: int(min(max(v, 0), n - 1))
    cells = read(spark, path, (clip(r0 - 2, meta.h), clip(r1 + 2, meta.h), clip(c0 - 2, meta.w), clip(c1 + 2, meta.w)))[1]
    out = grid.align(cells, meta, target)
    return None if out.isEmpty() else out


def _directory(meta: Meta, epsg: int, rows: int, offsets: list[int], counts: list[int], at: int, nodata: bool) -> bytes:
    """What follows the strips: values that do not fit their fields, then the directory, whose place comes first."""
    n = len(offsets)
    extra = [struct.pack("<3d", meta.dx, -meta.dy, 0.0), struct.pack("<6d", 0, 0, 0, meta.x0, meta.y0, 0), struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 2 if meta.geographic else 1, 2048 if meta.geographic else 3072, 0, 1, epsg), b"-9999\0", struct.pack(f"<{n}I", *offsets), struct.pack(f"<{n}I", *counts)]
    places = []
    for e in extra:
        places.append(at)
        at += len(e) + len(e) % 2
    listed = lambda tag, values, there: (tag, 4, n, there if n > 1 else values[0])
    fields = [(WIDTH, 4, 1, meta.w), (HEIGHT, 4, 1, meta.h), (BITS, 3, 1, 32), (COMPRESSION, 3, 1, DEFLATE), (262, 3, 1, 1), listed(OFFSETS, offsets, places[4]), (SAMPLES, 3, 1, 1), (ROWS, 4, 1, rows), listed(COUNTS, counts, places[5]), (FORMAT, 3, 1, 3), (SCALE, 12, 3, places[0]), (TIE, 12, 6, places[1]), (KEYS, 3, 12, places[2])]
    fields += [(NODATA, 2, 6, places[3])] if nodata else []
    body = b"".join(struct.pack("<HHII", *f) if f[1] == 4 or f[2] > 1 else struct.pack("<HHIHH", *f, 0) for f in sorted(fields))
    return struct.pack("<I", at) + b"".join(e + b"\0" * (len(e) % 2) for e in extra) + struct.pack("<H", len(fields)) + body + struct.pack("<I", 0)


def write(grid: DataFrame, meta: Meta, path: str, epsg: int = 0, rows: int = 64, nodata: bool = True) -> None:
    """grid as one float32 file. Masked cells get the nodata value; with nodata false they are 0 and no such value is named."""
    none, w, h = NONE if nodata else 0.0, meta.w, meta.h

    def strip(cells: pa.Table) -> pa.Table:
        i = cells["i"][0].as_py()
        a = np.full((min(rows, h - i * rows), w), none, "<f4")
        a[cells["r"].to_numpy() - i * rows, cells["c"].to_numpy()] = cells["v"].to_numpy()
        return pa.table({"i": pa.array([i], pa.int32()), "data": pa.array([zlib.compress(a.tobytes())], pa.binary())})

    cells = grid.filter("v IS NOT NULL").select((F.col("r") / rows).cast("int").alias("i"), "r", "c", F.col("v").cast("double").alias("v"))
    made = dict(zip(*(x.to_pylist() for x in cells.groupBy("i").applyInArrow(strip, "i int, data binary").toArrow().columns), strict=True))  # compressed strips
    empty = lambda i: zlib.compress(np.full((min(rows, h - i * rows), w), none, "<f4").tobytes())
    strips = [made.get(i) or empty(i) for i in range(-(-h // rows))]
    offsets = (8 + np.concatenate([[0], np.cumsum([len(s) for s in strips])])).tolist()
    tail = _directory(meta, epsg, rows, offsets[:-1], [len(s) for s in strips], offsets[-1] + offsets[-1] % 2, nodata)
    fs, name = place(path)
    with fs.open_output_stream(name, compression=None) as f:
        f.write(b"II" + struct.pack("<H", 42) + tail[:4])
        for s in strips:
            f.write(s)
        f.write(b"\0" * (offsets[-1] % 2) + tail[4:])
