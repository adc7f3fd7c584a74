"""Raster files as pixel tables: GeoTIFFs without compression or deflated, in strips or tiles.

Headers are read first and say where a file's strips and tiles lie; tasks then
read byte ranges, so that a file is many tasks' work and a window reads only
what it meets. Pixels come as rows of values, cut to stretches of MOST columns.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 1024
#: Bytes of an uncompressed strip that are read at a time, and of a header that are read at once.
PIECE, HEAD = 1 << 22, 1 << 16
# Numbers of the tags, and bytes of the field types, of the TIFF format.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, MATRIX, GEO_KEYS, NO_DATA, METADATA = 33550, 33922, 34264, 34735, 42113, 42112
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q"}
KINDS = {1: "u", 2: "i", 3: "f"}


class Ranges:
    """A file's bytes by ranges, from any store that Spark's workers see; slices of it are read when asked for."""

    def __init__(self, path: str):
        if path.startswith("file:"):
            self.file = open("/" + path[5:].lstrip("/"), "rb")  # noqa: SIM115
        else:
            self.file = fs.FileSystem.from_uri(path)
            self.file = self.file[0].open_input_file(self.file[1])
        self.head = self.file.read(HEAD)

    def __getitem__(self, part: slice) -> bytes:
        if part.stop <= len(self.head):
            return self.head[part]
        self.file.seek(part.start)
        return self.file.read(part.stop - part.start)

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


class Tiff:
    """The first image of a TIFF file, of its bytes or ``Ranges``."""

    def __init__(self, data: bytes | Ranges):
        self.data, self.order = data, {b"II": "<", b"MM": ">"}.get(data[:2])
        if self.order is None or self._read("H", 2)[0] != 42:
            raise ValueError("not a TIFF file")
        self.tags: dict[int, tuple] = {}
        at = self._read("I", 4)[0]
        for i in range(self._read("H", at)[0]):
            tag, kind, n = self._read("HHI", at + 2 + 12 * i)
            code = TYPES.get(kind)
            if code is None:
                continue
            code = f"{n}s" if code == "s" else code * n
            size = struct.calcsize(self.order + code)
            where = at + 10 + 12 * i
            self.tags[tag] = self._read(code, where if size <= 4 else self._read("I", where)[0])
        self.width, self.height = self.tags[WIDTH][0], self.tags[HEIGHT][0]
        self.bands = self._one(SAMPLES, 1)
        if self._one(COMPRESSION, 1) not in (1, 8, 32946):
            raise ValueError(f"compression {self._one(COMPRESSION, 1)} can't be read")
        self.dtype = np.dtype(f"{self.order}{KINDS[self._one(FORMAT, 1)]}{self._one(BITS, 1) // 8}")

    def _read(self, code: str, at: int) -> tuple:
        code = self.order + code
        return struct.unpack(code, self.data[at : at + struct.calcsize(code)])

    def _one(self, tag: int, default: int) -> int:
        return self.tags.get(tag, (default,))[0]

    def transform(self) -> tuple[float, ...] | None:
        """(a, b, c, d, e, f) of x' = ax + by + c, y' = dx + ey + f."""
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            return (m[0], m[1], m[3], m[4], m[5], m[7])
        if SCALE in self.tags and TIEPOINT in self.tags:
            (sx, sy, _), (i, j, _, x, y, _) = self.tags[SCALE], self.tags[TIEPOINT][:6]
            return (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
        return None

    def epsg(self) -> int | None:
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return found.get(3072) or found.get(2048)

    def no_data(self) -> float | None:
        try:
            return float(self.tags[NO_DATA][0].split(b"\0")[0])
        except (KeyError, ValueError):
            return None

    def names(self) -> list[str]:
        """Descriptions of the bands, or band1, band2."""
        import re

        text = self.tags.get(METADATA, (b"",))[0].decode("utf-8", "replace")
        own = {int(m[1]): m[2] for m in re.finditer(r'<Item name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)<', text)}
        return [own.get(i) or f"band{i + 1}" for i in range(self.bands)]

    def pieces(self, col_off: int = 0, row_off: int = 0, width: int | None = None, height: int | None = None, bands: list[str] | None = None) -> Iterator[tuple]:
        """(plane, r0, r1, c0, c1, first row, tiles): the rows and columns of the window by strips and rows of tiles, at most MOST columns each.

        ``tiles`` are (column, offset, bytes) of what is read. A plane is a
        band, or -1 for all of them together; planes of no named band are left out.
        """
        tiled, apart = TILES in self.tags, self._one(PLANAR, 1) == 2
        w, h = (self.tags[TILE_W][0], self.tags[TILE_H][0]) if tiled else (self.width, min(self._one(ROWS, self.height), self.height))
        starts, sizes = self.tags[TILES if tiled else STRIPS], self.tags[TILE_BYTES if tiled else STRIP_BYTES]
        across, down = -(-self.width // w), -(-self.height // h)
        end_c = self.width if width is None else min(self.width, col_off + width)
        end_r = self.height if height is None else min(self.height, row_off + height)
        col, row = max(col_off, 0), max(row_off, 0)
        if col >= end_c or row >= end_r:
            return
        line = w * (1 if apart else self.bands) * self.dtype.itemsize
        some = max(1, PIECE // line) if self._one(COMPRESSION, 1) == 1 else h
        for plane in [i for i, n in enumerate(self.names()) if bands is None or n in bands] if apart else [-1]:
            for y in range(row // h, -(-end_r // h)):
                for top in range(y * h, min((y + 1) * h, end_r), some):
                    r0, r1 = max(top, row), min(top + some, (y + 1) * h, end_r)
                    if r0 >= r1:
                        continue
                    for c0 in range(col, end_c, MOST):
                        c1 = min(c0 + MOST, end_c)
                        tiles, first = [], y * h
                        for x in range(c0 // w, -(-c1 // w)):
                            n = max(plane, 0) * across * down + y * across + x
                            at, size = starts[n], sizes[n]
                            if some < h:  # whole rows of bytes can be read alone
                                at, size, first = at + (r0 - y * h) * line, (r1 - r0) * line, r0
                            tiles.append((x * w, at, size))
                        yield plane, r0, r1, c0, c1, first, tiles

    def read(self, piece: tuple) -> np.ndarray:
        """bands x rows x columns of a piece."""
        plane, r0, r1, c0, c1, first, tiles = piece
        per = self.bands if plane < 0 else 1
        w = self.tags[TILE_W][0] if TILES in self.tags else self.width
        out = np.zeros((per, r1 - r0, c1 - c0), self.dtype)
        for x, at, size in tiles:
            raw = self.data[at : at + size]
            raw = zlib.decompress(raw) if self._one(COMPRESSION, 1) != 1 else raw
            part = np.frombuffer(raw, self.dtype, len(raw) // (w * per * self.dtype.itemsize) * w * per).reshape(-1, w, per)[r0 - first : r1 - first]
            if self._one(PREDICTOR, 1) == 2:
                part = np.cumsum(part, axis=1, dtype=self.dtype)
            elif self._one(PREDICTOR, 1) != 1:
                raise ValueError("the predictor of floats can't be read")
            lo, hi = max(x, c0), min(x + w, c1)
            out[:, : len(part), lo - c0 : hi - c0] = part[:, lo - x : hi - x].transpose(2, 0, 1)
        return out

    def array(self) -> np.ndarray:
        """bands x height x width."""
        out = np.zeros((self.bands, self.height, self.width), self.dtype)
        for p in self.pieces():
            out[slice(None) if p[0] < 0 else slice(p[0], p[0] + 1), p[1] : p[2], p[3] : p[4]] = self.read(p)
        return out


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of every file; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, bands, dtype, epsg, transform, no_data, gsd, names of every file; only headers are read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for name in p["path"]:
                with Ranges(name) as data:
                    t = Tiff(data)
                    m = t.transform()
                    rows.append((name, t.width, t.height, t.bands, t.dtype.name, t.epsg(), None if m is None else list(m), t.no_data(), None if m is None else abs(m[0]), t.names()))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "bands", "dtype", "epsg", "transform", "no_data", "gsd", "names"])

    return files(spark, path).select("path").mapInPandas(run, "path string, width int, height int, bands int, dtype string, epsg int, transform array<double>, no_data double, gsd double, names array<string>")


def pieces(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, bands: list[str] | None = None) -> DataFrame:
    """path, plane, r0, r1, c0, c1, first, tiles, bytes: what tasks read of every file, a row each; only headers are read here.

    ``window`` is (col_off, row_off, width, height), cut to each file; strips and
    tiles that it doesn't meet, and planes of other bands, are left out. A file
    that the window misses has no row.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name in p["path"]:
                with Ranges(name) as data:
                    rows = [(name, *x[:6], [dict(zip(("x", "at", "size"), t)) for t in x[6]], sum(t[2] for t in x[6])) for x in Tiff(data).pieces(*(window or ()), bands=bands)]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "plane", "r0", "r1", "c0", "c1", "first", "tiles", "bytes"])

    return files(spark, path).select("path").mapInPandas(run, "path string, plane int, r0 long, r1 long, c0 long, c1 long, first long, tiles array<struct<x: long, at: long, size: long>>, bytes long")


def read_rows(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, bands: list[str] | None = None) -> DataFrame:
    """path, band, r, c0, values: the pixels of every file, or of a window counted from its corner, by stretches of rows; no data and NaN are NULL.

    ``pieces`` are dealt to tasks one by one, so that a large file is read by
    many; a task holds one piece (a row of tiles or a strip, MOST columns of it)
    at a time.
    """
    dx, dy = (max(window[0], 0), max(window[1], 0)) if window else (0, 0)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, own in p.groupby("path"):
                with Ranges(name) as data:
                    t = Tiff(data)
                    gap, names = t.no_data(), t.names()
                    for x in own.itertuples(index=False):
                        planes = t.read((x.plane, x.r0, x.r1, x.c0, x.c1, x.first, [(q["x"], q["at"], q["size"]) for q in x.tiles])).astype("float64")
                        if gap is not None:
                            planes[planes == gap] = np.nan
                        for band, plane in zip(names if x.plane < 0 else [names[x.plane]], planes):
                            if bands is None or band in bands:
                                values = [[None if v != v else v for v in line.tolist()] for line in plane]
                                yield pd.DataFrame({"path": name, "band": band, "r": np.arange(x.r0, x.r1) - dy, "c0": x.c0 - dx, "values": values})

    todo = pieces(spark, path, window, bands)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return todo.repartition(n, "path", "plane", "r0", "c0").mapInPandas(run, "path string, band string, r long, c0 long, values array<double>")


def pixels(rows: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """path, r, c and a column per band: ``read_rows`` as a pixel table. The bands must share a grid (``stacks.stack`` puts them on one)."""
    from seasight.operators import stacks

    return stacks.pixels(rows, bands or sorted(r["band"] for r in rows.select("band").distinct().collect()))


def window(px: DataFrame, col_off: int, row_off: int, width: int, height: int) -> DataFrame:
    """The pixels of a window, counted from its corner."""
    inside = F.col("c").between(col_off, col_off + width - 1) & F.col("r").between(row_off, row_off + height - 1)
    return px.filter(inside).withColumns({"c": F.col("c") - col_off, "r": F.col("r") - row_off})


def on_grid(long: DataFrame, gsd: float, own: float, method: str = "bilinear") -> DataFrame:
    """r, c, v of a band whose pixels are ``own`` wide, on a grid of pixels ``gsd`` wide that shares its corner.

    Nearest takes the pixel under each new pixel's centre; bilinear weighs the
    four around it, those without data left out, and repeats the outer ones.
    """
    from seasight.operators.display import coarsen

    if own == gsd:
        return long.select("r", "c", "v")
    k = own / gsd
    if k < 1:
        by = round(1 / k)
        return coarsen(long, by, ["v"])
    span = lambda at, more: F.explode(F.sequence(F.floor((F.col(at) - more) * k).cast("long"), F.ceil((F.col(at) + 1 + more) * k).cast("long") - 1))
    if method == "nearest":
        return long.select("v", span("r", 0).alias("r2"), "c").select("v", "r2", span("c", 0).alias("c2")).select(F.col("r2").alias("r"), F.col("c2").alias("c"), "v")
    ends = long.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    if ends["r"] is None:
        return long.select("r", "c", "v")
    o = long.filter("v is not null").withColumn("r2", span("r", 0.5)).withColumn("c2", span("c", 0.5))

    def weight(new: str, old: str, last: int):
        at = F.least(F.greatest((F.col(new) + 0.5) / k - 0.5, F.lit(0.0)), F.lit(float(last)))
        return F.greatest(1 - F.abs(at - F.col(old)), F.lit(0.0))

    o = o.withColumn("w", weight("r2", "r", ends["r"]) * weight("c2", "c", ends["c"])).filter(f"w > 0 and r2 >= 0 and c2 >= 0 and r2 < {(ends['r'] + 1) * k} and c2 < {(ends['c'] + 1) * k}")
    return o.groupBy(F.col("r2").alias("r"), F.col("c2").alias("c")).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def encode(planes: dict[str, np.ndarray], transform: tuple[float, ...] | None = None, epsg: int | None = None) -> bytes:
    """A small GeoTIFF of 16-bit bands, without compression; names go into the descriptions."""
    names, stack = list(planes), np.stack(list(planes.values())).astype("<u2")
    n, h, w = stack.shape
    body = stack.tobytes()
    text = "<GDALMetadata>" + "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{x}</Item>' for i, x in enumerate(names)) + "</GDALMetadata>"
    tags: dict[int, tuple[str, tuple]] = {
        WIDTH: ("I", (w,)), HEIGHT: ("I", (h,)), BITS: ("H", (16,) * n), COMPRESSION: ("H", (1,)), 262: ("H", (1,)), STRIPS: ("I", tuple(8 + i * h * w * 2 for i in range(n))),
        SAMPLES: ("H", (n,)), ROWS: ("I", (h,)), STRIP_BYTES: ("I", (h * w * 2,) * n), PLANAR: ("H", (2,)), FORMAT: ("H", (1,) * n), METADATA: ("s", (text.encode() + b"\0",)),
    }
    if transform:
        a, _, c, _, e, f = transform
        tags |= {SCALE: ("d", (a, -e, 0.0)), TIEPOINT: ("d", (0.0, 0.0, 0.0, c, f, 0.0))}
    if epsg:
        tags[GEO_KEYS] = ("H", (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg))
    at = 8 + len(body)
    back = {v: k for k, v in TYPES.items() if len(v) == 1}
    head, extra, where = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        code, values = tags[tag]
        raw = values[0] if code == "s" else struct.pack("<" + code * len(values), *values)
        head += struct.pack("<HHI", tag, back[code], len(raw) if code == "s" else len(values))
        if len(raw) <= 4:
            head += raw.ljust(4, b"\0")
        else:
            head += struct.pack("<I", where + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(tags)) + head + struct.pack("<I", 0) + extra


def chips(px: DataFrame, key: str, bands: list[str], width: int, height: int, transform: tuple[float, ...] | None = None, epsg: int | None = None) -> DataFrame:
    """key, content: every chip of a pixel table (key, r, c, bands) as a GeoTIFF; pixels that are missing are 0. A chip is one file and one task's work."""

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        planes = {b: np.zeros((height, width)) for b in bands}
        for b in bands:
            planes[b][rows["r"], rows["c"]] = rows[b].fillna(0)
        return pd.DataFrame({key: [rows[key].iloc[0]], "content": [encode(planes, transform, epsg)]})

    return px.groupBy(key).applyInPandas(make, f"{key} {px.schema[key].dataType.simpleString()}, content binary")
