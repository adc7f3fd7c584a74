"""Windows of a scene's pixels as arrays: packed blocks that a detector sees.

Pixels travel as stretches of rows, arrays of a band, and not one by one; a
window's stretches are laid into one block per band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasight.lineage import keep

WINDOW = ["image", "row_off", "col_off"]
#: Pixels of a stretch at most.
STRETCH = 1024
BLOCK = "image long, row_off long, col_off long, height int, width int, dtype string, bands map<string,binary>"
FOUND = "image long, row_off long, col_off long, xmin double, ymin double, xmax double, ymax double, label string, score double"
#: Blocks that a detector gets at a time: a frame of them is held in memory.
AT_A_TIME = 4

Detector = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def stretches(px: DataFrame, bands: list[str], most: int = STRETCH) -> DataFrame:
    """image, r, band, cs, values: a pixel table (image, r, c, bands) by stretches of rows, each with its pixels' columns. NULL is no data."""
    c = F.col
    own = px.select("image", "r", c("c").cast("long").alias("c"), *[c(b).cast("double").alias(b) for b in bands])
    rows = own.groupBy("image", "r", F.floor(c("c") / most).alias("s")).agg(F.collect_list(F.struct("c", *bands)).alias("p"))
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), c(f"p.{b}").alias("values")) for b in bands]))
    return rows.select("image", "r", c("p.c").alias("cs"), each.alias("x")).select("image", "r", "x.band", "cs", "x.values")


def from_rows(rows: DataFrame) -> DataFrame:
    """The same of stretches that begin at a column (image, band, r, c0, values), as raster files give them."""
    n = F.size("values")
    return rows.filter(n > 0).select("image", "r", "band", F.sequence(F.col("c0").cast("long"), F.col("c0").cast("long") + n - 1).alias("cs"), "values")


def pixels(s: DataFrame, bands: list[str]) -> DataFrame:
    """image, r, c and a column per band, of stretches that all bands cut alike: bands meet as arrays, and pixels are made of them in place."""
    c = F.col
    one = s.filter(c("band").isin(bands)).groupBy("image", "r", F.get("cs", 0).alias("c0")).agg(F.first("cs").alias("cs"), *[F.first(F.when(c("band") == b, c("values")), True).alias(b) for b in bands])
    return one.select("image", "r", F.explode(F.arrays_zip("cs", *bands)).alias("p")).select("image", "r", c("p.cs").alias("c"), *[c(f"p.{b}").alias(b) for b in bands])


def window_range(lo: Column, hi: Column, extent: int, size: int, overlap: int) -> Column:
    """Where the windows along an axis start that have a pixel from lo to hi."""
    step = size - overlap
    last = -(-(extent - size) // step) * step if extent > size else 0
    first = F.greatest(F.lit(0), F.ceil((lo - size + 1) / step)) * step
    return F.sequence(first.cast("long"), F.greatest(first, F.least(F.floor(hi / step) * step, F.lit(last))).cast("long"), F.lit(step).cast("long"))


def blocks(s: DataFrame, windows: DataFrame, width: int, height: int, size: int, overlap: int, dtype: str = "float32") -> DataFrame:
    """BLOCK: the ``windows`` (image, row_off, col_off) of stretches, with the bytes of every band, row by row; no data is NaN.

    A stretch names the windows that it has pixels of; a window is put together
    in one task, and as large as a window is.
    """
    c = F.col
    w = s.withColumn("row_off", F.explode(window_range(c("r"), c("r"), height, size, overlap)))
    w = w.withColumn("col_off", F.explode(window_range(F.array_min("cs"), F.array_max("cs"), width, size, overlap)))
    w = w.join(windows.select(*WINDOW).distinct(), WINDOW, "left_semi")

    def lay(rows: pa.Table) -> pa.Table:
        first = {k: rows.column(k)[0].as_py() for k in WINDOW}
        h, wide = min(size, height - first["row_off"]), min(size, width - first["col_off"])
        out: dict[str, np.ndarray] = {}
        for b in rows.to_batches():
            band, r = b.column("band").to_pylist(), b.column("r").to_numpy() - first["row_off"]
            cs, values = b.column("cs"), b.column("values")
            for i, name in enumerate(band):
                at = cs[i].values.to_numpy() - first["col_off"]
                v = values[i].values.to_numpy(zero_copy_only=False)
                inside = (at >= 0) & (at < wide)
                if name not in out:
                    out[name] = np.full((h, wide), np.nan, dtype)
                out[name][r[i], at[inside]] = v[inside]
        bands = pa.array([[(k, v.tobytes()) for k, v in sorted(out.items())]], pa.map_(pa.string(), pa.binary()))
        return pa.table({**{k: pa.array([v], pa.int64()) for k, v in first.items()}, "height": pa.array([h], pa.int32()), "width": pa.array([wide], pa.int32()), "dtype": [dtype], "bands": bands})

    return w.select(*WINDOW, "r", "band", "cs", "values").groupBy(*WINDOW).applyInArrow(lay, BLOCK)


def arrays(block) -> dict[str, np.ndarray]:
    """The bands of a block (a row of a frame of BLOCK), by name, of its height and width."""
    return {k: np.frombuffer(v, block["dtype"]).reshape(block["height"], block["width"]) for k, v in dict(block["bands"]).items()}


def as_uint8(image: np.ndarray) -> np.ndarray:
    """An image of one or three channels as height x width x 3 bytes: grey thrice, a fourth channel dropped, floats within 0 and 1 as shares of 255, others cut to 0 to 255, no data as 0."""
    a = np.asarray(image)
    a = a[..., None] if a.ndim == 2 else a
    if a.ndim != 3 or a.shape[2] not in (1, 3, 4):
        raise ValueError(f"an image has one, three or four channels, got the shape {np.shape(image)}")
    a = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[..., :3]
    if a.dtype == np.uint8:
        return a
    v = np.nan_to_num(a.astype("float64"), nan=0.0, posinf=255.0, neginf=0.0)
    return np.rint(np.clip(v * 255 if v.size and v.max() <= 1 else v, 0, 255)).astype("uint8")


def rgb(bands: dict[str, np.ndarray], channels: tuple[str, str, str] = ("red", "green", "blue"), low: float = 2.0, high: float = 98.0) -> np.ndarray:
    """Three bands as an image of bytes, each stretched between its percentiles; no data is the low end, a band without contrast mid grey, and one without data, or that isn't there, black."""
    shape = next(iter(bands.values())).shape
    out = np.zeros((*shape, 3), "uint8")
    for i, name in enumerate(channels):
        v = bands[name].astype("float64") if name in bands else np.full(shape, np.nan)
        good = np.isfinite(v)
        if good.any():
            lo, hi = np.percentile(v[good], [low, high])
            share = np.clip((np.where(good, v, lo) - lo) / (hi - lo), 0, 1) if hi > lo else np.full(shape, 0.5)
            out[..., i] = np.rint(share * 255)
    return out


def per_window(find: Callable[[dict[str, np.ndarray]], list[tuple]]) -> Detector:
    """A detector of a function from a window's bands to its boxes (xmin, ymin, xmax, ymax, label, score), in the window's pixels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(*(b[k] for k in WINDOW), *found) for b in f.to_dict("records") for found in find(arrays(b))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")])

    return run


def detect(blocks: DataFrame, detector: Detector, schema: str = FOUND, at_a_time: int = AT_A_TIME) -> DataFrame:
    """What a detector finds in blocks, computed once and kept: it maps an iterator of frames of BLOCK, of ``at_a_time`` rows at most, to frames of ``schema``, and can load its model once a task."""
    conf, name = blocks.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(at_a_time))  # windows are large; keep() runs before it is put back
    try:
        return keep(blocks.mapInPandas(lambda frames: detector(frames), schema))
    finally:
        conf.set(name, before)
