"""Web Mercator tiles, UTM projection and boxes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LATITUDE = 85.0511287798066  # fixed value: where the Mercator square ends
# WGS84 and UTM.
_A, _F, _K0, _FALSE_EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)

_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def tile_lon(x: Column, z: Column) -> Column:
    return x / F.pow(F.lit(2.0), z) * 360.0 - 180.0


def tile_lat(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / F.pow(F.lit(2.0), z)))))


def lon_tile(lon: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * n), F.lit(0)), (n - 1).cast("long"))


def lat_tile(lat: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE)))
    return F.least(F.greatest(F.floor((1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * n), F.lit(0)), (n - 1).cast("long"))


def tile_name(x: Column, y: Column, z: Column) -> Column:
    return F.concat_ws("-", x.cast("string"), y.cast("string"), z.cast("string"))


def valid_tile(x: Column, y: Column, z: Column) -> Column:
    """Zooms from 0 to 30, and columns and rows that the zoom has."""
    n = F.pow(F.lit(2.0), z)
    return F.coalesce(z.between(0, 30) & (x >= 0) & (x < n) & (y >= 0) & (y < n), F.lit(False))


def parse_tile_name(name: Column) -> Column:
    """x, y and z of a tile's file name: its last three parts between hyphens; NULL where they aren't whole numbers or name no tile."""
    stem = F.regexp_replace(F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    part = lambda i: F.regexp_extract(stem, r"(?:^|.*-)([0-9]+)-([0-9]+)-([0-9]+)$", i).try_cast("long")
    x, y, z = part(1), part(2), part(3)
    return F.when(valid_tile(x, y, z), F.struct(x.alias("x"), y.alias("y"), z.cast("int").alias("z")))


def tiles_of_box(west: Column, south: Column, east: Column, north: Column, zoom: int) -> Column:
    """x and y of every tile of the zoom that a box in degrees reaches, row by row; a box whose west is east of its east crosses the date line."""
    if not 0 <= zoom <= 30:
        raise ValueError(f"zoom must be from 0 to 30, got {zoom}")
    z, edge = F.lit(zoom), 1e-11  # a box that ends at a tile's edge doesn't reach the next one
    top = F.lit(2**zoom - 1).cast("long")
    run = lambda a, b: F.sequence(a, F.greatest(a, b))
    first, last = lon_tile(west, z), lon_tile(east - edge, z)
    xs = F.when(west > east, F.array_distinct(F.concat(run(F.lit(0).cast("long"), last), run(first, top)))).otherwise(run(first, last))
    ys = run(lat_tile(north, z), lat_tile(south + edge, z))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def axis_offsets(extent: Column, size: int, step: int) -> Column:
    """Where windows of ``size`` start along an axis: every ``step``, and once more where a strip is left."""
    return F.when(extent > 0, F.expr("sequence(0L, 0L)") if size <= 0 else F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil((extent - size) / step) * step).cast("long"), F.lit(step).cast("long")))


def windows_of(width: Column, height: Column, size: int, overlap: int) -> Column:
    """col_off, row_off, width and height of overlapping windows over a raster, row by row; the last ones of a row or column may be short."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"need 0 <= overlap < size, got {overlap} and {size}")
    xs, ys = axis_offsets(width, size, size - overlap), axis_offsets(height, size, size - overlap)
    part = lambda extent, at: F.least(F.lit(size), extent - at)
    one = lambda y: F.transform(xs, lambda x: F.struct(x.alias("col_off"), y.alias("row_off"), part(width, x).alias("width"), part(height, y).alias("height")))
    return F.flatten(F.transform(ys, one))


def window_transform(transform: tuple[float, ...], col_off: Column, row_off: Column) -> tuple[Column, ...]:
    """The transform of a window's own pixels, of a raster's ``transform``."""
    a, b, c, d, e, f = transform
    x, y = affine(col_off, row_off, transform)
    return F.lit(a), F.lit(b), x, F.lit(d), F.lit(e), y


def utm_zone(lon: Column) -> Column:
    return F.least(F.greatest(F.floor((lon + 180.0) / 6.0) + 1, F.lit(1)), F.lit(60))


def utm_epsg(lon: Column, lat: Column) -> Column:
    return utm_zone(lon) + F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700))


def utm_forward(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing (of the northern grid) by the Krueger series; good to a millimetre within a zone."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _FALSE_EAST + _K0 * _RADIUS * east, _K0 * _RADIUS * north


def utm_inverse(easting: Column, northing: Column, zone: Column) -> tuple[Column, Column]:
    """Longitude and latitude of easting and northing (of the northern grid)."""
    xi, eta = northing / (_K0 * _RADIUS), (easting - _FALSE_EAST) / (_K0 * _RADIUS)
    x, e = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(e), F.cos(x))), F.degrees(phi)


def affine(x: Column, y: Column, transform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """A pixel position in map units: transform is (a, b, c, d, e, f) of x' = ax + by + c, y' = dx + ey + f."""
    a, b, c, d, e, f = transform
    return a * x + b * y + c, d * x + e * y + f


def tile_transform(x: Column, y: Column, z: Column, size: int) -> tuple[Column, ...]:
    """Of a tile's image, ``size`` pixels wide: pixels to degrees, linear within the tile."""
    west, north = tile_lon(x, z), tile_lat(y, z)
    zero = F.lit(0.0)
    return (tile_lon(x + 1, z) - west) / size, zero, west, zero, (tile_lat(y + 1, z) - north) / size, north


def box_ring(transform: tuple) -> Column:
    """The four corners (x, y) of a box through a transform, from (xmin, ymin) on, around."""
    corners = [affine(F.col(a), F.col(b), transform) for a, b in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))]
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])


def area_m2(pixel: Column) -> Column:
    """Of a box in pixels ``pixel`` metres wide; NULL where that is unknown."""
    return area() * pixel * pixel


def overlap(a: str = "", b: str = "g_") -> Column:
    c = F.col
    w = F.least(c(f"{a}xmax"), c(f"{b}xmax")) - F.greatest(c(f"{a}xmin"), c(f"{b}xmin"))
    h = F.least(c(f"{a}ymax"), c(f"{b}ymax")) - F.greatest(c(f"{a}ymin"), c(f"{b}ymin"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def area(a: str = "") -> Column:
    return (F.col(f"{a}xmax") - F.col(f"{a}xmin")) * (F.col(f"{a}ymax") - F.col(f"{a}ymin"))


def iou(a: str = "", b: str = "g_") -> Column:
    """Intersection over union; 0 for disjoint boxes and for an empty union."""
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def width(a: str = "") -> Column:
    return F.col(f"{a}xmax") - F.col(f"{a}xmin")


def height(a: str = "") -> Column:
    return F.col(f"{a}ymax") - F.col(f"{a}ymin")


def centre(a: str = "") -> tuple[Column, Column]:
    return (F.col(f"{a}xmin") + F.col(f"{a}xmax")) / 2, (F.col(f"{a}ymin") + F.col(f"{a}ymax")) / 2


def geo_centre(west="west", south="south", east="east", north="north") -> tuple[Column, Column]:
    """Longitude and latitude of the middle of a box in degrees."""
    return (F.col(west) + F.col(east)) / 2, (F.col(south) + F.col(north)) / 2


def finite_box(a: str = "") -> Column:
    """All four ends are numbers."""
    out = F.lit(True)
    for k in ("xmin", "ymin", "xmax", "ymax"):
        out = out & F.coalesce(F.abs(F.col(f"{a}{k}")) < float("inf"), F.lit(False)) & ~F.isnan(F.col(f"{a}{k}"))
    return out


def centre_size(width: float, height: float, a: str = "") -> Column:
    """Centre and size of a box, as shares of an image's width and height: what detectors are trained on."""
    x, y = centre(a)
    return F.array(x / width, y / height, (F.col(f"{a}xmax") - F.col(f"{a}xmin")) / width, (F.col(f"{a}ymax") - F.col(f"{a}ymin")) / height)


def xyxy(a: str = "") -> Column:
    return F.array(*[F.col(f"{a}{k}") for k in ("xmin", "ymin", "xmax", "ymax")])


def valid_pixel_box(a: str = "") -> Column:
    """Neither axis runs backwards; a box without width or height is one."""
    return F.coalesce((F.col(f"{a}xmax") >= F.col(f"{a}xmin")) & (F.col(f"{a}ymax") >= F.col(f"{a}ymin")), F.lit(False))


def box_of(values: Column, order: str = "yxyx", width: Column | None = None, height: Column | None = None) -> dict[str, Column]:
    """xmin, ymin, xmax, ymax of an array of four in the ``order`` yxyx or xyxy; with width and height they are shares of these."""
    if order not in ("yxyx", "xyxy"):
        raise ValueError(f"order must be yxyx or xyxy, got {order}")
    names = ("ymin", "xmin", "ymax", "xmax") if order == "yxyx" else ("xmin", "ymin", "xmax", "ymax")
    scale = {"x": width, "y": height}
    out = {n: F.get(values, i).cast("double") for i, n in enumerate(names)}
    return {n: out[n] * scale[n[0]] if scale[n[0]] is not None else out[n] for n in ("xmin", "ymin", "xmax", "ymax")}


def around(lon: Column, lat: Column, by: float = 0.15) -> dict[str, Column]:
    """A box in degrees, ``by`` on all sides of a point."""
    return {"west": lon - by, "south": lat - by, "east": lon + by, "north": lat + by}


def geo_ring(west="west", south="south", east="east", north="north") -> Column:
    """The closed ring of a box in degrees, as GeoJSON has it."""
    at = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    return F.array(at(west, south), at(east, south), at(east, north), at(west, north), at(west, south))
