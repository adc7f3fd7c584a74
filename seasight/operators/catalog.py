"""Scene catalogues, band aliases, patch identifiers and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Other names of bands in providers' catalogues.
BAND_ALIASES = {
    "b01": "B01", "coastal": "B01", "coastal_aerosol": "B01",
    "b02": "B02", "blue": "B02", "b03": "B03", "green": "B03", "b04": "B04", "red": "B04",
    "b05": "B05", "rededge1": "B05", "b06": "B06", "rededge2": "B06", "b07": "B07", "rededge3": "B07",
    "b08": "B08", "nir": "B08", "b8a": "B8A", "b08a": "B8A", "nir08": "B8A", "b09": "B09", "nir09": "B09", "b10": "B10", "cirrus": "B10",
    "b11": "B11", "swir16": "B11", "swir1": "B11", "b12": "B12", "swir22": "B12", "swir2": "B12",
    "scl": "SCL", "aot": "AOT", "wvp": "WVP", "visual": "VISUAL", "tci": "VISUAL",
}
# Ground sample distance of the bands in metres.
BAND_GSD = {
    "B01": 60, "B02": 10, "B03": 10, "B04": 10, "B05": 20, "B06": 20, "B07": 20, "B08": 10, "B8A": 20,
    "B09": 60, "B10": 60, "B11": 20, "B12": 20, "SCL": 20, "AOT": 10, "WVP": 10, "VISUAL": 10,
}
# Annotated classes in the order of their codes (1 first), each with its surface class.
CLASSES = (
    ("Marine Debris", "marine_debris"), ("Dense Sargassum", "sargassum"), ("Sparse Sargassum", "sargassum"), ("Natural Organic Material", "sargassum"),
    ("Ship", "ship"), ("Clouds", "cloud"), ("Marine Water", "open_water"), ("Sediment-Laden Water", "sediment_plume"), ("Foam", "sea_foam"), ("Turbid Water", "sediment_plume"),
    ("Shallow Water", "open_water"), ("Waves", "sea_foam"), ("Cloud Shadows", "cloud"), ("Wakes", "ship_wake"), ("Mixed Water", "open_water"),
)
#: Endpoint part, provider.
PROVIDERS = (("planetarycomputer", "planetary-computer"), ("earth-search", "earth-search"))


def alias(name: Column) -> Column:
    """The canonical band of a provider's name; NULL for a name that isn't one."""
    known = F.create_map(*[F.lit(x) for kv in BAND_ALIASES.items() for x in kv])
    return F.try_element_at(known, F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit("_")))


def _lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def gsd(band: Column) -> Column:
    """Metres per pixel of a canonical band; NULL for another name."""
    return _lookup(BAND_GSD, band, None)


def class_name(code: Column) -> Column:
    """The annotated class of a pixel's code; NULL for 0 and for codes without a class."""
    names = F.array(*[F.lit(n) for n, _ in CLASSES])
    return F.when(code > 0, F.get(names, code.cast("int") - 1))


def surface_class(name: Column) -> Column:
    return _lookup(dict(CLASSES), name, "unknown")


def multi_hot(bits: Column) -> Column:
    """The surface classes of an array of 0 and 1 in class order, each once, in order."""
    names = F.array(*[F.lit(s) for _, s in CLASSES])
    return F.array_distinct(F.array_compact(F.transform(bits, lambda b, i: F.when(b == 1, F.get(names, i)))))


def tile_url(base: str, item_type: Column, item: Column, z: Column, x: Column, y: Column) -> Column:
    """Of a provider's tile service, without a key: keys go into headers, not into tables."""
    return F.concat(F.lit(base.rstrip("/")), F.lit("/"), F.concat_ws("/", item_type, item, z.cast("string"), x.cast("string"), y.cast("string")), F.lit(".png"))


def valid_box(west="west", south="south", east="east", north="north") -> Column:
    """Longitudes and latitudes in range, north not below south; west may be east of east."""
    c = F.col
    ok = c(west).between(-180, 180) & c(east).between(-180, 180) & c(south).between(-90, 90) & c(north).between(-90, 90) & (c(north) >= c(south))
    return F.coalesce(ok, F.lit(False))


def normalize(assets: DataFrame, by: list[str], first: bool = True) -> DataFrame:
    """Of columns pos and key, per ``by``: the first (or last) key of every band."""
    pick = F.min_by if first else F.max_by
    return assets.withColumn("band", alias(F.col("key"))).filter("band is not null").groupBy(*by, "band").agg(pick("key", "pos").alias("key"))


def provider(endpoint: Column) -> Column:
    out = F.lit("unknown")
    for part, name in reversed(PROVIDERS):
        out = F.when(F.contains(endpoint, F.lit(part)), name).otherwise(out)
    return out


def search(scenes: DataFrame, west: float, south: float, east: float, north: float, start, end, max_cloud: float, limit: int) -> DataFrame:
    """Scenes that overlap the box within the days, below ``max_cloud``; the clearest first, an unknown cloud cover as clear. A box, or a scene, whose west is east of its east crosses the date line."""
    crosses = F.col("west") > F.col("east")
    either, both = (F.col("west") <= east) | (F.col("east") >= west), (F.col("west") <= east) & (F.col("east") >= west)
    along = F.when(crosses, either).otherwise(both) if west <= east else crosses | either
    hit = along & (F.col("south") <= north) & (F.col("north") >= south)
    cloud = F.coalesce("cloud", F.lit(0.0))
    return scenes.filter(hit & F.col("day").between(start, end) & (cloud < max_cloud)).orderBy(cloud, "scene_id").limit(limit)


def roi_date(roi: Column) -> Column:
    """The day of a patch name ``d-m-yy_TILE_n``."""
    d = F.split(F.split_part(roi, F.lit("_"), F.lit(1)), "-")
    return F.make_date(2000 + F.get(d, 2).cast("int"), F.get(d, 1).cast("int"), F.get(d, 0).cast("int"))


def prompt_class(text: Column, prompts: list[tuple[str, str]], unknown: str = "unknown") -> Column:
    """The class of a phrase: the equal prompt's, else of the longest prompt that holds it or is held by it; the first of equals."""
    out = F.lit(unknown)
    t = F.lower(F.trim(text))
    for p, label in sorted(prompts, key=lambda x: len(x[0])):
        out = F.when(F.contains(t, F.lit(p)) | (F.contains(F.lit(p), t) & (t != "")), label).otherwise(out)
    for p, label in reversed(prompts):
        out = F.when(t == p, label).otherwise(out)
    return out


# Places of the tiles that annotated patches come from.
SITES = {
    "16PCC": "Motagua, Guatemala", "16PDC": "Ulua, Honduras", "16PEC": "La Ceiba, Honduras", "16QED": "Roatan, Honduras", "18QWF": "Haiti", "18QYF": "Haiti", "18QYG": "Haiti",
    "19QDA": "Santo Domingo, Dominican Republic", "30VWH": "Scotland", "36JUN": "Durban, South Africa", "48MXU": "Jakarta, Indonesia", "48MYU": "Jakarta, Indonesia",
    "48PZC": "Danang, Vietnam", "50LLR": "Bali, Indonesia", "51PTS": "Manila, Philippines", "51RVQ": "Yangtze, China", "52SDD": "Nakdong, South Korea",
}


def class_code(name: Column) -> Column:
    """The code of an annotated class, from 1; an unknown name is an error."""
    known = F.array_position(F.array(*[F.lit(n) for n, _ in CLASSES]), name).cast("int")
    return F.when(known > 0, known).otherwise(F.raise_error(F.concat(F.lit("no annotated class "), F.coalesce(name, F.lit("")))).cast("int"))


def roi_tile(roi: Column) -> Column:
    """The tile of a patch name ``d-m-yy_TILE_n``."""
    return F.split_part(roi, F.lit("_"), F.lit(2))


def site(tile: Column) -> Column:
    """The place of a patch's tile; the tile itself where none is known."""
    return F.coalesce(_lookup(SITES, tile, None), tile)


def tile_url_template(base: str, item_type: Column, item: Column) -> Column:
    """``tile_url`` with {z}, {x} and {y} left open."""
    return tile_url(base, item_type, item, F.lit("{z}"), F.lit("{x}"), F.lit("{y}"))


def item(items: DataFrame, scene_id: str, collection: str | None = None) -> DataFrame:
    """The item of that id; none raises."""
    found = items.filter(F.col("scene_id") == scene_id)
    found = found if collection is None else found.filter(F.col("collection") == collection)
    if found.isEmpty():
        raise LookupError(f"no item {scene_id}")
    return found


def scene_refs(items: DataFrame, endpoint: Column) -> DataFrame:
    """scene_id, collection, datetime, platform, cloud_cover, source of catalogue items, with defaults where an item is silent."""
    has = lambda c, default=None: F.coalesce(c, F.lit(default)) if c in items.columns else F.lit(default)
    return items.select("scene_id", has("collection", "sentinel-2-l2a").alias("collection"), has("day").cast("string").alias("datetime"), has("platform").cast("string").alias("platform"), has("cloud").cast("double").alias("cloud_cover"), provider(endpoint).alias("source"))


def parse_box(text: str) -> tuple[float, float, float, float]:
    """west, south, east, north from a text, with commas or spaces between."""
    parts = text.replace(" ", ",").split(",")
    try:
        west, south, east, north = (float(p) for p in parts if p.strip())
    except ValueError as e:
        raise ValueError(f"a box is west,south,east,north, got {text!r}") from e
    return west, south, east, north
