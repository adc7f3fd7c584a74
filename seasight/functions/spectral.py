"""Spectral indices, masks and radiometry as column expressions. No data is NULL; a vanishing denominator gives NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wavelengths in nm (red, near infrared, short-wave infrared), scale of the debris index.
RED, NIR, NIR_WIDE, SWIR = 665.0, 833.0, 842.0, 1610.0
MIN_DENOMINATOR = 1e-12
# Scene classes counted as cloud, and the default thresholds.
CLOUD_CLASSES = (0, 1, 3, 8, 9, 10)
FDI_THRESHOLD, NDWI_THRESHOLD = 0.006, 0.0
# Digital numbers to reflectance; the offset holds from processing baseline 04.00 on.
REFLECTANCE_SCALE, BOA_OFFSET, OFFSET_BASELINE = 1e-4, -0.1, 4.0


def safe_divide(num: Column, den: Column) -> Column:
    return F.when(F.abs(den) > MIN_DENOMINATOR, num / den)


def normalized_difference(a: Column, b: Column) -> Column:
    return safe_divide(a - b, a + b)


def slope(nir: float = NIR, scale: float = 1.0) -> float:
    return (nir - RED) * scale / (SWIR - RED)  # one rounding: a value at a threshold is on the side that it is on in SQL


def baseline_difference(nir: Column, low: Column, swir: Column, by: float) -> Column:
    """How far nir is above the line from low to swir."""
    return nir - (low + (swir - low) * by)


c = F.col
#: name: (bands, expression)
INDICES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "fdi": (("nir", "rededge2", "swir1"), lambda: baseline_difference(c("nir"), c("rededge2"), c("swir1"), slope(NIR, 10))),
    "fdi_b04": (("nir", "red", "swir1"), lambda: baseline_difference(c("nir"), c("red"), c("swir1"), slope(NIR, 10))),
    "fdi_usgs": (("nir", "rededge2", "swir1"), lambda: baseline_difference(c("nir"), c("rededge2"), c("swir1"), slope(NIR_WIDE, 10))),
    "fai": (("nir", "red", "swir1"), lambda: baseline_difference(c("nir"), c("red"), c("swir1"), slope())),
    "ndvi": (("nir", "red"), lambda: normalized_difference(c("nir"), c("red"))),
    "ndwi": (("green", "nir"), lambda: normalized_difference(c("green"), c("nir"))),
    "mndwi": (("green", "swir1"), lambda: normalized_difference(c("green"), c("swir1"))),
    "ndmi": (("nir", "swir1"), lambda: normalized_difference(c("nir"), c("swir1"))),
    "rndvi": (("red", "nir"), lambda: normalized_difference(c("red"), c("nir"))),
    "pi": (("nir", "red"), lambda: safe_divide(c("nir"), c("nir") + c("red"))),
    "kndvi": (("nir", "red"), lambda: F.tanh(F.pow(normalized_difference(c("nir"), c("red")), 2))),
}


def available_indices(columns: list[str]) -> list[str]:
    return [n for n, (bands, _) in INDICES.items() if set(bands) <= set(columns)]


def compute_indices(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``df`` with the named indices, all that its bands allow by default; unknown names raise, missing bands skip."""
    unknown = set(names or ()) - set(INDICES)
    if unknown:
        raise KeyError(f"unknown index: {', '.join(sorted(unknown))}")
    can = available_indices(df.columns)
    return df.withColumns({n: INDICES[n][1]() for n in (names or can) if n in can})


# The order of a classifier's features, eleven bands and seven indices.
FEATURES = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12", "FDI", "FAI", "NDVI", "NDWI", "PI", "KNDVI", "MNDWI")


def features(df: DataFrame, bands: dict[str, str]) -> DataFrame:
    """``df`` with a column per feature; bands names the columns of those that it has, the others and what needs them are NULL."""
    d = compute_indices(df)
    source = {f: bands.get(f, f.lower()) for f in FEATURES}
    indices = set(available_indices(df.columns))
    keep = [c for c in d.columns if c not in indices]
    return d.select(*keep, *[(F.col(source[f]) if source[f] in d.columns else F.lit(None)).cast("double").alias(f) for f in FEATURES])


def water_mask(threshold: float = NDWI_THRESHOLD) -> Column:
    return F.coalesce(INDICES["ndwi"][1]() > threshold, F.lit(False))


def cloud_mask(scl: str = "scl", classes: tuple[int, ...] = CLOUD_CLASSES) -> Column:
    """Unknown (NULL) counts as cloud; fractional codes go to the nearest even."""
    return F.coalesce(F.rint(F.col(scl).cast("double")).isin([float(x) for x in classes]), F.lit(True))


def candidate_mask(columns: list[str], fdi: float = FDI_THRESHOLD, ndwi: float = NDWI_THRESHOLD) -> Column:
    """Water, not cloud (where scl is there), and a debris index above the threshold; red stands in for a missing red edge."""
    name = "fdi" if "rededge2" in columns else "fdi_b04"
    mask = water_mask(ndwi) & F.coalesce(INDICES[name][1]() > fdi, F.lit(False))
    return mask & ~cloud_mask() if "scl" in columns else mask


def to_reflectance(dn: Column, offset: Column | float, scale: Column | float = REFLECTANCE_SCALE) -> Column:
    return dn * scale + offset


def baseline_offset(baseline: Column) -> Column:
    """The reflectance offset of a processing baseline; what can't be read counts as a modern one."""
    b = F.coalesce(F.expr("1") * baseline.try_cast("double"), F.lit(OFFSET_BASELINE))
    return F.when(b >= OFFSET_BASELINE, F.lit(BOA_OFFSET)).otherwise(F.lit(0.0))


# Layers that are no reflectance.
NO_REFLECTANCE = ("SCL", "AOT", "WVP", "VISUAL")


def scale_bands(df: DataFrame, bands: dict[str, str], scale: float = REFLECTANCE_SCALE, offset: Column | float = BOA_OFFSET, skip: tuple[str, ...] = NO_REFLECTANCE) -> DataFrame:
    """``df`` with its reflectance columns as reflectances (float); ``bands`` names the band of each column. Layers of ``skip``, and columns without a band, stay as they are."""
    own = {column: band for column, band in bands.items() if band not in skip and column in df.columns}
    return df.withColumns({column: to_reflectance(F.col(column).cast("float"), F.lit(offset).cast("float") if not isinstance(offset, Column) else offset.cast("float"), F.lit(scale).cast("float")) for column in own})


def item_params(assets: Column, baseline: Column) -> Column:
    """scale and offset of a catalogue item: what its first reflectance asset says (``assets``: band, scale, offset), else what its processing baseline implies."""
    told = F.get(F.filter(assets, lambda a: a["band"].isNotNull() & ~a["band"].isin(list(NO_REFLECTANCE)) & a["scale"].isNotNull()), 0)
    return F.when(told.isNotNull(), F.struct(told["scale"].cast("double").alias("scale"), F.coalesce(told["offset"].cast("double"), F.lit(0.0)).alias("offset"))).otherwise(
        F.struct(F.lit(REFLECTANCE_SCALE).alias("scale"), baseline_offset(baseline).alias("offset"))
    )
