"""Distances, scores and vector arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.params import EARTH_RADIUS_KM

# Weight of each quality component.
QUALITY_WEIGHTS = {"sharpness": 0.30, "exposure": 0.15, "resolution": 0.10, "face": 0.20, "aesthetic": 0.25}


# ---------- signatures ----------

def hex_to_signature(text: Column) -> Column:
    """16 hex digits to a signed 64-bit value."""
    return F.conv(text, 16, -10).cast("bigint")


def signature_to_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_signature(values: Column) -> Column:
    """One bit per coefficient, first coefficient in the top bit: is it above the median?

    The first coefficient is left out of the median. Meant for 64 coefficients.
    """
    ranked = F.array_sort(F.slice(values, F.lit(2), F.size(values) - 1))
    half = F.floor(F.size(ranked) / 2).cast("int")
    median = F.when(F.size(ranked) % 2 == 1, F.get(ranked, half)).otherwise(
        (F.get(ranked, half - 1) + F.get(ranked, half)) / 2
    )
    start = F.struct(F.lit(0).cast("bigint").alias("bits"), median.cast("double").alias("median"))
    # the median travels in the accumulator, so it is computed once per row
    return F.aggregate(
        values,
        start,
        lambda acc, x: F.struct(
            F.shiftleft(acc["bits"], 1)
            .bitwiseOR(F.when(x.cast("double") > acc["median"], 1).otherwise(0).cast("bigint"))
            .alias("bits"),
            acc["median"].alias("median"),
        ),
        lambda acc: acc["bits"],
    )


# ---------- places and boxes ----------

def degrees(parts: Column, ref: Column) -> Column:
    """[degrees, minutes, seconds] and a hemisphere letter to decimal degrees."""
    value = F.get(parts, 0) + F.get(parts, 1) / 60 + F.get(parts, 2) / 3600
    return F.when(F.trim(F.translate(ref, "\x00", "")).isin("S", "W"), -value).otherwise(value)


def gps_point(lat: Column, lon: Column) -> Column:
    """struct(lat, lon) rounded to 6 places; null when incomplete or exactly (0, 0)."""
    usable = lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))
    return F.when(usable, F.struct(F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon")))


def valid_geo(lat: Column, lon: Column) -> Column:
    """struct(lat, lon), or null when incomplete or practically (0, 0)."""
    origin = (F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6)
    return F.when(
        lat.isNotNull() & lon.isNotNull() & ~origin,
        F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")),
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = (
        F.pow(F.sin((p2 - p1) / 2), 2)
        + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    )
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(h))


def display_size(width: Column, height: Column, orientation: Column) -> Column:
    """struct(width, height) as shown: swapped for orientations 5 to 8."""
    turned = F.coalesce(orientation.isin(5, 6, 7, 8), F.lit(False))
    return F.struct(
        F.when(turned, height).otherwise(width).alias("width"),
        F.when(turned, width).otherwise(height).alias("height"),
    )


def is_landscape(width: Column, height: Column) -> Column:
    return F.coalesce(width, F.lit(0)) >= F.coalesce(height, F.lit(0))


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of two x, y, width, height boxes; 0 for an empty union."""
    ix = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    iy = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = ix * iy
    union = aw * ah + bw * bh - inter
    return F.when(union != 0, inter / union).otherwise(0.0)


# ---------- score curves ----------

def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def sharpness_score(variance: Column) -> Column:
    level = F.log10(F.greatest(variance.cast("double"), F.lit(1e-3)))
    return 1 / (1 + F.exp(-(level - 2.0) * 3))


def exposure_score(mean: Column, dark: Column, bright: Column) -> Column:
    clipped = F.greatest(F.lit(0.0), dark - 0.05) * 1.5 + F.greatest(F.lit(0.0), bright - 0.05) * 1.5
    return clamp01(1 - F.abs(mean - 0.48) * 1.4 - clipped)


def exposure_from_levels(levels: Column) -> Column:
    """Exposure of an array of 0..255 intensities."""
    n = F.size(levels).cast("double")
    mean = F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + x / 255.0) / n
    dark = F.size(F.filter(levels, lambda x: x / 255.0 < 0.03)) / n
    bright = F.size(F.filter(levels, lambda x: x / 255.0 > 0.97)) / n
    return exposure_score(mean, dark, bright)


def resolution_score(width: Column, height: Column) -> Column:
    megapixels = width.cast("double") * height / 1e6
    return F.least(F.lit(1.0), F.log2(megapixels + 1) / F.log2(F.lit(13.0)))


def aesthetic_score(rating: Column) -> Column:
    return clamp01((rating - 3.5) / 4.0)


def face_score(eyes_open: Column, sharpness: Column) -> Column:
    return 0.6 * eyes_open + 0.4 * F.coalesce(sharpness, F.lit(0.0))


def face_usability(detection: Column, size_px: Column, sharpness: Column) -> Column:
    det = clamp01((detection - 0.5) / 0.4)
    size = clamp01((size_px - 24) / 88)
    return F.when(size_px < 24, 0.0).otherwise(F.round(0.4 * det + 0.3 * size + 0.3 * sharpness, 3))


def total_score(components: dict[str, Column]) -> Column:
    """Weighted mean (0..100, one decimal) of the components that are present; 0 for none.

    Weights are added up as whole percents and tenths are rounded as whole numbers, so that a mean
    half way between two decimals goes to the even one although its last digits are not exact.
    """
    num, den = F.lit(0.0), F.lit(0)
    for name, weight in QUALITY_WEIGHTS.items():
        if name in components:
            value = components[name].cast("double")
            num = num + F.coalesce(weight * value, F.lit(0.0))
            den = den + F.when(value.isNotNull(), round(100 * weight)).otherwise(0)
    return F.when(den > 0, F.bround(100 * num / (den / 100) * 10, 0) / 10).otherwise(0.0)


# ---------- vectors ----------

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """Unit vector; the length (plus 1e-8) is computed once per row."""
    boxed = F.array(F.struct(a.alias("v"), (norm(a) + 1e-8).alias("n")))
    return F.get(F.transform(boxed, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"])), 0)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
