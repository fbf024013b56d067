"""Scalar expressions: hashes, colours, dates, keys, boxes."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def hex_channel(colour: Column, k: int) -> Column:
    """Red, green or blue (k = 0, 1, 2) of ``#rrggbb`` or ``#rgb``."""
    h = F.regexp_replace(colour, "^#", "")
    full = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return F.conv(F.substring(full, 2 * k + 1, 2), 16, 10).cast("int")


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(c), 2, "0")) for c in (r, g, b)))


def text_colour(r: Column, g: Column, b: Column) -> Column:
    """Dark text on light backgrounds by the YIQ brightness, light text on others."""
    return F.when((r * 299 + g * 587 + b * 114) / 1000 >= 128, "#121212").otherwise("#FFFFFF")


# Fixed value: how a date and time stand in file names.
FILE_DATE = r"(20\d{2})[-_]?([01]\d)[-_]?([0-3]\d)[-_]?([0-2]\d)?([0-5]\d)?([0-5]\d)?"


def filename_time(name: Column) -> Column:
    """The date and time in a file name, noon where only a date is there, null where it is none."""
    part = lambda k, default: F.coalesce(F.nullif(F.regexp_extract(name, FILE_DATE, k), F.lit("")), F.lit(default)).cast("int")
    has = F.regexp_extract(name, FILE_DATE, 0) != ""
    hms = F.regexp_extract(name, FILE_DATE, 4) != ""
    return F.when(has, F.try_make_timestamp(part(1, "0"), part(2, "0"), part(3, "0"), F.when(hms, part(4, "12")).otherwise(12), F.when(hms, part(5, "0")).otherwise(0), F.when(hms, part(6, "0")).otherwise(0).cast("decimal(16,6)")))


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as signed degrees; south and west are negative."""
    v = d + m / 60.0 + s / 3600.0
    return F.when(ref.isin("S", "W"), -v).otherwise(v)


def fit_box(aspect: Column, x, y, w, h) -> tuple[Column, Column, Column, Column]:
    """The largest box of an aspect inside another, centred, on a canvas twice as wide as high. Numbers or columns."""
    x, y, w, h = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y, w, h))
    a = F.when(aspect.isNull() | F.isnan(aspect) | (aspect <= 0.05), 1.33).otherwise(aspect)
    wide = w * 2.0 / h > a
    bw = F.when(wide, h * a / 2.0).otherwise(w)
    bh = F.when(wide, h).otherwise(w * 2.0 / a)
    return x + (w - bw) / 2.0, y + (h - bh) / 2.0, bw, bh


# Page margins as shares of the canvas.
TOP, BOTTOM, OUTER, GUTTER, GAP, TEXT = 0.05, 0.06, 0.025, 0.039, 0.018, 0.08


def safe_bounds(left: bool, text: bool) -> tuple[float, float, float, float]:
    """(x, y, width, height) that photos may take on a page, less a strip for text."""
    return (OUTER if left else 0.50 + GUTTER), TOP, 0.50 - OUTER - GUTTER, 1.0 - TOP - BOTTOM - (TEXT if text else 0.0)


# Words of each story category, first match wins.
CATEGORIES = (
    ("Memories", ("temple", "iskcon", "devotion", "prayer")),
    ("Celebration", ("wedding", "marriage", "party", "birthday")),
    ("Travel", ("travel", "trip", "vacation", "beach")),
    ("Portraits", ("portrait", "selfie")),
    ("Milestones", ("gradu", "office", "college")),
)


def category(prompt: Column) -> Column:
    low, out = F.lower(prompt), None
    for name, words in CATEGORIES:
        hit = None
        for w in words:
            hit = low.contains(w) if hit is None else hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Family")


def valid_key(key: Column) -> Column:
    """A storage key: relative, of plain parts, no traversal, drive or backslash."""
    return key.rlike(r"^[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*$") & ~key.rlike(r"(^|/)\.\.(/|$)") & ~key.rlike("^[A-Za-z]:")


def register(spark: SparkSession) -> None:
    """Makes ``hamming64`` and ``haversine_km`` callable from SQL, as SQL functions that the optimizer inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming64(a BIGINT, b BIGINT) RETURNS INT RETURN IF(a IS NULL OR b IS NULL, 99, bit_count(a ^ b))")
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN CASE WHEN a + b + c + d IS NULL THEN 0D ELSE 12742D * asin(least(1D, sqrt(
        pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2)))) END"""
    )
