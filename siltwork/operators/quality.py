"""Quality gates and scores: per-row expressions that stay in one generated stage.

All rules are SQL text over the signal columns of a photo, so they fold into any
plan without an exchange and can be evaluated before an expensive stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashes import near_pairs

# The thresholds of the gates.
BAD_EXPOSURE = "black_share > 0.92 AND std_light < 12 AND mean_light < 10 OR white_share > 0.92 AND std_light < 12 AND mean_light > 248"
BLURRY = "laplacian < CASE WHEN mean_light < 65 AND std_light >= 25 THEN 18 ELSE 30 END AND tenengrad < 120"
MONOCHROME = "mono < 20"  # the channels' mean differences, summed
JUNK = """CASE WHEN has_qr THEN 'QR_CODE' WHEN contours >= 3 THEN 'NESTED_MARKS'
  WHEN white_share > 0.60 AND edge_share > 0.22 AND entropy < 3.9 THEN 'DOCUMENT' WHEN faces > 0 THEN 'OK'
  WHEN entropy < 3.8 AND (NOT is_mono OR white_share > 0.65) AND edge_share > 0.18 THEN 'SCREENSHOT'
  WHEN entropy < 3.8 AND (NOT is_mono OR white_share > 0.65) AND white_share > 0.65 THEN 'RECEIPT'
  WHEN (aspect < 0.45 OR aspect > 2.40) AND entropy < 4.0 THEN 'BANNER' ELSE 'OK' END"""
STATUS = f"CASE WHEN {BAD_EXPOSURE} THEN 'REJECTED_EXPOSURE' WHEN {JUNK} <> 'OK' THEN 'REJECTED_JUNK' WHEN {BLURRY} THEN 'REJECTED_BLURRY' ELSE 'PASSED' END"
ORIENTATION = "CASE WHEN aspect < 0.85 THEN 'PORTRAIT' WHEN aspect > 1.25 THEN 'LANDSCAPE' ELSE 'SQUARE' END"
CLIENT_ORIENTATION = "CASE WHEN aspect >= 1.2 THEN 'landscape' WHEN aspect <= 0.8 THEN 'portrait' ELSE 'square' END"
HERO = """least(100.0, CASE WHEN aspect BETWEEN 1.35 AND 2.20 OR aspect BETWEEN 0.60 AND 0.75 THEN 20.0 ELSE 5.0 END
  + CASE WHEN width >= 2400 THEN 15.0 WHEN width >= 1920 THEN 10.0 ELSE 5.0 END
  + CASE WHEN major_faces >= 1 THEN 25.0 WHEN faces >= 3 THEN 20.0 WHEN faces >= 1 THEN 15.0 ELSE 10.0 END
  + CAST(least(15.0, face_quality * 15.0) AS DOUBLE) + CAST(least(15.0, greatest(0.0, blur / 3.0)) AS DOUBLE)
  + CASE WHEN entropy >= 4.8 THEN 10.0 WHEN entropy >= 4.0 THEN 5.0 ELSE 0.0 END)"""
ROLE = "CASE WHEN hero >= 75 AND aspect >= 1.35 THEN 'DOUBLE_PAGE_HERO' WHEN hero >= 62 THEN 'FULL_PAGE_HERO' ELSE 'STANDARD_FRAME' END"


def double_literals(sql: str) -> str:
    """The rule with decimal literals as doubles, as both engines must compare them."""
    import re

    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"CAST(\1 AS DOUBLE)", sql)


def with_status(photos: DataFrame) -> DataFrame:
    """Exposure, then junk, then blur decide a photo's status."""
    return photos.withColumn("status", F.expr(double_literals(STATUS)))


def with_hero(photos: DataFrame) -> DataFrame:
    return photos.withColumn("hero", F.expr(double_literals(HERO)).cast("double"))


def with_role(photos: DataFrame) -> DataFrame:
    return photos.withColumn("layout_role", F.expr(ROLE))


def hamming(a: str | Column, b: str | Column) -> Column:
    """Differing bits of two 64-bit hashes; 99 where one is unknown."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(99))


def entropy(histogram: Column) -> Column:
    """Shannon entropy in bits of an array of counts."""
    total = F.aggregate(histogram, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(histogram, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))


def solo_anchors(photos: DataFrame, seconds: int = 30, bits: int = 10, blur: float = 18.0) -> DataFrame:
    """Blurry photos that are the only record of their moment: no other row within ``seconds`` looks alike.

    Rows meet by bands of their hashes, so a crowded moment does not compare all with all.
    """
    x = photos.where(f"status = 'REJECTED_BLURRY' AND blur >= {blur}")
    alike = (hamming("a_shell", "b_shell") <= bits) & (F.col("a_photo_id") != F.col("b_photo_id"))
    seen = near_pairs(x, photos, ["session_id"], "moment", seconds, "shell", bits, ["photo_id", "moment", "shell"], flips=2).where(alike).select(F.col("a_photo_id").alias("photo_id")).distinct()
    return x.select("photo_id").distinct().join(seen, "photo_id", "left_anti")
