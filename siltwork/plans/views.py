"""The photo view: a library of photos read off the events table, for Spark and, as SQL text, for DuckDB.

A photo is an event, a session the events of one type among 4,000
consecutive ones, so that no session grows with the table. Quality signals are fixed functions
of the event number, perceptual hashes come in bursts of four similar ones. Raw
tables are read with all pruning left to Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name: (Spark expression, DuckDB expression); one text where both agree
_COLUMNS = {
    "photo_id": "event_id",
    "session_id": ("concat(event_type, '-', event_id div 4000)", "concat(event_type, '-', event_id // 4000)"),
    "taken_at": ("unix_micros(CAST(ts AS TIMESTAMP)) / 1000000D", "epoch_us(ts) / 1000000.0::DOUBLE"),
    "epoch": ("CASE WHEN event_id % 50 = 0 THEN 0D ELSE unix_micros(CAST(ts AS TIMESTAMP)) / 1000000D END", "CASE WHEN event_id % 50 = 0 THEN 0::DOUBLE ELSE epoch_us(ts) / 1000000.0::DOUBLE END"),
    "burst_epoch": ("unix_micros(CAST(ts AS TIMESTAMP)) div 120000000", "epoch_us(ts) // 120000000"),
    "latitude": ("CASE WHEN event_id % 10 = 0 THEN NULL ELSE 12D + (event_id % 97) / 100D END", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE 12.0::DOUBLE + (event_id % 97) / 100.0::DOUBLE END"),
    "longitude": ("CASE WHEN event_id % 10 = 0 THEN NULL ELSE 77D + (event_id % 89) / 100D END", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE 77.0::DOUBLE + (event_id % 89) / 100.0::DOUBLE END"),
    "width": "600 + (event_id * 37) % 3400",
    "height": "600 + (event_id * 53) % 2600",
    "aspect": ("(600 + (event_id * 37) % 3400) / CAST(600 + (event_id * 53) % 2600 AS DOUBLE)", "(600 + (event_id * 37) % 3400) / CAST(600 + (event_id * 53) % 2600 AS DOUBLE)"),
    "blur": "value",
    "contrast": ("CAST((event_id * 13) % 60 AS DOUBLE)", "CAST((event_id * 13) % 60 AS DOUBLE)"),
    "entropy": ("(event_id * 17) % 70 / 10D", "(event_id * 17) % 70 / 10.0::DOUBLE"),
    "faces": "event_id % 5",
    "major_faces": "event_id % 3",
    "face_quality": ("(event_id % 11) / 10D", "(event_id % 11) / 10.0::DOUBLE"),
    "mean_light": ("CAST((event_id * 7) % 256 AS DOUBLE)", "CAST((event_id * 7) % 256 AS DOUBLE)"),
    "std_light": ("CAST((event_id * 11) % 64 AS DOUBLE)", "CAST((event_id * 11) % 64 AS DOUBLE)"),
    "black_share": ("(event_id * 19) % 100 / 100D", "(event_id * 19) % 100 / 100.0::DOUBLE"),
    "white_share": ("(event_id * 23) % 100 / 100D", "(event_id * 23) % 100 / 100.0::DOUBLE"),
    "edge_share": ("(event_id * 29) % 50 / 100D", "(event_id * 29) % 50 / 100.0::DOUBLE"),
    "has_qr": "event_id % 97 = 0",
    "contours": "event_id % 7",
    "is_mono": "event_id % 6 = 0",
    "laplacian": ("CAST((event_id * 31) % 60 AS DOUBLE)", "CAST((event_id * 31) % 60 AS DOUBLE)"),
    "tenengrad": ("CAST((event_id * 41) % 240 AS DOUBLE)", "CAST((event_id * 41) % 240 AS DOUBLE)"),
    "shell": ("((event_id div 4) * 2654435761 % 2147483648) ^ ((event_id % 4) * 17)", "xor((event_id // 4) * 2654435761 % 2147483648, (event_id % 4) * 17)"),
    "core": ("((event_id div 4) * 2246822519 % 2147483648) ^ ((event_id % 4) * 37)", "xor((event_id // 4) * 2246822519 % 2147483648, (event_id % 4) * 37)"),
    "bytes": "100000 + (event_id * 7919) % 900000",
    "synced": "event_id % 3 <> 0",
    "upload_status": "event_id % 4",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(f"{e if isinstance(e, str) else e[0]} AS {name}" for name, e in _COLUMNS.items()))


PHOTOS = "photos AS (SELECT " + ", ".join(f"{e if isinstance(e, str) else e[1]} AS {name}" for name, e in _COLUMNS.items()) + " FROM events)"
WITH = f"WITH {PHOTOS} "
