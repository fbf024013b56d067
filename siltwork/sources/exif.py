"""Capture time, place and orientation from the EXIF block of JPEG files.

A block is a small TIFF file in an APP1 segment: directories of 12-byte entries, with
values behind them. Only the tags below are read; a file without a sound block has none.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags of the standard.
ORIENTATION, CHANGED, DETAILS, PLACE, TAKEN = 0x0112, 0x0132, 0x8769, 0x8825, 0x9003
SOUTH_NORTH, LATITUDE, WEST_EAST, LONGITUDE = 1, 2, 3, 4
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}
FIELDS = "path string, orientation int, taken string, latitude double, longitude double"


def _segment(data: bytes) -> bytes | None:
    """The TIFF part of the first EXIF segment."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def _directory(tiff: bytes, order: str, at: int) -> dict[int, object]:
    """Tag: number, text or list of ratios."""
    out: dict[int, object] = {}
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(min(n, 512)):
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
        size = SIZES.get(kind, 0) * count
        if not size or count > 1 << 12:
            continue
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", tiff, at + 10 + 12 * k)[0]
        raw = tiff[where : where + size]
        if len(raw) < size:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("latin-1")
        elif kind == 5:
            parts = struct.unpack(order + "II" * count, raw)
            out[tag] = [a / b if b else None for a, b in zip(parts[::2], parts[1::2], strict=True)]
        else:
            out[tag] = struct.unpack(order + {1: "B", 3: "H", 4: "I"}[kind] * count, raw)[0]
    return out


def _degrees(value, ref) -> float | None:
    if not isinstance(value, list) or len(value) != 3 or None in value:
        return None
    d = value[0] + value[1] / 60 + value[2] / 3600
    return -d if ref in ("S", "W") else d


def read(data: bytes) -> dict:
    """orientation (1 if unknown), taken (as the file says it), latitude, longitude."""
    found = {"orientation": 1, "taken": None, "latitude": None, "longitude": None}
    tiff = _segment(data)
    try:
        order = {b"II": "<", b"MM": ">"}[tiff[:2]]
        main = _directory(tiff, order, struct.unpack_from(order + "I", tiff, 4)[0])
        details = _directory(tiff, order, main[DETAILS]) if DETAILS in main else {}
        place = _directory(tiff, order, main[PLACE]) if PLACE in main else {}
    except (TypeError, KeyError, struct.error):
        return found
    turn = main.get(ORIENTATION, 1)
    found["orientation"] = turn if turn in range(1, 9) else 1
    found["taken"] = details.get(TAKEN, main.get(CHANGED))
    found["latitude"], found["longitude"] = _degrees(place.get(LATITUDE), place.get(SOUTH_NORTH)), _degrees(place.get(LONGITUDE), place.get(WEST_EAST))
    return found


def metadata(spark: SparkSession, folder: str, suffixes: str = "*.{jpg,jpeg,JPG,JPEG}") -> DataFrame:
    """One row a file of a folder and below: what its EXIF block says, with ``at``, the time taken, null where there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffixes).load(folder).select("path", F.substring("content", 1, 1 << 17).alias("head"))
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = pa.schema([("path", pa.string()), ("orientation", pa.int32()), ("taken", pa.string()), ("latitude", pa.float64()), ("longitude", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p.as_py(), **read(h.as_py())} for p, h in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=kinds)

    return files.mapInArrow(run, FIELDS).withColumn("at", F.try_to_timestamp("taken", F.lit("yyyy:MM:dd HH:mm:ss")))
