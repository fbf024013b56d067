"""Pictures in, features out. Decoding is Spark's image source (BGR bytes, rotation ignored); an undecodable file is a row with height -1.

Features are one NumPy pass over each picture in Arrow batches; pixel bytes never
reach an exchange.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = "*.{jpg,jpeg,png,webp,bmp,heic}"
SIDE = 800

FEATURES = "path string, ok boolean, width int, height int, mean_light double, std_light double, black_share double, white_share double, edge_share double, mono double, entropy double, laplacian double, tenengrad double, shell long, core long, hsv_hist array<double>, colours array<string>"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures of a folder and below: path, height, width, channels, bytes."""
    return spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", SUFFIXES).load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Objects of a folder without their bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length")


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes an object through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB picture as PNG."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def unpng(data: bytes | None) -> np.ndarray | None:
    """The pixels of an 8-bit grey, RGB or RGBA PNG without interlacing, as height by width by channels; None for anything else."""
    if not data or data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    try:
        at, body, head = 8, b"", None
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8]
            own = data[at + 8 : at + 8 + size]
            if zlib.crc32(kind + own) != struct.unpack_from(">I", data, at + 8 + size)[0]:
                return None
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", own)
            body, at = body + own * (kind == b"IDAT"), at + 12 + size
        w, h, depth, colour, _, _, interlaced = head
        n = {0: 1, 2: 3, 6: 4}[colour]
        if depth != 8 or interlaced:
            return None
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    except (struct.error, zlib.error, KeyError, TypeError, ValueError):
        return None
    out = np.zeros((h + 1, w + 1, n), dtype=np.uint8)  # a row above and a column before, of zeros
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].reshape(w, n)
        if kind == 1:  # sums along the row, modulo 256
            out[y + 1, 1:] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            out[y + 1, 1:] = line + out[y, 1:]
        elif kind in (3, 4):
            for x in range(w):
                a, b, c = (out[i, j].astype(int) for i, j in ((y + 1, x), (y, x + 1), (y, x)))
                p = a + b - c
                near = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
                out[y + 1, x + 1] = line[x] + ((a + b) // 2 if kind == 3 else near)
        elif kind:
            return None
        else:
            out[y + 1, 1:] = line
    return out[1:, 1:]


HELD = 64  # pictures that a task holds decoded at once


def slices(batches: Iterator[pa.RecordBatch], rows: int = HELD) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows: a batch of encoded pictures is small, decoded it may be a thousand times as large."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def decoded(pictures: DataFrame, name: str = "name", data: str = "picture") -> DataFrame:
    """origin, height, width, nChannels, data (BGR bytes) of encoded pictures kept as rows, as ``scan`` gives of files; height is -1 where one is no sound PNG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, found = batch.column(0), [unpng(x.as_py()) for x in batch.column(1)]
            size = lambda k: pa.array([-1 if x is None else x.shape[k] for x in found], pa.int32())  # noqa: B023, E731
            pixels = pa.array([b"" if x is None else x[..., (2, 1, 0, 3)[: x.shape[2]] if x.shape[2] > 1 else (0,)].tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([names, size(0), size(1), size(2), pixels], ["origin", "height", "width", "nChannels", "data"])

    return pictures.select(F.col(name).cast("string"), F.col(data).cast("binary")).mapInArrow(run, "origin string, height int, width int, nChannels int, data binary")


def _resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area means for shrinking, nearest rows and columns otherwise."""
    if x.shape[0] >= h and x.shape[1] >= w:
        rows, cols = np.linspace(0, x.shape[0], h + 1).astype(int)[:-1], np.linspace(0, x.shape[1], w + 1).astype(int)[:-1]
        sums = np.add.reduceat(np.add.reduceat(x, rows, axis=0), cols, axis=1)
        n = np.diff(np.append(rows, x.shape[0]))[:, None] * np.diff(np.append(cols, x.shape[1]))[None, :]
        return sums / (n if x.ndim == 2 else n[..., None])
    return x[np.minimum(np.arange(h) * x.shape[0] // h, x.shape[0] - 1)][:, np.minimum(np.arange(w) * x.shape[1] // w, x.shape[1] - 1)]


_DCT = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(32) + 1) / 64)


def phash(gray: np.ndarray) -> int:
    """64 signs of the low DCT frequencies against their median, as a signed integer."""
    low = _DCT @ _resized(gray, 32, 32) @ _DCT.T
    bits = (low > np.median(low.ravel()[1:])).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def _filtered(x: np.ndarray, kernel: list[list[float]]) -> np.ndarray:
    k = np.array(kernel)
    return sum(k[i, j] * x[i : x.shape[0] - 2 + i, j : x.shape[1] - 2 + j] for i in range(3) for j in range(3))


def sharpness(gray: np.ndarray, fx: float = 0.5, fy: float = 0.5) -> tuple[float, float]:
    """Laplacian variance and mean squared Sobel gradient of the half-size box around the focus, lightly smoothed."""
    h, w = gray.shape
    y0, x0 = int(np.clip(fy * h - h / 4, 0, max(0, h - h // 2))), int(np.clip(fx * w - w / 4, 0, max(0, w - w // 2)))
    box = gray[y0 : y0 + max(1, h // 2), x0 : x0 + max(1, w // 2)].astype(float)
    if min(box.shape) < 7:
        return 0.0, 0.0
    box = _filtered(box, [[1 / 16, 2 / 16, 1 / 16], [2 / 16, 4 / 16, 2 / 16], [1 / 16, 2 / 16, 1 / 16]])
    lap = _filtered(box, [[0, 1, 0], [1, -4, 1], [0, 1, 0]])
    gx, gy = _filtered(box, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]), _filtered(box, [[-1, -2, -1], [0, 0, 0], [1, 2, 1]])
    return float(lap.var()), float((gx * gx + gy * gy).mean())


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hue and saturation in 0..1."""
    x = rgb.astype(float) / 255
    top, low = x.max(axis=-1), x.min(axis=-1)
    span = np.where(top > low, top - low, 1)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    hue = np.where(top == r, (g - b) / span % 6, np.where(top == g, (b - r) / span + 2, (r - g) / span + 4)) / 6
    return np.where(top > low, hue, 0), np.where(top > 0, (top - low) / np.maximum(top, 1e-9), 0)


def dominant(rgb: np.ndarray, k: int = 3, rounds: int = 10, seed: int = 7) -> list[str]:
    """The k most populous colour clusters, most populous first; a k-means of a 64 by 64 copy."""
    x = _resized(rgb.astype(float), 64, 64).reshape(-1, 3)
    rng = np.random.default_rng(seed)
    c = x[rng.integers(len(x))][None]
    while len(c) < k:
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1)
        c = np.vstack((c, x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else c[-1]))
    for _ in range(rounds):
        own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k)])
    n = np.bincount(own, minlength=k)
    return ["#%02x%02x%02x" % tuple(int(round(v)) for v in c[j]) for j in np.argsort(-n, kind="stable")]


def upright(x: np.ndarray, orientation: int | None) -> np.ndarray:
    """A picture as it was seen: orientations 2, 4, 5 and 7 are mirrored, 5 to 8 lie on their side."""
    o = orientation or 1
    if o in (2, 4, 5, 7):
        x = x[:, ::-1]
    return np.rot90(x, {3: 2, 4: 2, 6: 3, 7: 3, 8: 1, 5: 1}.get(o, 0))


def _one(path: str, h: int, w: int, channels: int, data: bytes, orientation: int | None = 1) -> dict:
    if h is None or h <= 0:
        return {"path": path, "ok": False}
    bgr = np.frombuffer(data, np.uint8).reshape(h, w, channels)[..., :3]
    rgb = upright(bgr[..., ::-1] if bgr.shape[-1] == 3 else np.repeat(bgr, 3, axis=-1), orientation)
    h, w = rgb.shape[:2]
    shrink = SIDE / max(h, w)
    if shrink < 1:
        rgb = _resized(rgb.astype(float), max(1, int(h * shrink)), max(1, int(w * shrink))).astype(np.uint8)
    gray = rgb.astype(float) @ np.array([0.299, 0.587, 0.114])
    hue, sat = hsv(rgb)
    joint = np.histogram2d(hue.ravel(), sat.ravel(), bins=16, range=((0, 1), (0, 1)))[0].ravel()
    p = joint[joint > 0] / joint.sum()
    hist = np.histogram2d(hue.ravel(), sat.ravel(), bins=(8, 4), range=((0, 1), (0, 1)))[0].ravel()
    hist = (hist - hist.min()) / max(hist.max() - hist.min(), 1e-9)
    lap, ten = sharpness(gray)
    gh, gw = gray.shape
    core = gray[gh // 5 : gh - gh // 5 or None, gw // 5 : gw - gw // 5 or None]
    shell = gray.copy()
    shell[gh // 5 : gh - gh // 5, gw // 5 : gw - gw // 5] = 0
    edges = _filtered(gray, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]) if min(gray.shape) >= 3 else np.zeros((1, 1))
    c = rgb.astype(float)
    return {
        "path": path, "ok": True, "width": w, "height": h, "mean_light": float(gray.mean()), "std_light": float(gray.std()), "black_share": float((gray < 12).mean()), "white_share": float((gray > 248).mean()),
        "edge_share": float((np.abs(edges) > 100).mean()), "mono": float(np.abs(c[..., 0] - c[..., 1]).mean() + np.abs(c[..., 1] - c[..., 2]).mean()), "entropy": float(-(p * np.log2(p)).sum()),
        "laplacian": lap, "tenengrad": ten, "shell": phash(shell), "core": phash(core), "hsv_hist": hist.tolist(), "colours": dominant(rgb),
    }


def features(pictures: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One row of features a picture, turned upright as ``metadata`` (path, orientation) says; ``ok`` is false where it could not be decoded."""
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64(), "long": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in FEATURES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [_one(*(v.as_py() for v in row)) for row in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)

    rows = pictures.select("origin", "height", "width", "nChannels", "data")
    if metadata is not None:
        rows = rows.join(metadata.select(F.col("path").alias("origin"), "orientation"), "origin", "left").select(*rows.columns, "orientation")
    return rows.mapInArrow(run, FEATURES)
