"""Picture features and EXIF blocks on drawn pictures and built files, and the kinds of the drawn album."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltwork.operators import quality
from siltwork.sources import exif, images, objects


def block(order: str, main: list, details: list = (), place: list = ()) -> bytes:
    """A JPEG file's head with an EXIF segment; entries are (tag, kind, values)."""
    sizes = [2 + 12 * len(x) + 4 for x in (main, details, place)]
    starts = [8, 8 + sizes[0], 8 + sizes[0] + sizes[1]]
    after, tail = 8 + sum(sizes), b""

    def pack(entries: list) -> bytes:
        nonlocal tail
        out = struct.pack(order + "H", len(entries))
        for tag, kind, values in entries:
            raw = values.encode() + b"\0" if kind == 2 else struct.pack(order + {3: "H", 4: "I", 5: "I"}[kind] * len(values), *values)
            count = len(raw) // exif.SIZES[kind]
            if len(raw) <= 4:
                out += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
            else:
                out += struct.pack(order + "HHII", tag, kind, count, after + len(tail))
                tail += raw
        return out + b"\0" * 4

    links = [(exif.DETAILS, 4, [starts[1]])] * bool(details) + [(exif.PLACE, 4, [starts[2]])] * bool(place)
    main = [*main, *links]
    sizes = [2 + 12 * len(x) + 4 for x in (main, details, place)]
    starts = [8, 8 + sizes[0], 8 + sizes[0] + sizes[1]]
    after = 8 + sum(sizes)
    main = [(t, k, [starts[1]] if t == exif.DETAILS else [starts[2]] if t == exif.PLACE else v) for t, k, v in main]
    tiff = ({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8)) + pack(main) + pack(list(details)) + pack(list(place)) + tail
    return b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xda"


FULL = [(exif.ORIENTATION, 3, [6]), (exif.CHANGED, 2, "2020:01:01 00:00:00")], [(exif.TAKEN, 2, "2024:02:29 23:59:58")], [(1, 2, "S"), (2, 5, [12, 1, 30, 1, 36, 1]), (3, 2, "E"), (4, 5, [77, 1, 0, 1, 9, 2])]


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_blocks(order):
    got = exif.read(block(order, *FULL))
    assert got["orientation"] == 6 and got["taken"] == "2024:02:29 23:59:58"
    assert got["latitude"] == pytest.approx(-12.51) and got["longitude"] == pytest.approx(77.00125)
    assert exif.read(block(order, FULL[0]))["taken"] == "2020:01:01 00:00:00"


def test_files_without_a_sound_block():
    none = {"orientation": 1, "taken": None, "latitude": None, "longitude": None}
    whole = block("<", *FULL)
    for data in (b"", b"\xff\xd8", b"not a picture", whole[:30], b"\x89PNG" + whole, block("<", [(exif.ORIENTATION, 3, [9])])):
        assert exif.read(data) == none
    zero = [(1, 2, "N"), (2, 5, [12, 0, 30, 1, 36, 1])]
    assert exif.read(block("<", [], [], zero)) == none


def test_exif_of_a_folder(spark, tmp_path):
    for k, data in enumerate((block("<", *FULL), b"nothing", block(">", [(exif.CHANGED, 2, "no date")]))):
        (tmp_path / f"{k}.jpg").write_bytes(data)
    rows = {r.path[-5]: r for r in exif.metadata(spark, f"file://{tmp_path}").collect()}
    assert str(rows["0"]["at"]) == "2024-02-29 23:59:58" and rows["1"]["at"] is rows["2"]["at"] is None and rows["2"].taken == "no date"


def test_pictures_are_turned_upright(spark, tmp_path):
    seen = np.arange(6, dtype=np.uint8).reshape(2, 3)
    stored = {1: seen, 2: seen[:, ::-1], 3: seen[::-1, ::-1], 4: seen[::-1], 5: seen.T, 6: np.rot90(seen, 1), 7: np.rot90(seen, 2).T, 8: np.rot90(seen, 3)}
    for o, x in stored.items():
        assert (images.upright(x, o) == seen).all(), o
    images.put(spark, f"file://{tmp_path}/a.png", images.png(np.zeros((40, 60, 3))))
    pictures = images.scan(spark, f"file://{tmp_path}")
    turned = images.features(pictures, pictures.select(F.col("origin").alias("path"), F.lit(6).alias("orientation"))).first()
    assert (turned.width, turned.height) == (40, 60)


def test_hashes_tell_pictures_apart():
    rng = np.random.default_rng(1)
    x = rng.random((64, 64)).cumsum(axis=0).cumsum(axis=1)
    bits = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert images.phash(x) == images.phash(x * 3 + 7) and bits(images.phash(x), images.phash(x + rng.random((64, 64)))) <= 6
    assert bits(images.phash(x), images.phash(x[::-1])) > 10
    low = images._DCT @ images._resized(x, 32, 32) @ images._DCT.T
    want = sum(1 << (63 - k) for k, v in enumerate(low.ravel()) if v > np.median(low.ravel()[1:]))
    assert images.phash(x) & (1 << 64) - 1 == want


def test_sharpness_of_an_edge_and_of_nothing():
    flat, edge = np.full((64, 64), 90.0), np.zeros((64, 64))
    edge[:, 32:] = 255
    soft = np.repeat(np.linspace(0, 255, 64)[None], 64, axis=0)
    assert images.sharpness(flat) == (0.0, 0.0) and images.sharpness(np.zeros((4, 4))) == (0.0, 0.0)
    assert images.sharpness(edge)[0] > 100 > images.sharpness(soft)[0] and images.sharpness(edge)[1] > images.sharpness(soft)[1]


def test_colours_by_share():
    x = np.zeros((64, 64, 3))
    x[:, :40], x[:, 40:60], x[:, 60:] = (200, 0, 0), (0, 180, 0), (0, 0, 160)
    assert images.dominant(x) == ["#c80000", "#00b400", "#0000a0"]
    assert images.dominant(np.full((8, 8, 3), 7)) == ["#070707"] * 3


def test_hue_and_saturation():
    import colorsys

    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (20, 3))
    hue, sat = images.hsv(x)
    for (r, g, b), h, s in zip(x / 255, hue, sat, strict=True):
        assert (h, s) == pytest.approx(colorsys.rgb_to_hsv(r, g, b)[:2])


@pytest.fixture(scope="module")
def album(spark, tmp_path_factory):
    """Sharp, blurred, dark, blown, two-coloured and broken pictures as files."""
    folder = f"file://{tmp_path_factory.mktemp('album')}"
    rng = np.random.default_rng(42)
    y, x = np.mgrid[0:96, 0:128]
    for k in range(4):
        noise = rng.integers(60, 200, (96, 128, 3))
        images.put(spark, f"{folder}/sharp_{k}.png", images.png(np.where(((x % 24 == k) | (y % 24 == 0))[..., None], 255, noise)))
        images.put(spark, f"{folder}/soft_{k}.png", images.png(np.stack([(x + y * k) // 4 + 50] * 3, axis=-1)))
        images.put(spark, f"{folder}/dark_{k}.png", images.png(np.full((96, 128, 3), k)))
        images.put(spark, f"{folder}/blown_{k}.png", images.png(np.full((96, 128, 3), 255 - k // 2)))
        images.put(spark, f"{folder}/flag_{k}.png", images.png(np.where((x < 80)[..., None], np.array([200, 30 * k, 20]), np.array([20, 40, 220]))))
    images.put(spark, f"{folder}/broken.png", b"not a picture")
    return folder


def test_outcomes_by_kind_of_the_album(spark, album):
    f = images.features(images.scan(spark, album))
    rules = [F.expr(quality.BLURRY).alias("blurry"), F.expr(quality.double_literals(quality.BAD_EXPOSURE)).alias("exposure"), F.expr(quality.MONOCHROME).alias("mono")]
    by = {}
    for r in f.select(F.regexp_extract("path", "([a-z]+)(_[0-9]+)?[.]png$", 1).alias("kind"), "ok", *rules).collect():
        by.setdefault(r.kind, []).append((r.ok, r.blurry, r.exposure, r.mono))
    assert {k: len(v) for k, v in by.items()} == {"sharp": 4, "soft": 4, "dark": 4, "blown": 4, "flag": 4, "broken": 1}
    assert all(ok and not blurry and not exposure for ok, blurry, exposure, _ in by["sharp"])
    assert all(blurry and mono for _, blurry, _, mono in by["soft"]) and not any(mono for *_, mono in by["flag"])
    assert all(exposure for _, _, exposure, _ in by["dark"] + by["blown"]) and not by["broken"][0][0]


def test_histogram_counts_every_pixel(spark, album):
    for r in images.features(images.scan(spark, album)).where("ok").select("hsv_hist").collect():
        assert len(r.hsv_hist) == 32 and min(r.hsv_hist) == 0 and max(r.hsv_hist) in (0.0, 1.0)


def test_rows_decode_as_files_do(spark, album):
    """Pictures kept in a column against Spark's own decoder over the same files."""
    files = spark.read.format("binaryFile").load(album).select(F.col("path").alias("name"), F.col("content").alias("picture"))
    key = lambda df: {r.origin[-12:]: (r.height, r.width, r.nChannels if r.height > 0 else -1, bytes(r.data)) for r in df.collect()}
    assert key(images.decoded(files)) == key(images.scan(spark, album))


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_filtered_lines_of_a_png(channels):
    """Lines stored by all five filters give the pixels that were put in."""
    rng = np.random.default_rng(channels)
    h, w = 10, 7
    x = rng.integers(0, 256, (h, w, channels))
    at = lambda i, j: x[i, j] if i >= 0 and j >= 0 else np.zeros(channels, dtype=int)

    def guess(kind, i, j):
        a, b, c = at(i, j - 1), at(i - 1, j), at(i - 1, j - 1)
        if kind < 4:
            return [0 * a, a, b, (a + b) // 2][kind]
        p = a + b - c
        return np.array([min((abs(p[k] - v[k]), n, v[k]) for n, v in enumerate((a, b, c)))[2] for k in range(channels)])

    raw = b"".join(bytes([i % 5]) + b"".join(((x[i, j] - guess(i % 5, i, j)) % 256).astype(np.uint8).tobytes() for j in range(w)) for i in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    body = zlib.compress(raw)
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body[:9]) + chunk(b"IDAT", body[9:]) + chunk(b"IEND", b"")
    assert (images.unpng(data) == x).all()
    assert images.unpng(data[:-20]) is None or (images.unpng(data[:-20]) == x).all()
    assert images.unpng(data.replace(head, head[:-1] + b"\1")) is None and images.unpng(None) is images.unpng(b"") is None


def test_objects(spark, tmp_path):
    base = f"file://{tmp_path}"
    for k in range(3):
        images.put(spark, f"{base}/original/s1/p{k}.jpg", b"x" * (k + 1))
    assert objects.head(spark, base, "original/s1/p2.jpg")["bytes"] == 3
    assert objects.head(spark, base, "original/s1") is None and objects.head(spark, base, "original/s1/none.jpg") is None
    assert objects.delete(spark, base, "original/s1/p0.jpg") and not objects.delete(spark, base, "original/s1/p0.jpg") and not objects.delete(spark, base, "original/s1")
    assert objects.delete_prefix(spark, base, "original/s1/") == 2 and objects.delete_prefix(spark, base, "original/s1") == 0
    for key in ("../x", "a/../b", "/abs", "", "C:/x"):
        with pytest.raises(ValueError, match="storage key"):
            objects.delete_prefix(spark, base, key)


def test_a_task_holds_few_decoded_pictures(spark):
    """A batch of any number of encoded pictures is decoded, and its features made, in parts of at most 64."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["x"])
    parts = list(images.slices(iter([batch, batch.slice(0, 0), batch.slice(3, 1)])))
    assert max(p.num_rows for p in parts) == images.HELD and [v for p in parts for v in p.column(0).to_pylist()] == [*range(1000), 3]
    pictures = spark.createDataFrame([(str(k), images.png(np.full((4, 4, 3), k % 256))) for k in range(300)], "name string, picture binary").coalesce(1)
    seen = images.decoded(pictures).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in images.slices(batches)), "n long").collect()
    assert sum(r.n for r in seen) == 300 and max(r.n for r in seen) <= images.HELD
