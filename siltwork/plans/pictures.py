"""Queries over pictures. The tables hold none, so each vector of ``embeddings`` is drawn as one: eight by eight tones, encoded as PNG."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import quality
from ..sources import images
from .registry import query
from .views import table

CELL = 12  # pixels of a tone's side


def drawn(tones: np.ndarray, kind: int) -> bytes:
    """64 tones as a picture: plain, coloured, nearly black, nearly white; every fifth kind is no picture."""
    t = np.kron(tones.reshape(8, 8), np.ones((CELL, CELL), dtype=int))
    rgb = [(t, t, t), (t, 255 - t, t // 2), (t // 32,) * 3, (255 - t // 32,) * 3][kind] if kind < 4 else None
    return b"not a picture" if rgb is None else images.png(np.stack(rgb, axis=-1))


def album(spark, d):
    """name and picture of every vector; drawn in tasks, so the album grows with the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in images.slices(batches):
            made = [drawn(np.array(t), k) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["name", "picture"])

    tones = F.transform(F.slice("embedding", 1, 64), lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + v.cast("double") * 400))).cast("int"))
    e = table(spark, d, "embeddings").where("size(embedding) >= 64")
    return e.select(F.col("vec_id").cast("string").alias("name"), tones.alias("tones"), F.pmod("vec_id", F.lit(5)).cast("int").alias("kind")).mapInArrow(run, "name string, picture binary")


def _features(spark, d):
    return images.features(images.decoded(album(spark, d)))


@query(f"SELECT CAST(vec_id AS VARCHAR) AS name, CASE WHEN vec_id % 5 < 4 THEN {8 * CELL} ELSE -1 END AS height, CASE WHEN vec_id % 5 < 4 THEN {8 * CELL} ELSE -1 END AS width, vec_id % 5 < 4 AS ok FROM embeddings WHERE len(embedding) >= 64")
def q_image_scan(spark, d):
    """The sizes of all pictures, and which are none."""
    f = images.decoded(album(spark, d))
    return f.select(F.col("origin").alias("name"), "height", "width", (F.col("height") > 0).alias("ok"))


@query(
    """WITH t AS (SELECT vec_id, unnest(embedding[1:64]) AS v FROM embeddings WHERE len(embedding) >= 64 AND vec_id % 5 < 4),
    g AS (SELECT vec_id, vec_id % 5 AS kind, greatest(0, least(255, CAST(floor(128 + CAST(v AS DOUBLE) * 400) AS BIGINT))) AS t FROM t),
    l AS (SELECT vec_id, CASE kind WHEN 0 THEN t WHEN 1 THEN t * 0.299::DOUBLE + (255 - t) * 0.587::DOUBLE + t // 2 * 0.114::DOUBLE WHEN 2 THEN t // 32 ELSE 255 - t // 32 END AS light FROM g)
    SELECT CAST(vec_id AS VARCHAR) AS name, round(avg(light), 9) AS mean_light, round(stddev_pop(light), 6) AS std_light FROM l GROUP BY vec_id"""
)
def q_picture_light(spark, d):
    """How light each picture is, and how much that varies."""
    return _features(spark, d).where("ok").select(F.col("path").alias("name"), F.round("mean_light", 9).alias("mean_light"), F.round("std_light", 6).alias("std_light"))


@query()
def q_directory_scan(spark, d):
    """Every stored object below the given folder, without its bytes."""
    return images.stored(spark, d).select(F.substring_index("path", "/", -1).alias("name"), "length")


@query()
def q_sharpness(spark, d):
    f = _features(spark, d)
    return f.select(F.col("path").alias("name"), "ok", "laplacian", "tenengrad", F.expr(quality.BLURRY).alias("blurry"), F.expr(quality.double_literals(quality.BAD_EXPOSURE)).alias("bad_exposure"), F.expr(quality.MONOCHROME).alias("mono"))


@query()
def q_dominant_colors(spark, d):
    return _features(spark, d).where("ok").select(F.col("path").alias("name"), "colours", "shell", "core", "hsv_hist", "entropy")
