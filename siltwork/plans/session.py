"""Sessions with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import scalar


def session(master: str | None = None, **settings: str) -> SparkSession:
    """UTC times and adaptive plans; everything else stays the cluster's own unless given."""
    b = SparkSession.builder.appName("siltwork")
    if master:
        b = b.master(master)
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for k, v in (conf | settings).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    scalar.register(spark)
    return spark
