"""Scratch tables: what they keep, what they leave behind."""

from __future__ import annotations

from pathlib import Path

import pytest

from siltwork.sources import scratch


def files(table) -> list[str]:
    return [p.name for p in Path(table.scratch_path.removeprefix("file:")).rglob("*")]


def test_written_tables_go_when_released(spark):
    one, two = (scratch.written(spark.range(100 * k), "test") for k in (1, 2))
    assert (one.count(), two.count()) == (100, 200) and any(f.endswith(".parquet") for f in files(one)) and not any(f.endswith(".crc") or f == "_SUCCESS" for f in files(one))
    scratch.released(one, None, spark.range(3))
    assert not files(one) and two.count() == 200
    scratch.released(one, two)
    assert not files(two)


def test_few_tasks_write(spark):
    many = spark.range(1000).repartition(16)
    assert sum(f.endswith(".parquet") for f in files(scratch.written(many, "test", 3))) <= 3
    assert scratch.tasks_for(many) >= 2 * spark.sparkContext.defaultParallelism


def test_settings_are_as_before(spark):
    keys = (scratch.SHUFFLE_CLEANUP, scratch.BATCH_BYTES)
    before = [spark.conf.get(k) for k in keys]
    scratch.written(spark.range(5), "test")
    with pytest.raises(ZeroDivisionError), scratch.setting(spark, scratch.BATCH_BYTES, "1m"):
        assert spark.conf.get(scratch.BATCH_BYTES) == "1m"
        1 / 0  # noqa: B018
    assert [spark.conf.get(k) for k in keys] == before
    with scratch.setting(spark, "siltwork.unset", "x"):
        assert spark.conf.get("siltwork.unset") == "x"
    assert spark.conf.get("siltwork.unset", None) is None


def test_a_cluster_must_name_the_shared_folder():
    class Conf:
        def __init__(self, **k):
            self.k = k

        def get(self, key, default):
            return self.k.get(key.replace(".", "_"), default)

    class Session:
        def __init__(self, master, **k):
            self.conf, self.sparkContext = Conf(**k), type("C", (), {"master": master})

    assert scratch.shared_dir(Session("local[4]")) == scratch.LOCAL_FALLBACK
    assert scratch.shared_dir(Session("yarn", spark_checkpoint_dir="hdfs:///x")) == "hdfs:///x"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.shared_dir(Session(master))
