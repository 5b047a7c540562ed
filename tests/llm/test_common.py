import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from quirefold.llm import common


def session(master, folder=None):
    """As much of a session as shared_dir() asks for."""
    settings = {"spark.checkpoint.dir": folder} if folder else {}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: settings.get(name, default)), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_a_cluster_needs_a_shared_folder():
    for master in ("local-cluster[3,2,3000]", "spark://host:7077", "yarn", "k8s://https://host"):
        with pytest.raises(RuntimeError):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, "file:///shared/")) == "file:///shared"
    for master in ("local", "local[4]", "local[*]"):
        at = common.shared_dir(session(master))
        assert os.path.isdir(at) and common.shared_dir(session(master)) == at  # one folder a session


def test_cut_tables_are_in_the_application_s_folder_and_settings_are_restored(spark):
    names = list(common.WRITING)
    spark.conf.set(names[1], "777")
    before = [spark.conf.get(n, None) for n in names]
    df = common.cut(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count(), "counts")
    assert [spark.conf.get(n, None) for n in names] == before
    spark.conf.unset(names[1])
    assert df.count() == 3
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(f"{folder.removeprefix('file:')}/{spark.sparkContext.applicationId}/counts-" in f for f in df.inputFiles())


def test_settings_are_restored_after_an_error(spark):
    with pytest.raises(ZeroDivisionError), common.settings(spark, {"spark.sql.shuffle.partitions": "3"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        1 / 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
