"""Where cuts are written, and that they can be deleted."""

from types import SimpleNamespace

import pytest

from ledgerlark.plans import lineage


def session(master, named):
    held = {}
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: held.get("dir"), setCheckpointDir=lambda d: held.update(dir=d))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named or default))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="checkpoint"):
        lineage.shared_dir(session("spark://host:7077", None))
    assert lineage.shared_dir(session("spark://host:7077", "hdfs://shared")) == "hdfs://shared"
    assert "ckpt-" in lineage.shared_dir(session("local[2]", None))


def test_cuts_read_back_and_are_deleted(spark):
    rows = lineage.cut(spark.range(5))
    assert rows.count() == 5
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    lineage.clean(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert lineage.cut(spark.range(3)).count() == 3
