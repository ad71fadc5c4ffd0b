from types import SimpleNamespace

import pytest

from sparkloom.functions import lineage


def session(master, checkpoint=None, own=None):
    known = SimpleNamespace(isDefined=lambda: checkpoint is not None, get=lambda: checkpoint)
    context = SimpleNamespace(master=master, applicationId="app", _jvm=None, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: known)))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: own, set=lambda k, v: None))


def test_clusters_need_a_shared_folder():
    with pytest.raises(ValueError):
        lineage.folder(session("spark://host:7077"))
    with pytest.raises(ValueError):
        lineage.folder(session("local-cluster[2,1,1024]"))
    assert lineage.folder(session("yarn", checkpoint="hdfs://x/c")).startswith("hdfs://x/c/")
    assert lineage.folder(session("yarn", own="s3://y/d")).startswith("s3://y/d/")


def test_small_tables_are_spread_and_stay_the_same(spark):
    df = spark.range(100).coalesce(1)
    assert lineage.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in lineage.spread(df).collect()) == list(range(100))
