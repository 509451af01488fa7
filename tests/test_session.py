"""Where shared files go."""

from types import SimpleNamespace

import pytest

from yearweave.errors import ParameterFailure
from yearweave.session import shared_dir


def fake(master, setting=None):
    conf = SimpleNamespace(get=lambda key, default=None: setting)
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: conf)
    return SimpleNamespace(conf=conf, sparkContext=context)


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://host:7077", "yarn"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ParameterFailure):
        shared_dir(fake(master))


def test_a_named_folder_is_used_and_a_local_master_may_go_without():
    assert shared_dir(fake("yarn", "hdfs://x/y/")).startswith("hdfs://x/y/yearweave-")
    spark = fake("local[4]")
    one, two = shared_dir(spark), shared_dir(spark)
    assert one != two and one.rpartition("/")[0] == two.rpartition("/")[0]


def test_the_sessions_settings_stay_as_they_are(spark):
    before = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark).startswith(before.rstrip("/"))
    assert spark.conf.get("spark.checkpoint.dir") == before
