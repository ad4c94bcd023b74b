"""The scratch folder: from the session; made only in local mode."""

import types

import pytest

from leakscan import session as S


class _Conf(dict):
    def set(self, k, v):
        self[k] = v


def _fake(master, **conf):
    ctx = types.SimpleNamespace(master=master, setCheckpointDir=lambda d: None)
    return types.SimpleNamespace(conf=_Conf(conf), sparkContext=ctx)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]"])
def test_cluster_without_a_shared_folder_fails(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.scratch_path(_fake(master), "x")


def test_named_folder_is_used_as_it_is():
    assert S.scratch_path(_fake("yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"}), "x") == "hdfs:///shared/x"


def test_local_mode_makes_one_folder():
    spark = _fake("local[8]")
    assert S.scratch_path(spark, "x") == S.scratch_path(spark, "x")
