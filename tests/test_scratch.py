"""Where intermediate tables go when spark.checkpoint.dir is set, unset on one machine, unset on a cluster."""

from types import SimpleNamespace

import pytest

from millrace.sources.scratch import scratch, shared_folder


def stand_in(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder or default), sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_one_machine_has_a_folder_of_its_own(master):
    assert shared_folder(stand_in(master)).startswith("file:///")


@pytest.mark.parametrize("master", ["yarn", "spark://head:7077", "local-cluster[2,1,1024]", "k8s://head"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(stand_in(master))
    assert scratch(stand_in(master, "hdfs:///x/"), "t").startswith("hdfs:///x/t-")
