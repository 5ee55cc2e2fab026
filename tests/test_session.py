"""Intermediate data: never in a folder of one machine."""

from types import SimpleNamespace

import pytest

from gridloom.session import shared_dir


def _session(master, folder=None, context=None):
    given = SimpleNamespace(isDefined=lambda: context is not None, get=lambda: context)
    sc = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: given)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder if name == "spark.checkpoint.dir" else default), sparkContext=sc)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://https://x"])
def test_more_than_one_machine_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_session(master))
    assert shared_dir(_session(master, "hdfs://n/x/")) == "hdfs://n/x"
    assert shared_dir(_session(master, None, "hdfs://n/y")) == "hdfs://n/y"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]", "local[4,2]"])
def test_one_process_has_its_own(master):
    assert shared_dir(_session(master)).startswith("file:")
