"""The shared folder: taken from the session, made up only on a local master."""

import types

import pytest

from haulmark.session import scratch_path, shared_dir


def _session(master: str, configured: str | None):
    values = {"spark.checkpoint.dir": configured}
    conf = types.SimpleNamespace(get=lambda key, default: values.get(key) or default, set=values.__setitem__)
    context = types.SimpleNamespace(master=master, setCheckpointDir=lambda path: None)
    return types.SimpleNamespace(conf=conf, sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://host"])
def test_cluster_without_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_session(master, None))


def test_cluster_uses_the_configured_folder():
    assert scratch_path(_session("yarn", "hdfs:///work/"), "x").startswith("hdfs:///work/x-")


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_local_master_gets_a_folder_once(master):
    session = _session(master, None)
    assert shared_dir(session) == shared_dir(session)
