from types import SimpleNamespace

import pytest

from docwarden import scratch


class Session:
    """Just enough of a session to ask for the folder."""

    def __init__(self, master, setting=None):
        self.conf = SimpleNamespace(get=lambda key, default=None: setting if key == "spark.checkpoint.dir" else default)
        conf = SimpleNamespace(get=lambda key, default=None: default)
        self.sparkContext = SimpleNamespace(master=master, applicationId="app-1", getConf=lambda: conf)


def test_named_folder_is_used():
    assert scratch.scratch_root(Session("yarn", "hdfs:///shared/")) == "hdfs:///shared/docwarden-app-1"


def test_clusters_need_a_shared_folder():
    with pytest.raises(RuntimeError):
        scratch.scratch_root(Session("yarn"))


def test_local_runs_make_one_folder():
    first = scratch.scratch_root(Session("local[2]"))
    assert first.startswith("/") and scratch.scratch_root(Session("local[2]")) == first


def test_written_tables(spark):
    df = scratch.materialise(spark.range(10), "numbers")
    assert df.count() == 10 and scratch.scratch_root(spark) in df.inputFiles()[0]
