from types import SimpleNamespace

import pytest

from corpusloom.llm import scratch


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))


def test_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.folder(session("spark://host:7077"))
    assert scratch.folder(session("spark://host:7077", "hdfs://shared/")) == "hdfs://shared"
