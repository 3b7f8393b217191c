"""The shared folder, caches bounded by bytes, and the state of Python workers."""

import os
from types import SimpleNamespace

import pytest

from waymark.llm import common


def session(master, own=None, conf=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, other=None: conf), sparkContext=SimpleNamespace(master=master, applicationId="app-1", getCheckpointDir=lambda: own))


def test_shared_folder():
    assert common.shared_dir(session("spark://x", conf="hdfs:/a/")) == "hdfs:/a"
    assert common.shared_dir(session("spark://x", own="hdfs:/b")) == "hdfs:/b"
    at = common.shared_dir(session("local[2]"))
    assert os.path.isdir(at) and common.shared_dir(session("local[2]")) == at
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(session("spark://x"))


def test_cache_is_bounded_by_bytes():
    made = []
    cache = common.Cache(lambda k: made.append(k) or len(k), 20_000)
    for k in range(1000):
        assert cache[b"%d" % k] == len(b"%d" % k)
    assert len(cache) + len(cache.old) < 2 * 20_000 / 180 + 2
    cache[b"999"]
    assert made.count(b"999") == 1


def test_a_worker_keeps_the_state_of_one_operator():
    common.worker_state("a")["x"] = 1
    assert common.worker_state("a") == {"x": 1}
    assert common.worker_state("b") == {} and common.worker_state("a") == {}


def test_release_keeps_what_is_read(spark):
    one, two = (common.written(spark.range(k), "kept") for k in (3, 5))
    common.release(keep=two)
    assert two.count() == 5
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound|FILE_NOT_EXIST"):
        one.count()
    common.release()
