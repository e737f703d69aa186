"""The shared folder is read from the session and never set on a running one."""

import pytest

from churnspark.plans import session


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" and self.value else default

    def set(self, key, value):  # a running session rejects core settings
        raise AssertionError("must not set spark.checkpoint.dir at run time")


class _Ctx:
    applicationId = "app-test"

    def __init__(self, master):
        self.dir = None
        self.master = master

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Spark:
    def __init__(self, value, master="local[8]"):
        self.conf = _Conf(value)
        self.sparkContext = _Ctx(master)


def test_reads_configured_folder():
    assert session.shared_dir(_Spark("hdfs://nn/shared/")) == "hdfs://nn/shared"
    assert session.shared_dir(_Spark("hdfs://nn/shared", master="yarn")) == "hdfs://nn/shared"


def test_cluster_without_folder_is_an_error():
    s = _Spark(None, master="yarn")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(s)
    assert s.sparkContext.dir is None


def test_fallback_registered_once_when_unset():
    s = _Spark(None)
    d1 = session.shared_dir(s)
    assert s.sparkContext.dir == d1
    assert session.shared_dir(s) == d1


def test_checked_broadcast_bounds_rows_and_bytes(spark):
    from churnspark.plans.broadcast import checked_broadcast
    df = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "k int, s string")
    assert checked_broadcast(df) is not df                  # 50 rows, ~50 kB: broadcast
    assert checked_broadcast(df, max_rows=10) is df         # too many rows
    assert checked_broadcast(df, max_bytes=10_000) is df    # 50 kB of strings > 10 kB
