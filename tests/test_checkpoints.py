"""Where lineage is cut, and how scans are spread and repeated rows dropped."""

import pytest

from srclens.operators import checkpoints
from tests.conftest import rows


class _Context:
    """A session's context as far as the choice of a folder looks at it."""

    def __init__(self, master, folder):
        self.master, self.folder, self.chosen = master, folder, None
        self._jsc = self

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isEmpty(self):
        return True

    def getConf(self):
        return {"spark.checkpoint.dir": self.folder} if self.folder else {}

    def setCheckpointDir(self, folder):
        self.chosen = folder


class _Frame:
    def __init__(self, context):
        self.sparkSession = type("S", (), {"sparkContext": context})()

    def checkpoint(self):
        return self


@pytest.mark.parametrize(("master", "folder", "ok"), [("local[4]", None, True), ("local", None, True), ("local[*]", "/shared", True), ("yarn", None, False), ("local-cluster[3,2,1024]", None, False), ("spark://a:7077", "/shared", True)])
def test_folder(master, folder, ok):
    context = _Context(master, folder)
    if not ok:
        with pytest.raises(RuntimeError):
            checkpoints.durable(_Frame(context))
        return
    checkpoints.durable(_Frame(context))
    assert context.chosen == folder if folder else context.chosen


def test_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c"), (3, None)], "k bigint, n string")
    assert rows(checkpoints.once(df, "k"), "k", "n") == sorted([(1, "a"), (2, "b"), (3, None), (None, "c"), (None, "c")], key=repr)
    assert checkpoints.once(df.limit(0), "k").count() == 0


def test_spread(spark):
    df = spark.range(100).coalesce(1)
    assert checkpoints.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert checkpoints.spread(spark.range(0, 100, 1, 40)).rdd.getNumPartitions() == 40
