import os
import time

from pyspark.sql import functions as F

from timberline import session


def test_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (None, "n"), (None, "n"), (3, None)], "k int, v string")
    want = [(1, "a"), (2, "b"), (3, None), (None, "n")]
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(session.once(df, "k").collect()) == want
    monkeypatch.setattr(session, "REPEATED", 1)
    assert order(session.once(df, "k").collect()) == want
    assert session.once(df.limit(0), "k").collect() == []
    assert session.once(df.where("k > 1"), "k").count() == 2


def test_scope_removes_its_tables(spark):
    with session.scope(spark):
        t = session.cut(spark.range(3), "mine")
        path = t.inputFiles()[0].removeprefix("file://")
        assert t.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_cut_leaves_no_shuffle_files(spark):
    def files():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {disk.apply(i).getName() for i in range(disk.size()) if disk.apply(i).getName().startswith("shuffle_")}

    had = files()
    t = session.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 20
    while (left := files() - had) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert t.count() == 7 and spark.conf.get(session.SHUFFLES_GO, None) in (None, "false")
