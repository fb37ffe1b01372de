import os
import time

import pytest
from pyspark.sql import functions as F

from timberline.streaming import pipeline as P
from timberline.streaming import tail_source
from timberline.streaming.tail_source import TailReader, TailSource, resume


def test_resume_rule():
    e = {"dev": 1, "ino": 2, "off": 50}
    assert resume(e, 1, 2, 100, 0) == 50
    assert resume(e, 1, 2, 40, 0) == 0  # truncated
    assert resume(e, 1, 3, 100, 0) == 0  # replaced
    assert resume(None, 1, 2, 100, -1) == 100
    assert resume(None, 1, 2, 100, 0) == 0


def batch(r, start):
    end = r.latestOffset()
    return [x for p in r.partitions(start, end) for x in r.read(p)], end


def test_reader_follows_growth_rotation_truncation(tmp_path):
    p = tmp_path / "a.log"
    p.write_text("one\ntwo\nhal")
    r = TailReader({"path": str(tmp_path / "*.log")})
    rows, at = batch(r, {})
    assert [x[2] for x in rows] == ["one", "two"]
    with open(p, "a") as f:
        f.write("f\nthree\n")
    rows, at2 = batch(r, at)
    assert [x[2] for x in rows] == ["half", "three"]
    assert [x[2] for q in r.partitions(at, at2) for x in r.read(q)] == ["half", "three"]  # again
    os.rename(p, tmp_path / "a.log.1")
    p.write_text("new\n")
    rows, at3 = batch(r, at2)
    assert [x[2] for x in rows] == ["new"]
    p.write_text("")
    rows, at4 = batch(r, at3)
    assert rows == []
    p.write_text("again\n")
    assert [x[2] for x in batch(r, at4)[0]] == ["again"]
    # another reader goes on from the checkpoint
    _, at5 = batch(r, at4)
    with open(p, "a") as f:
        f.write("more\n")
    assert [x[2] for x in batch(TailReader({"path": str(tmp_path / "*.log"), "startoffset": "-1"}), at5)[0]] == ["more"]


def test_long_lines_and_splits(tmp_path, monkeypatch):
    monkeypatch.setattr(tail_source, "SPLIT_BYTES", 10)
    monkeypatch.setattr(tail_source, "STEP", 4)
    p = tmp_path / "a.log"
    want = ["x" * 95, "", "short", "y" * 9, "z" * 10, "end"]
    p.write_text("\n".join(want) + "\nrest")
    r = TailReader({"path": str(p)})
    rows, at = batch(r, {})
    assert [x[2] for x in rows] == want
    assert batch(r, at)[0] == []
    late = TailReader({"path": str(p), "startoffset": "-1"})
    rows, at = batch(late, {})
    assert rows == []
    with open(p, "a") as f:
        f.write(" of it\n")
    assert [x[2] for x in batch(late, at)[0]] == ["rest of it"]


def test_tail_stream(spark, tmp_path):
    (tmp_path / "a.log").write_text("ERROR a\nINFO b\n")
    spark.dataSource.register(TailSource)
    s = spark.readStream.format("tail").option("path", str(tmp_path / "*.log")).load()
    got = P.drain(s.select("byte_offset", "text"))
    assert sorted(map(tuple, got.collect())) == [(0, "ERROR a"), (8, "INFO b")]


def test_registry():
    r = P.Registry()
    r.register("b", "processor", lambda d: d)
    r.register("a", "input", lambda d: d)
    assert r.names() == ["a", "b"] and r.names("input") == ["a"]
    with pytest.raises(ValueError):
        r.register("a", "input", lambda d: d)
    with pytest.raises(TypeError):
        r.register("c", "input", 3)
    r.unregister("a")
    with pytest.raises(KeyError):
        r.get("a")


def test_chain_quarantine_and_failing_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    good, bad = P.split_valid(df, F.col("v").isNotNull())
    assert good.count() == 1 and bad.count() == 1
    assert P.chain(df, lambda d: d.where("k = 1"), lambda d: d.select("v")).collect()[0][0] == "a"
    out = P.each_row(df, lambda r: {**r, "v": r["v"].upper()}).orderBy("k").collect()
    assert [r["v"] for r in out] == ["A", None]


def test_limits_keep_state_between_batches(spark, tmp_path):
    from timberline.operators.series import Bucket, Sliding
    from timberline.streaming import limits

    rows = [("a", i, float(i)) for i in range(12)] + [("b", 100 + i, float(3 * i)) for i in range(6)]
    src = str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame([r for r in rows if int(r[2]) // 5 == k], "k string, id bigint, t double").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken in order of their times
    for fn, rule in ((limits.sliding, Sliding), (limits.bucket, Bucket)):
        s = spark.readStream.schema("k string, id bigint, t double").option("maxFilesPerTrigger", 1).parquet(src)
        got = {r["id"]: r["admitted"] for r in P.drain(fn(s, "k", 2, 5.0, expire=False)).collect()}
        want = {}
        for key in ("a", "b"):
            state = rule(2, 5.0)
            for _, i, t in sorted((r for r in rows if r[0] == key), key=lambda r: r[2]):
                want[i] = state.admit(t)
        assert got == want


def test_policies_of_a_row_step(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")

    def step(r):
        return {**r, "v": r["v"].upper()}

    assert [r["v"] for r in P.each_row(df, step, "retry").orderBy("k").collect()] == ["A", None]
    with pytest.raises(Exception):
        P.each_row(df, step, "abort").collect()
    with pytest.raises(ValueError):
        P.each_row(df, step, "other")
