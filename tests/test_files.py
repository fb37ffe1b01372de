import os

import pytest

from timberline.operators import index as I
from timberline.sources import files


@pytest.fixture
def log(tmp_path):
    p = tmp_path / "a.log"
    lines = [f"2024-01-15T10:30:{i % 60:02d}Z {'ERROR' if i % 5 == 0 else 'INFO'} line {i} é" for i in range(997)]
    p.write_bytes(("\r\n".join(lines[:10]) + "\r\n" + "\n".join(lines[10:])).encode() + b"\xff broken tail")
    return str(p)


@pytest.mark.parametrize("split", [1, 7, 100, 4096, 1 << 20])
def test_splits_lose_and_double_nothing(spark, tmp_path, split):
    p = tmp_path / "s.log"
    p.write_bytes(b"\n\na\nbb\r\n" + b"c" * 50 + b"\n\nlast")
    got = files.numbered(files.read_lines(spark, str(p), split)).orderBy("line_number").collect()
    raw = p.read_bytes()
    assert [r["line"] for r in got] == ["", "", "a", "bb", "c" * 50, "", "last"]
    assert [r["line_number"] for r in got] == list(range(1, 8))
    assert all(raw[r["byte_offset"] : r["byte_offset"] + r["line_length"]].rstrip(b"\r\n").decode() == r["line"] for r in got)


def test_lifecycle(spark, log):
    state, idx = I.open_log(spark, log)
    assert state == "built" and idx.count() == 997
    assert I.open_log(spark, log)[0] == "hit"
    m = I.manifest(spark, I.index_path(log)).first()
    assert m["total_lines"] == 997 and m["levels"]["ERROR"] == 200
    assert [r["line_number"] for r in I.line_range(idx, 5, 7).collect()] == [5, 6, 7]
    req = idx.where("line_number in (3, 500, 997)").selectExpr("line_number as ordinal", "path", "byte_offset", "line_length")
    got = {r["ordinal"]: r["text"] for r in files.read_ranges(req).collect()}
    assert got[3].endswith("line 2 é") and got[500].endswith("line 499 é") and got[997].endswith("broken tail")
    with open(log, "ab") as f:
        f.write(b"\nmore")
    assert I.validate(spark, log) == (False, "size")
    assert I.open_log(spark, log)[0] == "rebuilt"
    os.utime(log, (1, 1))
    assert I.validate(spark, log) == (False, "mtime")
    assert [x["valid"] for x in I.list_indices(spark, os.path.dirname(log))] == [False]
    assert I.delete(I.index_path(log)) and not I.delete(I.index_path(log))
    assert I.validate(spark, log) == (False, "missing")


def test_corrupt_manifest(spark, log):
    t = I.build(spark, log)
    for f in os.listdir(f"{t}/manifest"):
        if f.endswith(".parquet"):
            with open(f"{t}/manifest/{f}", "wb") as h:
                h.write(b"junk")
    assert I.validate(spark, log) == (False, "unreadable")


def test_empty_file(spark, tmp_path):
    p = tmp_path / "e.log"
    p.write_bytes(b"")
    assert files.read_lines(spark, str(p)).collect() == []
    assert I.open_log(spark, str(p))[1].count() == 0
