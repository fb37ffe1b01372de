import random

from pyspark.sql import functions as F

from timberline.operators import series, similarity, trends


def triangle(points, threshold):
    """Largest-triangle-three-buckets by the book."""
    n = len(points)
    if n <= threshold:
        return points
    size = (n - 2) / (threshold - 2)
    bucket = lambda i: max(0, -int(-((i - 1 + 1e-9) / size) // 1) - 1)
    groups = {}
    for i in range(1, n - 1):
        groups.setdefault(bucket(i), []).append(points[i])
    out = [points[0]]
    keys = sorted(groups)
    for a, k in enumerate(keys):
        nxt = groups[keys[a + 1]] if a + 1 < len(keys) else [points[-1]]
        cx, cy = sum(p[0] for p in nxt) / len(nxt), sum(p[1] for p in nxt) / len(nxt)
        ax, ay = out[-1]
        out.append(max(groups[k], key=lambda p: abs((ax - cx) * (p[1] - ay) - (ax - p[0]) * (cy - ay))))
    return [*out, points[-1]]


def test_lttb_equals_the_sequential_one(spark):
    r = random.Random(3)
    pts = [(float(i), r.gauss(0, 1) + (5 if i % 97 == 0 else 0)) for i in range(2000)]
    df = spark.createDataFrame([("s", x, y) for x, y in pts] + [("t", 1.0, 2.0)], "series string, x double, y double")
    got = series.largest_triangles(df, "series", 50, ["x"], F.floor(F.col("x") / 300)).where("series = 's'").orderBy("i").collect()
    assert [(g["x"], g["y"]) for g in got] == triangle(pts, 50)
    assert series.largest_triangles(df, "series", 50, ["x"], F.floor(F.col("x") / 300)).where("series = 't'").count() == 1


def test_sliding_window_counts_admitted_only():
    s = series.Sliding(2, 10)
    assert [s.admit(t) for t in (0, 1, 2, 9, 10, 11, 12)] == [True, True, False, False, True, True, False]


def test_token_bucket():
    b = series.Bucket(2, 10)
    assert [b.admit(t) for t in (0, 0, 0, 5, 5)] == [True, True, False, True, False]


def test_admitted_per_key(spark):
    rows = [(k, i, float(i)) for k in ("a", "b") for i in range(20)]
    df = spark.createDataFrame(rows, "k string, e int, t double")
    got = series.admitted(df, "k", ["t", "e"], series.Sliding, 3, 5.0).collect()
    for k in ("a", "b"):
        s = series.Sliding(3, 5.0)
        want = [s.admit(float(i)) for i in range(20)]
        assert [r["admitted"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["e"])] == want


def test_running_total_over_hours(spark):
    df = spark.createDataFrame([(i, f"2024-01-01 {i:02d}:30:00", 1) for i in range(24)], "id int, s string, c int").withColumn("ts", F.to_timestamp("s"))
    got = trends.running_total(df, F.to_date("ts"), ["ts", "id"], "c").orderBy("id").collect()
    assert [r["running"] for r in got] == list(range(1, 25))


def test_top_k(spark):
    v = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 2, [1.0, 0.1]), (4, 1, [0.0, 0.0]), (5, 1, None)], "vec_id bigint, grp int, embedding array<float>")
    got = [(r["vec_id"], r["rank"]) for r in similarity.top_k(v, v.where("vec_id = 0"), 2).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]
    assert similarity.top_k(v, v.where("vec_id = 99"), 2).collect() == []


def test_sinks(spark):
    have = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, at int")
    new = spark.createDataFrame([("a", 2, 2), ("a", 3, 3), ("c", 1, 1)], "k string, v int, at int")
    assert sorted(r["k"] for r in trends.only_new(new, have, "k").collect()) == ["c"]
    assert sorted((r["k"], r["v"]) for r in trends.upsert(have, new, "k", "at").collect()) == [("a", 3), ("b", 1), ("c", 1)]


def test_incremental(spark):
    lines = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "doc_id int, pos int")
    seen = spark.createDataFrame([(1, 3)], "doc_id int, prev_count int")
    assert sorted(map(tuple, series.fresh(lines, seen).collect())) == [(1, 3), (1, 4), (2, 0)]


def test_windows_over_blocks(spark, monkeypatch):
    from timberline.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 3)
    df = spark.createDataFrame([(d, p, p * 10 + d) for d in (1, 2) for p in range(10) if p != 4], "doc int, pos bigint, v bigint")
    got = blocks.with_previous(df, "doc", "pos", "v", "prev").orderBy("doc", "pos").collect()
    for d in (1, 2):
        mine = [r for r in got if r["doc"] == d]
        assert [r["prev"] for r in mine] == [None] + [r["v"] for r in mine[:-1]]
    got = blocks.with_running_sum(df, "doc", "pos", F.col("v"), "sum").where("doc = 1").orderBy("pos").collect()
    total = 0
    for r in got:
        total += r["v"]
        assert r["sum"] == total
