import shlex

from pyspark.sql import functions as F

from timberline.functions import line_columns as L
from timberline.operators import commands as C
from timberline.operators import documents as D
from timberline.operators import fingerprint as X


def test_truncation(spark):
    short, wide = "a\nb", "x" * 7001
    many = "\n".join(f"line {i} " + "x" * 40 for i in range(200))
    df = spark.createDataFrame([(0, short), (1, wide), (2, many), (3, None), (4, "")], "k int, t string")
    got = {r["k"]: r["t"] for r in df.select("k", D.truncated_text(F.col("t")).alias("t")).collect()}
    assert got[0] == short and got[3] is None and got[4] == ""
    assert got[1].startswith("x" * 3000 + "\n") and got[1].endswith("\n" + "x" * 3000) and len(got[1]) < 6100
    kept = got[2].split("\n")
    assert kept[:50] == many.split("\n")[:50] and kept[-100:] == many.split("\n")[-100:] and "50" in kept[51]


def test_parsed_and_keys(spark):
    df = spark.createDataFrame([(1, "npm ERR! error ERESOLVE\nok\nnpm ERR! error ERESOLVE"), (2, None), (3, "")], "k int, t string")
    p = {r["doc_id"]: r for r in D.parsed(df, "k", "t").collect()}
    assert p[1]["error_lines"] == ["npm ERR! error ERESOLVE"] and p[1]["platform"] != "Unknown"
    assert p[2]["platform"] == p[3]["platform"] == "Unknown" and p[2]["error_lines"] == [] and not p[2]["is_truncated"]
    k = {r["doc_id"]: r for r in D.keys(D.parsed(df, "k", "t")).collect()}
    assert k[2]["raw_key"] == k[3]["raw_key"] != k[1]["raw_key"]


def test_report_keeps_documents_that_an_analysis_skips(spark):
    df = spark.createDataFrame([(1, 0, "2024-01-01T00:00:00Z ok"), (1, 1, "2024-01-01T00:00:09Z ok"), (2, 0, "plain")], "doc_id int, pos int, line string")
    r = {x["doc_id"]: x for x in D.report(df).collect()}
    assert r[1]["span_s"] == 9 and r[2]["span_s"] is None and r[2]["analyses"] == 2
    assert D.report(df.limit(0)).collect() == []


def test_exact_hits(spark):
    store = spark.createDataFrame([("a", 1, "2024-01-01"), ("a", 2, "2024-02-01"), (None, 3, "2024-02-01")], "k string, stored_id int, t string").select("k", "stored_id", F.col("t").cast("timestamp").alias("stored_at"))
    ask = spark.createDataFrame([(10, "a", "2024-02-20"), (11, "a", "2024-05-01"), (12, "b", "2024-02-20"), (13, None, "2024-02-20")], "id int, k string, t string").select("id", "k", F.col("t").cast("timestamp").alias("at"))
    got = sorted((r["id"], r["stored_id"], r["alive"]) for r in D.exact_hits(ask, store, "k", "30 DAYS").collect())
    assert got == [(10, 2, True), (11, 2, False)]


def test_commands(spark):
    lines = ["ls", "echo 'a", 'echo "a', "echo \\", 'echo "a \\" b"', "a 'b c' d", "rm -rf /", "sudo ls", "", None, "x" * 100_000]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(lines)], "i int, c string")
    for r in df.select("c", C.closed(F.col("c")).alias("ok")).collect():
        if r["c"]:
            try:
                shlex.split(r["c"])
                fine = True
            except ValueError:
                fine = False
            assert r["ok"] == fine, r["c"][:20]
    got = [r["v"] for r in df.orderBy("i").select(C.gate(F.col("c")).alias("v")).collect()]
    assert got == ["safe", "syntax", "syntax", "syntax", "safe", "safe", "blocked", "review", "empty", None, "safe"]
    s = C.summary(df.withColumn("g", F.lit(1)), "g", "c").first()
    assert (s["safe"], s["review"], s["dangerous"], s["overall"]) == (4, 4, 1, "dangerous")


def test_secret_rows_and_full_chain(spark):
    line = "from fe80::1 to ada@example.org and bob@example.org"
    df = spark.createDataFrame([(1, 0, line), (1, 1, None), (1, 2, "")], "doc_id int, pos int, line string")
    rows = sorted((r["rule"], r["place"]) for r in X.secret_rows(df).collect())
    assert [x[0] for x in rows] == ["email", "email", "ipv6_compressed"]
    assert rows[0][1] == line.index("ada@") and rows[1][1] == line.index("bob@")
    assert "fe80" not in df.where("pos = 0").select(L.redact(F.col("line")).alias("x")).first()["x"]


def test_long_shingles(spark):
    words = " ".join(f"w{i}" for i in range(2000))
    df = spark.createDataFrame([("abcd",), (words,), ("",)], "t string")
    got = [set(r[0]) for r in df.select(L.shingles(F.col("t"))).collect()]
    assert got[0] == {"abc", "bcd"} and got[2] == set()
    assert "w1997 w1998 w1999" in got[1] and words[:3] in got[1]


def test_timeline_stamp(spark):
    lines = ["at 2024-02-01 10:00:00.5Z x", "Jan  5 01:02:03 x", "2024/03/04 05:06:07", "t=1700000000123 x", "none", "2024-02-31T00:00:00"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = [r[0] for r in df.orderBy("i").select(L.timeline_us(F.col("line"))).collect()]
    assert got == [1706781600000000, 1704416523000000, 1709528767000000, 1700000000000000, None, None]
