import random

from pyspark.sql import functions as F

from timberline.functions.templates import Miner, Templates, lcs
from timberline.operators import entries

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def body(r):
    return " ".join(r.choice(WORDS) for _ in range(5))


LAYOUTS = {
    "pipe": lambda r, c, lv: f"2024-11-0{r.randint(1, 9)} 10:00:0{r.randint(0, 9)},123 | {lv} | {c} | {body(r)}",
    "syslog": lambda r, c, lv: f"Nov  {r.randint(1, 9)} 10:00:01 host-01 {c}[{r.randint(1, 999)}]: {lv}: {body(r)}",
    "bracket": lambda r, c, lv: f"[{lv}] {c}: {body(r)}",
    "kv": lambda r, c, lv: f'ts=2024-11-0{r.randint(1, 9)}T10:00:00Z level={lv} component={c} msg="{body(r)}"',
    "json": lambda r, c, lv: f'{{"time": 17300000{r.randint(10, 99)}, "severity": "{lv}", "component": "{c}", "message": "{body(r)}"}}',
    "clf": lambda r, c, lv: f"[0{r.randint(1, 9)}/Nov/2024:10:00:00 +0100] [{c}] [{lv}] {body(r)}",
}


def sample(n=300, seed=1):
    r = random.Random(seed)
    out = []
    for k, f in LAYOUTS.items():
        for _ in range(n):
            c, lv = r.choice(["app.core", "net-io", "store_pool", "plain"]), r.choice(["INFO", "warn", "ERR", "Critical"])
            out.append((k, f(r, c, lv), c, {"INFO": "INFO", "warn": "WARN", "ERR": "ERROR", "Critical": "CRITICAL"}[lv]))
    r.shuffle(out)
    return out


def templates(lines):
    m = Miner()
    for x in lines:
        m.add(x)
    return Templates(m.rows())


def test_lcs():
    assert lcs(tuple("abcbdab"), tuple("bdcaba")) in {tuple("bcba"), tuple("bdab"), tuple("bcab")}
    assert lcs((), ("a",)) == ()


def test_mined_templates_name_every_field():
    rows = sample()
    t = templates([x[1] for x in rows] + ["    at foo.bar(x.java:1)", "Traceback (most recent call last):", '{', '  "a": "b",', "error while doing this"])
    for _, line, comp, level in rows:
        p = t.parse(line)
        assert p is not None and p[2] == level and p[3] == comp, line
    for line in ("    at foo.bar(x.java:1)", "{", '  "a": "b",', "", "error while doing this", "}", "> a b 1.2.3"):
        assert t.parse(line) is None, line


def test_merge_of_partitions_equals_one_pass():
    lines = [x[1] for x in sample()]
    one = templates(lines)
    parts = []
    for i in range(4):
        m = Miner()
        for x in lines[i::4]:
            m.add(x)
        parts += m.rows()
    many = Templates(parts)
    assert {k: set(v) for k, v in one.source.items()} == {k: set(v) for k, v in many.source.items()}


def test_letter_levels_and_no_level():
    t = templates([f"I0116 06:12:25.272082  268{i} app.core] {w} {w} {w}" for i, w in enumerate(WORDS)] + [f"Nov  1 10:00:01 host app[{i}]: {w} {w} {w}" for i, w in enumerate(WORDS)])
    assert t.parse("W0116 06:12:25.272082  2681 app.core] x y z")[2:4] == ("WARN", "app.core")
    assert t.parse("Nov  1 10:00:01 host app[1]: fatal signal handler registered")[2:4] == ("", "app")


def test_text_entries_edges(spark):
    lines = [x[1] for x in sample(40)]
    mine = spark.createDataFrame([(x,) for x in lines], "t string")
    t = entries.mine_templates(mine)
    a = "2024-11-01 10:00:00,123 | INFO | app.core | one two three\r\n  more\r\n\r\n[WARN] net-io: two two two\n"
    long = "x" * 300_000 + "\n" + a
    df = spark.createDataFrame([("a", a), ("a", a), ("n", None), ("e", ""), ("b", "\n\n"), ("l", long), ("c", "no entry"), (None, a)], "key string, text string")
    got = sorted(map(tuple, entries.text_entries(df, t).collect()))
    assert got == [("a", 1, 3, "INFO", "app.core"), ("a", 4, 1, "WARN", "net-io"), ("l", 2, 3, "INFO", "app.core"), ("l", 5, 1, "WARN", "net-io")]
    none = spark.createDataFrame([], "key string, text string")
    assert entries.text_entries(none, t).collect() == []
    bare = entries.mine_templates(none.select("text"))
    assert bare.plans == {} and bare.parse("[INFO] app.core: x") is None


def test_line_entries_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(entries, "BLOCK", 4)
    text = ["2024-11-01 10:00:00,123 | INFO | app.core | one two three", *["  more"] * 9, "[WARN] net-io: two two two", "[ERROR] net-io: a b c", "  tail"]
    rows = [(7, i, None, "UNKNOWN", x.strip()) for i, x in enumerate(text, 1)] + [(8, 1, 0, None, "[INFO] app.core: x y z")]
    rows += rows[:3]  # repeated deliveries
    rows += [(None, 1, 0, "INFO", text[0]), (7, None, 0, "INFO", text[0])]  # no key
    df = spark.createDataFrame(rows, "file_id bigint, line_number int, timestamp_us bigint, level string, message_preview string").withColumn("block", F.lit("clash")).withColumn("first", F.lit(0))
    t = templates([x[1] for x in sample(40)])
    got = sorted(tuple(r) for r in entries.line_entries(df, t).select("file_id", "line_number", "n_lines", "level").collect())
    assert got == [(7, 1, 10, "INFO"), (7, 11, 1, "WARN"), (7, 12, 2, "ERROR"), (8, 1, 1, "INFO")]


def test_line_instants(spark):
    t = templates([x[1] for x in sample(40)])
    rows = [(1, 1, 0, "INFO", "2024-11-01 10:00:00,123 | INFO | app.core | a b c", "s1"), (1, 2, 5, "INFO", "Nov  1 10:00:01 host-01 app.core[3]: INFO: a b c", "s1"), (1, 2, 5, "INFO", "Nov  1 10:00:01 host-01 app.core[3]: INFO: a b c", "s1"), (2, 1, None, None, None, "s2")]
    lines = spark.createDataFrame(rows, "file_id bigint, line_number int, timestamp_us bigint, level string, message_preview string, source_file string")
    files = spark.createDataFrame([(1, 1_730_500_000_000_000)], "file_id bigint, seen_us bigint")
    zones = spark.createDataFrame([("s1", "Europe/Berlin")], "source_file string, time_zone string")
    got = sorted(tuple(r)[:3] for r in entries.line_instants(lines, files, zones, t).collect())
    base = 1_730_451_600_000_000  # 2024-11-01 09:00 UTC
    assert got == [(1, 1, base + 123_000), (1, 2, base + 1_000_000)]


def test_line_instants_do_not_depend_on_blocks(spark, monkeypatch):
    r = random.Random(2)
    texts = [f"{d:02d}/{m:02d}/2024 10:00:00 [INFO] app.core: x y" for m in (2, 3, 4) for d in range(1, 29)]
    other = ["2024-03-04T01:00:00Z [INFO] app.core: x", "2024-03-04 10:00:00 CST [INFO] app.core: x", "2024-03-04T03:00:00Z [INFO] app.core: x", "03/04/2024 10:00:00 [INFO] app.core: x"]
    rows = [(1, i, 0, "INFO", x, "s1") for i, x in enumerate(texts, 1)] + [(2, i, 0, "INFO", r.choice(other), "s2") for i in range(1, 60)]
    lines = spark.createDataFrame(rows, "file_id bigint, line_number int, timestamp_us bigint, level string, message_preview string, source_file string")
    files = spark.createDataFrame([(1, 1_730_500_000_000_000)], "file_id bigint, seen_us bigint")
    zones = spark.createDataFrame([("s1", "UTC")], "source_file string, time_zone string")
    t = templates([x[4] for x in rows])
    found = []
    for block in (1, 3, 1000):
        monkeypatch.setattr(entries, "BLOCK", block)
        found.append(sorted(tuple(x)[:3] for x in entries.line_instants(lines, files, zones, t).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    assert [x[2] for x in found[0] if x[0] == 1] == sorted(x[2] for x in found[0] if x[0] == 1)  # day first


def test_project_queries_run(spark, small):
    a = entries.found_instants(spark, small)
    assert a.columns == ["record_table", "record_key", "line_no", "utc_us"] and a.count() > 0
    b = entries.found_entries(spark, small)
    assert b.columns == ["record_table", "record_key", "line_no", "n_lines", "level", "component"]
    assert b.dropDuplicates(["record_table", "record_key", "line_no"]).count() == b.count()


def test_rare_layouts_and_keys():
    r = random.Random(5)
    many = [f"Nov  3 10:00:01 host-01 app[{i}]: {body(r)}" for i in range(2000)]
    words = [f"Nov  3 10:00:01 host-01 app[{i}]: critical {body(r)}" for i in range(40)]  # text, not a level
    t = templates(many + words + ["Nov  3 10:00:01 host-01 net-io[7]: INFO: alpha beta", "Nov  3 10:00:01 host-01 net-io[8]: ERR: beta"])
    line = "Nov  3 10:00:01 host-01 net-io[7]: ERR: alpha beta"
    p = t.parse(line)
    assert p[2:4] == ("ERROR", "net-io") and line[p[4] :] == "alpha beta"
    assert all(t.parse(x)[2:4] == ("", "app") for x in many + words)
    kv = [f"ts=2024-11-03T10:00:00Z level=INFO component=app msg=x{i}" for i in range(3000)]
    t = templates([*kv, '{"at": "2024-11-03T10:00:00Z", "sev": "WARN", "who": "net-io", "text": "alpha beta"}'])
    assert t.parse('{"at": "2024-11-03T10:00:09Z", "sev": "ERR", "who": "net-io", "text": "beta"}')[2:4] == ("ERROR", "net-io")


def test_many_rare_layouts_under_one_stamp_and_any_partitioning(spark):
    r = random.Random(8)
    frames = ["{lv} {c}: {m}", "[{lv}] [{c}] {m}", "<{lv}> {c} - {m}", "{c}[{n}]: {lv}: {m}", "({n}) {lv} {c} | {m}", "{lv} [{t}] {c}: {m}", "#{n} {c} ({lv}) {m}"]
    lines, want = [], {}
    for p in range(1000):  # each program has a thousandth of the lines
        f = r.choice(frames)
        for _ in range(3):
            lv, n = r.choice([("INFO", "INFO"), ("warn", "WARN"), ("ERR", "ERROR")]), r.randint(1, 9999)
            line = "2024-11-03T10:00:00Z " + f.format(lv=lv[0], c=f"prog-{p}.core", n=n, t=f"worker-{n}", m=body(r))
            lines.append(line)
            want[line] = (lv[1], f"prog-{p}.core")
    lines += [f"2024-11-03T10:00:00Z INFO hot.app: {body(r)}" for _ in range(3000)] + ["2024-11-03T10:00:00Z <{ERR}> (zeta.rare) alpha beta gamma"]
    want[lines[-1]] = ("ERROR", "zeta.rare")
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    one, many = entries.mine_templates(df.coalesce(1)), entries.mine_templates(df.repartition(13))
    assert one.source == many.source and one.slots == many.slots and one.keys == many.keys
    for line, w in want.items():
        assert many.parse(line)[2:4] == w, line


def test_header_is_the_common_subsequence_of_entries():
    lines = [f"2024-11-03T10:00:00Z INFO app: alpha={i} beta" for i in range(50)] + [f"2024-11-03T10:00:00Z INFO app: beta ({i}) gamma" for i in range(40)] + ["2024-11-03T10:00:00Z WARN net: zeta 7% alpha"]
    t = templates(lines)
    assert [p[2:4] for p in map(t.parse, lines)] == [("INFO", "app")] * 90 + [("WARN", "net")]
    assert lines[0][t.parse(lines[0])[4] :] == "alpha=0 beta"
    s = next(iter(t.source["iso"]))
    assert t.slots["iso"][s] == [" ", None, " ", None, ":"]  # constant marks, variable level and name
