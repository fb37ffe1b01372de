import random

from pyspark.sql import functions as F

from timberline.functions import line_columns as L
from timberline.operators import cluster, lsh, trends


def grams(s):
    return {s[i : i + 3] for i in range(len(s) - 2)}


def jac(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def leaders(rows):
    """In order of id, over equal texts once."""
    first, centre, out = {}, {}, {}
    for k, s in sorted(rows):
        first.setdefault(s, k)
    texts = {k: s for s, k in first.items()}
    for k in sorted(texts):
        best = max(((jac(texts[k], texts[c]), -c) for c in centre if centre[c] == c and jac(texts[k], texts[c]) >= cluster.THRESHOLD), default=None)
        centre[k] = k if best is None else -best[1]
    for k, s in rows:
        out[k] = centre[first[s]]
    return out


def test_leaders_equal_the_sequential_ones(spark):
    r = random.Random(9)
    syl = "bako neru mita loze vipa gusa".split()
    name = lambda: "".join(r.choice(syl) for _ in range(3))
    rows = []
    for c in range(25):
        base = [name() for _ in range(14)]
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = name()
            rows.append((len(rows) + 1, " ".join(dict.fromkeys(w))))
    rows += [(900, rows[0][1]), (901, rows[5][1])]
    df = spark.createDataFrame([(k, s) for k, s in rows] + rows[:3] + [(950, None), (951, ""), (952, "12")], "id bigint, t string")
    got = {x["id"]: x["centre"] for x in cluster.assign(df, "id", "t").collect()}
    assert got == leaders(rows)
    assert cluster.assign(df.limit(0), "id", "t").collect() == []


def test_links_of_one_failure_are_few_and_whole(spark, monkeypatch):
    monkeypatch.setattr(cluster, "TILE", 4)  # hot buckets are cut into tiles
    monkeypatch.setattr(cluster, "PASS_ROWS", 1)
    r = random.Random(5)
    syl = "bako neru mita loze vipa gusa dödi kyfu".split()
    name = lambda: "".join(r.choice(syl) for _ in range(3))
    core = [name() for _ in range(24)]
    rows = [(k + 1, " ".join(core + [name() for _ in range(16)])) for k in range(60)]  # some 0.6 alike
    rows += [(100 + k, rows[k][1] + " " + name()) for k in range(10)]
    rows += [(200, "ab"), (201, "ab"), (202, "a"), (203, "😀é"), (204, "abc"), (205, "abcd"), (206, ""), (207, None)]
    df = spark.createDataFrame(rows, "item bigint, text string")
    shingles = lambda s: grams(s) if len(s) > 2 else {s}
    like = lambda x, y: len(x & y) / len(x | y)
    sets = {k: shingles(s) for k, s in rows if s}
    want = {(a, b): like(sets[a], sets[b]) for a in sets for b in sets if a < b and like(sets[a], sets[b]) >= 0.75}
    got = {(x["a"], x["b"]): x["similarity"] for x in cluster.links(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    met = [near for near in _spied(monkeypatch, cluster, "_near", lambda: cluster.links(df).collect())]
    assert len({p for n in met for p in n}) < 2 * len(want) + 20  # of 2000 pairs of the failure


def _spied(monkeypatch, module, name, run):
    made, real = [], getattr(module, name)

    def spy(*a):
        out = real(*a)
        made.append({tuple(x) for x in out.collect()})
        return out

    monkeypatch.setattr(module, name, spy)
    run()
    return made


def test_components(spark):
    edges = [(i, i + 1, 1.0) for i in range(1, 40)] + [(100, 101, 1.0)]
    nodes = [(i,) for i in [*range(1, 41), 100, 101, 200]]
    got = cluster.components(spark.createDataFrame(nodes, "item bigint"), spark.createDataFrame(edges, "a bigint, b bigint, similarity double")).collect()
    assert {r["item"]: r["comp"] for r in got} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 200}


def test_split(spark):
    rows = [(1, 1, "abcdefgh"), (1, 2, "abcdefgx"), (1, 3, "zyxwvuts"), (1, 4, "zyxwvutq"), (2, 5, "abc"), (2, 6, "abd")]
    df = spark.createDataFrame(rows, "cluster_id int, id bigint, s string").select("cluster_id", "id", L.trigrams(F.col("s")).alias("g"))
    assert {r["id"]: r["side"] for r in cluster.split(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_split_by_any_two_members(spark, monkeypatch):
    monkeypatch.setattr(cluster, "tiles", lambda df, key, item: lsh.tiles(df, key, item, 2))
    rows = [(1, 11, "abcdef"), (1, 12, "abcdgh"), (1, 13, "cdefij"), (1, 14, "abcdef"), *((2, 20 + k, s) for k, s in enumerate(["abcdef", "abcdeg", "abcdeh", "abcdef"]))]
    r = random.Random(4)
    rows += [(c, 100 * c + k, "".join(r.sample("abcdefghijklmn", 11))) for c in range(3, 23) for k in range(5)]
    rows += [(30, 3000, "abcdef"), (30, 3001, "abcdgh"), (30, 3002, "cdefij")]  # too few
    df = spark.createDataFrame(rows, "cluster_id int, id bigint, s string").select("cluster_id", "id", F.array_distinct(F.split("s", "")).alias("g"))
    got = {(x["cluster_id"], x["id"]): x["side"] for x in cluster.split(df).collect()}
    dist = lambda a, b: 1 - len(set(a) & set(b)) / len(set(a) | set(b))
    want, late = {}, 0
    for c in {x[0] for x in rows}:
        m = [(i, s) for k, i, s in rows if k == c]
        if len(m) < 4 or max(dist(a, b) for _, a in m for _, b in m) <= 0.5:
            continue
        far = max(m, key=lambda x: (dist(x[1], m[0][1]), -x[0]))
        late += dist(far[1], m[0][1]) <= 0.5
        want |= {(c, i): int(dist(s, far[1]) < dist(s, m[0][1])) for i, s in m}
    assert got == want
    assert late and 2 not in {c for c, _ in got}


def test_weekly_report(spark):
    log = spark.createDataFrame([(i, i % 2, "2025-03-30 10:00:00") for i in range(6)], "id int, cluster_id int, t string").withColumn("created_at", F.to_timestamp("t"))
    c = spark.createDataFrame([({"npm": 3},)], "platform_distribution map<string,bigint>")
    text = trends.weekly_report(log, c, "2025-04-01 00:00:00")
    assert "| 0 | 3 |" in text and "| npm | 3 |" in text and "2025-03-30" in text
