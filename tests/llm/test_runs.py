import random

from timberline.functions.templates import Miner, Templates
from timberline.llm import runs
from timberline.operators import entries

SCHEMA = "file_id bigint, line_number int, message_preview string"


def templates(lines):
    m = Miner()
    for x in lines:
        m.add(x or "")
    return Templates(m.rows())


def test_canonical():
    assert runs.canonical("took 12.5s at 10.0.0.1:80, 7% of 0xff id 550e8400-e29b-41d4-a716-446655440000 sum 0c1d2e3f4a5b") == "took # at #, # of # id # sum #"
    assert runs.canonical("  a   b ") == "a b"


def test_stretches():
    e = [x.split() for x in ("a b c", "a b c", "x b c", "x y c", "x y c", "x z c", "q")]
    assert [(a, b) for a, b, _ in runs.stretches(e)] == [(0, 2), (2, 5), (6, 6)]
    assert runs.stretches([]) == []


def test_spans_find_repetitions():
    assert runs.spans(["a b", "a b", "c d e", "f g h i", "f g h j", "f g h i"]) == [(0, 2), (3, 6)]


def brute(rows):
    """Longest stretches by trying every start and slot."""
    out, n = set(), len(rows)
    ok = lambda i, j, s: (i == j or [""] not in [r[1] for r in rows[i : j + 1]]) and all(len(rows[i][1]) == len(r[1]) and all(x == y or k == s for k, (x, y) in enumerate(zip(rows[i][1], r[1]))) for r in rows[i : j + 1])
    spans = {(i, j) for i in range(n) for j in range(i, n) for s in range(-1, len(rows[i][1])) if ok(i, j, s)}
    for i, j in spans:
        if j - i + 1 >= 3 and not any((a, b) != (i, j) and a <= i and b >= j for a, b in spans):
            out.add((rows[i][0], rows[j][0]))
    return out


def test_runs_equal_brute_force_over_blocks(spark, monkeypatch):
    r = random.Random(4)
    pool = ["still waiting for gate open", "now waiting for gate open", "lock drift found in store", "queue depth is 5 again", "cache miss on shard 7 today"]
    for block in (1, 2, 5, 1000):
        monkeypatch.setattr(entries, "BLOCK", block)
        rows, truth = [], {}
        for f in range(12):
            seq, n = [], 0
            while n < 40:
                msg, k = r.choice(pool), r.choice([1, 1, 2, 3, 6])
                for _ in range(k):
                    n += 1
                    m = msg.replace("still", r.choice(["still", "again", "yet"])).replace("5", str(r.randint(0, 99)))
                    rows.append((f, n, f"2024-11-01 10:00:{n:02d},123 | INFO | app.core | {m}"))
                    seq.append((n, runs.canonical(m).split()))
                    if r.random() < 0.2:
                        n += 1
                        rows.append((f, n, r.choice(["at x.y(z)", "", None])))
            truth[f] = (seq, n)
        df = spark.createDataFrame(rows + rows[:30], SCHEMA)
        t = templates([x[2] for x in rows])
        got = {(x["file_id"], x["first_line"], x["last_entry"], x["last_line"]) for x in runs.runs(df, t).collect()}
        want = set()
        for f, (seq, n) in truth.items():
            nos = [s[0] for s in seq] + [n + 1]
            for a, b in brute(seq):
                want.add((f, a, b, nos[nos.index(b) + 1] - 1))
        assert got == want


def test_spans_do_not_depend_on_blocks():
    import pandas as pd

    names = [x.split()[0] for x in runs.EDGE.split(", ")]
    r = random.Random(11)
    for _ in range(250):
        n = r.randint(1, 14)
        keys = [r.choice(["a b c", "a b d", "a e c", "f b c", "a b", ""]) if r.random() < 0.7 else "a b c" for _ in range(n)]
        seq = [(i, k.split(" ")) for i, k in enumerate(keys, 1)]
        want = {(a, b) for a, b in brute(seq) if keys[a - 1]}
        for size in (1, 2, 3, 6, 20):
            found = [x for k in range(0, n, size) for x in runs._block_runs(1, k // size, list(range(k + 1, min(n, k + size) + 1)), keys[k : k + size])]
            pdf = pd.DataFrame(found, columns=names).assign(last_line=n)
            edges = runs._stitch((1,), pdf[pdf.kind > 0])
            got = [(x.first_line, x.last_entry) for x in edges.itertuples()] + [(x[3], x[4]) for x in found if x[2] == 0]
            assert len(got) == len(set(got)) and set(got) == want, (keys, size)


def test_long_runs_are_linear():
    import time

    began = time.perf_counter()
    assert len(runs.stretches([["x", "y"]] + [["a", "b"]] * 32_768 + [["c", "d"]])) == 3
    mixed = [["a", str(i % 2)] for i in range(32_768)] + [["c", "0"]] + [["c", "1"]] * 32_768
    assert [s[:2] for s in runs.stretches(mixed)] == [(0, 32_767), (32_768, 65_536)]
    assert time.perf_counter() - began < 2


def test_one_long_run_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(entries, "BLOCK", 7)
    rows = [(1, i, f"2024-11-01 10:00:00,123 | INFO | app.core | tick {i} of the clock") for i in range(1, 101)]
    got = runs.runs(spark.createDataFrame(rows, SCHEMA), templates([x[2] for x in rows])).collect()
    assert [(x["first_line"], x["last_line"], x["n"]) for x in got] == [(1, 100, 100)]


def test_empty(spark):
    t = templates(["2024-11-01 10:00:00,123 | INFO | app.core | a b c"])
    assert runs.runs(spark.createDataFrame([], SCHEMA), t).collect() == []
    assert runs.runs(spark.createDataFrame([(1, 1, None), (1, 2, ""), (None, 1, "2024-11-01 10:00:00,123 | INFO | app.core | a b c"), (1, None, "2024-11-01 10:00:00,123 | INFO | app.core | a b c")], SCHEMA), t).collect() == []
