import itertools
import random

import numpy as np
import pytest

from timberline.llm import clusters, near_dup, nearest
from timberline.llm.words import word_list

SYL = "ba ko ne ru mi ta lo ze vi pa gu sa".split()


def name(r, n=3):
    return "".join(r.choice(SYL) for _ in range(n))


def jac(a, b):
    a, b = set(word_list(a or "")), set(word_list(b or ""))
    return len(a & b) / len(a | b) if a and b else 0.0


def test_words():
    assert word_list("The {TIMESTAMP} run of f4efbb4d106c at 2024-12-02T16:19:33Z, über x1y2z, ab don't Nov 12 10:00:00") == ["the", "run", "über", "don"]
    assert word_list("id 550e8400-e29b-41d4-abcd-446655440000 tail") == ["tail"]


def edited(r, words, k):
    w = list(words)
    for _ in range(k):
        i = r.randrange(len(w))
        w[i] = name(r)
    return " ".join(w)


def corpus(seed=1):
    r = random.Random(seed)
    rows, n = [], 0
    for _ in range(60):
        base = [name(r) for _ in range(40)]
        for k in (0, 0, 1, 2, 12):
            n += 1
            rows.append((n % 2, n, edited(r, base, k)))
    rows += [(0, None, "one two three"), (None, 5, "one two three"), (0, 9001, None), (0, 9002, ""), (0, 9003, "12 34"), (0, 9004, "ab"), rows[0], rows[1]]
    hot = "same text for very many rows of one source"
    rows += [(0, 10_000 + i, hot) for i in range(60)]
    return rows


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 8)  # hot classes are cut into tiles
    rows = corpus()
    df = spark.createDataFrame(rows, "tab int, id bigint, text string")
    members, links = near_dup.similar_sets(df)
    got = sorted(map(tuple, near_dup.id_pairs(members, links).collect()))
    uniq = sorted({(t, i): x for t, i, x in rows if None not in (t, i)}.items())
    want = sorted((a[0][0], a[0][1], b[0][1]) for a, b in itertools.combinations(uniq, 2) if a[0][0] == b[0][0] and jac(a[1], b[1]) >= 0.7)
    assert len(got) == len(set(got))
    assert got == want
    g = {(r["tab"], r["id"]): r for r in near_dup.groups(members, links).collect()}
    assert g[0, 10_005]["class_id"] == 10_000 and g[0, 10_005]["n_links"] == 59
    assert (0, 9001) not in g and (0, 9003) not in g


def test_pairs_at_the_threshold(spark):
    r = random.Random(3)
    rows = []
    for k in range(300):
        both, a, b = ([name(r, 5) for _ in range(n)] for n in (14, 3, 3))  # 14 of 20
        rows += [(0, 2 * k, " ".join(both + a)), (0, 2 * k + 1, " ".join(both + b))]
    m, links = near_dup.similar_sets(spark.createDataFrame(rows, "tab int, id bigint, text string"))
    got = {(x["id_a"], x["id_b"]) for x in near_dup.id_pairs(m, links).collect()}
    want = {(i, i + 1) for _, i, x in rows if i % 2 == 0 and jac(x, rows[i + 1][2]) >= 0.7 - 1e-9}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_no_ids_broadcast_path(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    df = spark.createDataFrame([(0, 1, "one two three four five six seven eight nine ten"), (0, 2, "one two three four five six seven eight nine other")], "tab int, id bigint, text string")
    m, k = near_dup.similar_sets(df)
    assert sorted(map(tuple, near_dup.id_pairs(m, k).collect())) == [(0, 1, 2)]


def test_empty(spark):
    df = spark.createDataFrame([], "tab int, id bigint, text string")
    m, k = near_dup.similar_sets(df)
    assert near_dup.id_pairs(m, k).collect() == [] and near_dup.groups(m, k).collect() == []
    e = spark.createDataFrame([], "id bigint, text string")
    assert clusters.density_peaks(e).collect() == []


def failures(seed=2):
    r = random.Random(seed)
    rows, truth, n = [], {}, 0
    for c, size in enumerate([1, 1, 2, 3, 5, 8, 13, 60]):
        core = [[name(r), name(r), "refused", name(r)] for _ in range(9)]
        for _ in range(size):
            n += 1
            part = core + [["owner", name(r), "team", name(r)] for _ in range(5)]
            r.shuffle(part)
            rows.append((n, " ".join(sum(part, []))))
            truth[n] = c
    return rows, truth


def test_clusters_neighbours_and_samples(spark):
    rows, truth = failures()
    df = spark.createDataFrame(rows + rows[:5] + [(7001, None), (7002, " "), (7003, "12"), (None, rows[0][1])], "id bigint, text string")
    lab = clusters.density_peaks(df)
    got = {x["id"]: x["label"] for x in lab.collect()}
    assert set(got) == set(truth)
    for a, b in itertools.combinations(truth, 2):
        assert (got[a] == got[b]) == (truth[a] == truth[b])
    want = []
    for c in set(truth.values()):
        ids = sorted(i for i in truth if truth[i] == c)
        want += list(zip(ids, ids[1:]))
    assert sorted(map(tuple, clusters.neighbours(lab).collect())) == sorted(want)
    d = {r["cluster_id"]: r for r in clusters.describe(lab).collect()}
    assert sorted(r["occurrence_count"] for r in d.values()) == [1, 1, 2, 3, 5, 8, 13, 60]
    for r in d.values():
        assert len(r["representative_samples"]) == min(3, r["occurrence_count"])
        assert r["cluster_id"] == r["representative_samples"][0]


def test_hot_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "TILE", 4)
    rows, truth = failures()
    got = {x["id"]: x["label"] for x in clusters.density_peaks(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    assert all((got[a] == got[b]) == (truth[a] == truth[b]) for a, b in itertools.combinations(truth, 2))


def test_id_blocks_do_not_part_neighbours(spark, monkeypatch):
    monkeypatch.setattr(clusters, "ID_BLOCK", 10)
    rows, truth = failures()
    lab = clusters.density_peaks(spark.createDataFrame(rows, "id bigint, text string"))
    assert clusters.neighbours(lab).count() == sum(n - 1 for n in [1, 1, 2, 3, 5, 8, 13, 60])


def test_reordered_records_of_a_failure_meet(spark):
    r = random.Random(6)
    rows, truth = [], {}
    for c in range(12):
        core = [name(r, 4) for _ in range(20)]
        for k in range(3):
            own = [name(r, 4) for _ in range(10)]
            w = core + own
            r.shuffle(w)
            rows.append((len(rows) + 1, " ".join(w + ["job", "failed"])))
            truth[len(rows)] = c
    got = {x["id"]: x["label"] for x in clusters.density_peaks(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    assert all((got[a] == got[b]) == (truth[a] == truth[b]) for a, b in itertools.combinations(truth, 2))


def test_parents_are_the_nearest_denser_of_all(spark, monkeypatch):
    monkeypatch.setattr(clusters, "TILE", 16)
    rows, _ = failures(8)
    got = {x["id"]: x for x in clusters.density_peaks(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    text = dict(rows)
    for i, x in got.items():
        denser = [y for j, y in got.items() if (-y["density"], j) < (-x["density"], i)]
        near = [(jac(text[i], text[y["id"]]), -y["id"]) for y in denser]
        best = max((k for k in near if k[0] >= clusters.MIN_SIMILARITY), default=None)
        assert x["parent"] == (None if best is None else -best[1])


def test_no_pair_is_shuffled(spark):
    r = random.Random(9)
    core = [name(r, 4) for _ in range(30)]
    rows = [(i, " ".join(core + [name(r, 5) for _ in range(12)])) for i in range(700)]  # 244 650 pairs of one failure
    df = spark.createDataFrame(rows, "id bigint, text string")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = shuffled()
    assert len({x["label"] for x in clusters.density_peaks(df).collect()}) == 1
    assert shuffled() - before < 2_000_000


@pytest.mark.parametrize("hot", [1, 70, 1024])
@pytest.mark.parametrize("chunk", [1, 1_000_000])
def test_tiles_give_the_nearest_denser_set(monkeypatch, hot, chunk):
    monkeypatch.setattr(nearest, "HOT", hot)
    monkeypatch.setattr(nearest, "CHUNK", chunk)
    g = np.random.default_rng(hot)
    common, cores = np.arange(100, 220), [g.choice(np.arange(220, 900), 20, False) for _ in range(9)]
    sets = []
    for _ in range(500):
        core = cores[min(8, g.geometric(0.4) - 1)]
        sets.append(np.concatenate((g.choice(common, g.integers(1, 100), False), g.choice(core, g.integers(0, 21), False), g.choice(np.arange(1000, 3000), g.integers(0, 15), False))))
    sets = [g.permutation(s).astype(np.int32) for s in sets]
    ids, density = g.permutation(500) * 7, g.integers(0, 60, 500) / 4
    at, flat = np.cumsum([0] + [len(s) for s in sets]), np.concatenate(sets)
    parent, similarity = nearest.Tile(ids, density, at, flat).nearest(ids, density, at, flat, 0.317)
    words = [set(s.tolist()) for s in sets]
    for i in range(500):
        near = [(len(words[i] & words[j]) / len(words[i] | words[j]), -ids[j]) for j in range(500) if (-density[j], ids[j]) < (-density[i], ids[i])]
        best = max((k for k in near if k[0] >= 0.317), default=None)
        assert (similarity[i], parent[i]) == ((-1, 0) if best is None else (best[0], -best[1]))
