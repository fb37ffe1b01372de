import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import qdigest as Q


def rank_range(sorted_values, v):
    """Ranks at which v, or a value of its leaf, stands."""
    lo = np.searchsorted(sorted_values, v * (1 - 2**-Q.MANTISSA) if v > 0 else v * (1 + 2**-Q.MANTISSA) - 1e-18, "left")
    hi = np.searchsorted(sorted_values, v * (1 + 2**-Q.MANTISSA) if v > 0 else v * (1 - 2**-Q.MANTISSA) + 1e-18, "right")
    return lo, hi


@pytest.mark.parametrize("kind", ["uniform", "tail", "equal", "signed", "few"])
def test_rank_error_over_merged_parts(spark, kind):
    r = random.Random(kind)
    n = 6000 if kind != "few" else 3
    make = {"uniform": lambda: r.random() * 1000, "tail": lambda: math.exp(r.gauss(5, 3)), "equal": lambda: r.choice([1.0, 2.0, 2.0, 7.5]), "signed": lambda: r.gauss(0, 100), "few": lambda: r.random()}[kind]
    rows = [("g", i % 7, make()) for i in range(n)]
    df = spark.createDataFrame(rows, "grp string, day int, value double").withColumn("node", F.lit(1)).withColumn("n", F.lit("clash"))
    eps = 0.02
    parts = Q.digests(df, ["grp", "day"], "value", eps)
    assert parts.agg(F.max(F.size("nodes"))).first()[0] <= 3 * math.ceil(Q.BITS / eps)
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = Q.percentiles(Q.merge(parts.drop("day"), ["grp"], eps), ["grp"], qs, eps).collect()
    v = np.sort([x[2] for x in rows])
    for row in got:
        assert row["n"] == n
        want = max(1, math.ceil(row["q"] * n))
        lo, hi = rank_range(v, row["value"])
        assert lo - row["max_rank_error"] - 1 <= want <= hi + row["max_rank_error"] + 1, (row, lo, hi)


def test_nulls_nan_infinite_and_empty(spark):
    rows = [("a", None), ("a", float("nan")), (None, 5.0), (None, None), ("i", float("inf")), ("i", float("-inf")), ("z", 0.0), ("z", -0.0)]
    df = spark.createDataFrame(rows, "grp string, value double")
    got = {r["grp"]: r for r in Q.percentiles(Q.digests(df, ["grp"], "value"), ["grp"], [0.5]).collect()}
    assert set(got) == {None, "i", "z"}
    assert abs(got[None]["value"] - 5) < 5 * 2**-Q.MANTISSA and got["z"]["value"] == 0.0 and got["z"]["n"] == 2
    assert Q.digests(df.limit(0), ["grp"], "value").collect() == []


def test_leaves_ascend(spark):
    v = sorted([-1e9, -3.0, -1.0, -1e-9, 0.0, 1e-9, 0.5, 1.0, 1.999, 2.0, 3.0, 4.0, 1e9, 2**52 + 0.0])
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v double").select(Q.leaf(F.col("v"))).collect()]
    assert got == sorted(got) and len(set(got)) == len(got)
    assert np.allclose(Q.upper(np.array(got)), v, rtol=2**-Q.MANTISSA, atol=0)
