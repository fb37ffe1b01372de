"""Ordered folds that windows cannot express: down-sampling and admission limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 50_000


def positions(points: DataFrame, by: str, order: list[str], block) -> DataFrame:
    """Adds i (place in the series from 0) and n (its length). block: a column that never falls along the order; places are
    counted in blocks and offset by a table of one row per block, so a long series is not numbered by one task."""
    p = points.withColumn("__b", block)
    per = p.groupBy(by, "__b").agg(F.count("*").alias("__k"))
    w = Window.partitionBy(by).orderBy("__b")
    base = per.select(by, "__b", (F.sum("__k").over(w) - F.col("__k")).alias("__base"), F.sum("__k").over(Window.partitionBy(by)).alias("n"))
    inside = F.row_number().over(Window.partitionBy(by, "__b").orderBy(*order)) - 1
    return p.withColumn("__i", inside).join(base, [by, "__b"]).withColumn("i", F.col("__base") + F.col("__i")).drop("__b", "__base", "__i")


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the convex hull of points ascending in x."""
    keep = []
    for sign in (1, -1):
        h: list[int] = []
        for k in range(len(x)):
            while len(h) > 1 and sign * ((x[h[-1]] - x[h[-2]]) * (y[k] - y[h[-2]]) - (y[h[-1]] - y[h[-2]]) * (x[k] - x[h[-2]])) < 0:
                h.pop()
            h.append(k)
        keep += h
    return np.unique(keep)


def largest_triangles(points: DataFrame, by: str, threshold: int, order: list[str], block) -> DataFrame:
    """Largest-triangle-three-buckets to `threshold` points; shorter series stay. points: by, x, y, order columns.

    The area of a triangle is a linear form of the middle point, so its maximum lies on the bucket's convex hull: buckets
    are cut to their hulls in parallel and only hull points and bucket means meet in the fold that picks one point after
    another. Ties fall to the earlier point."""
    p = positions(points, by, order, block)
    size = (F.col("n") - 2) / (threshold - 2)
    bucket = F.when(F.col("i") == 0, -1).when(F.col("i") == F.col("n") - 1, threshold - 2).otherwise(F.greatest(F.lit(0), F.ceil((F.col("i") - 1 + 1e-9) / size) - 1).cast("int"))
    b = p.select(by, "x", "y", "i", "n", bucket.cast("int").alias("bucket"), F.floor(F.col("i") / CHUNK).alias("chunk"))
    short = b.where(F.col("n") <= threshold).select(by, "i", "x", "y")
    long = b.where(F.col("n") > threshold)
    means = long.groupBy(by, "bucket").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pdf.iloc[hull(pdf["x"].to_numpy(), pdf["y"].to_numpy())]

    kind = dict(points.dtypes)[by]
    hulls = long.groupBy(by, "bucket", "chunk").applyInPandas(cut, f"`{by}` {kind}, x double, y double, i bigint, n bigint, bucket int, chunk bigint")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        groups = {k: g for k, g in pdf.groupby("bucket", sort=True)}
        a = groups[-1].iloc[0]
        out = [(a["i"], a["x"], a["y"])]
        for k in range(threshold - 2):
            g = groups.get(k)
            if g is None:
                continue
            nxt = next((groups[j] for j in range(k + 1, threshold - 1) if j in groups), g)
            cx, cy = nxt["mx"].iloc[0], nxt["my"].iloc[0]
            ax, ay = out[-1][1], out[-1][2]
            area = np.abs((ax - cx) * (g["y"].to_numpy() - ay) - (ax - g["x"].to_numpy()) * (cy - ay)) * 0.5
            r = g.iloc[int(np.argmax(area))]
            out.append((r["i"], r["x"], r["y"]))
        z = groups[threshold - 2].iloc[-1]
        out.append((z["i"], z["x"], z["y"]))
        return pd.DataFrame({by: pdf[by].iloc[0], "i": [int(o[0]) for o in out], "x": [o[1] for o in out], "y": [o[2] for o in out]})

    picked = hulls.join(means, [by, "bucket"]).groupBy(by).applyInPandas(pick, f"`{by}` {kind}, i bigint, x double, y double")
    return short.unionAll(picked)


class Sliding:
    """At most `most` admitted calls in `window` seconds."""

    def __init__(self, most: int, window: float):
        self.most, self.window, self.seen = most, window, deque()

    def admit(self, t: float) -> bool:
        while self.seen and self.seen[0] <= t - self.window:
            self.seen.popleft()
        if len(self.seen) >= self.most:
            return False
        self.seen.append(t)
        return True


class Bucket:
    """A bucket of `most` tokens that fills at most / window tokens a second; a call takes one."""

    def __init__(self, most: int, window: float):
        self.most, self.rate, self.tokens, self.at = float(most), most / window, float(most), None

    def admit(self, t: float) -> bool:
        if self.at is not None:
            self.tokens = min(self.most, self.tokens + (t - self.at) * self.rate)
        self.at = t
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True


def admitted(events: DataFrame, by: str, order: list[str], rule: type, most: int, window: float) -> DataFrame:
    """by, order columns, t, admitted: each key's calls in order through a limit. events hold t, seconds as double. The fold
    keeps `most` times per key at most and streams through sorted partitions; it is sequential per key by definition."""
    cols = list(dict.fromkeys([by, *order, "t"]))
    at = cols.index("t")
    kinds = dict(events.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for b in batches:
            ok = []
            for k, t in zip(b.column(0).to_pylist(), b.column(at).to_pylist()):
                if k != key:
                    key, state = k, rule(most, window)
                ok.append(state.admit(t))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], names=[*cols, "admitted"])

    return events.select(*cols).repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", admitted boolean")


def fresh(lines: DataFrame, seen: DataFrame) -> DataFrame:
    """Lines past the count seen before. seen: (doc_id, prev_count); unknown documents count from 0."""
    return lines.join(seen, "doc_id", "left").where(F.col("pos") >= F.coalesce("prev_count", F.lit(0))).drop("prev_count")
