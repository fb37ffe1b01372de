"""Nearest vectors and similar fingerprints.

Vector search answers a stated set of queries against all rows: queries go out in blocks of BLOCK vectors (a bounded
broadcast each), every row is met once per block by a matrix product on its executor, each task keeps k per query, and the
k best of all tasks are picked after one small shuffle. No pair is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    rows: list = []
    for r in queries.toLocalIterator():
        rows.append(r)
        if len(rows) == BLOCK:
            yield _unit(rows)
            rows = []
    if rows:
        yield _unit(rows)


def _unit(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = np.array([r[2] for r in rows], np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows]), m / np.where(n == 0, 1, n)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, same_group: bool = True) -> DataFrame:
    """query_id, vec_id, score, rank: the k rows of highest cosine, the query itself left out; ties by
    vec_id. Both frames: (vec_id bigint, grp int, embedding array). Null or empty vectors take no part."""
    sc = vectors.sparkSession.sparkContext
    parts = []
    for block in _blocks(queries.where(F.size("embedding") > 0).select("vec_id", "grp", "embedding")):
        shared = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, qg, q = shared.value
            best_s = np.full((len(qid), 0), -np.inf)
            best_i = np.zeros((len(qid), 0), np.int64)
            for b in batches:
                ids = b.column(0).to_numpy()
                v = np.array(b.column(2).to_pylist(), np.float64)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                s = q @ (v / np.where(n == 0, 1, n)).T
                s[qid[:, None] == ids[None, :]] = -np.inf
                if same_group:
                    s[qg[:, None] != b.column(1).to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                best_s, best_i = np.hstack([best_s, s]), np.hstack([best_i, np.broadcast_to(ids, s.shape)])
                if best_s.shape[1] > k:
                    o = np.lexsort((best_i, -np.round(best_s, 12)), axis=1)[:, :k]
                    best_s, best_i = np.take_along_axis(best_s, o, 1), np.take_along_axis(best_i, o, 1)
            keep = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, keep.sum(1))), pa.array(best_i[keep]), pa.array(best_s[keep])], names=["query_id", "vec_id", "score"])

        parts.append(vectors.where(F.size("embedding") > 0).select("vec_id", "grp", "embedding").mapInArrow(run, "query_id bigint, vec_id bigint, score double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tier(score: Column, age_hours: Column, high: float = 0.92, low: float = 0.80, ttl: float = 720) -> Column:
    """Hit, context or miss; what is older than ttl hours is a miss."""
    return F.when(age_hours > ttl, "miss").when(score >= high, "hit").when(score >= low, "context").otherwise("miss")


def confidence(age_hours: Column) -> Column:
    """M05."""
    return F.round(F.greatest(F.lit(0.5), 1 - F.greatest(F.lit(0.0), (age_hours - 24) / 24) * 0.05), 3)
