"""Percentiles by q-digests: bounded, mergeable summaries with a deterministic rank error.

A value is quantised to a leaf of a universe of 2**BITS ordered leaves: sign, power of two (2**-64 to 2**63) and MANTISSA
bits. Within that range a leaf spans less than 2**-MANTISSA of its value; larger magnitudes fall into the last leaf, smaller
ones into zero. The digest of a group keeps counts at nodes of the binary tree over the leaves: a node and its sibling are
added to their parent where the three together hold at most n // k. Digests are merged by adding up equal nodes and
compressed again. The rank of any value is known within BITS * n / k of n values, so eps = BITS / k, however many digests
were merged.

Leaf counts are added up before the shuffle and a digest task sees at most one row per leaf, so a group may hold any
share of all rows. Null and NaN are no values; infinities fall into the outermost leaves. Groups without values give no
row; null group keys form a group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANTISSA, EXP_LOW, EXP_N = 8, -64, 128
HALF = EXP_N << MANTISSA  # leaves of one sign
BITS = HALF.bit_length() + 1
DIGEST = "n bigint, nodes array<int>, counts array<bigint>"


def leaf(v: Column) -> Column:
    """Leaf number of a double, null for null and NaN."""
    x = F.abs(v)
    e = F.floor(F.log2(x))
    e = e + F.when(F.pow(F.lit(2.0), e) > x, -1).when(F.pow(F.lit(2.0), e + 1) <= x, 1).otherwise(0)  # log2 is rounded
    part = F.floor((x / F.pow(F.lit(2.0), e) - 1) * (1 << MANTISSA))
    mag = (e - EXP_LOW) * (1 << MANTISSA) + part + 1
    mag = F.when(x == float("inf"), HALF).when(x == 0, 0).otherwise(F.least(F.greatest(mag, F.lit(0)), F.lit(HALF)))
    n = F.when(v < 0, -mag).otherwise(mag)
    return F.when(v.isNotNull() & ~F.isnan(v), (n + HALF + 1).cast("int"))


def upper(leaves: np.ndarray) -> np.ndarray:
    """The middle of each leaf's values."""
    n = leaves.astype(np.int64) - HALF - 1
    m = np.abs(n) - 1
    out = np.ldexp(1 + ((m & ((1 << MANTISSA) - 1)) + 0.5) / (1 << MANTISSA), (m >> MANTISSA) + EXP_LOW)
    return np.where(n == 0, 0.0, np.sign(n) * out)


def compress(nodes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes are heap numbers, root 1, leaves from 2**BITS. Bottom-up over the levels."""
    order = np.argsort(nodes)
    nodes, counts = nodes[order].astype(np.int64), counts[order].astype(np.int64)
    limit = counts.sum() // k
    kept_n, kept_c = [], []
    for level in range(BITS, 0, -1):
        here = nodes >= 1 << level
        mine, c = nodes[here], counts[here]
        rest_n, rest_c = nodes[~here], counts[~here]
        if len(mine):
            up, inv = np.unique(mine >> 1, return_inverse=True)
            total = np.bincount(inv, c, len(up)).astype(np.int64)
            at = np.searchsorted(rest_n, up)
            has = (at < len(rest_n)) & (rest_n[np.minimum(at, max(len(rest_n) - 1, 0))] == up) if len(rest_n) else np.zeros(len(up), bool)
            own = np.zeros(len(up), np.int64)
            if has.any():
                own[has] = rest_c[at[has]]
            go = total + own <= limit
            stay = ~go[inv]
            kept_n.append(mine[stay])
            kept_c.append(c[stay])
            if go.any():
                hit = go & has
                rest_c[at[hit]] += total[hit]
                new = go & ~has
                rest_n, rest_c = np.concatenate([rest_n, up[new]]), np.concatenate([rest_c, total[new]])
                o = np.argsort(rest_n)
                rest_n, rest_c = rest_n[o], rest_c[o]
        nodes, counts = rest_n, rest_c
    return np.concatenate([nodes, *kept_n]), np.concatenate([counts, *kept_c])


def quantiles(nodes: np.ndarray, counts: np.ndarray, qs: Sequence[float]) -> np.ndarray:
    """Nodes by their last leaf, deeper ones first; the first whose running count reaches rank ceil(q n)."""
    depth = np.floor(np.log2(nodes)).astype(np.int64)
    last = ((nodes + 1) << (BITS - depth)) - 1 - (1 << BITS)
    o = np.lexsort((-depth, last))
    run = np.cumsum(counts[o])
    rank = np.maximum(1, np.ceil(np.asarray(qs) * run[-1] - 1e-9))
    return upper(last[o][np.searchsorted(run, rank)])


def _pack(names: list[str], key: tuple, n: int, nodes: np.ndarray, counts: np.ndarray, schema: pa.Schema) -> pa.Table:
    cols = [pa.array([k.as_py()], schema.field(i).type) for i, k in enumerate(key)]
    return pa.Table.from_arrays([*cols, pa.array([n]), pa.array([nodes.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int64()))], names=[*names, "n", "nodes", "counts"])


def _digest_groups(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """df: by..., node int, c bigint with one row per node at most."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        nodes, counts = compress(t.column("node").to_numpy(), t.column("c").to_numpy(), k)
        return _pack(by, key, int(counts.sum()), nodes, counts, t.select(by).schema)

    types = dict(df.dtypes)
    return df.groupBy(*by).applyInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in by) + ", " + DIGEST)


def digests(df: DataFrame, by: list[str], value: str, eps: float = 0.01) -> DataFrame:
    """One digest per group: by..., n, nodes, counts."""
    k = int(np.ceil(BITS / eps))
    leaves = df.select(*by, leaf(F.col(value).cast("double")).alias("leaf")).where("leaf is not null")
    return _digest_groups(leaves.groupBy(*by, (F.col("leaf") + (1 << BITS)).alias("node")).agg(F.count("*").alias("c")), by, k)


def merge(parts: DataFrame, by: list[str], eps: float = 0.01) -> DataFrame:
    """Digests of any parts, merged per group by node addition."""
    k = int(np.ceil(BITS / eps))
    flat = parts.select(*by, F.explode(F.arrays_zip("nodes", "counts")).alias("x")).groupBy(*by, F.col("x.nodes").alias("node")).agg(F.sum("x.counts").alias("c"))
    return _digest_groups(flat, by, k)


def percentiles(merged: DataFrame, by: list[str], qs: Sequence[float], eps: float = 0.01) -> DataFrame:
    """by..., q, value, n, max_rank_error. Map-only."""
    qs = [float(q) for q in qs]
    types = dict(merged.dtypes)

    def run(batches):
        for b in batches:
            n, nodes, counts = (b.column(b.schema.get_field_index(c)) for c in ("n", "nodes", "counts"))
            rows = range(b.num_rows)
            idx = pa.array([i for i in rows for _ in qs], pa.int64())
            vals = [v for i in rows for v in quantiles(np.array(nodes[i].as_py(), np.int64), np.array(counts[i].as_py(), np.int64), qs)]
            err = [int(eps * x) for x in n.to_pylist()]
            keys = [b.column(b.schema.get_field_index(c)).take(idx) for c in by]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(qs * b.num_rows), pa.array(vals, pa.float64()), n.take(idx), pa.array(err, pa.int64()).take(idx)], names=[*by, "q", "value", "n", "max_rank_error"])

    return merged.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in by) + ", q double, value double, n bigint, max_rank_error bigint")
