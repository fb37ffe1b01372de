"""MinHash signatures and banded joins of sets of 32-bit hashes; shared by similarity operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TILE = 1024


class MinHash:
    """`bands` x `rows` hash functions, the same in every process."""

    def __init__(self, bands: int, rows: int, seed: int = 20240229):
        self.bands, self.rows = bands, rows
        g = np.random.default_rng(seed)
        self.a = (g.integers(0, 2**32, bands * rows, dtype=np.uint64) | 1).astype(np.uint32)
        self.b = g.integers(0, 2**32, bands * rows, dtype=np.uint64).astype(np.uint32)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, bands * rows) minima; no set may be empty."""
        flat = np.concatenate(sets)
        at = np.zeros(len(sets), np.int64)
        np.cumsum([len(s) for s in sets[:-1]], out=at[1:])
        sig = np.empty((self.bands * self.rows, len(sets)), np.uint32)
        for k in range(self.bands * self.rows):
            y = flat * self.a[k] + self.b[k]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            y ^= y >> np.uint32(13)
            sig[k] = np.minimum.reduceat(y, at)
        return np.ascontiguousarray(sig.T)


def shared_keys(df: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """The rows of keys that more than one item has, with `tiles`, the number of tiles of the key."""
    n = df.withColumn("n", F.count("*").over(Window.partitionBy(key))).where("n > 1")
    return n.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).drop("n")


def tile_sides(shared: DataFrame, key: str, item: str) -> tuple[DataFrame, DataFrame]:
    """Two sides of a join on (key, tile) that meets each two items of a key once, from shared_keys."""
    left = shared.select(key, F.col(item).alias("a"), F.pmod(F.xxhash64(item), F.col("tiles")).cast("int").alias("tile"))
    right = shared.select(key, F.col(item).alias("b"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    return left, right


def tiles(df: DataFrame, key: str, item: str, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Two sides of a join on (key, tile) that meets each two items of a key once. Keys of one item are dropped; the
    items of a key of n lie in ceil(n / tile) tiles, one side copied to each."""
    return tile_sides(shared_keys(df, key, tile), key, item)
