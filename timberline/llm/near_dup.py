"""Near-duplicate texts by MinHash banding.

1. Each text becomes its set of distinct words, and the set a MinHash signature of BANDS x ROWS values. Texts with equal
   sets form one class; a task gives the bands of a class once, however many copies it reads.
2. Classes are shuffled on band hashes, equal rows dropped. Buckets of one class, nine in ten, are dropped; a bucket of n classes is
   split into tiles so that no task pairs more than TILE classes with the bucket.
3. What is left of the buckets gets the sketch of its classes, two bits of each of HASHES hashes, and a bucket gives only the
   pairs whose sketches do not rule out the threshold: so the many pairs of a large failure that lie well below it are neither
   shuffled nor joined with their texts. Pairs are made distinct and verified on the full word sets.

A sketch estimates the similarity with a standard deviation of 0.031 at the threshold; SLACK is 3.1 of these, so it loses one
true pair in a thousand there and fewer above. With 6 rows and 54 bands a pair is proposed with probability 0.9988 at the threshold of 0.7, 0.99997 at 0.75, and 0.57 at
0.5. No cap is set on partners or candidates. Null texts and texts without words take no part; equal
word sets have similarity 1. Repeated rows of an id count once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.words import hash32, word_list
from timberline.operators.lsh import MinHash, shared_keys, tile_sides, tiles
from timberline.session import cut

ROWS, BANDS, TILE = 6, 54, 1024
SKETCH = 10  # longs of two low bits per hash
HASHES = 32 * SKETCH
#: An estimate below the threshold by more than this stops a candidate: over three standard deviations.
SLACK = 0.097
#: So many candidate ids at most are broadcast to pick texts; beyond, the texts are joined by shuffle.
BROADCAST_IDS = 200_000
SEEN = 2_000_000

_HASH = MinHash(BANDS, ROWS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shift = np.arange(0, 64, 2, dtype=np.uint64)
    seen: set[int] = set()  # classes whose bands this task has given; forgotten when many, as equal rows are dropped later
    for b in batches:
        tab, ids, sets = [], [], []
        for t, i, text in zip(*(c.to_pylist() for c in b.columns)):
            if text and (w := set(word_list(text))):
                tab.append(t)
                ids.append(i)
                sets.append(hash32(w))
        if not ids:
            continue
        keys = [xxhash.xxh3_64_intdigest(s.tobytes(), seed=t) - 2**63 for t, s in zip(tab, sets)]
        sig = _HASH.signatures(sets)
        bands = np.array(tab, np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        raw = sig.reshape(len(ids), BANDS, ROWS).astype(np.uint64)
        for r in range(ROWS):
            bands = (bands ^ raw[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
            bands ^= bands >> np.uint64(29)
        bands = bands.view(np.int64)
        new = np.zeros(len(ids), bool)
        for i, k in enumerate(keys):
            if k not in seen:
                seen.add(k)
                new[i] = True
        if len(seen) > SEEN:
            seen.clear()
        at = np.concatenate([[0], np.cumsum(new * BANDS)])
        low = (sig[:, :HASHES] & 3).astype(np.uint64).reshape(len(ids), SKETCH, 32)
        sketch = (low << shift).sum(axis=2, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(tab, pa.int32()),
                pa.array(ids, pa.int64()),
                pa.array(keys, pa.int64()),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bands[new].ravel())),
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) * SKETCH + 1, SKETCH), pa.int32()), pa.array(sketch.ravel())),
            ],
            names=["tab", "id", "set", "bands", "sketch"],
        )


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [hash32(set(word_list(t or ""))).view(np.int32) for t in b.column(1).to_pylist()]
        at = np.zeros(len(sets) + 1, np.int32)
        np.cumsum([len(s) for s in sets], out=at[1:])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int32)))], names=["key", "words"])


def _estimate():
    """Similarity by the sketches of two items a and b: equal pairs of bits, less those that are equal by chance."""
    equal = F.lit(0)
    for k in range(SKETCH):
        x = F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))
        equal = equal + F.bit_count(F.bitwise_not(x.bitwiseOR(F.shiftright(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    return (equal / HASHES - 0.25) / 0.75


def similar_sets(texts: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(members: tab, id, set; links: a, b, similarity between sets). texts: (tab int, id bigint, text string)."""
    texts = texts.where("tab is not null and id is not null")
    signed = cut(texts.select("tab", "id", "text").mapInArrow(_sign, "tab int, id bigint, set bigint, bands array<bigint>, sketch array<bigint>"), "signed")
    members = signed.select("tab", "id", "set").dropDuplicates()
    bands = signed.select("set", F.explode("bands").alias("key")).repartition("key").dropDuplicates(["key", "set"])
    shared = cut(shared_keys(bands, "key", TILE), "buckets")
    sketch = signed.select("set", "sketch").dropDuplicates(["set"])
    items = shared.join(sketch, "set").select("key", "tiles", F.struct("set", *(F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH))).alias("item"))
    left, right = tile_sides(items, "key", "item")
    near = left.join(right, ["key", "tile"]).where("a.set < b.set").where(_estimate() >= threshold - SLACK)
    near = cut(near.select(F.col("a.set").alias("a"), F.col("b.set").alias("b")).distinct(), "near")
    first = signed.groupBy("set").agg(F.min(F.struct("tab", "id")).alias("r")).select("set", "r.*")
    wanted = near.select(F.col("a").alias("set")).union(near.select(F.col("b").alias("set"))).distinct()
    picked = cut(first.join(wanted, "set", "left_semi"), "picked")
    if picked.count() <= BROADCAST_IDS:
        picked = F.broadcast(picked)
    chosen = texts.join(picked, ["tab", "id"]).select(F.col("set").alias("key"), "text").mapInArrow(_word_sets, "key bigint, words array<int>").dropDuplicates(["key"])
    chosen = cut(chosen, "chosen")
    both = near.join(chosen.select(F.col("key").alias("a"), F.col("words").alias("wa")), "a").join(chosen.select(F.col("key").alias("b"), F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    sim = common / (F.size("wa") + F.size("wb") - common)
    return members, both.withColumn("similarity", sim).where(F.col("similarity") >= threshold - 1e-9).select("a", "b", "similarity")


def id_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of ids of linked or equal sets: tab, id_a < id_b."""
    m = members
    x = m.select("tab", F.col("set").alias("a"), F.col("id").alias("ia"))
    y = m.select(F.col("tab").alias("tb"), F.col("set").alias("b"), F.col("id").alias("ib"))
    linked = links.join(x, "a").join(y, "b")
    # equal texts: every two members, the larger classes in tiles
    left, right = tiles(m.select("tab", "set", "id").withColumn("key", F.struct("tab", "set")).select("key", "id"), "key", "id", TILE)
    equal = left.join(right, ["key", "tile"]).where("a < b").select(F.col("key.tab").alias("tab"), F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    return linked.select("tab", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).unionAll(equal)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per id: tab, id, class_id (the least id whose set is equal), n_links (other ids of linked or equal sets)."""
    size = members.groupBy("set").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    other = both.join(size.select(F.col("set").alias("y"), F.col("n").alias("m")), "y").groupBy(F.col("x").alias("set")).agg(F.sum("m").alias("m"))
    per_set = size.join(other, "set", "left").select("set", "class_id", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    return members.join(per_set, "set").select("tab", "id", "class_id", "n_links")
