"""Incremental clusters of error fingerprints: leaders in order of arrival, and splitting.

A record joins the most similar earlier centre at THRESHOLD or more (ties: the earlier centre), else it becomes a centre.
Whether a record is a centre depends only on the earlier records it is similar to, so all records whose earlier neighbours are
settled are settled at once, round by round: the outcome is that of the order, and no component of the similarity graph is
ever held by one task. Candidates come from MinHash banding over character trigrams of the skeleton and are verified exactly.

The records of one failure are some 0.55 alike and meet in the buckets by the million, so a bucket gives a pair only if a sketch
does not rule it out: BITS parities of the trigrams by hash. Each trigram that only one of two sets has turns one parity, so the parities
that differ are never more than those trigrams, and no pair at the threshold is lost by them. Sketches travel with the bands,
a few bands at a time; what a pass has shuffled is removed before the next (`session.cut`)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import line_columns as L
from timberline.operators.lsh import TILE, MinHash, tiles
from timberline.session import REPEATED, cut, once

THRESHOLD = 0.75
BANDS, ROWS = 36, 6  # a pair at 0.75 is proposed with probability 0.9991, at 0.8 with 0.99998, at 0.55 with 0.64
BITS = 1024
#: Bands shuffled at once: all where that makes PASS_ROWS rows at most, PASS_BANDS of them otherwise.
PASS_ROWS, PASS_BANDS = 4_000_000, 3
LETTERS = 250_000  # of the texts taken apart at once


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of each text as three code points in one number, end to end and in order, and where each text begins (and the
    last ends). As L.trigrams has it: a text of one or two letters is its own only shingle, an empty one has none."""
    size = np.array([len(t) for t in texts], np.int64)
    c = np.frombuffer(("".join(texts) + "\0\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    text = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # letters from here to the end of the text
    first = np.repeat(size, size) == left
    code = np.where(left == 1, code & np.uint64(0x1FFFFF << 42), np.where(left == 2, code & np.uint64(0x3FFFFFFFFFF << 21), code))
    keep = (left >= 3) | first
    code, text = code[keep], text[keep]
    o = np.lexsort((code, text))
    code, text = code[o], text[o]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    code, text = code[new], text[new]
    return code, np.searchsorted(text, np.arange(len(texts) + 1))


def _chunks(b: pa.RecordBatch, texts: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows of b in turn, LETTERS bytes of the named columns at most, one row at least."""
    size = np.cumsum(sum(np.fromiter((len(x.as_buffer()) for x in b.column(k)), np.int64, b.num_rows) for k in texts))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + LETTERS, "right")))
        yield b.slice(at, to - at)
        at = to


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, n (trigrams), bands, sketch. In: item, text, none of them empty."""
    mh, longs = MinHash(BANDS, ROWS), BITS // 64
    for b in batches:
        for part in _chunks(b, [1]):
            code, at = _trigrams(part.column(1).to_pylist())
            m, n = part.num_rows, np.diff(at)
            h = _mix(code)
            raw = mh.signatures(np.split((h & np.uint64(0xFFFFFFFF)).astype(np.uint32), at[1:-1])).reshape(m, BANDS, ROWS).astype(np.uint64)
            key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (m, 1))
            for r in range(ROWS):
                key = _mix(key ^ raw[:, :, r])
            spot = np.repeat(np.arange(m), n) * BITS + (h >> np.uint64(40)).astype(np.int64) % BITS
            odd = (np.bincount(spot, minlength=m * BITS) & 1).astype(np.uint8)
            sketch = np.packbits(odd.reshape(m, BITS), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(n, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, BANDS), pa.int32()), pa.array((key >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel())),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, sketch.size + 1, longs), pa.int32()), pa.array(sketch.ravel())),
                ],
                names=["item", "n", "bands", "sketch"],
            )


def _possible(threshold: float) -> Column:
    """Whether the sketches of a and b leave the threshold possible: sets x, y of similarity t differ in (1 - t) / (1 + t) * (|x| + |y|)."""
    differ = F.lit(0)
    for k in range(BITS // 64):
        differ = differ + F.bit_count(F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}")))
    return differ <= (1 - threshold) / (1 + threshold) * (F.col("a.n") + F.col("b.n")) + 1e-6


def _near(signed: DataFrame, first: int, last: int, threshold: float) -> DataFrame:
    """a < b that share a bucket of the bands from `first` to before `last` and whose sketches leave the threshold possible. Buckets of
    more than TILE items are cut into tiles, to each of which the bucket is copied."""
    band = F.posexplode(F.slice("bands", first + 1, last - first)).alias("band", "hash")
    rows = signed.select("item", "n", "sketch", band).select("band", "hash", F.struct("item", "n", *(F.col("sketch")[k].alias(f"s{k}") for k in range(BITS // 64))).alias("x"))
    hot = cut(rows.groupBy("band", "hash").agg(F.count("*").alias("k")).where(F.col("k") > TILE).select("band", "hash", F.ceil(F.col("k") / TILE).cast("int").alias("tiles")), "hot")
    left, right = rows.withColumnRenamed("x", "a"), rows.withColumnRenamed("x", "b")
    keys = ["band", "hash"]
    if not hot.isEmpty():
        # at most one bucket in TILE rows is hot
        n = F.coalesce("tiles", F.lit(1))
        left = left.join(F.broadcast(hot), keys, "left").withColumn("tile", F.pmod(F.xxhash64("a.item"), n).cast("int")).drop("tiles")
        right = right.join(F.broadcast(hot), keys, "left").withColumn("tile", F.explode(F.sequence(F.lit(0), n - 1))).drop("tiles")
        keys = ["band", "hash", "tile"]
    return left.join(right, keys).where("a.item < b.item").where(_possible(threshold)).select(F.col("a.item").alias("a"), F.col("b.item").alias("b")).distinct()


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _chunks(b, [2, 3]):
                x, at = _trigrams(part.column(2).to_pylist())
                y, to = _trigrams(part.column(3).to_pylist())
                both = np.array([len(np.intersect1d(x[at[i] : at[i + 1]], y[to[i] : to[i + 1]], True)) for i in range(part.num_rows)], np.int64)
                sim = both / (np.diff(at) + np.diff(to) - both)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim)], names=["a", "b", "similarity"]).filter(pa.array(sim >= threshold))

    return run


def links(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A < b, similarity of distinct texts by their trigrams. texts: (item bigint, text), a stored table; null and empty texts
    take no part."""
    texts = texts.where("item is not null and text <> ''").select("item", "text")
    signed = cut(texts.mapInArrow(_sign, "item bigint, n int, bands array<int>, sketch array<bigint>"), "signed")
    step = max(PASS_BANDS, min(BANDS, PASS_ROWS // max(1, signed.count())))
    near = None
    for k in range(0, BANDS, step):
        found = cut(_near(signed, k, min(k + step, BANDS), threshold), "near")
        near = found if near is None else near.unionAll(found)
    pairs = near.distinct().join(texts.select(F.col("item").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("item").alias("b"), F.col("text").alias("tb")), "b")
    return pairs.select("a", "b", "ta", "tb").mapInArrow(_verified(threshold), "a bigint, b bigint, similarity double")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """item, comp: least item of the connected component. Labels fall to the least neighbour and are shortened by doubling
    until none moves; nothing is gathered."""
    both = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))), "edges")
    lab = cut(nodes.select("item", F.col("item").alias("comp")), "labels")
    while True:
        near = both.join(lab.select(F.col("item").alias("y"), "comp"), "y").groupBy(F.col("x").alias("item")).agg(F.min("comp").alias("m"))
        step = cut(lab.join(near, "item", "left").select("item", F.least("comp", F.coalesce("m", "comp")).alias("comp"), F.col("comp").alias("old")), "labels")
        up = step.select(F.col("item").alias("comp"), F.col("comp").alias("top"))
        new = cut(step.join(up, "comp").select("item", F.col("top").alias("comp"), (F.col("top") != F.col("old")).alias("moved")), "labels")
        lab = new.drop("moved")
        if new.where("moved").isEmpty():
            return lab


def leaders(edges: DataFrame) -> DataFrame:
    """item, centre of all items with an edge: the most similar earlier centre, ties to the earlier one, else itself. edges: (a, b,
    similarity), a before b. A centre near an item settles it as none; an item all of whose earlier neighbours are none is
    one. Each round settles the first item of every component at least."""
    state = cut(edges.select(F.col("a").alias("item")).union(edges.select(F.col("b").alias("item"))).distinct().withColumn("is", F.lit(None).cast("boolean")), "leaders")
    while True:
        near = edges.join(state.select(F.col("item").alias("a"), "is"), "a").groupBy(F.col("b").alias("item"))
        near = near.agg(F.bool_or(F.coalesce("is", F.lit(False))).alias("some"), F.bool_or(F.col("is").isNull()).alias("open"))
        found = F.when(F.col("is").isNotNull(), F.col("is")).when(F.col("some"), False).when(F.coalesce("open", F.lit(False)), None).otherwise(True)
        state = cut(state.join(near, "item", "left").select("item", found.alias("is")), "leaders")
        if state.where("is is null").isEmpty():
            break
    centres = state.where("is").select(F.col("item").alias("a"))
    best = edges.join(centres, "a").groupBy(F.col("b").alias("item")).agg(F.max(F.struct("similarity", (-F.col("a")).alias("neg"))).alias("m"))
    return state.join(best, "item", "left").select("item", F.when(F.col("is"), F.col("item")).otherwise(-F.col("m.neg")).alias("centre"))


def assign(log: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """Key, centre (the key of the cluster's first record). Records of equal skeleton stand for one; null and
    empty texts belong to no cluster; repeated rows of a key count once."""
    s = once(log.select(key, text), key).select(F.col(key).cast("bigint").alias("k"), L.fingerprint_text(F.col(text)).alias("n")).where("n is not null and n <> ''")
    s = s.select("k", L.skeleton(F.col("n")).alias("skeleton")).where("skeleton <> ''")
    s = cut(s.select("k", F.unhex(F.md5("skeleton")).alias("digest"), "skeleton"), "skeletons")
    again = cut(s.groupBy("digest").agg(F.min("k").alias("item"), F.count("*").alias("n")).where("n > 1").select("digest", "item"), "repeated")
    if again.count() <= REPEATED:
        again = F.broadcast(again)
    known = cut(s.select("k", "digest").join(again, "digest", "left").select("k", F.coalesce("item", "k").alias("item")), "firsts")
    texts = s.join(known.where("k <> item").select("k"), "k", "left_anti").select(F.col("k").alias("item"), F.col("skeleton").alias("text"))
    edge = cut(links(texts, threshold), "links")
    return known.join(leaders(edge), "item", "left").select(F.col("k").alias(key), F.coalesce("centre", "item").alias("centre"))


def split(members: DataFrame, least: int = 4, apart: float = 0.5) -> DataFrame:
    """cluster_id, id, side 0 or 1 of clusters of `least` or more of which any two members are more than `apart`
    from each other: members go to the nearer of the first and the one farthest from it, ties to the first. members:
    (cluster_id, id, g)."""
    first = members.groupBy("cluster_id").agg(F.min(F.struct("id", "g")).alias("f"), F.count("*").alias("n")).where(F.col("n") >= least)
    far = cut(members.join(first, "cluster_id").select("cluster_id", "id", "g", (1 - L.jaccard(F.col("g"), F.col("f.g"))).alias("d0")), "far")
    seed = far.groupBy("cluster_id").agg(F.max(F.struct("d0", (-F.col("id")).alias("neg"), "g")).alias("s"))
    both = cut(far.join(seed, "cluster_id").select("cluster_id", "id", "g", "d0", (1 - L.jaccard(F.col("g"), F.col("s.g"))).alias("d1")), "seeds")
    wide = cut(_wide(both, apart), "wide")
    return both.join(wide, "cluster_id", "left_semi").select("cluster_id", "id", (F.col("d1") < F.col("d0")).cast("int").alias("side"))


def _wide(both: DataFrame, apart: float) -> DataFrame:
    """cluster_id of the clusters with two members more than `apart` from each other. both: (cluster_id, id, g, d0, d1), d0
    and d1 the distances from the two seeds.

    Most show it by a seed. Of the rest, distinct texts meet in tiles; as the distance keeps to the triangle inequality,
    two whose distances from a seed add up to no more than `apart` cannot be farther from each other and are not compared."""
    reach = both.groupBy("cluster_id").agg(F.max(F.greatest("d0", "d1")).alias("most"), F.max("d0").alias("d0"), F.max("d1").alias("d1"))
    near = apart - 1e-9
    unsure = reach.where((F.col("most") <= apart) & (2 * F.least("d0", "d1") > near)).select("cluster_id")
    texts = both.join(unsure, "cluster_id", "left_semi").groupBy("cluster_id", F.array_sort("g").alias("g")).agg(F.min("id").alias("id"), F.first("d0").alias("d0"), F.first("d1").alias("d1"))
    left, right = tiles(texts.select("cluster_id", F.struct("id", "d0", "d1", "g").alias("text")), "cluster_id", "text")
    pairs = left.join(right, ["cluster_id", "tile"]).where("a.id < b.id")
    pairs = pairs.where((F.col("a.d0") + F.col("b.d0") > near) & (F.col("a.d1") + F.col("b.d1") > near))
    found = pairs.where(1 - L.jaccard(F.col("a.g"), F.col("b.g")) > apart).select("cluster_id").distinct()
    return reach.where(F.col("most") > apart).select("cluster_id").union(found)
