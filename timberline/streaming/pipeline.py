"""Chains of transforms over streams and batches, with a registry, quarantine and event-time rates."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import line_columns as L
from timberline.session import shared_dir

Transform = Callable[[DataFrame], DataFrame]


class Registry:
    """Named transforms, unique by name."""

    def __init__(self):
        self._by: dict[str, tuple[str, Transform]] = {}

    def register(self, name: str, kind: str, fn: Transform) -> None:
        if kind not in ("input", "processor", "output"):
            raise ValueError(f"unknown kind {kind}")
        if name in self._by:
            raise ValueError(f"{name} is registered")
        if not callable(fn):
            raise TypeError("a transform is callable")
        self._by[name] = (kind, fn)

    def unregister(self, name: str) -> None:
        self._by.pop(name)

    def get(self, name: str) -> Transform:
        return self._by[name][1]

    def names(self, kind: str | None = None) -> list[str]:
        return sorted(n for n, (k, _) in self._by.items() if kind in (None, k))


def chain(df: DataFrame, *steps: Transform) -> DataFrame:
    """T05."""
    for s in steps:
        df = df.transform(s)
    return df


def split_valid(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """T05 policy skip: (rows that pass, quarantine); a null condition does not pass."""
    good = F.coalesce(ok, F.lit(False))
    return df.where(good), df.where(~good)


def each_row(df: DataFrame, fn: Callable[[dict], dict], policy: str = "skip", tries: int = 3) -> DataFrame:
    """Python per row in Arrow batches. A row whose step fails goes on as it was (skip), is tried up to `tries` times
    first (retry), or ends the query (abort)."""
    import pandas as pd

    if policy not in ("skip", "retry", "abort"):
        raise ValueError(f"unknown policy {policy}")
    times = tries if policy == "retry" else 1

    def one(r: dict) -> dict:
        for k in range(times):
            try:
                return fn(dict(r))
            except Exception:
                if policy == "abort":
                    raise
        return r

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([one(r) for r in p.to_dict("records")], columns=p.columns)

    return df.mapInPandas(run, df.schema)


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the project as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    local = path.removeprefix("file://")
    if os.path.isfile(local):
        return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return r.parquet(path)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote. A batch has a folder by its number, so one that runs
    again after a failure replaces what it wrote. In complete mode the last batch counts."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    out = spark.read.schema(stream.schema)
    return out.parquet(f"{at}/out") if mode == "complete" else out.option("recursiveFileLookup", "true").parquet(f"{at}/out")


def stream_levels(lines: DataFrame) -> DataFrame:
    """A04 over a stream of (message_preview)."""
    return lines.groupBy(L.level(F.coalesce("message_preview", F.lit(""))).alias("level")).agg(F.count("*").alias("n"))


def error_rate(lines: DataFrame, us: str, minutes: int = 5, most: float = 10.0, late: str = "1 day") -> DataFrame:
    """Windows of `minutes` whose errors exceed `most` a window; rows later than `late` behind the newest are dropped
    by the watermark, which bounds the state."""
    t = lines.where(f"{us} > 0 and level in ('ERROR','CRITICAL','FATAL')").withColumn("at", F.timestamp_micros(us)).withWatermark("at", late)
    return t.groupBy(F.window("at", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("w.start").alias("start"), "n")


def hit_ratio(calls: DataFrame, at: str, hit: Column, minutes: int = 60, least: float = 0.5, late: str = "1 day") -> DataFrame:
    """Windows of `minutes` in which fewer than `least` of the calls were hits; a null condition is no hit."""
    t = calls.withWatermark(at, late) if calls.isStreaming else calls
    g = t.groupBy(F.window(at, f"{minutes} minutes").alias("w")).agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"), F.count("*").alias("n"))
    return g.where(F.col("hits") < least * F.col("n")).select(F.col("w.start").alias("start"), "hits", "n")


def costly_days(calls: DataFrame, at: str, cost: str, most: float, late: str = "1 day") -> DataFrame:
    """Days whose calls cost more than `most`; the limit is the caller's."""
    t = calls.withWatermark(at, late) if calls.isStreaming else calls
    c = F.sum(F.coalesce(F.col(cost).cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)")))
    return t.groupBy(F.window(at, "1 day").alias("w")).agg(c.alias("cost")).where(F.col("cost") > most).select(F.col("w.start").alias("start"), "cost")
