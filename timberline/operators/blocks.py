"""Windows over long sequences, cut into blocks.

A window partitioned by document runs a document of any length in one task. Here a sequence is cut into blocks of BLOCK
positions; what a block needs from earlier ones comes from a table of one row per block. Both steps read one exchange on
(document, block), which Spark reuses, so the input is computed and shuffled once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 100_000


def _cut(df: DataFrame, by: str, pos: str) -> DataFrame:
    return df.withColumn("__b", F.floor(F.col(pos) / BLOCK)).repartition(by, "__b")


def with_previous(df: DataFrame, by: str, pos: str, value: str, name: str) -> DataFrame:
    """Adds the value at the position before, over the whole sequence; null at its start. value holds no nulls."""
    b = _cut(df, by, pos)
    last = b.groupBy(by, "__b").agg(F.max_by(value, pos).alias("__v"))
    carry = last.select(by, "__b", F.lag("__v").over(Window.partitionBy(by).orderBy("__b")).alias("__v"))
    inside = b.withColumn("__i", F.lag(value).over(Window.partitionBy(by, "__b").orderBy(pos)))
    return inside.join(carry, [by, "__b"]).withColumn(name, F.coalesce("__i", "__v")).drop("__b", "__i", "__v")


def with_running_sum(df: DataFrame, by: str, pos: str, value: Column, name: str) -> DataFrame:
    """Adds the sum of value over all positions up to and with this one."""
    b = _cut(df.withColumn("__s", value), by, pos)
    per = b.groupBy(by, "__b").agg(F.sum("__s").alias("__t"))
    w = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(by, "__b", F.coalesce(F.sum("__t").over(w), F.lit(0)).alias("__t"))
    inside = b.withColumn("__i", F.sum("__s").over(Window.partitionBy(by, "__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return inside.join(base, [by, "__b"]).withColumn(name, F.col("__t") + F.col("__i")).drop("__b", "__i", "__t", "__s")
