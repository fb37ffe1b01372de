"""Cluster tables over time, ledgers, upserts: one conditional aggregation each. `as_of` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ts(v: str | Column) -> Column:
    return F.lit(v).cast("timestamp") if isinstance(v, str) else v


def once(log: DataFrame, key: str = "id") -> DataFrame:
    """Repeated deliveries once; they are equal in all columns."""
    return log.dropDuplicates([key])


def trending(log: DataFrame, as_of: str, days: int = 7, k: int = 10) -> DataFrame:
    """The k clusters with most rows since as_of - days, ties by id."""
    since = _ts(as_of) - F.expr(f"INTERVAL {days} DAYS")
    return log.where((F.col("created_at") >= since) & F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(k)


def insight(log: DataFrame, as_of: str) -> DataFrame:
    """Per cluster rows of 7 and 30 days, all rows, mean minutes to resolve."""
    age = lambda d: F.col("created_at") >= _ts(as_of) - F.expr(f"INTERVAL {d} DAYS")
    return (
        log.where("cluster_id is not null")
        .groupBy("cluster_id")
        .agg(
            F.count("*").alias("total"),
            F.count_if(age(7)).alias("last_7_days"),
            F.count_if(age(30)).alias("last_30_days"),
            F.round(F.avg("time_to_resolve_minutes"), 2).alias("avg_resolve_minutes"),
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
        )
    )


def daily(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Rows per day of the last `days` days, days without rows included."""
    end = F.to_date(_ts(as_of))
    calendar = log.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    n = log.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def map_totals(clusters: DataFrame, column: str = "platform_distribution") -> DataFrame:
    """Key-wise sum of a map column."""
    return clusters.select(F.explode(column).alias("platform", "n")).groupBy("platform").agg(F.sum("n").alias("n"))


def week_over_week(log: DataFrame, as_of: str) -> DataFrame:
    """Rows and active clusters of the last and the week before, change in percent (null from nothing)."""
    t = _ts(as_of)
    this = (F.col("created_at") >= t - F.expr("INTERVAL 7 DAYS")) & (F.col("created_at") < t)
    before = (F.col("created_at") >= t - F.expr("INTERVAL 14 DAYS")) & (F.col("created_at") < t - F.expr("INTERVAL 7 DAYS"))
    g = log.agg(F.count_if(this).alias("this_week"), F.count_if(before).alias("last_week"), F.count_distinct(F.when(this, F.col("cluster_id"))).alias("active_clusters"))
    return g.withColumn("delta_percent", F.round((F.col("this_week") - F.col("last_week")) * 100 / F.nullif(F.col("last_week"), F.lit(0)), 1))


def rollup(log: DataFrame, samples: int = 3) -> DataFrame:
    """The cluster table recomputed: bounds, count, counts by platform, the last ids, state."""
    by = log.where("cluster_id is not null")
    plat = by.groupBy("cluster_id", F.coalesce("platform", F.lit("Unknown")).alias("platform")).agg(F.count("*").alias("n"))
    maps = plat.groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "n")))).alias("platform_distribution"))
    last = by.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("id")))).where(F.col("r") <= samples)
    ids = last.groupBy("cluster_id").agg(F.sort_array(F.collect_list("id"), asc=False).alias("representative_samples"))
    core = by.groupBy("cluster_id").agg(F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.count("*").alias("occurrence_count"), F.min_by("error_fingerprint", F.struct("created_at", "id")).alias("centroid_fingerprint"))
    return core.join(maps, "cluster_id").join(ids, "cluster_id")


def active(clusters: DataFrame, as_of: str, idle_days: int = 30) -> DataFrame:
    """C04, F08."""
    return clusters.withColumn("is_active", F.col("last_seen") >= _ts(as_of) - F.expr(f"INTERVAL {idle_days} DAYS"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def only_new(new: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored; repeated new rows once."""
    return new.dropDuplicates([key]).join(have.select(key), key, "left_anti")


def upsert(have: DataFrame, new: DataFrame, key: str, newest: str) -> DataFrame:
    """New rows replace stored ones of the same key; of several new ones the newest stays."""
    w = Window.partitionBy(key).orderBy(F.desc(newest))
    fresh = new.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return have.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def running_total(events: DataFrame, day: Column, order: list[str], amount: str) -> DataFrame:
    """Cumulative amount of each day in order. The day is cut into hours first: totals of earlier hours come from a
    small table, so a busy day is not summed up by one task."""
    e = events.withColumn("day", day).withColumn("hour", F.hour("ts"))
    hours = e.groupBy("day", "hour").agg(F.sum(amount).alias("s"))
    before = hours.select("day", "hour", F.coalesce(F.sum("s").over(Window.partitionBy("day").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.sum(amount).over(Window.partitionBy("day", "hour").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return e.withColumn("inside", inside).join(before, ["day", "hour"]).withColumn("running", F.col("base") + F.col("inside")).drop("inside", "base")


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    """K13, A25."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bounds: list[float], *by: str) -> DataFrame:
    """Cumulative buckets value <= bound, per group."""
    return df.groupBy(*by).agg(*(F.count_if(F.col(value) <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds), F.count(value).alias("n"))


def report_markdown(clusters: DataFrame) -> DataFrame:
    """One line of Markdown per cluster, a severity word and a bar of the count."""
    label = F.when(F.col("avg_severity_score") >= 3.5, "critical").when(F.col("avg_severity_score") >= 2.5, "high").when(F.col("avg_severity_score") >= 1.5, "medium").otherwise("low")
    n = F.coalesce("occurrence_count", F.lit(0))
    return clusters.select("cluster_id", F.concat(F.lit("| "), F.col("cluster_id").cast("string"), F.lit(" | "), n.cast("string"), F.lit(" | "), label, F.lit(" | "), F.repeat(F.lit("█"), F.least(n, F.lit(20))), F.lit(" |")).alias("line"))


def export_json(clusters: DataFrame) -> DataFrame:
    """One JSON object per row; maps and arrays become JSON objects and arrays."""
    return clusters.select(F.to_json(F.struct(*clusters.columns)).alias("json"))


def weekly_report(log: DataFrame, clusters: DataFrame, as_of: str, k: int = 10) -> str:
    """Markdown of the week: change, busiest clusters, days, platforms. Only totals and k rows reach the driver."""
    w = week_over_week(log, as_of).first()
    top = trending(log, as_of, 7, k).collect()
    days = daily(log, as_of, 7).orderBy("day").collect()
    plats = map_totals(clusters).orderBy(F.desc("n"), "platform").limit(20).collect()
    bar = lambda n, most: "█" * min(n, most)
    lines = ["# Week to " + as_of[:10], "", f"Rows: {w['this_week']} (before: {w['last_week']}), active clusters: {w['active_clusters']}", "", "| cluster | rows |", "|-|-|"]
    lines += [f"| {r['cluster_id']} | {r['n']} |" for r in top] + ["", "| day | rows | |", "|-|-|-|"]
    lines += [f"| {r['day']} | {r['n']} | {bar(r['n'], 30)} |" for r in days] + ["", "| platform | rows |", "|-|-|"]
    return "\n".join(lines + [f"| {r['platform']} | {r['n']} |" for r in plats])
