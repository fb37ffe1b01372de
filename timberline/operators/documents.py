"""Whole documents: truncation, and the composites that join several analyses of one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import line_columns as L
from timberline.functions import patterns as P
from timberline.operators import analysis as A
from timberline.sources.lines import from_text, split_lines


def truncated_text(text: Column, longest: int = 6000, head: int = 50, tail: int = 100) -> Column:
    """Texts of up to `longest` letters stay. Of longer ones the first `head` and last `tail` lines are kept, where there
    are no more lines than that half of `longest` letters from each end; a mark stands for the rest. Null stays null."""
    lines = split_lines(text)
    half = longest // 2
    ends = F.concat(F.left(text, F.lit(half)), F.lit(P.OMITTED_TEXT), F.right(text, F.lit(half)))
    before, after = P.OMITTED_LINES
    mark = F.concat(F.lit(before), (F.size(lines) - head - tail).cast("string"), F.lit(after))
    kept = F.concat(F.array_join(F.slice(lines, 1, head), "\n"), mark, F.array_join(F.slice(lines, -tail, tail), "\n"))
    return F.when(F.length(text) <= longest, text).when(F.size(lines) <= head + tail, ends).otherwise(kept)


def parsed(docs: DataFrame, key: str, text: str, most: int = 30) -> DataFrame:
    """doc_id, platform, error_lines (distinct, in order, `most` at most as the feature has it), text, is_truncated. A
    null or empty text is of an Unknown platform and has no error lines. docs: one row per key."""
    lines = from_text(docs, key, text)
    errors = A.error_lines(lines, most).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "error_line"))).alias("e"))
    cut = truncated_text(F.col(text))
    whole = docs.select(F.col(key).alias("doc_id"), cut.alias("text"), F.coalesce(F.length(cut) < F.length(text), F.lit(False)).alias("is_truncated"))
    both = whole.join(A.platform(lines).select("doc_id", "platform"), "doc_id", "left").join(errors, "doc_id", "left")
    found = F.coalesce(F.transform("e", lambda x: x["error_line"]), F.array().cast("array<string>"))
    return both.select("doc_id", F.coalesce("platform", F.lit("Unknown")).alias("platform"), found.alias("error_lines"), "text", "is_truncated")


def keys(parsed_docs: DataFrame) -> DataFrame:
    """doc_id, cache_key (of the normal form of platform and error lines), raw_key (of both as they are)."""
    raw = F.concat_ws("\n", F.col("platform"), F.array_join("error_lines", "\n"))
    return parsed_docs.select("doc_id", F.sha2(L.cache_text(raw), 256).alias("cache_key"), F.sha2(raw, 256).alias("raw_key"))


def report(lines: DataFrame) -> DataFrame:
    """Statistics, anomalies, patterns and timeline of each document, one row each. The four are joined outward, so a
    document that one of them has nothing to say of keeps the others; `analyses` counts those that spoke."""
    repeated = lines.groupBy("doc_id", F.substring(L.strip(F.col("line")), 1, 80).alias("signature")).agg(F.count("*").alias("n")).where("n >= 2 and signature <> ''")
    patterns = repeated.groupBy("doc_id").agg(F.count("*").alias("repeated_signatures"), F.max("n").alias("most_repeats"))
    parts = [A.statistics(lines), A.anomaly_summary(lines), patterns, A.time_span(lines)]
    out, spoke = None, F.lit(0)
    for i, p in enumerate(parts):
        p = p.withColumn(f"__{i}", F.lit(1))
        out = p if out is None else out.join(p, "doc_id", "full")
        spoke = spoke + F.coalesce(f"__{i}", F.lit(0))
    return out.withColumn("analyses", spoke).drop(*(f"__{i}" for i in range(len(parts))))


def exact_hits(requests: DataFrame, store: DataFrame, key: str, ttl: Column | str) -> DataFrame:
    """Each request (id, key, at) with the newest stored row (key, stored_id, stored_at) of an equal key, ties to the
    larger stored_id, and whether it is still alive: no older than `ttl` before the request. Requests without an equal key
    and null keys give no row."""
    newest = store.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("stored_at", "stored_id")).alias("s"))
    hit = requests.join(newest, key).select("id", key, F.col("s.stored_id").alias("stored_id"), "at", F.col("s.stored_at").alias("stored_at"))
    ttl = F.expr(f"INTERVAL {ttl}") if isinstance(ttl, str) else ttl
    return hit.withColumn("alive", F.col("at") <= F.col("stored_at") + ttl)


def catalogue(requests: DataFrame, name: str, entries: dict[str, list[str]], aliases: dict[str, str] | None = None) -> DataFrame:
    """Each request with every entry of its platform's catalogue, by name or alias, case ignored; unknown names give no
    row. The catalogue is an argument of the call and so small enough to be sent to all tasks."""
    names = {k.lower(): k for k in entries} | {a.lower(): t for a, t in (aliases or {}).items()}
    rows = [(low, k, i, e) for low, k in names.items() for i, e in enumerate(entries[k])]
    table = requests.sparkSession.createDataFrame(rows, "low string, platform string, ord int, entry string")
    return requests.join(F.broadcast(table), F.lower(F.col(name)) == F.col("low")).drop("low")
