"""Per-document analyses of line frames (doc_id, pos, line).

Each is one aggregation keyed by document, or by document and a low-cardinality label, with partial aggregation before
its only shuffle. Ordered steps use windows over (document) and are marked; ties always fall to the smaller pos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.functions import line_columns as L
from timberline.functions import patterns as P
from timberline.operators.blocks import with_previous, with_running_sum



def _line() -> Column:
    return F.col("line")


def level_histogram(lines: DataFrame) -> DataFrame:
    """A04 by P01."""
    return lines.groupBy("doc_id", L.level(_line()).alias("level")).agg(F.count("*").alias("n"))


def level_histogram_leftmost(lines: DataFrame) -> DataFrame:
    """A04 by P02."""
    return lines.groupBy("doc_id", L.level_leftmost(_line()).alias("level")).agg(F.count("*").alias("n"))


def totals(lines: DataFrame) -> DataFrame:
    """A01."""
    low = F.lower("line")
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("total_lines"),
        F.count_if(low.contains("error")).alias("error_count"),
        F.count_if(low.contains("warn")).alias("warning_count"),
        F.count_if(low.contains("fatal")).alias("fatal_count"),
    )


def error_lines(lines: DataFrame, most: int = 30) -> DataFrame:
    """Distinct stripped error lines of five or more letters in order of first sight, `most` per document (the
    feature's own limit)."""
    s = L.strip(_line())
    d = lines.where(L.is_error_line(_line()) & (F.length(s) >= 5)).groupBy("doc_id", s.alias("error_line")).agg(F.min("pos").alias("first_pos"))
    w = Window.partitionBy("doc_id").orderBy("first_pos")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def platform(lines: DataFrame) -> DataFrame:
    """Distinct signatures present in the document; highest count wins, ties by declaration, none is Unknown."""
    found = [F.max(_line().rlike("(?i)" + sig).cast("int")).alias(f"s{i}_{j}") for i, sigs in enumerate(P.PLATFORM_SIGNATURES.values()) for j, sig in enumerate(sigs)]
    g = lines.groupBy("doc_id").agg(*found)
    scores = [sum((F.col(f"s{i}_{j}") for j in range(len(sigs))), F.lit(0)) for i, sigs in enumerate(P.PLATFORM_SIGNATURES.values())]
    best = F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (s, name) in enumerate(zip(scores, P.PLATFORM_SIGNATURES)))))
    return g.select("doc_id", best.alias("b")).select("doc_id", F.when(F.col("b.score") > 0, F.col("b.name")).otherwise("Unknown").alias("platform"), F.col("b.score").alias("score"))


def statistics(lines: DataFrame) -> DataFrame:
    """A06, A08, P11."""
    n = F.count("*")
    err = _line().rlike("(?i)" + "|".join(P.STATS_ERROR_WORDS))
    msg = F.substring(L.strip(_line()), 1, 80)
    return lines.groupBy("doc_id").agg(
        n.alias("total_lines"),
        F.count_if(err).alias("error_lines"),
        F.round(F.count_if(err) / n, 4).alias("error_density"),
        F.round(F.avg(F.length("line")), 2).alias("avg_line_length"),
        F.max(F.length("line")).alias("max_line_length"),
        F.count_if(_line().rlike(P.STACK_LINE)).alias("stacktrace_lines"),
        F.count_distinct(F.when(F.lower("line").contains("error"), msg)).alias("unique_errors"),
    )


def top_error_patterns(lines: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent labels of all lines, ties by first sight (document, pos)."""
    label = L.first_match(_line(), P.ERROR_LABELS, None)
    g = lines.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).where("label is not null")
    return g.orderBy(F.desc("n"), "first").limit(k).select("label", "n")


def anomalies(lines: DataFrame) -> DataFrame:
    """One row per anomalous line."""
    flags = L.anomaly_flags()
    err = _line().rlike(P.ANOMALY_ERROR)
    return lines.select("doc_id", "pos", L.anomaly_type(flags).alias("anomaly_type"), L.anomaly_severity(flags, err).alias("severity")).where("anomaly_type is not null")


def severity_histogram(lines: DataFrame) -> DataFrame:
    """A09."""
    return lines.groupBy(L.anomaly_severity(L.anomaly_flags(), _line().rlike(P.ANOMALY_ERROR)).alias("severity")).agg(F.count("*").alias("n"))


def anomaly_summary(lines: DataFrame) -> DataFrame:
    """A10."""
    flags = L.anomaly_flags()
    sev = L.anomaly_severity(flags, _line().rlike(P.ANOMALY_ERROR))
    t = lines.select("doc_id", L.anomaly_type(flags).alias("t"), sev.alias("s"), flags["burst"].alias("b"))
    return t.groupBy("doc_id").agg(
        F.bool_or("b").alias("has_burst"),
        F.count("t").alias("total_anomalies"),
        F.count_if(F.col("s").isin("high", "critical")).alias("high_severity"),
        F.round(F.count("t") / F.count("*"), 4).alias("anomaly_density"),
    )


def categories(lines: DataFrame) -> DataFrame:
    """A11 by P15."""
    return lines.groupBy("doc_id", L.first_match(_line(), P.LINE_CATEGORIES, "info").alias("category")).agg(F.count("*").alias("n"))


def version_conflicts(lines: DataFrame) -> DataFrame:
    """Package and wanted version, other package and its version."""
    g = [F.regexp_extract("line", P.VERSION_CONFLICT, i) for i in (1, 2, 3, 4)]
    return lines.where(L.found(_line(), P.VERSION_CONFLICT)).select("doc_id", "pos", g[0].alias("package"), g[1].alias("expected"), g[2].alias("actual"), g[3].alias("actual_version"))


def dependencies(lines: DataFrame) -> DataFrame:
    """Distinct missing dependencies with the place of first sight."""
    d = L.strip(F.regexp_extract("line", P.DEPENDENCY_ERROR, 1))
    return lines.where(_line().rlike(P.DEPENDENCY_ERROR)).groupBy("doc_id", d.alias("dependency")).agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))


def file_paths(lines: DataFrame, most: int = 30) -> DataFrame:
    """Distinct paths of a document in order of name, `most` each (the feature's own limit)."""
    p = lines.select("doc_id", F.explode(L.all_matches(_line(), P.FILE_PATH, "/", "\\", ".")).alias("path")).distinct()
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))).where(F.col("rank") <= most)


def repeated(lines: DataFrame, k: int = 20) -> DataFrame:
    """Signatures seen twice or more, the k most frequent of a document, ties by first sight."""
    sig = F.substring(L.strip(_line()), 1, 80)
    g = lines.groupBy("doc_id", sig.alias("signature")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).where("n >= 2 and signature <> ''")
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first_pos")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stamped(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "pos", L.stamp_us(_line()).alias("us")).where("us is not null")


def coverage(lines: DataFrame) -> DataFrame:
    """A05."""
    t = lines.select("doc_id", L.stamp_us(_line()).alias("us"))
    return t.groupBy("doc_id").agg(F.count("*").alias("total"), F.count("us").alias("stamped"), F.round(F.count("us") / F.count("*"), 4).alias("coverage"), F.min("us").alias("min_us"), F.max("us").alias("max_us"))


def intervals(lines: DataFrame) -> DataFrame:
    """Seconds to the stamped line before, in line order."""
    p = with_previous(stamped(lines), "doc_id", "pos", "us", "before")
    return p.select("doc_id", "pos", ((F.col("us") - F.col("before")) / 1e6).alias("interval_s")).where("interval_s is not null")


def gaps(lines: DataFrame, most: int = 20) -> DataFrame:
    """Intervals above mean + 3 sigma (sample); where sigma is 0 above five means; the first `most` of a document."""
    i = intervals(lines)
    stats = i.groupBy("doc_id").agg(F.avg("interval_s").alias("mu"), F.coalesce(F.stddev_samp("interval_s"), F.lit(0.0)).alias("sd"))
    cut = F.when(F.col("sd") > 0, F.col("mu") + 3 * F.col("sd")).otherwise(5 * F.col("mu"))
    g = i.join(stats, "doc_id").where(F.col("interval_s") > cut)
    w = Window.partitionBy("doc_id").orderBy("pos")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("doc_id", "pos", "interval_s", "rank")


def regressions(lines: DataFrame) -> DataFrame:
    """W03."""
    return intervals(lines).groupBy("doc_id").agg(F.count_if(F.col("interval_s") < 0).alias("regressions"))


def durations(lines: DataFrame) -> DataFrame:
    """A14 by P08."""
    return (
        lines.select("doc_id", L.duration_s(_line()).alias("s"))
        .groupBy("doc_id")
        .agg(F.count("s").alias("n"), F.round(F.sum("s"), 3).alias("total_s"), F.round(F.avg("s"), 3).alias("avg_s"), F.max("s").alias("max_s"), F.min("s").alias("min_s"))
        .where("n > 0")  # a filter on s before would evaluate its regexes once more
    )


def minute_density(lines: DataFrame, k: int = 20) -> DataFrame:
    """The k busiest minutes over all documents, ties by time."""
    m = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm")
    return stamped(lines).groupBy(m.alias("minute")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "minute").limit(k)


def time_span(lines: DataFrame) -> DataFrame:
    """First and last stamp by line order, not by time."""
    at = F.when(F.col("us").isNotNull(), F.col("pos"))  # a filter on us would evaluate its regexes once more
    return (
        lines.select("doc_id", "pos", L.stamp_us(_line()).alias("us"))
        .groupBy("doc_id")
        .agg(F.min_by("us", at).alias("first_us"), F.max_by("us", at).alias("last_us"))
        .where("first_us is not null")
        .withColumn("span_s", (F.col("last_us") - F.col("first_us")) / 1e6)
    )


def byte_offsets(lines: DataFrame) -> DataFrame:
    """The row shape of a line index: line number from 1, byte offset, byte length with the line feed, level,
    stamp, preview of 200 letters."""
    size = F.octet_length("line") + 1
    return with_running_sum(lines, "doc_id", "pos", size, "end").select(
        "doc_id",
        (F.col("pos") + 1).cast("int").alias("line_number"),
        (F.col("end") - size).cast("bigint").alias("byte_offset"),
        size.cast("int").alias("line_length"),
        L.stamp_us(_line()).alias("timestamp_us"),
        L.level(_line()).alias("level"),
        F.substring(L.strip(_line()), 1, 200).alias("message_preview"),
    )


def hydrate(lines: DataFrame) -> DataFrame:
    """Deep parse of each line."""
    return lines.withColumn("low", F.lower("line")).select(
        "doc_id",
        "pos",
        L.first_match(F.col("low"), P.DEEP_CATEGORIES, None).alias("category"),
        F.array_join(F.slice(L.all_matches(_line(), P.VERSION_NUMBER, "."), 1, 5), ",").alias("versions"),
        F.array_join(L.all_matches(_line(), P.FILE_PATH, "/", "\\", "."), ",").alias("paths"),
        L.duration_s(_line()).alias("duration_s"),
        _line().rlike(P.STACK_LINE).alias("is_stacktrace"),
        F.substring(L.strip(_line()), 1, 80).alias("signature"),
    )


def truncated(lines: DataFrame, longest: int = 6000, head: int = 50, tail: int = 100) -> DataFrame:
    """The kept line numbers of documents that are too long: first `head` and last `tail` lines where there are
    more than both, with the number of lines left out; others keep all."""
    n = lines.groupBy("doc_id").agg(F.count("*").alias("n"), (F.sum(F.length("line") + 1) - 1).alias("chars"))
    big = (F.col("chars") > longest) & (F.col("n") > head + tail)
    j = lines.select("doc_id", "pos").join(n, "doc_id")
    return j.where(~big | (F.col("pos") < head) | (F.col("pos") >= F.col("n") - tail)).select("doc_id", "pos", F.when(big, F.col("n") - head - tail).otherwise(0).alias("omitted"))


def filtered(index: DataFrame, least: str | None = None, keyword: str | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """F01 to F05 on a line index: least level, keyword in the preview (case ignored, taken literally), inclusive time range
    that unstamped lines pass. Level and time are plain comparisons of stored columns and are pushed into the scan, where
    row groups without a match are skipped; the keyword is checked on what is left."""
    out = index
    if least:
        out = out.where(F.col("level").isin([k for k, r in P.LEVEL_RANK.items() if r >= P.LEVEL_RANK[least]]))
    if keyword:
        out = out.where(F.lower("message_preview").contains(keyword.lower()))
    if between:
        us = F.col("timestamp_us")
        out = out.where(us.isNull() | (us == 0) | us.between(*between))
    return out
