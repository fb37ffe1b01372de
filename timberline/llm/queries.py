"""Queries p1 to p10 of this subpackage (p4 and p5 are the core's) and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import bpe, clusters, leaks, mojibake, near_dup, pii, qdigest, runs
from timberline.operators import entries
from timberline.session import cut, once, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PERCENTS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
EPS = 0.005
TABLES = ("analyze_request", "analysis_log")


def _near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "analyze_request").select(F.lit(0).alias("tab"), F.col("request_no").alias("id"), F.col("log_text").alias("text"))
    b = table(spark, sf_dir, "analysis_log").select(F.lit(1).alias("tab"), "id", F.col("error_fingerprint").alias("text"))
    return a.unionAll(b).where("text is not null")


def _tab_name() -> F.Column:
    return F.when(F.col("tab") == 0, TABLES[0]).otherwise(TABLES[1]).alias("record_table")


def _free_texts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    a = table(spark, sf_dir, "analyze_request").select(F.col("request_id").alias("key"), F.col("log_text").alias("text"))
    b = table(spark, sf_dir, "log_record").select(F.col("id").alias("key"), F.col("content").alias("text"))
    return {"analyze_request": a, "log_record": b}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (pii.find(t).select(F.lit(n).alias("record_table"), F.col("key").alias("record_key"), "line_no", "pii_type") for n, t in _free_texts(spark, sf_dir).items())
    return a.unionAll(b)


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (pii.redacted(t.dropDuplicates(["key"])).select(F.lit(n).alias("record_table"), F.col("key").alias("record_key"), "text") for n, t in _free_texts(spark, sf_dir).items())
    return a.unionAll(b)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_dup.id_pairs(*near_dup.similar_sets(_near_texts(spark, sf_dir)))
    return pairs.select(_tab_name(), "id_a", "id_b")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(*near_dup.similar_sets(_near_texts(spark, sf_dir))).select(_tab_name(), "id", "class_id", "n_links")


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.density_peaks(table(spark, sf_dir, "analysis_log").select("id", F.col("error_fingerprint").alias("text")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.neighbours(_failures(spark, sf_dir))


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.describe(_failures(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, entries.Templates]:
    lines = table(spark, sf_dir, "line_index")
    t = entries.mine_templates(lines.select("message_preview"))
    return lines, runs.runs(lines, t), t


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)[1].select("file_id", "first_line", "last_line")


def p7_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run as one event: first and last line, count and, from the entries' own stamps, begin and duration (null where
    the first or last entry has none)."""
    lines, found, t = _runs(spark, sf_dir)
    files = table(spark, sf_dir, "index_manifest").groupBy("file_id").agg(F.max(F.unix_micros(F.col("mtime").cast("timestamp"))).alias("seen_us"))
    zones = table(spark, sf_dir, "log_source").select("source_file", "time_zone").dropDuplicates(["source_file"])
    at = cut(entries.line_instants(lines, files, zones, t).select("file_id", "line_number", "utc_us"), "instants")
    begin = at.select("file_id", F.col("line_number").alias("first_line"), F.col("utc_us").alias("begin_us"))
    end = at.select("file_id", F.col("line_number").alias("last_entry"), F.col("utc_us").alias("end_us"))
    both = found.join(begin, ["file_id", "first_line"], "left").join(end, ["file_id", "last_entry"], "left")
    return both.select("file_id", "first_line", "last_line", F.col("n").alias("count"), "begin_us", (F.col("end_us") - F.col("begin_us")).alias("duration_us"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(table(spark, sf_dir, "analyze_response_meta").select("request_no", "model_used", "platform_detected", "duration_ms", "cost_usd", "served_at"), "request_no")
    metrics = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("duration_ms", "cost_usd")))).alias("m")
    long = rows.select("model_used", "platform_detected", F.to_date("served_at").alias("day"), metrics).select("model_used", "platform_detected", "day", "m.metric", "m.value")
    return qdigest.digests(long, ["model_used", "platform_detected", "metric", "day"], "value", EPS)


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per model, platform and metric from daily digests, within EPS of n ranks and 2**-9 of the value."""
    by = ["model_used", "platform_detected", "metric"]
    return qdigest.percentiles(qdigest.merge(_daily(spark, sf_dir), by, EPS), by, PERCENTS, EPS)


def p1_daily_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(once(docs, "doc_id"), TOKENIZER)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_removal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.removal_spans(_leaks(spark, sf_dir))


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mojibake.repaired(docs, mojibake.train(docs))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_restored(spark, sf_dir).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1].isdigit() and callable(f)}


_CLEAN = "text"
for _p in (
    r"\{[^{}\n]*\}",
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"\b(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? +)?(?:\d{1,2}[ /])?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[ /]{1,2}(?:\d{1,2} \d\d:|\d{4}[ :])",
):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', ' ', 'g')"


def _shared_words(texts: str) -> str:
    """Common table expressions: f the distinct words of each row, n their number, p the pairs that share words."""
    return (
        f"WITH t AS ({texts}), w AS (SELECT DISTINCT tab, id, unnest(regexp_extract_all(lower({_CLEAN}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM t),"
        " f AS (SELECT * FROM w WHERE length(w) > 2 AND regexp_full_match(w, '\\p{L}+')), n AS (SELECT tab, id, count(*) AS n FROM f GROUP BY ALL),"
        " p AS (SELECT a.tab, a.id AS id_a, b.id AS id_b, count(*) AS c FROM f a JOIN f b ON a.tab = b.tab AND a.w = b.w AND a.id < b.id GROUP BY ALL),"
        " s AS (SELECT p.*, c / (x.n + y.n - c) AS similarity FROM p JOIN n x ON p.tab = x.tab AND id_a = x.id JOIN n y ON p.tab = y.tab AND id_b = y.id) "
    )


_FAILED = "SELECT DISTINCT 'analysis_log' AS tab, id, error_fingerprint AS text FROM analysis_log WHERE error_fingerprint IS NOT NULL"


def oracle_sql() -> dict[str, str]:
    """p3: all pairs over shared words; of the groups, equal word sets and the number of pairs. p6: any two rows of one failure are similar, so the next row of a cluster is the
    least later id that is."""
    asked = "SELECT DISTINCT 'analyze_request' AS tab, request_no AS id, log_text AS text FROM analyze_request WHERE log_text IS NOT NULL"
    return {
        "p3_found": _shared_words(f"{asked} UNION ALL {_FAILED}") + "SELECT tab AS record_table, id_a, id_b FROM s WHERE similarity >= 0.7 - 1e-9",
        "p3_groups": _shared_words(f"{asked} UNION ALL {_FAILED}")
        + ", g AS (SELECT tab, id, string_agg(w, ' ' ORDER BY w) AS words FROM f GROUP BY ALL), c AS (SELECT tab, id, min(id) OVER (PARTITION BY tab, words) AS class_id FROM g),"
        " l AS (SELECT tab, id_a AS id FROM s WHERE similarity >= 0.7 - 1e-9 UNION ALL SELECT tab, id_b FROM s WHERE similarity >= 0.7 - 1e-9), k AS (SELECT tab, id, count(*) AS n_links FROM l GROUP BY ALL)"
        " SELECT c.tab AS record_table, c.id, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN k ON c.tab = k.tab AND c.id = k.id",
        "p6_found": _shared_words(_FAILED) + "SELECT id_a, min(id_b) AS id_b FROM s WHERE similarity >= 0.317 GROUP BY id_a",
    }
