"""Line frames: (doc_id, pos, line), pos from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.session import table

#: A log view over `events`, the same text in Spark and DuckDB; one document per user. See FIXTURES.md.
LOG_LINES_SQL = """
WITH e AS (
  SELECT event_id, user_id, event_type,
         CAST(CAST(ts AS DATE) AS VARCHAR(20)) AS d,
         concat(lpad(CAST(hour(ts) AS VARCHAR(20)),2,'0'),':',lpad(CAST(minute(ts) AS VARCHAR(20)),2,'0'),':',lpad(CAST(second(ts) AS VARCHAR(20)),2,'0')) AS t,
         event_id % 10 AS f, event_id % 24 AS k,
         CAST(event_id % 50 + 1 AS VARCHAR(20)) AS n, CAST(event_id % 200 AS VARCHAR(20)) AS o, CAST(user_id AS VARCHAR(20)) AS u
  FROM EVENTS_TABLE)
SELECT user_id AS doc_id,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
       concat(
         CASE WHEN k = 21 OR f = 9 THEN '' WHEN f = 8 THEN concat(replace(d,'-','/'),' ',t,' ')
              WHEN f = 7 THEN concat(d,' ',t,' ') ELSE concat(d,'T',t,'Z ') END,
         CASE WHEN k IN (15,16,17,21,22) THEN '' WHEN event_type = 'error' THEN 'ERROR ' WHEN event_type = 'purchase' THEN 'WARN '
              WHEN event_type = 'click' THEN 'DEBUG ' WHEN event_type = 'signup' THEN 'FATAL ' ELSE 'INFO ' END,
         CASE k WHEN 0 THEN 'npm ERR! code ERESOLVE'
              WHEN 1 THEN 'npm ERR! react@18.2.0 requires react-dom@17.0.2'
              WHEN 2 THEN 'Could not find a version that satisfies numpy==1.99.0'
              WHEN 3 THEN 'ImportError: No module named requests in /app/main.py'
              WHEN 4 THEN 'TypeError: expected str'
              WHEN 5 THEN 'Connection refused: ECONNREFUSED 10.0.1.5:9090'
              WHEN 6 THEN 'Permission denied: /var/run/docker.sock'
              WHEN 7 THEN concat('request took ',n,'s')
              WHEN 8 THEN concat('step finished in 2m ',n,'s')
              WHEN 9 THEN 'slow 250ms query'
              WHEN 10 THEN 'rate limit hit, too many requests'
              WHEN 11 THEN 'memory usage at 97%'
              WHEN 12 THEN '12 errors in 5s'
              WHEN 13 THEN 'repeated 7 times'
              WHEN 14 THEN 'process killed by SIGKILL'
              WHEN 15 THEN 'FAILURES'
              WHEN 16 THEN concat('Step ',n,'/50 : RUN make')
              WHEN 17 THEN '##[error]Process completed with exit code 1.'
              WHEN 18 THEN concat('contact ops+',u,'@example.com from 192.168.1.',o)
              WHEN 19 THEN 'AssertionError: assert 500 == 200'
              WHEN 20 THEN concat('pid=123',o,' addr 0x7fff5fbff8ac id 550e8400-e29b-41d4-a716-446655440000')
              WHEN 21 THEN '  File "/srv/app/utils.py", line 42, in helper'
              WHEN 22 THEN 'information only'
              ELSE 'warning: deprecated flag --legacy' END) AS line
FROM e
"""
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOG_LINES_SQL.replace("EVENTS_TABLE", "{events}"), events=table(spark, sf_dir, "events"))


def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the stored index; repeated deliveries once."""
    t = table(spark, sf_dir, "line_index").dropDuplicates(["file_id", "line_number"])
    return t.select(F.col("file_id").alias("doc_id"), (F.col("line_number") - 1).cast("bigint").alias("pos"), F.col("message_preview").alias("line"))


def split_lines(text: Column) -> Column:
    """All line breaks of universal newlines; a closing break opens no further line, an empty text has none."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def from_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line of each text; a narrow generate, no shuffle."""
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))


def from_path(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as documents: doc_id is the path. Bytes are read as UTF-8 with replacement."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.decode("content", F.lit("UTF-8")).alias("text"))
    return from_text(raw, "path", "text")


def tail_records(tsv: DataFrame) -> DataFrame:
    """Lines path TAB offset TAB text; fewer fields are dropped, a bad offset is -1."""
    p = F.split("value", "\t", 3)
    return tsv.select(p.alias("p")).where(F.size("p") == 3).select(F.col("p")[0].alias("path"), F.coalesce(F.col("p")[1].try_cast("bigint"), F.lit(-1)).alias("offset"), F.col("p")[2].alias("text"))
