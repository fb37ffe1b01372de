"""Line indexes as Parquet tables with a manifest: build, validate, open, list, delete, query.

An index is a folder: lines/ (one row per line, zstd, sorted by line number within files, so that predicates on line number
and time skip row groups) and manifest/ (one row: source, size, mtime, fingerprint, version, totals)."""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import line_columns as L
from timberline.sources.files import _plain, numbered, read_lines

VERSION = "1"
HEAD_TAIL = 4096
LINES = "path string, line_number bigint, byte_offset bigint, line_length int, timestamp_us bigint, level string, message_preview string"
MANIFEST = "source_file string, source_size bigint, mtime timestamp, fingerprint string, parser_version string, total_lines bigint, stamped bigint, min_us bigint, max_us bigint, levels map<string,bigint>, created_at timestamp"


def _fs(path: str):
    return pafs.FileSystem.from_uri(_plain(path))


def fingerprint(path: str) -> str:
    """SHA-256 of the first and last HEAD_TAIL bytes, of all up to twice that."""
    system, at = _fs(path)
    size = system.get_file_info(at).size
    with system.open_input_file(at) as f:
        if size <= 2 * HEAD_TAIL:
            return hashlib.sha256(f.read()).hexdigest()
        head = f.read(HEAD_TAIL)
        f.seek(size - HEAD_TAIL)
        return hashlib.sha256(head + f.read()).hexdigest()


def index_path(source: str) -> str:
    return source.rstrip("/") + ".idx"


def build(spark: SparkSession, source: str, target: str | None = None) -> str:
    """Writes the index of one file and its manifest. Statistics come from the written lines."""
    target = target or index_path(source)
    system, at = _fs(source)
    info = system.get_file_info(at)
    lines = numbered(read_lines(spark, source)).select(
        "path", "line_number", "byte_offset", "line_length", L.stamp_us(F.col("line")).alias("timestamp_us"), L.level(F.col("line")).alias("level"), F.substring(L.strip(F.col("line")), 1, 200).alias("message_preview")
    )
    lines.sortWithinPartitions("line_number").write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/lines")
    back = load(spark, target)
    per = back.groupBy("level").agg(F.count("*").alias("n"), F.count("timestamp_us").alias("stamped"), F.min("timestamp_us").alias("lo"), F.max("timestamp_us").alias("hi"))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_lines"), F.coalesce(F.sum("stamped"), F.lit(0)).alias("stamped"), F.min("lo").alias("min_us"), F.max("hi").alias("max_us"), F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("levels"))
    stat = one.select(
        F.lit(source).alias("source_file"), F.lit(info.size).cast("bigint").alias("source_size"), F.lit(info.mtime).cast("timestamp").alias("mtime"), F.lit(fingerprint(source)).alias("fingerprint"),
        F.lit(VERSION).alias("parser_version"), "total_lines", "stamped", "min_us", "max_us", "levels", F.lit(datetime.now(timezone.utc)).cast("timestamp").alias("created_at"),
    )
    stat.coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest")
    return target


def load(spark: SparkSession, target: str) -> DataFrame:
    """S08."""
    return spark.read.schema(LINES).parquet(f"{target}/lines")


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """No line is read."""
    return spark.read.schema(MANIFEST).parquet(f"{target}/manifest")


def validate(spark: SparkSession, source: str, target: str | None = None) -> tuple[bool, str]:
    """(valid, first reason against): missing, unreadable, version, size, mtime, fingerprint."""
    target = target or index_path(source)
    system, at = _fs(f"{target}/manifest")
    if system.get_file_info(at).type == pafs.FileType.NotFound:
        return False, "missing"
    try:
        m = manifest(spark, target).first()
    except Exception:
        return False, "unreadable"
    if m is None:
        return False, "unreadable"
    src, at = _fs(source)
    info = src.get_file_info(at)
    if m["parser_version"] != VERSION:
        return False, "version"
    if m["source_size"] != info.size:
        return False, "size"
    if abs(m["mtime"].timestamp() - info.mtime.timestamp()) > 0.001 and abs(m["mtime"].replace(tzinfo=timezone.utc).timestamp() - info.mtime.timestamp()) > 0.001:
        return False, "mtime"
    return (True, "") if m["fingerprint"] == fingerprint(source) else (False, "fingerprint")


def open_log(spark: SparkSession, source: str, force: bool = False, target: str | None = None) -> tuple[str, DataFrame]:
    """(hit, built or rebuilt, index)."""
    target = target or index_path(source)
    ok, why = validate(spark, source, target)
    if ok and not force:
        return "hit", load(spark, target)
    build(spark, source, target)
    return ("built" if why == "missing" else "rebuilt"), load(spark, target)


def list_indices(spark: SparkSession, folder: str) -> list[dict]:
    """Manifests under a folder with their validity."""
    system, at = _fs(folder)
    out = []
    for f in system.get_file_info(pafs.FileSelector(at)):
        if f.type == pafs.FileType.Directory and f.base_name.endswith(".idx"):
            source = f"{folder.rstrip('/')}/{f.base_name.removesuffix('.idx')}"
            ok, why = validate(spark, source, f"{folder.rstrip('/')}/{f.base_name}")
            out.append({"source": source, "valid": ok, "reason": why})
    return sorted(out, key=lambda x: x["source"])


def delete(target: str) -> bool:
    """K02."""
    system, at = _fs(target)
    if system.get_file_info(at).type != pafs.FileType.Directory:
        return False
    system.delete_dir(at)
    return True


def line_range(index: DataFrame, first: int, last: int, most: int = 1000) -> DataFrame:
    """S06."""
    return index.where(F.col("line_number").between(first, last)).orderBy("line_number").limit(most)
