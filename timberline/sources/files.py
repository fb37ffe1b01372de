"""Text files of any size as lines with byte offsets.

A file is planned as byte ranges of SPLIT_BYTES; each task seeks to its range and yields the lines that begin in it, so one
file of terabytes is read by many tasks and no line is lost or doubled at a border. Offsets are exact bytes whatever the
line ends or broken UTF-8 sequences (which are replaced in the text only)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPLIT_BYTES = 64 << 20
READ_BYTES = 4 << 20
ROWS = 20_000


def _plain(uri: str) -> str:
    return uri if "://" in uri else "file://" + uri.removeprefix("file:")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, mtime of a file, folder or glob; reads no content."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "split", "n", "byte_offset", "line_length", "line"]
    for b in batches:
        for path, split, start, end, size in zip(*(c.to_pylist() for c in b.columns)):
            system, at = pafs.FileSystem.from_uri(_plain(path))
            with system.open_input_file(at) as f:
                # a line that began before the range belongs to the range before
                pos = start
                if start:
                    f.seek(start - 1)
                    rest, pos = b"", start - 1
                    while True:
                        more = f.read(READ_BYTES)
                        cut = more.find(b"\n")
                        if cut >= 0:
                            rest, pos = more[cut + 1 :], pos + cut + 1
                            break
                        pos += len(more)
                        if not more:
                            break
                else:
                    rest = b""
                out: list[list] = [[], [], [], []]
                n = 0
                buf = rest
                done = pos >= end
                while not done:
                    cut = buf.find(b"\n")
                    if cut < 0:
                        more = f.read(READ_BYTES)
                        if more:
                            buf += more
                            continue
                        if not buf:
                            break
                        raw, step = buf, len(buf)
                        done = True
                    else:
                        # all whole lines in the buffer at once
                        last = buf.rfind(b"\n")
                        for raw in buf[:last].split(b"\n"):
                            if pos >= end:
                                done = True
                                break
                            _add(out, n, pos, raw, len(raw) + 1)
                            n, pos = n + 1, pos + len(raw) + 1
                        buf = buf[last + 1 :]
                        if pos >= end:
                            done = True
                        if len(out[0]) >= ROWS:
                            yield _pack(path, split, out, names)
                            out = [[], [], [], []]
                        continue
                    if pos < end:
                        _add(out, n, pos, raw, step)
                        n, pos = n + 1, pos + step
                if out[0]:
                    yield _pack(path, split, out, names)


def _add(out, n, pos, raw, size):
    out[0].append(n)
    out[1].append(pos)
    out[2].append(size)
    out[3].append((raw[:-1] if raw.endswith(b"\r") else raw).decode("utf-8", "replace"))


def _pack(path, split, out, names):
    k = len(out[0])
    return pa.RecordBatch.from_arrays([pa.array([path] * k), pa.array([split] * k, pa.int32()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], names=names)


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, split, n (line in its split, from 0), byte_offset, line_length (with its line feed), line."""
    plan = list_files(spark, path).where("size > 0").select("path", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / split_bytes).cast("int"))).alias("split"), "size")
    start = F.col("split").cast("bigint") * split_bytes
    plan = plan.select("path", "split", start.alias("start"), F.least(start + split_bytes, F.col("size")).alias("end"), "size")
    return plan.repartition(F.col("path"), F.col("split")).mapInArrow(_lines, "path string, split int, n bigint, byte_offset bigint, line_length int, line string")


def numbered(lines: DataFrame) -> DataFrame:
    """Adds line_number from 1: the lines of earlier splits are counted in a table of one row per split."""
    per = lines.groupBy("path", "split").agg(F.count("*").alias("k"))
    w = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("path", "split", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("base"))
    return lines.join(base, ["path", "split"]).withColumn("line_number", (F.col("base") + F.col("n") + 1).cast("bigint")).drop("base", "n")


def read_ranges(requests: DataFrame) -> DataFrame:
    """Ordinal, text of byte ranges. requests: (ordinal, path, byte_offset, line_length). Byte-exact; a range
    beyond the file's end gives what there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, object] = {}
        for b in batches:
            text = []
            for path, off, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                f = opened.get(path)
                if f is None:
                    system, at = pafs.FileSystem.from_uri(_plain(path))
                    f = opened[path] = system.open_input_file(at)
                f.seek(off)
                text.append(f.read(n).rstrip(b"\r\n").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["ordinal", "text"])

    r = requests.select(F.col("ordinal").cast("bigint"), "path", F.col("byte_offset").cast("bigint"), F.col("line_length").cast("int"))
    at = F.floor(F.col("byte_offset") / SPLIT_BYTES)  # a file of any size is read by many tasks
    return r.repartition(F.col("path"), at).sortWithinPartitions("path", "byte_offset").mapInArrow(run, "ordinal bigint, text string")
