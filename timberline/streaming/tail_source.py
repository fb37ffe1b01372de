"""A streaming source that follows growing files across rotation, truncation and replacement.

The offset is {path: {dev, ino, off}} and lives in the query's checkpoint. Only whole lines are delivered, of any length; the
bytes after the last line feed wait. The driver only looks for the last line feed of each file; new bytes are read by tasks, SPLIT_BYTES
each. Resume rule: the same path and identity with an offset not beyond the size goes on, else from 0."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, byte_offset bigint, text string"
STEP = 1 << 20
SPLIT_BYTES = 64 << 20


def resume(entry: dict | None, dev: int, ino: int, size: int, start: int) -> int:
    """Where to go on. start: offset of files never seen, -1 for their end."""
    if entry is None:
        return size if start < 0 else min(start, size)
    if (entry["dev"], entry["ino"]) == (dev, ino) and entry["off"] <= size:
        return entry["off"]
    return 0


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, opens: bool = True):
        self.path, self.start, self.end, self.opens = path, start, end, opens


def lines_of(path: str, start: int, end: int, opens: bool = True) -> Iterator[tuple[str, int, str]]:
    """The whole lines that begin in [start, end). opens: a line begins at start."""
    with open(path, "rb") as f:
        pos = start
        if not opens:
            f.seek(start - 1)
            pos = start - 1 + len(f.readline())
        f.seek(pos)
        while pos < end:
            raw = f.readline()
            if not raw.endswith(b"\n"):
                return
            yield path, pos, raw.rstrip(b"\r\n").decode("utf-8", "replace")
            pos += len(raw)


def whole_lines(path: str, size: int) -> int:
    """The offset after the last line feed, 0 if there is none; reads backwards from the end."""
    with open(path, "rb") as f:
        hi = size
        while hi > 0:
            lo = max(0, hi - STEP)
            f.seek(lo)
            at = f.read(hi - lo).rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            hi = lo
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.patterns = options["path"].split(",")
        self.first = int(options.get("startoffset", "0"))

    def _files(self) -> list[str]:
        return sorted({p for g in self.patterns for p in glob.glob(g) if os.path.isfile(p)})

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = {}
        for p in self._files():
            try:
                st = os.stat(p)
                now[p] = {"dev": st.st_dev, "ino": st.st_ino, "off": whole_lines(p, st.st_size)}
            except FileNotFoundError:  # gone between listing and reading; the next batch sees its successor
                continue
        return now

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for p, e in end.items():
            # only files that are there at the very start may be followed from their end
            a = resume(start.get(p), e["dev"], e["ino"], e["off"], 0 if start else self.first)
            if os.path.exists(p):
                out += [Range(p, k, min(k + SPLIT_BYTES, e["off"]), k == a) for k in range(a, e["off"], SPLIT_BYTES)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        if partition.path:
            yield from lines_of(partition.path, partition.start, partition.end, partition.opens)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """spark.dataSource.register(TailSource); spark.readStream.format("tail").option("path", "/a/*.log,/b.log")"""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)
