"""Entries of log texts and of line indexes: mined header templates, corrected levels, one UTC instant per stamp.

Two input forms are served. *Texts* hold all lines of a record in one string. *Line tables* hold one line per row, keyed
by (file_id, line_number); a file may hold any share of the rows, so its rows are spread over blocks of BLOCK lines and
no task ever holds a whole file. Rows without a key take no part."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.functions.stamps import decode, join_parts, order_cost, orders_of, part, readings
from timberline.functions.templates import Miner, Templates
from timberline.session import cut, table

BLOCK = 32_768
KEYED = "file_id is not null and line_number is not null"
MINED = "kind string, what string, n bigint, texts array<string>"


def text_lines(text: str) -> list[str]:
    """Lines end at a line feed; a carriage return before it is no content; a final line feed opens no further line."""
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


def _mine(batches: Iterator[pa.RecordBatch], keys_only: bool = False) -> Iterator[pa.RecordBatch]:
    m = Miner(keys_only=keys_only)
    for b in batches:
        for text in b.column(0).to_pylist():
            if text:
                if "\n" in text:
                    for line in text_lines(text):
                        m.add(line)
                else:
                    m.add(text)
    rows = m.rows()
    types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["kind", "what", "n", "texts"])


def mine_templates(*columns: DataFrame, keys_only: bool = False) -> Templates:
    """Templates of all texts in the first columns of the given frames. Each task clusters its entries by shape; Spark adds up
    the clusters of all tasks and finds their constant slots, so the result is the same however the rows are parted. The driver
    gets one row per distinct shape and per key whose values are levels, stamps or names; other keys are message keys. Null
    and empty texts count for nothing; with no entry at all the templates are empty and a line opens an entry only by a stamp of
    its own. keys_only: only the keys of structured records, which is all that stamps need."""
    rows = reduce(DataFrame.unionAll, [c.mapInArrow(partial(_mine, keys_only=keys_only), MINED) for c in columns])
    rows = cut(rows, "mined")
    shape = rows.where("kind not like '@%'")
    slot = shape.select("kind", "what", F.posexplode("texts").alias("i", "text")).groupBy("kind", "what", "i")
    slot = slot.agg(F.when((F.min("text") == F.max("text")) & (F.count("text") == F.count("*")), F.min("text")).alias("text"))
    texts = slot.groupBy("kind", "what").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("texts"))
    shapes = shape.groupBy("kind", "what").agg(F.sum("n").alias("n")).join(texts, ["kind", "what"], "left")
    key, typ = F.get_json_object("what", "$[0]"), F.get_json_object("what", "$[1]")
    keys = rows.where("kind like '@%'").groupBy("kind", "what").agg(F.sum("n").alias("n"))
    per = Window.partitionBy("kind", key)
    keys = keys.withColumn("share", F.max(F.when(typ.isin("L", "T", "W"), F.col("n"))).over(per) / F.sum("n").over(per)).where("share > 0.9")
    found = shapes.select("kind", "what", "n", F.coalesce("texts", F.array().cast("array<string>"))).unionAll(keys.select("kind", "what", "n", F.array().cast("array<string>")))
    return Templates([tuple(r) for r in found.collect()])


# -- texts ------------------------------------------------------------------------------------------------------------


def text_entries(texts: DataFrame, templates: Templates) -> DataFrame:
    """One row per entry of each text: key, line_no, n_lines, level, component.

    texts: (key string, text string, ...). Null or empty texts and texts without an entry give no row; lines before the
    first entry belong to none. Repeated rows of a key give its entries once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = templates.parse
        for b in batches:
            key, no, n, lvl, comp = [], [], [], [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                lines = text_lines(text)
                start = len(no)
                for i, line in enumerate(lines, 1):
                    if line and (p := parse(line)) is not None:
                        key.append(k)
                        no.append(i)
                        lvl.append(p[2])
                        comp.append(p[3])
                ends = [*no[start + 1 :], len(lines) + 1] if len(no) > start else []
                n.extend(e - s for s, e in zip(no[start:], ends))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(no, pa.int32()), pa.array(n, pa.int32()), pa.array(lvl, pa.string()), pa.array(comp, pa.string())], names=["key", "line_no", "n_lines", "level", "component"])

    return texts.where("key is not null").select("key", "text").mapInArrow(run, "key string, line_no int, n_lines int, level string, component string").dropDuplicates(["key", "line_no"])


def text_instants(texts: DataFrame, templates: Templates) -> DataFrame:
    """One row per entry with a stamp of its own: key, line_no, utc_us. texts: (key, text, time_zone, seen_us).

    All valid readings of each stamp are listed, and the order of numeric dates and one path are chosen per record by Viterbi. A stamp with
    no valid reading (30 February, hour 25) gives no row. A null time_zone is UTC; without seen_us a stamp that lacks the
    year gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamp_of = templates.stamp_of
        for b in batches:
            key, no, us = [], [], []
            for k, text, tz, seen in zip(*(b.column(i).to_pylist() for i in range(4))):
                if not text:
                    continue
                at, seq = [], []
                for i, line in enumerate(text_lines(text), 1):
                    if line and (p := stamp_of(line)) is not None and p[0] and (r := readings(p[0], p[1], tz, seen)):
                        at.append(i)
                        seq.append(r)
                for i, t in zip(at, decode(seq) if seq else ()):
                    key.append(k)
                    no.append(i)
                    us.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(no, pa.int32()), pa.array(us, pa.int64())], names=["key", "line_no", "utc_us"])

    return texts.where("key is not null").select("key", "text", "time_zone", "seen_us").mapInArrow(run, "key string, line_no int, utc_us bigint").dropDuplicates(["key", "line_no"])


# -- line tables ------------------------------------------------------------------------------------------------------


def _block(c: str = "line_number"):
    return F.floor((F.col(c) - 1) / BLOCK).cast("int")


def line_heads(lines: DataFrame, templates: Templates) -> DataFrame:
    """The lines that open an entry: file_id, block, line_number, old_us, old_level, fmt, stamp, level, component.
    lines: (file_id, line_number, timestamp_us, level, message_preview, ...). Map-only; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = templates.parse
        for b in batches:
            keep, fmt, stamp, lvl, comp = [], [], [], [], []
            for i, line in enumerate(b.column(4).to_pylist()):
                if line and (p := parse(line)) is not None:
                    keep.append(i)
                    fmt.append(p[0])
                    stamp.append(p[1])
                    lvl.append(p[2])
                    comp.append(p[3])
            if keep:
                t = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*(t.column(i) for i in range(4)), pa.array(fmt, pa.string()), pa.array(stamp, pa.string()), pa.array(lvl, pa.string()), pa.array(comp, pa.string())], names=["file_id", "line_number", "old_us", "old_level", "fmt", "stamp", "level", "component"])

    out = lines.where(KEYED).select("file_id", "line_number", "timestamp_us", "level", "message_preview").mapInArrow(
        run, "file_id bigint, line_number int, old_us bigint, old_level string, fmt string, stamp string, level string, component string"
    )
    return out.withColumn("block", _block())


def _line_stamps(lines: DataFrame, templates: Templates) -> DataFrame:
    """The lines that open an entry with a stamp: file_id, block, line_number, old_us, fmt, stamp. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamp_of = templates.stamp_of
        for b in batches:
            found = [(i, *p) for i, line in enumerate(b.column(3).to_pylist()) if line and (p := stamp_of(line)) is not None and p[0]]
            if found:
                keep, fmt, stamp = zip(*found)
                t = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*(t.column(i) for i in range(3)), pa.array(fmt), pa.array(stamp)], names=["file_id", "line_number", "old_us", "fmt", "stamp"])

    out = lines.where(KEYED).select("file_id", "line_number", "timestamp_us", "message_preview")
    return out.mapInArrow(run, "file_id bigint, line_number int, old_us bigint, fmt string, stamp string").withColumn("block", _block())


def shuffles(df: DataFrame) -> int:
    """Partitions of a shuffle before Python: named, so that they are not merged by size while work per row is high."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def file_ends(lines: DataFrame) -> DataFrame:
    """file_id, last_line; reads two columns."""
    return lines.where(KEYED).groupBy("file_id").agg(F.max("line_number").alias("last_line"))


def line_entries(lines: DataFrame, templates: Templates) -> DataFrame:
    """One row per entry: file_id, line_number, n_lines, level, component, old_level.

    The end of an entry is the next entry's line within the block, else the first entry of a later block, else the end of
    the file. The heads are written once and read for both steps; the table of block firsts has one row per block."""
    heads = cut(line_heads(lines, templates).drop("old_us", "fmt", "stamp"), "heads")
    per_file = Window.partitionBy("file_id").orderBy("block")
    firsts = heads.groupBy("file_id", "block").agg(F.min("line_number").alias("first")).join(file_ends(lines), "file_id")
    nexts = firsts.select("file_id", "block", F.coalesce(F.lead("first").over(per_file), F.col("last_line") + 1).alias("after"))
    per_block = Window.partitionBy("file_id", "block").orderBy("line_number")
    once = heads.repartition("file_id", "block").dropDuplicates(["file_id", "block", "line_number"])
    return (
        once.withColumn("next", F.lead("line_number").over(per_block))
        .join(nexts, ["file_id", "block"])
        .select("file_id", "line_number", (F.coalesce("next", "after") - F.col("line_number")).cast("int").alias("n_lines"), "level", "component", "old_level")
    )


def line_instants(lines: DataFrame, files: DataFrame, zones: DataFrame, templates: Templates) -> DataFrame:
    """One row per entry with a stamp: file_id, line_number, utc_us, old_us. files: (file_id, seen_us), one row per
    file; zones: (source_file, time_zone).

    The readings are decoded in line order per (file, block), under each order of numeric dates that the block leaves open.
    What depends on other blocks, the stamps before the first and after the last one with a single open reading and the orders
    themselves, is decided per file from one row a block, so the result does not depend on the size of blocks."""
    heads = _line_stamps(lines, templates)
    spread = (
        lines.where(KEYED)
        .groupBy("file_id")
        .agg(F.max("line_number").alias("last_line"), F.max("source_file").alias("source_file"))
        .join(files, "file_id", "left")
        .join(zones, "source_file", "left")
        .select("file_id", F.explode(F.sequence(F.lit(0), _block("last_line"))).alias("block"), "seen_us", "time_zone")
    )

    blocks = (
        heads.join(spread, ["file_id", "block"])
        .repartition(shuffles(lines), "file_id", "block")
        .sortWithinPartitions("file_id", "block", "line_number")
        .select("file_id", "block", "line_number", "old_us", "fmt", "stamp", "seen_us", "time_zone")
        .mapInArrow(_decode_blocks, DECODED)
    )
    blocks = cut(blocks, "instants")
    edges = blocks.where("edge is not null").select("file_id", "block", "edge").groupBy("file_id").applyInPandas(_decode_files, "file_id bigint, line_number int, old_us bigint, utc_us bigint, orders int")
    edges = cut(edges, "edges")
    plain = blocks.where("size(times) = 1").select("file_id", "line_number", F.col("times")[0].alias("utc_us"), "old_us")
    swapped = edges.where("orders > 0").select("file_id", "orders")
    open_ = blocks.where("size(times) > 1").join(swapped, "file_id", "left").select("file_id", "line_number", F.col("times")[F.coalesce("orders", F.lit(0))].alias("utc_us"), "old_us")
    return plain.unionAll(open_).unionAll(edges.where("line_number is not null").select("file_id", "line_number", "utc_us", "old_us"))


DECODED = "file_id bigint, block int, line_number int, old_us bigint, times array<bigint>, edge string"


def _decode_block(f: int, k: int, nos: list[int], olds: list[int | None], seq: list) -> list[tuple]:
    """DECODED rows: the instants that are settled in the block (one, or one per order), and its edge row."""
    tried = orders_of(seq, shown=True)
    parts = {o: part(seq, o) for o in tried}
    out = []
    for i, no in enumerate(nos):
        times = [parts[o].times[i] for o in tried]
        if None in times:  # settled per file under all orders
            continue
        if len(set(times)) == 1:
            times = times[:1]
        elif len(tried) < 4:  # an order that does not matter here
            times = [parts[o & tried[-1]].times[i] for o in range(4)]
        out.append((f, k, no, olds[i], times, None))
    loose = {i for p in parts.values() for i, t in enumerate(p.times) if t is None}
    edge = {
        "orders": tried,
        "parts": [(p.cost, p.head, p.tail) for p in parts.values()],
        # stamps that are settled under some orders only: their times there
        "stamps": {i: (nos[i], olds[i], [p.times[i] for p in parts.values()]) for i in loose},
    }
    return [*out, (f, k, None, None, None, json.dumps(edge))]


def _decode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string())
    names = [x.split()[0] for x in DECODED.split(", ")]
    group, nos, olds, seq, last, rows = None, [], [], [], None, []
    for b in batches:
        for f, k, n, old, fmt, stamp, seen, tz in zip(*(c.to_pylist() for c in b.columns)):
            if (f, k) != group:
                if nos:
                    rows += _decode_block(*group, nos, olds, seq)
                group, nos, olds, seq, last = (f, k), [], [], [], None
            if n == last:
                continue  # a repeated delivery
            last = n
            if r := readings(fmt, stamp, tz, seen):
                nos.append(n)
                olds.append(old)
                seq.append(r)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            rows = []
    if nos:
        rows = _decode_block(*group, nos, olds, seq)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _decode_files(key, pdf):
    """Of one file: a row with its orders where they are not the rules', and a row per stamp that its block left open."""
    import pandas as pd

    blocks = [json.loads(e) for e in pdf.sort_values("block")["edge"]]
    bits = reduce(int.__or__, (b["orders"][-1] for b in blocks))
    best = None
    for o in (x for x in range(4) if x & bits == x):
        mine = [b["parts"][b["orders"].index(o & b["orders"][-1])] for b in blocks]
        cost, times = join_parts([(c, [r for _, r in head], [r for _, r in tail]) for c, head, tail in mine])
        if best is None or cost + order_cost(o) < best[0]:
            best = cost + order_cost(o), times, o, mine
    _, times, o, mine = best
    out, queue = [], iter(times)
    for b, (cost, head, tail) in zip(blocks, mine):
        free = {i: next(queue) for i, _ in (head if cost is None else head[:-1])} | {i: next(queue) for i, _ in tail[1:]}
        at = b["orders"].index(o & b["orders"][-1])
        for i, (no, old, settled) in b["stamps"].items():
            out.append((int(key[0]), no, old, free.get(int(i), settled[at]), 0))
    if o:
        out.append((int(key[0]), None, None, None, o))
    return pd.DataFrame({c: pd.array([r[k] for r in out], dtype="Int64") for k, c in enumerate(("file_id", "line_number", "old_us", "utc_us", "orders"))})


# -- the tables of the project ----------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "log_record"), table(spark, sf_dir, "line_index"), table(spark, sf_dir, "log_source")


def project_templates(records: DataFrame, lines: DataFrame, **options: bool) -> Templates:
    return mine_templates(records.select("content"), lines.select("message_preview"), **options)


def _us(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def found_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found: the instant of each stamped entry of log_record, and of each of line_index that differs from the stored one."""
    records, lines, sources = _records(spark, sf_dir)
    t = project_templates(records, lines, keys_only=True)
    zones = sources.select("source_file", "time_zone").dropDuplicates(["source_file"])
    texts = (
        records.select(F.col("id").alias("key"), F.col("content").alias("text"), _us("received_at").alias("seen_us"), F.col("metadata")["source_file"].alias("source_file"))
        .where("text is not null")
        .join(zones, "source_file", "left")
    )
    a = text_instants(texts, t).select(F.lit("log_record").alias("record_table"), F.col("key").alias("record_key"), "line_no", "utc_us")
    files = table(spark, sf_dir, "index_manifest").groupBy("file_id").agg(F.max(_us("mtime")).alias("seen_us"))
    b = (
        line_instants(lines, files, zones, t)
        .where("coalesce(old_us, 0) <> utc_us")
        .select(F.lit("line_index").alias("record_table"), F.col("file_id").cast("string").alias("record_key"), F.col("line_number").alias("line_no"), "utc_us")
    )
    return a.unionAll(b)


def found_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: each entry of log_record, and each of line_index whose level differs from the stored one."""
    records, lines, _ = _records(spark, sf_dir)
    t = project_templates(records, lines)
    cols = ["record_table", "record_key", "line_no", "n_lines", "level", "component"]
    a = text_entries(records.select(F.col("id").alias("key"), F.col("content").alias("text")), t)
    a = a.select(F.lit("log_record").alias("record_table"), F.col("key").alias("record_key"), *cols[2:])
    stored = F.coalesce(F.nullif(F.col("old_level"), F.lit("UNKNOWN")), F.lit(""))
    b = line_entries(lines, t).where(stored != F.col("level"))
    b = b.select(F.lit("line_index").alias("record_table"), F.col("file_id").cast("string").alias("record_key"), F.col("line_number").alias("line_no"), *cols[3:])
    return a.unionAll(b)
