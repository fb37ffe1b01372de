"""Runs of the same or nearly the same event, by regex over symbol strings.

Each entry's message becomes a canonical event: its words, with numbers, ids, digests, addresses and durations masked. Per
file and block of lines the events are mapped to code points, events that follow one another and differ in one word
sharing one, and the string of code points is searched with a backreference, (.)\\1+. Spans map back to entries; within a
span the exact rule, at most one word slot that differs over the whole stretch, cuts it into longest stretches.

A file of any size is cut into blocks of entries.BLOCK lines. A stretch over a block's edge ends in each block either with the
events that equal the edge's own or with those that differ from it in one slot, so the stretches at the two edges, with the
part that equals the edge, say all that other blocks can need. From these rows, two a block, stretches over edges are found
by the same rule as inside a block: the result does not depend on the size of blocks. Entries without words form no run; null
previews and lines that open no entry extend the entry before them. Repeated rows count once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.templates import Templates
from timberline.operators.entries import KEYED, _block, file_ends, shuffles
from timberline.session import cut

LEAST = 3
_VALUE = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|0x[0-9a-fA-F]+"
    r"|\b(?=[a-f]*\d)[0-9a-f]{7,64}\b"
    r"|[+-]?\d+(?:[.:,-]\d+)*(?:(?:ms|us|ns|[smhd%]|[kKMG]i?B)(?![A-Za-z]))?"
)
_REPEAT = re.compile(r"(.)\1+", re.S)
EDGE = "file_id bigint, block int, kind int, first_line int, last_entry int, end_line int, n int, words string, slot int, head_n int, head_last int, head_end int, tail_n int, tail_first int, tail_words string"
#: Kinds of rows: a stretch inside a block, one that opens it, closes it, or is all of it.
INNER, OPENS, CLOSES, WHOLE = 0, 1, 2, 3


def canonical(message: str) -> str:
    """Words parted by one blank, values as '#'."""
    return " ".join(_VALUE.sub("#", message).split())


def slot_of(a: list[str], b: list[str], slot: int) -> int:
    """The one slot in which a run with template a and slot (-1: none yet) and event b differ; -2 if there is no such. Events
    without words go with nothing."""
    if len(a) != len(b) or a == [""] or b == [""]:
        return -2
    if a == b:
        return slot
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y and i != slot:
            if slot >= 0:
                return -2
            slot = i
    return slot


def meet(a: list[str], slot: int, item: tuple[list[str], int]) -> int:
    """slot_of for an item: events that equal its words but for its slot (-1: equal them)."""
    words, own = item
    if own >= 0:
        if slot not in (-1, own):
            return -2
        slot = own
    return slot_of(a, words, slot)


def longest(items: list[tuple[list[str], int]]) -> list[tuple[int, int, int]]:
    """(first, last, slot) of the longest stretches of items that are equal but for one slot, ascending; they may share items.
    Where an item ends a stretch, the next one opens at the earliest item that goes with it, found by stepping back."""
    out = []
    i, n = 0, len(items)
    while i < n:
        a, slot = items[i]
        j = i + 1
        while j < n and (s := meet(a, slot, items[j])) != -2:
            slot, j = s, j + 1
        out.append((i, j - 1, slot))
        if j >= n:
            break
        k, (a, s) = j, items[j]
        while k - 1 > i and (t := meet(a, s, items[k - 1])) != -2:
            k, s = k - 1, t
        i = k
    return out


def stretches(events: list[list[str]]) -> list[tuple[int, int, int]]:
    """(first, last, slot) of longest stretches of events equal but for one slot. Equal neighbours are taken as one item."""
    starts = [i for i, e in enumerate(events) if not i or e != events[i - 1]]
    ends = [*(x - 1 for x in starts[1:]), len(events) - 1]
    return [(starts[a], ends[b], s) for a, b, s in longest([(events[i], -1) for i in starts])]


def spans(keys: list[str]) -> list[tuple[int, int]]:
    """[start, end) of proposed repetitions: events to code points, backreference regex over the string."""
    code: dict[str, int] = {}
    chars, prev, prev_words, cp = [], None, None, 0
    for k in keys:
        words = k.split(" ")
        if k == prev:
            pass
        elif prev_words is not None and slot_of(prev_words, words, -1) != -2:
            code[k] = cp
        else:
            cp = code.setdefault(k, 0x10000 + len(code) % 0xF0000)
        chars.append(chr(cp))
        prev, prev_words = k, words
    return [m.span() for m in _REPEAT.finditer("".join(chars))]


def line_events(lines: DataFrame, templates: Templates) -> DataFrame:
    """file_id, line_number, event of the lines that open an entry. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = templates.parse
        for b in batches:
            keep, ev = [], []
            for i, line in enumerate(b.column(2).to_pylist()):
                if line and (p := parse(line)) is not None:
                    keep.append(i)
                    ev.append(canonical(line[p[4] :] if p[4] >= 0 else templates.message_of(line)))
            if keep:
                t = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(ev, pa.string())], names=["file_id", "line_number", "event"])

    return lines.where(KEYED).select("file_id", "line_number", "message_preview").mapInArrow(run, "file_id bigint, line_number int, event string").withColumn("block", _block())


def _edge(words: list[list[str]]) -> tuple[int, int, int]:
    """Of the stretch that opens with the first event: its last event, the last that equals the first one, its slot."""
    slot, equal, j = -1, 0, 1
    while j < len(words) and (s := slot_of(words[0], words[j], slot)) != -2:
        if s == -1:
            equal = j
        slot, j = s, j + 1
    return j - 1, equal, slot


def _block_runs(f: int, k: int, nos: list[int], keys: list[str]) -> list[tuple]:
    """EDGE rows of a block: runs inside it and the stretches at its edges."""
    n = len(nos)
    words = [x.split(" ") for x in keys]
    end = [x - 1 for x in nos[1:]] + [None]
    out = []
    for a, b in spans(keys):
        for x, y, s in stretches(words[a:b]):
            x, y = a + x, a + y
            if x > 0 and y < n - 1 and y - x + 1 >= LEAST and words[x] != [""]:
                out.append((f, k, INNER, nos[x], nos[y], end[y], y - x + 1, keys[x], s, *[None] * 6))
    b1, b0, slot = _edge(words)
    if b1 == n - 1:
        a1, a0, _ = _edge(words[::-1])
        out.append((f, k, WHOLE, nos[0], nos[-1], None, n, keys[0], slot, b0 + 1, nos[b0], end[b0], a0 + 1, nos[n - 1 - a0], keys[-1]))
        return out
    out.append((f, k, OPENS, nos[0], nos[b1], end[b1], b1 + 1, keys[0], slot, b0 + 1, nos[b0], end[b0], None, None, None))
    a1, a0, slot = _edge(words[::-1])
    out.append((f, k, CLOSES, nos[n - 1 - a1], nos[-1], None, a1 + 1, keys[-1], slot, None, None, None, a0 + 1, nos[n - 1 - a0], keys[-1]))
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in EDGE.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in EDGE.split(", ")]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    group, nos, keys = None, [], []
    for b in batches:
        rows = []
        for f, k, no, ev in zip(*(c.to_pylist() for c in b.columns)):
            if (f, k) != group:
                if nos:
                    rows += _block_runs(*group, nos, keys)
                group, nos, keys = (f, k), [], []
            if nos and nos[-1] == no:
                continue
            nos.append(no)
            keys.append(ev)
        if rows:
            yield pack(rows)
    if nos:
        yield pack(_block_runs(*group, nos, keys))


def _items(r: dict, end: int) -> list[tuple]:
    """(words, slot, first line, last entry, last line, n) of the parts of an edge row at which a stretch may begin or end."""
    words, slot, n = r["words"].split(" "), r["slot"], r["n"]
    whole = (words, slot, r["first_line"], r["last_entry"], end, n)
    if slot < 0:
        return [whole]
    out = []
    if r["kind"] != CLOSES:
        out.append((words, -1, r["first_line"], r["head_last"], r["head_end"], r["head_n"]))
    between = n - (r["head_n"] or 0) - (r["tail_n"] or 0)
    if between:
        out.append((words, slot, r["first_line"], r["last_entry"], end, between))
    if r["kind"] != OPENS:
        out.append((r["tail_words"].split(" "), -1, r["tail_first"], r["last_entry"], end, r["tail_n"]))
    return out


def _stitch(key, pdf):
    """The stretches at the edges of one file's blocks; two rows a block at most."""
    import pandas as pd

    rows = pdf.sort_values(["block", "kind"]).astype(object).where(pdf.notna(), None).to_dict("records")
    first_of: dict[int, int] = {}
    for r in rows:
        first_of.setdefault(r["block"], r["first_line"])
    blocks = sorted(first_of)
    after = dict(zip(blocks, [*(first_of[b] - 1 for b in blocks[1:]), rows[0]["last_line"]]))
    items: list[tuple] = []
    for r in rows:
        if r["kind"] == CLOSES:
            items.append(([""], -1, 0, 0, 0, 0))  # what opens the block does not reach its end
        items += _items(r, after[r["block"]] if r["end_line"] is None else r["end_line"])
    out = []
    for a, b, _ in longest([x[:2] for x in items]):
        n = sum(x[5] for x in items[a : b + 1])
        if n >= LEAST and items[a][0] != [""]:
            out.append((int(rows[0]["file_id"]), int(items[a][2]), int(items[b][3]), int(items[b][4]), int(n)))
    return pd.DataFrame(out, columns=["file_id", "first_line", "last_entry", "last_line", "n"])


def runs(lines: DataFrame, templates: Templates) -> DataFrame:
    """file_id, first_line, last_entry (first line of the last entry), last_line, n of each run of three or more."""
    found = cut(
        line_events(lines, templates)
        .repartition(shuffles(lines), "file_id", "block")
        .sortWithinPartitions("file_id", "block", "line_number")
        .select("file_id", "block", "line_number", "event")
        .mapInArrow(_search, EDGE),
        "runs",
    )
    inner = found.where("kind = 0").select("file_id", "first_line", "last_entry", F.col("end_line").alias("last_line"), "n")
    edges = found.where("kind > 0").join(file_ends(lines), "file_id")
    # files of one block need no joining
    many = edges.groupBy("file_id").agg(F.max("block").alias("top"), F.min("block").alias("low"))
    edges = edges.join(many, "file_id")
    single = edges.where("top = low and words <> '' and n >= %d" % LEAST)
    single = single.select("file_id", "first_line", "last_entry", F.coalesce("end_line", "last_line").alias("last_line"), "n")
    joined = edges.where("top > low").groupBy("file_id").applyInPandas(_stitch, "file_id bigint, first_line int, last_entry int, last_line int, n int")
    return inner.unionAll(single).unionAll(joined)
