"""Byte-level BPE encoding of a corpus with a public tokenizer's merges, by a pair occurrence index.

Per block of documents the texts are split by the tokenizer's pattern and each distinct piece becomes a chain of byte
tokens. Every adjacent pair with a merge is indexed by its rank to all its positions in the block; active ranks are applied
in ascending order, all occurrences of a pair at once, and the pairs to the left and right of each merge are entered into
the lists of their ranks. A merge cannot create a pair of lower rank, as a token exists only after its own merge, so one
ascending pass gives what merging each piece alone gives.

A null or empty text gives an empty list; strings of special tokens are ordinary text; lone surrogates cannot occur in
Spark strings. Texts of any length are encoded whole."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern that belongs to these merges. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS = 2_500_000
CACHE = 200_000  # pieces kept per Python worker


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself where printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class Merges:
    """Merge table as arrays: byte ids, and sorted pair keys with rank and result."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[c] for c in byte_letters()], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = left << 32 | right
        o = np.argsort(key, kind="stable")
        self.key, self.rank = key[o], np.arange(len(key), dtype=np.int32)[o]
        self.left, self.right, self.made = left.astype(np.int32), right.astype(np.int32), made


def encode_pieces(m: Merges, pieces: list[bytes]) -> list[np.ndarray]:
    """Token ids of each piece."""
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(size)
    n = len(flat)
    tok = m.byte_id[flat]
    # chains: next and previous live position, n and -1 at a piece's edge
    nxt = np.arange(1, n + 1)
    prv = np.arange(-1, n - 1)
    nxt[ends - 1] = n
    prv[ends - size] = -1
    live = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(pos: np.ndarray) -> None:
        """Add pairs that begin at pos to the lists of their ranks."""
        pos = pos[nxt[pos] < n]
        if not len(pos):
            return
        key = tok[pos].astype(np.int64) << 32 | tok[nxt[pos]]
        at = np.minimum(np.searchsorted(m.key, key), len(m.key) - 1)
        ok = m.key[at] == key
        pos, rank = pos[ok], m.rank[at[ok]]
        if not len(pos):
            return
        if len(pos) == 1:
            parts = [(int(rank[0]), pos)]
        else:
            o = np.argsort(rank, kind="stable")
            pos, rank = pos[o], rank[o]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            parts = zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(pos, cuts))
        for r, p in parts:
            have = index.get(r)
            if have is None:
                index[r] = [p]
                heapq.heappush(heap, r)
            else:
                have.append(p)

    enter(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = m.left[r], m.right[r]
        pos = pos[live[pos] & (tok[pos] == a)]
        after = nxt[pos]
        ok = after < n
        pos, after = pos[ok], after[ok]
        ok = tok[after] == b
        pos, after = pos[ok], after[ok]
        if a == b and len(pos) > 1:  # aaa holds one pair: left to right, none that begins inside the one before
            pos = np.sort(pos)
            keep, used = [], -1
            for p, q in zip(pos.tolist(), nxt[pos].tolist()):
                if p != used:
                    keep.append(p)
                    used = q
            pos = np.array(keep)
            after = nxt[pos]
        if not len(pos):
            continue
        tok[pos] = m.made[r]
        live[after] = False
        beyond = nxt[after]
        nxt[pos] = beyond
        inside = beyond < n
        prv[beyond[inside]] = pos[inside]
        before = prv[pos]
        before = before[before >= 0]
        enter(np.unique(np.concatenate([before, pos])))
    word = np.repeat(np.arange(len(pieces)), size)[live]
    out = tok[live]
    return np.split(out, np.cumsum(np.bincount(word, minlength=len(pieces)))[:-1])


class Encoder:
    def __init__(self, m: Merges, pattern: str = PATTERN):
        self.m, self.find, self.cache = m, regex.compile(pattern).findall, {}

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a list of texts."""
        number: dict[str, int] = {}
        seq: list[int] = []
        count = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                w = [number.setdefault(p, len(number)) for p in self.find(t)]
                count[i] = len(w)
                seq += w
        new = [p for p in number if p not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache = {p: self.cache[p] for p in number if p in self.cache}
        if new:
            self.cache.update(zip(new, encode_pieces(self.m, [p.encode("utf-8") for p in new])))
        pieces = [self.cache[p] for p in number]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.concatenate(pieces) if pieces else np.empty(0, np.int32)
        start = np.cumsum(size) - size
        s = np.asarray(seq, np.int64)
        n = size[s] if len(s) else np.empty(0, np.int64)
        ends = np.cumsum(n)
        take = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(start[s], n) if len(s) else np.empty(0, np.int64)
        offsets = np.zeros(len(texts) + 1, np.int64)
        tokens = np.concatenate([[0], ends])
        offsets[1:] = tokens[np.cumsum(count)]
        return offsets, flat[take]


def encode(texts: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids. The merge table is read by the driver and broadcast; its size is the tokenizer's, not the corpus'."""
    merges = texts.sparkSession.sparkContext.broadcast(Merges(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(merges.value)
        for b in batches:
            t = b.column(1).to_pylist()
            i = 0
            while i < len(t):
                j, chars = i, 0
                while j < len(t) and (j == i or chars + len(t[j] or "") <= BLOCK_CHARS):
                    chars += len(t[j] or "")
                    j += 1
                offsets, ids = e.block(t[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=[key, "ids"])
                i = j

    kind = dict(texts.dtypes)[key]
    return texts.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
