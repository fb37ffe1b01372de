"""Text decoded with the wrong encoding: find it, name the encoding chain, restore it where possible.

A multinomial classifier over hashed byte bigrams (UTF-8 bytes, only bigrams that touch a byte above 127) is trained on a
bounded sample of records: each record as it is (class "clean") and garbled with every chain (classes "S>W": written in S, read as
W; "S>W>S>W" for twice). Records that the first fit calls garbled leave the sample before the second fit. A text is cut
into sentences of each line; the non-ASCII words of a sentence are scored together. A sentence whose best chain beats
"clean" by MARGIN is inverted word by word and verified: the inverse must decode strictly and read better as clean text
than before. Where the sentence holds U+FFFD or marks of lost bytes the damage cannot be undone; it is reported, not restored.

Every record and every sentence is scored; only the training sample is bounded (SAMPLE_ROWS records
of least key hash, of SAMPLE_CHARS letters at most).
Null, empty, blank and ASCII-only texts are clean. Repeated rows of a key count once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 3000
SAMPLE_CHARS = 20_000
HASH_BITS = 15
MARGIN = 4.0
LOST = "�"

#: (written in, read as); fixed values: encodings of the public registries that hold the corpus' scripts.
_UTF8_READ_AS = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "koi8-r", "cp437", "cp850", "cp866", "mac_roman", "gbk", "big5", "shift_jis", "iso8859-2", "iso8859-15")
_OTHERS = (
    ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1252"),
    ("gbk", "cp1252"), ("gbk", "cp1251"), ("big5", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "gbk"),
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "koi8-r"),
)
_LOSSY = (("cp1252", "utf-8"), ("cp1251", "utf-8"), ("gbk", "utf-8"))
CHAINS: tuple[tuple[str, ...], ...] = (
    *(("utf-8", w) for w in _UTF8_READ_AS),
    *_OTHERS,
    *_LOSSY,
    ("utf-8", "cp1252", "utf-8", "cp1252"),
    ("utf-8", "latin-1", "utf-8", "latin-1"),
    ("utf-8", "cp1252", "utf-8", "latin-1"),
    ("utf-8", "cp1251", "utf-8", "cp1251"),
)
_OTHER_SCRIPT = {"cp1251", "koi8-r", "cp866", "gbk", "big5"}  # their words are written in letters above 127 throughout
_STRICT = np.array([False, *(c[0] != "utf-8" and c not in _LOSSY for c in CHAINS)])
_PARTS = np.where(_STRICT, 3.0, 1.0)
CLASSES = ("clean", *(">".join(c) for c in CHAINS))

_SENTENCE = re.compile(r"[^\n]*?(?:[.!?…。！？；;:]+(?=\s)|[。！？]|$)", re.M)
#: A word with a letter above 127; what follows may be a no-break space, which is half of some garbled letters.
_ODD = re.compile(r"\S*[^\s\x00-\x7f](?:\S|[^\x00-\x7f])*")


def _table(enc: str) -> tuple[str, dict[str, int]] | None:
    """A single-byte encoding as text of 256 letters and its inverse; bytes without a letter stand for themselves."""
    try:
        letters = "".join(bytes([b]).decode(enc, "ignore") or chr(b) for b in range(256))
    except LookupError:
        return None
    return (letters, {c: b for b, c in enumerate(letters)}) if len(letters) == 256 else None


_MULTI = {"utf-8", "gbk", "big5", "shift_jis"}
_TABLES = {e: t for c in CHAINS for e in c if e not in _MULTI and (t := _table(e))}


def _decode(raw: bytes, enc: str) -> str:
    if enc in _TABLES:
        letters = _TABLES[enc][0]
        return "".join([letters[b] for b in raw])
    return raw.decode(enc, "replace")


def _encode(text: str, enc: str) -> bytes:
    """Strict but for control letters that stand for undefined bytes."""
    if enc in _TABLES:
        inv = _TABLES[enc][1]
        try:
            return bytes([inv[c] for c in text])
        except KeyError as e:
            raise UnicodeError(str(e)) from None
    return text.encode(enc)


_CYRILLIC, _HAN = re.compile("[\u0400-\u04ff]"), re.compile("[\u3000-\u30ff\u4e00-\u9fff\uff00-\uffef]")
_SCRIPT = {"cp1251": _CYRILLIC, "koi8-r": _CYRILLIC, "cp866": _CYRILLIC, "gbk": _HAN, "big5": _HAN}


def writes(enc: str, words: str) -> bool:
    """Whether words would be written in an encoding: in its script, or for a Latin one with most letters plain."""
    odd = sum(c > "\x7f" for c in words)
    if enc == "utf-8" or not odd:
        return True
    if enc in _SCRIPT:
        return len(_SCRIPT[enc].findall(words)) >= 0.3 * odd
    return odd <= sum(c.isalpha() and c <= "\x7f" for c in words)


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """Write in the first, read as the second, and so on. None if nothing changes or the script is not the encoding's."""
    if not writes(chain[0], text):
        return None
    for s, w in zip(chain[::2], chain[1::2]):
        raw = text.encode(s, "replace")
        if s != "utf-8" and raw.count(b"?") - text.count("?") > 0.3 * sum(c > "\x7f" for c in text):
            return None
        new = _decode(raw, w)
        if new == text:
            return None
        text = new
    return text


def invert(text: str, chain: tuple[str, ...]) -> str | None:
    """The original if every step decodes strictly."""
    try:
        for s, w in zip(chain[-2::-2], chain[-1::-2]):
            text = _encode(text, w).decode(s, "strict")
    except UnicodeError:
        return None
    return text


def _hashed(raw: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    two = two[(two & 0x8080) != 0]
    return ((two * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)).astype(np.int64)


def sentences(text: str) -> Iterator[tuple[int, int]]:
    for m in _SENTENCE.finditer(text):
        if m.end() > m.start():
            yield m.span()


def odd_words(sentence: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ODD.finditer(sentence)]


def _best_stretch(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per class the largest sum over adjacent words, its first word and its length."""
    c = gain.shape[1]
    best, at, size = np.zeros(c), np.zeros(c, int), np.zeros(c, int)
    cur, start = np.zeros(c), np.zeros(c, int)
    for i, g in enumerate(gain):
        fresh = cur <= 0
        cur = np.where(fresh, g, cur + g)
        start = np.where(fresh, i, start)
        up = cur > best
        best = np.where(up, cur, best)
        at = np.where(up, start, at)
        size = np.where(up, i + 1 - start, size)
    return best, at, size


@dataclass
class Model:
    logp: np.ndarray  # (hash buckets, classes)

    def __post_init__(self):
        self.cache: dict[str, np.ndarray] = {}
        self.tops: dict[str, float] = {}

    def score(self, word: str) -> np.ndarray:
        s = self.cache.get(word)
        if s is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
                self.tops.clear()
            s = self.cache[word] = self.logp[_hashed(word.encode("utf-8"))].sum(axis=0)
        return s

    def top(self, word: str) -> float:
        """At most so much a word adds to the total of any chain."""
        t = self.tops.get(word)
        if t is None:
            s = self.score(word)
            t = self.tops[word] = max(0.0, float(((s - s[0]) / _PARTS)[1:].max()))
        return t

    def judge(self, sentence: str) -> tuple[str, str | None] | None:
        """(chain, restored sentence or None) of a garbled sentence, None of a clean one."""
        spans = odd_words(sentence)
        if not spans:
            return None
        words = [sentence[a:b] for a, b in spans]
        lost = any(LOST in w for w in words)
        if not lost and sum(map(self.top, words)) < MARGIN:
            return None  # no chain can reach the margin
        each = np.stack([self.score(w) for w in words])
        gain = each - each[:, :1]
        # UTF-8 read wrongly is unmistakable, so words that read better as clean do not speak against it (a sentence may be
        # garbled in part); letters of one single-byte encoding read as another's are mere letters, so a stretch of words
        # must speak as a whole
        runs, at, size = _best_stretch(gain)
        total = np.where(_STRICT, runs / _PARTS, np.maximum(gain, 0).sum(axis=0))
        order = np.argsort(-total, kind="stable")
        for k in order:
            if total[k] < MARGIN or k == 0:
                break
            chain = CHAINS[k - 1]
            if chain in _LOSSY:
                if lost:
                    return CLASSES[k], None
                continue
            if _STRICT[k]:
                speak = gain[at[k] : at[k] + size[k], k] > 0
                letters = "".join(words[at[k] : at[k] + size[k]])
                odd = sum(c > "\x7f" for c in letters)
                if CHAINS[k - 1][0] in _OTHER_SCRIPT and 2 * sum(c.isalpha() and c <= "\x7f" for c in letters) > odd:
                    continue
                if speak.sum() < 0.7 * size[k] or speak.sum() < (2 if odd >= 6 and CHAINS[k - 1][0] in _OTHER_SCRIPT else 3):
                    continue
            out, last, better, failed = [], 0, 0.0, lost
            for (a, b), w, g in zip(spans, words, gain[:, k]):
                if g <= 0:
                    continue
                t = invert(w, chain)
                if t is None:
                    t = self._part(w, chain)
                if t is None:
                    failed = True
                    continue
                now = self.score(t)[0] if not t.isascii() else 0.0
                if now <= self.score(w)[0]:
                    continue
                better += now - self.score(w)[0]
                out += [sentence[last:a], t]
                last = b
            if better >= MARGIN:
                return CLASSES[k], None if failed else "".join([*out, sentence[last:]])
        return ("unknown", None) if lost else None

    @staticmethod
    def _part(word: str, chain: tuple[str, ...]) -> str | None:
        """Inverse of the runs of non-ASCII letters only; a word may join garbled text and other letters."""
        done = [0]

        def back(m: re.Match) -> str:
            t = invert(m[0], chain)
            if t is None:
                return m[0]
            done[0] += 1
            return t

        t = re.sub(r"[^\x00-\x7f]+", back, word)
        return t if done[0] else None

    def repair(self, text: str | None) -> tuple[list[str], str | None]:
        """(chains found, text with all that can be restored)."""
        if not text or text.isascii():
            return [], text
        chains, out, last = [], [], 0
        for a, b in sentences(text):
            s = text[a:b]
            if s.isascii():
                continue
            if (j := self.judge(s)) is not None:
                if j[0] not in chains:
                    chains.append(j[0])
                if j[1] is not None:
                    out += [text[last:a], j[1]]
                    last = b
        return chains, "".join([*out, text[last:]]) if out else text


def fit(records: list[str], rounds: int = 2) -> Model:
    """From records that are mostly clean."""
    units = [t[a:b] for t in records for a, b in sentences(t) if not t[a:b].isascii()]
    model = None
    for _ in range(rounds):
        # only what was UTF-8 leaves the sample: a mistake about letters of one script would drop that script's clean text
        keep = units if model is None else [u for u in units if (j := model.judge(u)) is None or not j[0].startswith("utf-8")]
        n = np.full((1 << HASH_BITS, len(CLASSES)), 0.05)
        # sentences of one wording count as often as they occur, so a few garbled records stay few
        texts = Counter(" ".join(u[a:b] for a, b in odd_words(u)) for u in keep)
        for k, chain in enumerate((None, *CHAINS)):
            made = [" ".join([t] * c) for x, c in texts.items() if (t := x if chain is None else garble(x, chain))]
            n[:, k] += np.bincount(_hashed(" ".join(made).encode("utf-8")), minlength=1 << HASH_BITS)
        model = Model(np.log(n / n.sum(axis=0)))
    return model


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the `rows` records of least key hash among those with non-ASCII letters and at most SAMPLE_CHARS letters."""
    usable = F.col(text).rlike(r"[^\x00-\x7F]") & (F.length(text) <= SAMPLE_CHARS)
    picked = docs.where(usable).select(text, F.xxhash64(key).alias("h")).orderBy("h").limit(rows)
    return fit([r[0] for r in picked.select(text).collect()])


def repaired(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chains, restored of the records in which garbled text was found. Map-only but for repeated rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model.logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shared.value)
        for b in batches:
            keep, chains, out = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                c, r = m.repair(t)
                if c:
                    keep.append(i)
                    chains.append(c)
                    out.append(r)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(chains, pa.list_(pa.string())), pa.array(out, pa.string())], names=[key, "chains", "restored"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, chains array<string>, restored string").dropDuplicates([key])
