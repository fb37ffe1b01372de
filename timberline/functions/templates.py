"""Header templates of log entries by longest-common-subsequence mining.

An entry's first line is tokenised into typed tokens: its opening stamp, level words, names, numbers, runs of blanks and
single marks. The shape of a header is the token sequence up to the free text, MAX_TOKENS at most. Entries of one shape form
one cluster, for each of whose slots is kept whether all its entries hold the same text there (a constant slot) or not (a
variable one). Clusters are counted per partition (`Miner`) and added up in Spark, so the result does not depend on the
partitioning. Then clusters whose longest common subsequence is a header of its own are merged into it (`fold`): what follows
it is message text. No layout is dropped for being rare: a cluster merges only into a template that parses its lines. Each
slot of a template is classified: stamp, level, host, process number, component, message. Structured records (JSON
objects, key=value lines) are mined by key: a key's role follows from the types of the values seen under it."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from timberline.functions.levels import LETTER_LEVEL, LEVEL_ALT, LEVEL_OF
from timberline.functions.stamps import STAMP

MAX_TOKENS = 18
#: A shape that begins with a template and goes on with a name before a mark has a longer header or a message that begins so;
#: below this share of the template it is taken for the latter. The lines are parsed and keep level and component either way.
MINOR = 0.2

_TOK = re.compile(rf"(?P<L>(?i:{LEVEL_ALT})(?![\w./-]))|(?P<W>[A-Za-z_][\w./-]*\w|[A-Za-z])|(?P<N>\d+(?:\.\d+)*)|(?P<S>[ \t]+)|(?P<P>[^\w\s])")
_LEVEL_OPEN = re.compile(rf"\[?(?i:{LEVEL_ALT})\b")
_JSON_OPEN = re.compile(r'\{\s*"')
_JSON_PAIR = re.compile(r'(?:[{,])\s*"((?:[^"\\]|\\.)*)"\s*:\s*("((?:[^"\\]|\\.)*)(?:"|$)|[^,}\s]+)')
_KV_OPEN = re.compile(r'[A-Za-z_@][\w.@]*=(?:"|\S)')
_KV_PAIR = re.compile(r'(?:^|\s)([A-Za-z_@][\w.@]*)=("((?:[^"\\]|\\.)*)(?:"|$)|\S*)')
_NAME = re.compile(r"[A-Za-z_][\w./-]*\Z")
_LEVEL_FULL = re.compile(rf"(?i:{LEVEL_ALT})\Z")

Shape = tuple[str, ...]


def opener(line: str) -> tuple[str, int, int, int] | None:
    """(kind, start and end of the opening stamp or level, end of the opener) or None.

    kind: the stamp's format with "[" before a bracketed one, "level", "json" or "kv"."""
    if not line:
        return None
    c = line[0]
    if c.isdigit() or c.isupper():
        m = STAMP.match(line)
        if m:
            return m.lastgroup, 0, m.end(), m.end()
    if c == "[":
        m = STAMP.match(line, 1)
        if m and line[m.end() : m.end() + 1] == "]":
            return "[" + m.lastgroup, 1, m.end(), m.end() + 1
    if c == "{":
        return ("json", 0, 0, 0) if _JSON_OPEN.match(line) else None
    if _LEVEL_OPEN.match(line):
        return "level", 0, 0, 0
    if "=" in line and _KV_OPEN.match(line) and len(_KV_PAIR.findall(line)) >= 3:
        return "kv", 0, 0, 0
    return None


def tokens(line: str, start: int) -> tuple[Shape, list[str]]:
    """Typed tokens from start up to the free text, cut back to the last mark or level, and their texts."""
    out: list[str] = []
    texts: list[str] = []
    plain = 0  # names in a row, parted by blanks only
    pos = start
    while len(out) < MAX_TOKENS:
        m = _TOK.match(line, pos)
        if not m:
            break
        k = m.lastgroup
        pos = m.end()
        if k == "S":
            out.append(" ")
            texts.append(m[0])
            continue
        if k == "W":
            plain += 1
            if plain == 3:
                break
        else:
            plain = 0
        out.append(m[0] if k == "P" else k)
        texts.append(m[0])
    n = len(out)
    while n and out[n - 1] in (" ", "W", "N"):
        n -= 1
    return tuple(out[:n]), texts[:n]


def lcs(a: Shape, b: Shape) -> Shape:
    """A longest common subsequence."""
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return tuple(out)


def slots(s: Shape) -> tuple[bool, bool]:
    """Whether a shape has a level set off by a mark, as in "INFO:", and a name with a process number. A level word before a
    blank ("critical section") or a name before a colon may as well begin a message; their share decides."""
    return any(t == "L" and s[i + 1 : i + 2] not in ((), (" ",)) for i, t in enumerate(s)), any(t == "W" and s[i + 1 : i + 4] == ("[", "N", "]") for i, t in enumerate(s))


def header_of(a: Shape, b: Shape) -> Shape:
    """The longest common subsequence of two shapes, if it opens both and is a whole header: a level or process number and a
    name, closed by a mark, behind which neither goes on with a level or a name set off by a mark. Else ()."""
    c = list(lcs(a, b))
    while c and (c[-1] in (" ", "W", "N") or tuple(c) != a[: len(c)] or tuple(c) != b[: len(c)]):
        c.pop()
    t = tuple(c)
    if "W" not in t or not ("L" in t or slots(t)[1]):
        return ()
    for rest in (a[len(t) :], b[len(t) :]):
        if not rest or "L" in rest or any(x == "W" and y in (":", "]", ")", "|", "[") for x, y in zip(rest, rest[1:])):
            return ()
    return t


def fold(counts: Counter) -> Counter:
    """Templates of clustered shapes, by descending support. A shape merges into the longest template that opens it, where it
    is rarer than MINOR of it and has no level or process number of its own; what is left merges into the longest common
    subsequence of two of them where that is a header."""
    kept: Counter = Counter()
    for s, n in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0])):
        own = slots(s)
        homes = (s[:k] for k in range(len(s) - 1, -1, -1) if s[:k] in kept)
        home = next((t for t in homes if n < MINOR * kept[t] and all(x >= y for x, y in zip(slots(t), own))), s)
        kept[home] += n
    by: dict[Shape, list[Shape]] = defaultdict(list)
    for s in kept:  # only shapes with the same first marks can have a header in common
        by[tuple(x for x in s[:8] if x != " ")[:4]].append(s)
    for group in by.values():
        group.sort()
        for a, b in zip(group, group[1:]):
            if (t := header_of(a, b)) and t not in (a, b):
                for s in (a, b):
                    if s in kept:
                        kept[t] += kept.pop(s)
    return kept


def value_type(v: str) -> str:
    if _LEVEL_FULL.match(v):
        return "L"
    m = STAMP.match(v)
    if m and m.end() == len(v):
        return "T"
    if _NAME.match(v):
        return "W"
    return "M" if " " in v else "O"


def role_of(c: Counter) -> str:
    """Role of a key by the types of its values: nine in ten must agree."""
    n = sum(c.values())
    return "level" if c["L"] > 0.9 * n else "stamp" if c["T"] > 0.9 * n else "component" if c["W"] > 0.9 * n else "message"


def pairs(line: str, kind: str) -> list[tuple[str, str]]:
    found = (_JSON_PAIR if kind == "json" else _KV_PAIR).findall(line)
    return [(k, q if v[:1] == '"' else v) for k, v, q in found]


@dataclass
class Miner:
    """Counts of one partition: of shapes, with the texts of their slots as far as all entries agree, and of key roles."""

    shapes: dict[str, dict[Shape, list]] = field(default_factory=lambda: defaultdict(dict))
    roles: Counter = field(default_factory=Counter)
    keys_only: bool = False  # stamps need no shapes

    def add(self, line: str) -> None:
        if self.keys_only and (not line or line[0] != "{" and "=" not in line):
            return
        o = opener(line)
        if o is None:
            return
        kind = o[0]
        if kind in ("json", "kv"):
            for k, v in pairs(line, kind):
                self.roles[kind, k, value_type(v)] += 1
            return
        if self.keys_only:
            return
        s, texts = tokens(line, o[3])
        have = self.shapes[kind].get(s)
        if have is None:
            self.shapes[kind][s] = [1, texts]
            return
        have[0] += 1
        if have[1] != texts:
            have[1] = [x if x == y else None for x, y in zip(have[1], texts)]

    def rows(self) -> list[tuple[str, str, int, list[str | None]]]:
        out = [(kind, json.dumps(s), n, texts) for kind, c in self.shapes.items() for s, (n, texts) in c.items()]
        return out + [(f"@{kind}", json.dumps([k, t]), n, []) for (kind, k, t), n in self.roles.items()]


def merge(rows: list[tuple[str, str, int, list[str | None]]]) -> list[tuple[str, str, int, list[str | None]]]:
    """Rows of several partitions as of one."""
    out: dict[tuple[str, str], list] = {}
    for kind, what, n, texts in rows:
        have = out.get((kind, what))
        out[kind, what] = [n, texts] if have is None else [have[0] + n, [x if x == y else None for x, y in zip(have[1], texts)]]
    return [(*k, *v) for k, v in out.items()]


def fields(s: Shape) -> tuple[int, int]:
    """Slots of the level and the component, -1 for none. The component is the name before a process number, else the last
    name; the level the first level."""
    names = [i for i, t in enumerate(s) if t == "W"]
    comp = next((i for i in names if s[i + 1 : i + 4] == ("[", "N", "]")), names[-1] if names else -1)
    return (s.index("L") if "L" in s else -1), comp


class Templates:
    """Parser of first lines by mined templates. rows: as Miner.rows or merge gives them."""

    def __init__(self, rows: list[tuple[str, str, int, list[str | None]]]):
        shapes: dict[str, Counter] = defaultdict(Counter)
        constant: dict[str, dict[Shape, list[str | None]]] = defaultdict(dict)
        roles: dict[str, dict[str, Counter]] = {"json": defaultdict(Counter), "kv": defaultdict(Counter)}
        for kind, what, n, texts in merge(rows):
            if kind[0] == "@":
                k, t = json.loads(what)
                roles[kind[1:]][k][t] += n
            else:
                s = tuple(json.loads(what))
                shapes[kind][s] += n
                constant[kind][s] = texts
        self.source = {k: dict(fold(c)) for k, c in shapes.items()}
        self.slots = {k: {s: self._slots(s, constant[k]) for s in c} for k, c in self.source.items()}
        self.plans: dict[str, dict[Shape, tuple[int, int, int]]] = {}
        for kind, c in self.source.items():
            plans = {s: (len(s), *fields(s)) for s in c}
            # a line of text may begin with a level word, so there a header has both
            self.plans[kind] = {s: p for s, p in plans.items() if kind != "level" or min(p[1:]) >= 0}
        self.fitting: dict[tuple[str, Shape], tuple[int, int, int] | None] = {}
        self.keys = {kind: {k: role_of(c) for k, c in by.items()} for kind, by in roles.items()}

    @staticmethod
    def _slots(s: Shape, seen: dict[Shape, list[str | None]]) -> list[str | None]:
        """Per slot the text that all entries of the template hold there, None where it varies."""
        out: list[str | None] | None = None
        for x, texts in seen.items():
            if x[: len(s)] == s:
                out = texts[: len(s)] if out is None else [a if a == b else None for a, b in zip(out, texts)]
        return out or []

    def _plan(self, kind: str, s: Shape) -> tuple[int, int, int] | None:
        """The longest template that opens a shape."""
        key = (kind, s)
        if key not in self.fitting:
            plans = self.plans.get(kind, {})
            self.fitting[key] = next((plans[s[:k]] for k in range(len(s), -1, -1) if s[:k] in plans), None)
        return self.fitting[key]

    def parse(self, line: str) -> tuple[str | None, str | None, str, str, int] | None:
        """(format, stamp, level, component, start of the message) of a line that opens an entry, else None.
        For a structured record the message starts at -1; message_of gives it."""
        o = opener(line)
        if o is None:
            return None
        kind, a, b, end = o
        if kind in ("json", "kv"):
            role = self.keys[kind]
            f = s = None
            level = comp = ""
            hit = False
            for k, v in pairs(line, kind):
                r = role.get(k, "message")
                if r == "stamp" and s is None:
                    m = STAMP.match(v)
                    if m and m.end() == len(v):
                        f, s, hit = m.lastgroup, v, True
                elif r == "level" and not level:
                    level = LEVEL_OF.get(v.upper(), "")
                    hit = hit or bool(level)
                elif r == "component" and not comp:
                    comp = v
            return (f, s, level, comp, -1) if hit else None
        fmt = kind.lstrip("[") if kind != "level" else None
        stamp = line[a:b] if fmt else None
        letter = LETTER_LEVEL.get(line[0], "") if fmt == "glog" else ""
        shape, texts = tokens(line, end)
        if (p := self._plan(kind, shape)) is not None:
            k, lv, comp = p
            at = end + sum(map(len, texts[:k]))
            while line[at : at + 1] in (" ", "\t"):
                at += 1
            return fmt, stamp, letter or (LEVEL_OF[texts[lv].upper()] if lv >= 0 else ""), texts[comp] if comp >= 0 else "", at
        return None if fmt is None else (fmt, stamp, letter, "", end)

    def stamp_of(self, line: str) -> tuple[str | None, str | None] | None:
        """(format, stamp) as parse gives them; a stamp that opens a line needs no template."""
        o = opener(line)
        if o is None or o[0] == "level":
            return None
        if o[0] in ("json", "kv"):
            p = self.parse(line)
            return None if p is None else p[:2]
        return o[0].lstrip("["), line[o[1] : o[2]]

    def message_of(self, line: str, kind: str | None = None) -> str:
        """The message value of a structured record: the first key whose role is message."""
        kind = kind or ("json" if line[:1] == "{" else "kv")
        role = self.keys[kind]
        for k, v in pairs(line, kind):
            if role.get(k, "message") == "message":
                return v
        return ""
