"""Personal data in free text: regular expressions propose spans, checksum validators confirm them, context words adjust
the score; accepted spans become typed placeholders.

Types: email, phone, id_number (national, tax or passport number), address (postal), name (of a person); card and iban are
redacted too. A proposal scores by its pattern; a validator (Luhn, mod 97, mod 11-2, mod 23) settles it or throws it out;
words nearby in the line raise or lower it; THRESHOLD decides. Bots, queues, repositories, package versions and machine
addresses are no cases, nor is a name inside an e-mail address: spans are taken by type in the order of TYPES and a name
does not overlap an e-mail address. JSON escapes (\\u00df) are read as the letters they stand for.

Lines are counted from 1 and end at a line feed. Null and empty texts hold nothing and stay as they are; texts of any
length are searched whole; repeated rows of a key give its lines once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
NEAR = 48
TYPES = ("email", "iban", "card", "id_number", "phone", "address", "name")
HOLDER = {t: f"[{t.upper()}]" for t in TYPES}

_AT = r"(?:@|\s?\[at\]\s?|\s?\(at\)\s?|%40)"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)"
_SPELLED_DOT = r"\s?\[dot\]\s?|\s?\(dot\)\s?"
#: An address is sought from its sign: the part before it is at most LOCAL letters (64 by the standard, dots spelled out).
_SIGN = re.compile(_AT)
_LOCAL = re.compile(rf"(?<![\w@/.+-])[A-Za-z0-9](?:[\w+-]|\.(?=[\w+-])|{_SPELLED_DOT})*\Z")
_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,24}}\b")
LOCAL = 128
_MACHINE = re.compile(r"(?i)(?:git|hg|svn|no-?reply|do-?not-?reply|(?:[\w.-]*-)?bot|mailer-daemon|daemon|postmaster|root)\Z")
_NUMBER = re.compile(
    r"(?<![\w.:/+-])(?:"
    r"(?P<e164>(?:tel:)?\+\d{10,15})"
    r"|(?P<intl>(?:tel:)?\+\d{1,3}[ .-](?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]\d{2,5}){0,4})"
    r"|(?P<area>\(0?\d{2,5}\)[ -]?\d{3,4}[ -]?\d{3,4})"
    r"|(?P<nanp>\d{3}(?P<sep>[-. ])\d{3}(?P=sep)\d{4})"
    r"|(?P<trunk>0\d{2,4} \d{3,4} \d{3,4})"
    r"|(?P<pairs>0[1-9](?P<ps>[ .-])\d{2}(?:(?P=ps)\d{2}){3})"
    r"|(?P<ssn>\d{3}(?P<sp>[- ])\d{2}(?P=sp)\d{4})"
    r"|(?P<cn>\d{17}[\dXx])"
    r"|(?P<dni>\d{8}-?[A-Z])"
    r"|(?P<nino>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])"
    r"|(?P<pass>[A-Z]\d{7,8})"
    r"|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)"
    r"|(?P<card>\d{4}(?P<cs>[ -]?)\d{4}(?P=cs)\d{4}(?P=cs)\d{4})"
    r"|(?P<amex>3[47]\d{2}(?P<as>[ -]?)\d{6}(?P=as)\d{5})"
    r"|(?P<mobile>1[3-9]\d{9})"
    r"|(?P<pass9>\d{9})"
    r")(?: ?(?:ext\.?|x) ?\d{1,6})?(?![\w]|[.:-]\d)"
)
_INNER = ("sep", "sp", "cs", "ps", "as")
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"
_NAMES = r"[A-ZÀ-ÖØ-Þ][^\W\d_'’-]+(?:[ -][A-ZÀ-ÖØ-Þ][^\W\d_'’-]+)?"
_ADDRESS = re.compile(
    rf"P\.? ?O\.? Box \d+(?:, {_NAMES} (?:St|Street|Rd|Road|Ave)\b\.?)?(?:, {_NAMES})?"
    rf"|(?<![\w.:-])\d{{1,5}}[A-Za-z]? {_NAMES} (?:Lane|Blvd|Boulevard|Street|St\.|Road|Rd\.?|Avenue|Ave\.?|Drive|Way|Court|Close|Terrace)(?=[\s,'\"<]|$)(?:, Apt\.? \d+)?(?:, {_NAMES})?(?:,? [A-Z]{{2}} \d{{5}}|,? [A-Z]{{1,2}}\d{{1,2}}[A-Z]? \d[A-Z]{{2}})?"
    rf"|(?<![\w.:-])\d{{1,5}},? (?:rue|avenue|boulevard|place|chemin|quai|via|viale|piazza) (?:(?:de la|de l'|des|du|de|d') ?)?{_NAMES}(?:, \d{{5}} {_NAMES})?"
    rf"|(?<!\w)(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo|[Rr]ua|[Tt]ravessa) (?:(?:de la|del|de|da|do) )?{_NAMES},? \d{{1,5}}[a-z]?(?:, {_NAMES})?"
    rf"|(?<!\w){_NAMES}(?:stra(?:ß|ss)e|str\.|gasse|allee|platz|damm|ufer) \d{{1,5}}[a-z]?(?![/\w.:])(?:,? (?:in )?(?:\d{{5}} )?{_NAMES})?"
    rf"|(?<!\w){_NAMES} (?:Weg|Straße|Strasse|Allee|Platz|Gasse) \d{{1,5}}[a-z]?(?:, \d{{5}} {_NAMES})?"
)
_ADDRESS_CUES = ("box", "lane", "blvd", "boulevard", "street", "st.", "road", "rd", "ave", "drive", "way", "court", "close", "terrace", "rue ", "avenue", "place ", "chemin", "quai", "via ", "viale", "piazza", "calle ", "plaza", "paseo", "rua ", "travessa", "straße", "strasse", "str.", "gasse", "allee", "platz", "damm ", "ufer ", " weg ")
_TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Mx|Herr|Frau|Sr|Sra|Mme|Dra)\.? )"
_PART = r"(?:[^\W\d_]\.|[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*)"
_PERSON = rf"(?:{_TITLE}{_PART}(?:,? {_PART}){{0,3}}|{_PART}(?:,? {_PART}){{1,3}})"
#: Words that introduce a person, and what ends the name.
_CONTEXT = re.compile(
    rf"(?:\b(?:TODO|FIXME|XXX|HACK)\((?P<a>{_PERSON})\)"
    rf"|['\"](?:user(?:_?name)?|full_?name|name|author|owner|contact|reporter|assignee|customer|patient)\\?['\"]\s*:\s*\\?['\"](?P<b>{_PERSON})\\?['\"]"
    rf"|<(?:owner|author|user|contact|name|person)\b[^>]*>(?P<c>{_PERSON})</"
    rf"|\w*(?:AUTHOR|COMMITTER|USER|OWNER)_NAME=['\"]?(?P<d>{_PERSON})['\"]"
    rf"|\b(?:Author|Committer|Reviewed-by|Signed-off-by|Reported-by|From|Commit):\s+(?P<e>{_PERSON})\s+<"
    rf"|\b(?:[Tt]his is|[Mm]y name is|on-call is|on call is|last touched by|touched by|deliver to|(?:signed|reported|reviewed|approved|merged|committed|assigned) (?:off )?by|assigned to|greetings from|regards,|Herr|Frau|von|attn\.?|c/o)\s+(?P<f>{_PERSON})(?=,|\.(?:\s|$)| ask| gepr| after | by | in | on |<|'|\"|\)|;|$)"
    rf"|\bvalues\s*\([^()']*'(?P<g>{_PERSON})'"
    r")"
)
_OF = re.compile(r"\bvon\s+\Z")
_CONTEXT_CUES = ("todo(", "fixme(", "xxx(", "hack(", "name", "user", "assigned to", 'author', 'owner', 'contact', 'reporter', 'assignee', 'customer', "_name=", "committer", "-by:", "from:", "commit:", "this is", "my name", "on-call", "on call", "touched by", "deliver to", "ed by", "greetings", "regards", " von ", "herr ", "frau ", "attn", "c/o", "values")
_PAIR = re.compile(r"(?<![\w.'’/-])[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?: [A-Z]\.)? [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?: (?P<third>[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+))?(?![\w/.]\w)")
_SAYS = re.compile(r" (?:asked|says|said|wrote|writes|reported|reports|called|confirmed|noticed|replied|phoned|schrieb|fragte|meldete|sagte|a écrit|escribió|escreveu)\b")
#: Names in Cyrillic letters by the endings of family names; in Han characters behind a word that introduces a person.
_CYRILLIC_NAME = re.compile(r"(?<![\w-])(?P<n>[А-ЯЁ][а-яё]+(?: [А-ЯЁ][а-яё]+)? [А-ЯЁ][а-яё]+(?:ов|ев|ёв|ин|ын|ова|ева|ёва|ина|ына|ский|ская|цкий|цкая|енко|чук|юк|ян))(?!\w)")
_HAN_NAME = re.compile(r"(?:联系人|负责人|作者|我是|姓名|报告人|提交者|值班人)(?:是|为)?[:：]?\s*(?P<n>[\u4e00-\u9fff]{2,3})(?![\u4e00-\u9fff])")
#: Words of machines, roles, places and calendars that are no parts of persons' names.
_NOT_NAME = frozenset(
    "bot bots worker workers scheduler runner runners agent agents service services daemon queue queues pool pools manager system admin server client release nightly main build job jobs team group "
    "pipeline stage module error exception warning info debug trace fatal critical started finished failed passed skipped build building using executor uploading fetching archiving downloaded post run "
    "expected actual traceback caused file line test tests thread process step task node cluster host user owner author unknown none null true false the and for with from not was has "
    "jan feb mar apr may jun jul aug sep oct nov dec mon tue wed thu fri sat sun monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "lane blvd boulevard street road avenue drive way court box apt weg straße strasse platz allee gasse rue calle framework studio kernel hat cloud core engine api sdk cli ide database linux windows ubuntu debian fedora spring visual google amazon azure apache eclipse oracle android swift again tonight today tomorrow yesterday github gitlab jenkins docker maven gradle actions".split()
)
#: Context words: (type, words that raise, words that lower). Fixed values.
_RAISE = {
    "phone": re.compile(r"(?i)phone|\btel\b|call|contact|reach|pager|mobile|fax|dial|ring|whatsapp|handy|telefon|tél"),
    "id_number": re.compile(r"(?i)passport|ausweis|\bid\b|holder|ssn|nino|tax|steuer|payroll|applicant|national|dni|nif|insurance|identity|citizen|security"),
    "card": re.compile(r"(?i)card|visa|master|amex|payment|pan\b"),
}
_LOWER = {
    "phone": re.compile(r"(?i)checksum|build|order|version|port\b|offset|bytes|lines|commit|digest"),
    "id_number": re.compile(r"(?i)checksum|build|order|matrix|version|offset|bytes|digest|commit|record|job\b|request"),
    "card": re.compile(r"(?i)checksum|build|order|offset|bytes|digest|commit|trace|span|id\b"),
}


_PASSPORT = re.compile(r"(?i)passport|passeport|pasaporte|passaporte|reisepass|паспорт|护照")


def luhn(s: str) -> bool:
    d = [int(c) for c in s if c.isdigit()][::-1]
    return bool(d) and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def mod97(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def mod11_2(s: str) -> bool:
    weights = [pow(2, 17 - i, 11) for i in range(17)]
    return "10X98765432"[sum(int(c) * w for c, w in zip(s, weights)) % 11] == s[17].upper()


def dni_letter(s: str) -> bool:
    return _DNI[int(s[:8]) % 23] == s[-1]


def _cn_date(s: str) -> bool:
    return 1800 < int(s[6:10]) < 2100 and 1 <= int(s[10:12]) <= 12 and 1 <= int(s[12:14]) <= 31


def _judge_number(kind: str, s: str) -> tuple[str, float]:
    """Type and score before context; 0 throws out."""
    digits = sum(c.isdigit() for c in s)
    if kind == "e164":
        return "phone", 0.75 if s.startswith("tel:") or digits >= 11 else 0.4
    if kind == "intl":
        return "phone", 0.7 if 8 <= digits <= 15 else 0
    if kind == "area":
        return "phone", 0.65 if 9 <= digits <= 12 else 0
    if kind == "nanp":
        return "phone", 0.55
    if kind == "trunk":
        return "phone", 0.55 if 9 <= digits <= 12 else 0
    if kind == "pairs":
        return "phone", 0.55
    if kind == "mobile":  # eleven bare digits: only beside a word of telephones
        return "phone", 0.3
    if kind == "pass9":  # nine bare digits: only beside a word of passports
        return "id_number", 0.2
    if kind == "amex":
        return "card", 0.7 if luhn(s) else 0
    if kind == "ssn":
        return "id_number", 0.55 if s[4:6] != "00" and not s.endswith("0000") else 0
    if kind == "cn":
        return "id_number", 0.9 if _cn_date(s) and mod11_2(s) else 0
    if kind == "dni":
        return "id_number", 0.8 if dni_letter(s) else 0
    if kind == "nino":
        return "id_number", 0.7
    if kind == "pass":
        return "id_number", 0.25
    if kind == "iban":
        return "iban", 0.9 if mod97(s) else 0
    return "card", 0.7 if luhn(s) and s[0] in "3456" else 0


def is_person(s: str) -> bool:
    """Two to four names or initials, or a title and a name; no word of machines or roles."""
    titled = re.match(_TITLE, s) is not None
    parts = [p.strip(".,") for p in (re.sub(rf"\A{_TITLE}", "", s)).split()]
    parts = [p for p in parts if p]
    long = [p for p in parts if len(p) > 1]
    if any(p.lower() in _NOT_NAME for p in parts) or not 1 <= len(parts) <= 4:
        return False
    return len(long) >= 2 or (len(long) == 1 and (titled or len(parts) > 1) and len(long[0]) > 2)


def line_spans(line: str) -> list[tuple[int, int, str]]:
    """Accepted spans of one line, none overlapping another."""
    low = line.lower()
    got: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in got)

    if "@" in line or "at]" in low or "(at)" in low or "%40" in low:
        last = 0
        for at in _SIGN.finditer(line):
            local = _LOCAL.search(line, max(last, at.start() - LOCAL), at.start())
            domain = _DOMAIN.match(line, at.end()) if local else None
            if not domain:
                continue
            last = domain.end()
            after = line[last : last + 2]
            if _MACHINE.match(local[0]) or (after[:1] == ":" and after[1:].strip()) or after[:1] == "/":
                continue
            got.append((local.start(), last, "email"))
    for m in _NUMBER.finditer(line):
        kind, score = _judge_number(m.lastgroup if m.lastgroup not in _INNER else next(k for k, v in m.groupdict().items() if v and k not in _INNER), m[0])
        if not score or not free(m.start(), m.end()):
            continue
        if m["pass9"] and not _PASSPORT.search(line[max(0, m.start() - NEAR) : m.start()]):
            continue
        near = line[max(0, m.start() - NEAR) : m.start()] + " " + line[m.end() : m.end() + NEAR // 2]
        if kind in _RAISE and _RAISE[kind].search(near):
            score += 0.3
        if kind in _LOWER and _LOWER[kind].search(near):
            score -= 0.3
        if score >= THRESHOLD:
            got.append((m.start(), m.end(), kind))
    if any(c in low for c in _ADDRESS_CUES):
        for m in _ADDRESS.finditer(line):
            if free(m.start(), m.end()):
                got.append((m.start(), m.end(), "address"))
    if any(c in low for c in _CONTEXT_CUES):
        pos = 0
        while m := _CONTEXT.search(line, pos):
            g = m.lastgroup
            a, b = m.span(g)
            pos = max(b, pos + 1)
            s = m[g]
            if g == "f" and _OF.search(line[:a]) and not all(p[0].isupper() for p in re.findall(r"[^\W\d_]+", s)):
                # "von" stands before anything: without capitals only a word of persons' numbers nearby tells a name
                if not _RAISE["id_number"].search(line[max(0, a - NEAR) : a]):
                    continue
            if g == "f":  # running text: "Last, First" or "First M. Last" before a comma
                s = _trim(s)
                b = a + len(s)
            if is_person(s) and free(a, b):
                got.append((a, b, "name"))
    for m in _PAIR.finditer(line):
        a, b = m.span()
        if m["third"] and not is_person(m[0]):
            b = m.start("third") - 1
        if is_person(line[a:b]) and free(a, b):
            before = line[:a].rstrip()
            # two words may open a sentence; a person who says or does something is none of these
            if before and before[-1] not in ".!?" or _SAYS.match(line, b):
                got.append((a, b, "name"))
    if not line.isascii():
        for pattern in (_CYRILLIC_NAME, _HAN_NAME):
            for m in pattern.finditer(line):
                if free(*m.span("n")):
                    got.append((*m.span("n"), "name"))
    return sorted(got)


def _trim(s: str) -> str:
    """The name at the start of running text."""
    head, comma, tail = s.partition(",")
    if comma and len(head.split()) == 1 and not re.match(_TITLE, head + " "):
        return head + comma + " " + " ".join(tail.split()[:1])
    return head


_ESC = re.compile(r"\\u([0-9a-fA-F]{4})")


def _unescape(line: str) -> tuple[str, list[int] | None]:
    """The line with JSON escapes read, and the raw position of each letter (None: the same)."""
    if "\\u" not in line:
        return line, None
    out, at, last = [], [], 0
    for m in _ESC.finditer(line):
        out.append(line[last : m.start()])
        at += range(last, m.start())
        out.append(chr(int(m[1], 16)))
        at.append(m.start())
        last = m.end()
    out.append(line[last:])
    at += range(last, len(line) + 1)
    return "".join(out), at


def text_spans(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(line number, start, end, type) over the whole text."""
    base = 0
    for no, line in enumerate(text.split("\n"), 1):
        if len(line) > 6:
            plain, at = _unescape(line)
            for a, b, t in line_spans(plain):
                yield (no, base + a, base + b, t) if at is None else (no, base + at[a], base + at[b], t)
        base += len(line) + 1


def redact(text: str | None) -> str | None:
    if not text:
        return text
    out, last = [], 0
    for _, a, b, t in text_spans(text):
        out += [text[last:a], HOLDER[t]]
        last = b
    return "".join([*out, text[last:]]) if out else text


def find(texts: DataFrame, types: tuple[str, ...] = ("email", "phone", "id_number", "address", "name")) -> DataFrame:
    """key, line_no, pii_type, once per line and type. texts: (key string, text string)."""
    wanted = set(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[tuple, None] = {}
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    rows.update(dict.fromkeys((k, no, t) for no, _, _, t in text_spans(text) if t in wanted))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["key", "line_no", "pii_type"])

    return texts.select("key", "text").mapInArrow(run, "key string, line_no int, pii_type string").dropDuplicates()


def redacted(texts: DataFrame) -> DataFrame:
    """key, text with typed placeholders. Map-only: rows stay as they are, repeated ones included."""

    @F.pandas_udf("string")
    def clean(s):
        return s.map(redact, na_action="ignore")

    return texts.select("key", clean(F.col("text")).alias("text"))


def redact_column(c: Column) -> Column:
    @F.pandas_udf("string")
    def clean(s):
        return s.map(redact, na_action="ignore")

    return clean(c)
