"""Column expressions on one line of text. All stay inside code generation; none needs Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions import patterns as P


_PLAIN = re.compile(r"[A-Za-z_ ]+(?:\|[A-Za-z_ ]+)*")


def found(c: Column, pattern: str) -> Column:
    """Whether a pattern occurs; words are searched as bytes, which is several times faster than a regex."""
    if not _PLAIN.fullmatch(pattern):
        return c.rlike(P.NEEDS[pattern]) & c.rlike(pattern) if pattern in P.NEEDS else c.rlike(pattern)
    out = None
    for word in pattern.split("|"):
        out = c.contains(word) if out is None else out | c.contains(word)
    return out


def first_match(c: Column, rules: list[tuple[str, str]], other: str | None) -> Column:
    """Label of the first rule whose pattern is found."""
    out = None
    for label, pattern in rules:
        hit = found(c, pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(other))


def level(line: Column) -> Column:
    """Highest level word of the line as a whole word, UNKNOWN if none."""
    return first_match(line, [(k, rf"(?i)\b{P.LEVEL_WORD[k]}\b") for k in P.LEVEL_PRIORITY], "UNKNOWN")


def level_leftmost(line: Column) -> Column:
    """Leftmost level word, also inside words."""
    w = F.upper(F.regexp_extract(line, P.LEVEL_LEFTMOST, 1))
    return F.when(w == "", "UNKNOWN").when(w == "WARNING", "WARN").otherwise(w)


def level_rank(lv: Column) -> Column:
    """P04."""
    out = F.lit(0)
    for name, rank in P.LEVEL_RANK.items():
        if rank:
            out = F.when(lv == name, rank).otherwise(out)
    return out


def stamp_us(line: Column, default_year: int = 2024) -> Column:
    """Microseconds since 1970 of the first stamp form that parses; offsets are honoured, no zone is UTC."""

    def ts(pattern: str, fix=lambda c: c) -> Column:
        return F.unix_micros(F.try_to_timestamp(fix(F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")))))

    secs = F.regexp_extract(line, P.STAMP_SECONDS, 1)
    frac = F.rpad(F.regexp_extract(line, P.STAMP_SECONDS, 2), 6, "0")
    sec_us = F.when(secs != "", secs.cast("bigint") * 1_000_000 + frac.try_cast("bigint"))
    ms = F.regexp_extract(line, P.STAMP_MILLIS, 1)
    ms_us = F.when(ms != "", ms.cast("bigint") * 1000)

    def sane(us: Column) -> Column:
        return F.when(us.between(946_684_800_000_000, 4_102_444_800_000_000), us)

    us_date = F.regexp_replace(F.regexp_extract(line, P.STAMP_US, 1), r"^(\d{2})-(\d{2})-(\d{4})\s+", "$3-$1-$2 ")
    syslog = F.regexp_extract(line, P.STAMP_SYSLOG, 1)
    sys_ts = F.unix_micros(F.try_to_timestamp(F.when(syslog != "", F.concat(F.lit(f"{default_year} "), F.regexp_replace(syslog, r"\s+", " "))), F.lit("yyyy MMM d HH:mm:ss")))
    return F.coalesce(
        ts(P.STAMP_ISO),
        ts(P.STAMP_SPACE, lambda c: F.regexp_replace(F.regexp_replace(c, ",", "."), r"\s+", " ")),
        sys_ts,
        sane(sec_us),
        sane(ms_us),
        ts(P.STAMP_SLASH, lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "/", "-"), ",", "."), r"\s+", " ")),
        F.unix_micros(F.try_to_timestamp(F.nullif(us_date, F.lit("")))),
    )


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_error_line(line: Column) -> Column:
    """P09."""
    return line.rlike("(?i)" + "|".join(P.ERROR_WORDS))


def duration_s(line: Column) -> Column:
    """Seconds of the first duration after a duration word; zero is null."""
    part = lambda g, k: F.coalesce(F.nullif(F.regexp_extract(line, P.DURATION, g), F.lit("")).try_cast("double"), F.lit(0.0)) * k
    return F.when(found(F.lower(line), P.DURATION_SIGN), F.nullif(part(1, 3600.0) + part(2, 60.0) + part(3, 1.0), F.lit(0.0)))


def all_matches(line: Column, pattern: str, *signs: str) -> Column:
    """All matches of a pattern that needs one of the given letters; lines without them skip the regex."""
    some = None
    for x in signs:
        some = line.contains(x) if some is None else some | line.contains(x)
    return F.when(some, F.regexp_extract_all(line, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def anomaly_flags() -> dict[str, Column]:
    """P12."""
    return {k: F.col("line").rlike(p) for k, p in P.ANOMALY.items()}


def anomaly_type(flags: dict[str, Column]) -> Column:
    """First of burst, crash, repeated, resource, slow, ratelimit."""
    out = None
    for k in P.ANOMALY:
        out = F.when(flags[k], k) if out is None else out.when(flags[k], k)
    return out


def anomaly_severity(flags: dict[str, Column], error: Column) -> Column:
    """P13."""
    return (
        F.when(flags["crash"] | flags["burst"], "critical")
        .when(flags["repeated"] | flags["resource"], "high")
        .when(flags["slow"] | flags["ratelimit"], "medium")
        .when(error, "low")
        .otherwise("normal")
    )


def rewrite(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to.replace("\\", "\\\\").replace("$", "\\$"))
    return c


def fingerprint_text(c: Column) -> Column:
    """Thirteen rewrites, stripped, lower case."""
    return F.lower(strip(rewrite(c, P.FINGERPRINT_REWRITES)))


def skeleton(normal: Column) -> Column:
    """Distinct identifier tokens in order of first sight."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(normal, F.lit(P.SKELETON_TOKEN), F.lit(0))), " ")


def cache_text(c: Column) -> Column:
    """X03."""
    return F.lower(strip(rewrite(c, P.CACHE_REWRITES)))


def secret_rules() -> list[tuple[str, str, str]]:
    """The full chain: short IPv6 addresses after full ones."""
    return [*P.SECRET_RULES[:7], P.SECRET_IPV6_SHORT, *P.SECRET_RULES[7:]]


def redact(line: Column, custom: list[tuple[str, str, str]] | None = None) -> Column:
    """Default rules behind the sign that a line may hold a secret, then custom rules on every line."""
    rules = [(p, r) for _, p, r in secret_rules()]
    out = F.when(line.rlike(P.SECRET_SIGN), rewrite(line, rules)).otherwise(line)
    return rewrite(out, [(p, r) for _, p, r in custom]) if custom else out


def trigrams(c: Column) -> Column:
    """Distinct runs of three letters; a shorter text is its own only shingle, an empty one has none. c should be a
    stored column: a lambda evaluates the expression it is given once per shingle."""
    return F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3))))).when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))


def shingles(c: Column, long: int = 5000, letters: int = 2000) -> Column:
    """Trigrams of letters below `long` letters; of longer texts the trigrams of words, with those of the first
    `letters` letters beside them, as the fingerprint is defined."""
    w = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    three = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(c) < long, trigrams(c)).otherwise(F.array_distinct(F.concat(three, trigrams(F.left(c, F.lit(letters))))))


def timeline_us(line: Column, default_year: int = 2024) -> Column:
    """Microseconds of the leftmost stamp of the timeline's forms, in whole seconds and without zone; null where there is none
    or the leftmost one is no date."""
    s = F.regexp_extract(line, P.TIMELINE_STAMP, 1)
    sec = lambda text, fmt: F.unix_seconds(F.try_to_timestamp(text, F.lit(fmt)))
    iso = sec(F.regexp_replace(F.substring(s, 1, 19), "T", " "), "yyyy-MM-dd HH:mm:ss")
    slash = sec(F.regexp_replace(s, r"\s+", " "), "yyyy/MM/dd HH:mm:ss")
    month = F.initcap(F.substring(s, 1, 3))
    syslog = sec(F.concat(F.lit(f"{default_year} "), month, F.lit(" "), F.regexp_replace(F.substring(s, 4, 100), r"^\s+", "").substr(F.lit(1), F.lit(100))), "yyyy MMM d HH:mm:ss")
    unix = s.try_cast("bigint")
    out = (
        F.when(s.rlike(r"^\d{4}-"), iso)
        .when(s.rlike(r"^\d{4}/"), slash)
        .when(s.rlike(r"^\d+$"), F.when(unix > 1_000_000_000_000, F.floor(unix / 1000)).otherwise(unix))
        .when(s != "", syslog)
    )
    return out.cast("bigint") * 1_000_000


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; two empty ones are equal."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total == 0, 1.0).otherwise(common / total)
