"""Fingerprints, secrets, orders hidden in text, markup, JSON repair: text transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import line_columns as L
from timberline.functions import patterns as P


def fingerprints(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Normal text, skeleton, digests. Null texts give null; empty ones the digest of nothing."""
    n = L.fingerprint_text(F.col(text))
    return texts.select(
        key,
        n.alias("normalized"),
        L.skeleton(n).alias("skeleton"),
        F.sha2(n, 256).alias("fingerprint"),
        F.sha2(L.cache_text(F.col(text)), 256).alias("cache_key"),
        F.md5(text).alias("content_key"),
    )


def audit(lines: DataFrame) -> DataFrame:
    """Matches per rule, counted on the text as it stands when the rule's turn comes."""
    c = F.col("line")
    out = []
    for name, pattern, to in L.secret_rules():
        out.append(F.struct(F.lit(name).alias("rule"), F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).alias("n")))
        c = F.regexp_replace(c, pattern, to)
    hit = lines.where(F.col("line").rlike(P.SECRET_SIGN)).select(F.explode(F.array(*out)).alias("x"))
    return hit.where("x.n > 0").groupBy(F.col("x.rule").alias("rule")).agg(F.sum("x.n").alias("n"))


def secret_rows(lines: DataFrame) -> DataFrame:
    """doc_id, pos, rule, place (of the match in the line as it stands when the rule's turn comes, from 0), hash of the match's
    first eight letters. The match itself is not kept."""
    def letters(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))

    def rows(name: str, c: Column, pattern: str) -> Column:
        found, between = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)

        def one(m: Column, i: Column) -> Column:
            at = letters(F.slice(between, F.lit(1), i + 1)) + letters(F.slice(found, F.lit(1), i))
            return F.struct(F.lit(name).alias("rule"), at.alias("place"), F.sha2(F.left(m, F.lit(8)), 256).alias("hash"))

        return F.transform(found, one)

    c, out = F.col("line"), []
    for name, pattern, to in L.secret_rules():
        out.append(rows(name, c, pattern))
        c = F.regexp_replace(c, pattern, to)
    hit = lines.where(F.col("line").rlike(P.SECRET_SIGN))
    return hit.select("doc_id", "pos", F.explode(F.concat(*out)).alias("x")).select("doc_id", "pos", "x.*")


def redacted_lines(lines: DataFrame) -> DataFrame:
    """X11 on each line."""
    return lines.select("doc_id", "pos", L.redact(F.col("line")).alias("line"))


def redacted_records(records: DataFrame) -> DataFrame:
    """Content line by line, each error line, string metadata values."""

    def each(text: Column) -> Column:
        return F.array_join(F.transform(F.split(text, "\n", -1), lambda s: L.redact(s)), "\n")

    return records.withColumns(
        {
            "content": each(F.col("content")),
            "error_lines": F.transform("error_lines", each),
            "metadata": F.transform_values("metadata", lambda _, v: each(v)),
        }
    )


def sanitized(texts: DataFrame, key: str, text: str, longest_line: int = 2000) -> DataFrame:
    """Texts with a tripwire have long lines cut and orders replaced by [REDACTED]; others stay as they are. attempts:
    name and count of each pattern found."""
    c = F.col(text)
    gate = F.lit(False)
    for w in P.TRIPWIRES:
        gate = gate | F.lower(c).contains(w)
    cut = F.array_join(F.transform(F.split(c, "\n", -1), lambda s: F.when(F.length(s) > longest_line, F.concat(F.substring(s, 1, longest_line), F.lit("...[TRUNCATED]"))).otherwise(s)), "\n")
    found = F.array()
    for name, pattern in P.INJECTIONS:
        n = F.size(F.regexp_extract_all(cut, F.lit(pattern), F.lit(0)))
        found = F.concat(found, F.when(n > 0, F.array(F.struct(F.lit(name).alias("name"), n.alias("n")))).otherwise(F.array()))
        cut = F.regexp_replace(cut, pattern, "[REDACTED]")
    return texts.select(key, F.when(gate, cut).otherwise(c).alias("cleaned"), F.when(gate, found).otherwise(F.slice(found, 1, 0)).alias("attempts"), (gate & (cut != c)).alias("was_modified"))


def attempt_rows(clean: DataFrame, key: str) -> DataFrame:
    """Key, name, severity, n of the orders found in a text. clean: as sanitized gives it."""
    by = {n: k for k, names in P.INJECTION_SEVERITY.items() for n in names}
    severity = F.create_map(*(F.lit(x) for p in by.items() for x in p))
    x = clean.select(key, F.explode("attempts").alias("a")).select(key, "a.*")
    return x.select(key, "name", F.coalesce(severity[F.col("name")], F.lit("low")).alias("severity"), F.col("n").cast("bigint").alias("n"))


def strip_markup(c: Column, passes: int = 5) -> Column:
    """Tags out and five entities read, to a fixpoint within five passes."""
    for _ in range(passes):
        c = F.regexp_replace(c, "<[^>]*>", "")
        for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'")):
            c = F.replace(c, F.lit(a), F.lit(b))
    return L.strip(c)


def parsed_json(c: Column, schema: str) -> Column:
    """JSON in a code fence or amid text: as it is, else the widest {...}."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    wide = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    first = F.from_json(bare, schema, {"mode": "PERMISSIVE"})
    ok = F.get_json_object(bare, "$").isNotNull()
    return F.when(ok, first).otherwise(F.from_json(F.nullif(wide, F.lit("")), schema))


def repaired_probabilities(p: Column) -> Column:
    """An array of numbers scaled to a sum of 100 and rounded half to even, the rest to the first; empty and zero
    sums stay."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    scaled = F.transform(p, lambda x: F.bround(x * 100 / total, 0).cast("int"))
    rest = 100 - F.aggregate(scaled, F.lit(0), lambda a, x: a + x)
    return F.when((F.size(p) > 0) & (total > 0), F.transform(scaled, lambda x, i: F.when(i == 0, x + rest).otherwise(x))).otherwise(F.transform(p, lambda x: x.cast("int")))


RESULT = (
    "error_summary string, severity string, root_causes array<struct<description:string,probability:double>>, "
    "fix_suggestions array<struct<title:string,description:string,command:string>>, debug_commands array<string>, prevention array<string>"
)


def commands(r: Column) -> Column:
    """Commands of a parsed result, of fixes first, then of debugging; trimmed, blank ones left out, order kept."""
    none = F.array().cast("array<string>")
    fixes = F.coalesce(F.transform(r["fix_suggestions"], lambda x: F.trim(F.coalesce(x["command"], F.lit("")))), none)
    debug = F.coalesce(F.transform(r["debug_commands"], lambda x: F.trim(F.coalesce(x, F.lit("")))), none)
    return F.filter(F.concat(fixes, debug), lambda x: x != "")


def valid_result(r: Column) -> Column:
    """Probabilities of one to five causes sum to 100, one to four fixes, at most five commands and three measures."""
    total = F.aggregate(F.transform(r["root_causes"], lambda x: F.coalesce(x["probability"], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    ok = (F.abs(total - 100) < 1e-6) & F.size(r["root_causes"]).between(1, 5) & F.size(r["fix_suggestions"]).between(1, 4)
    return F.coalesce(ok & (F.size(F.coalesce(r["debug_commands"], F.array())) <= 5) & (F.size(F.coalesce(r["prevention"], F.array())) <= 3), F.lit(False))


def severity_hint(errors: Column, fatals: Column) -> Column:
    """P29."""
    return F.when(fatals > 0, "critical").when(errors >= 5, "high").when(errors >= 1, "medium").otherwise("low")


def size_class(chars: Column) -> Column:
    """Letters in kilobytes by the bounds 10, 50, 200, 500, 1000."""
    kb = chars / 1024
    return F.when(kb < 10, "tiny").when(kb < 50, "small").when(kb < 200, "medium").when(kb < 500, "large").when(kb < 1000, "huge").otherwise("extreme")


def token_estimate(c: Column) -> Column:
    """A quarter of the letters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("bigint")
