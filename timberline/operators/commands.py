"""Safety of shell commands: two flavours of rules and a summary per group. Nothing is ever run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import patterns as P

#: A command whose quotes and backslashes close, as a POSIX shell reads it. Possessive, so that long commands need no stack.
_CLOSED = r"(?s)\A(?:[^\\'\"]++|\\.|'[^']*+'|\"(?:[^\"\\]++|\\.)*+\")*+\z"


def closed(c: Column) -> Column:
    return c.rlike(_CLOSED)


def _any(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def gate(command: Column) -> Column:
    """X17: "empty", "syntax", "blocked", "review" or "safe"; null for null."""
    return (
        F.when(command.isNull(), F.lit(None).cast("string"))
        .when(F.trim(command) == "", "empty")
        .when(~closed(command), "syntax")
        .when(_any(command, P.COMMANDS_BLOCKED), "blocked")
        .when(_any(command, P.COMMANDS_REVIEWED), "review")
        .otherwise("safe")
    )


def classified(command: Column) -> Column:
    """struct(level, category) of a command that is not blank; null else. The first rule that is found counts, then a
    bare sudo outside of containers, then writes to the system's folders."""
    c = F.trim(command)
    none = F.lit(None).cast("string")
    out = F.when(~closed(c), F.struct(F.lit("review").alias("level"), none.alias("category")))
    for pattern, level, category in P.COMMAND_CLASSES:
        out = out.when(c.rlike(pattern), F.struct(F.lit(level).alias("level"), F.lit(category).alias("category")))
    risky = c.rlike(P.COMMAND_SUDO) & ~F.lower(c).contains("docker") | c.rlike(P.COMMAND_SYSTEM_WRITE)
    out = out.when(risky, F.struct(F.lit("review").alias("level"), F.lit("privilege_escalation").alias("category")))
    return F.when(c != "", out.otherwise(F.struct(F.lit("safe").alias("level"), none.alias("category"))))


def summary(commands: DataFrame, by: str, command: str) -> DataFrame:
    """Per group the counts by level and the worst level; blank and null commands count for nothing."""
    level = classified(F.col(command))["level"]
    g = commands.select(by, level.alias("level")).where("level is not null").groupBy(by)
    n = {k: F.count_if(F.col("level") == k).alias(k) for k in ("safe", "review", "dangerous")}
    worst = F.when(F.col("dangerous") > 0, "dangerous").when(F.col("review") > 0, "review").otherwise("safe")
    return g.agg(*n.values()).withColumn("overall", worst)
