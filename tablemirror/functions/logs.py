"""Query-log and access-log functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statements longer than these characters cost so much more.
LONG_SQL = ((5000, 2), (2000, 1))
#: Base cost of a request by category.
BASE_COST = {"auth": 1, "monitoring": 1, "query": 2, "read": 1, "write": 3}
_READS = ("select", "show", "describe", "desc", "explain")
_WRITES = ("insert", "update", "delete", "replace", "create", "alter", "drop", "truncate", "rename", "grant", "revoke", "load", "merge")


def normalize_sql(sql: Column) -> Column:
    """A statement's pattern: literals become ``?``, blanks one space."""
    out = F.regexp_replace(sql, r"'(?:[^'\\]|\\.)*'", "?")
    out = F.regexp_replace(out, r'"(?:[^"\\]|\\.)*"', "?")
    out = F.regexp_replace(out, r"\b\d+(?:\.\d+)?\b", "?")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def pattern_stats(log: DataFrame, pattern: str, duration: str, at: str, top: int = 100) -> DataFrame:
    """Count, mean, least and most duration and last run per pattern, for the most frequent ones."""
    found = log.groupBy(F.col(pattern).alias("pattern")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg(duration), 3).alias("avg_ms"),
        F.min(duration).alias("min_ms"),
        F.max(duration).alias("max_ms"),
        F.max(at).alias("last_run"),
    )
    return found.orderBy(F.col("runs").desc(), "pattern").limit(top)


def bare_sql(sql: Column) -> Column:
    """A statement without comments, with strings and quoted names emptied, in lower case."""
    out = F.regexp_replace(sql, r"(?s)'(?:[^'\\]|\\.|'')*'", "''")
    out = F.regexp_replace(out, r'(?s)"(?:[^"\\]|\\.)*"', '""')
    out = F.regexp_replace(out, r"`[^`]*`", "``")
    out = F.regexp_replace(out, r"(?s)/\*.*?\*/", " ")
    out = F.regexp_replace(out, r"(?:--[ \t][^\n]*|--$|#[^\n]*)", " ")
    return F.lower(F.trim(F.regexp_replace(out, r"\s+", " ")))


def classify_statement(sql: Column) -> Column:
    """``read``, ``write`` or ``other``.

    A read is one statement that starts with a reading keyword; EXPLAIN ANALYZE, which
    runs its statement, writing SELECTs (INTO, FOR UPDATE) and WITH are no reads.
    """
    bare = F.regexp_replace(bare_sql(sql), r"[;\s]+$", "")
    first = F.regexp_extract(bare, r"^\(*\s*([a-z]+)", 1)
    runs = bare.rlike(r"^(?:explain|desc|describe)\s+analyze\b")
    writing = bare.rlike(r"\binto\s+(?:outfile|dumpfile|@)|\bfor\s+(?:update|share)\b|\block\s+in\s+share\s+mode\b")
    several = bare.contains(";")
    return (
        F.when(first.isin(*_WRITES), "write")
        .when(first.isin(*_READS) & ~several & ~runs & ~writing, "read")
        .otherwise("other")
    )


def classify_endpoint(method: Column, path: Column) -> Column:
    """Quota category of a request; NULL where none applies."""
    verb = F.upper(method)
    plain = F.regexp_replace(F.regexp_extract(path, r"^([^?#]*)", 1), r"/+$", "")
    return (
        F.when(verb == "OPTIONS", F.lit(None))
        .when(plain.rlike(r"^/(?:api/)?(?:auth|login|logout|token)(?:/|$)"), "auth")
        .when(plain.rlike(r"^/(?:api/)?(?:health|metrics|status|stats|logs)(?:/|$)"), "monitoring")
        .when(plain.rlike(r"^/(?:api/)?query(?:/|$)"), "query")
        .when(~plain.startswith("/"), F.lit(None))
        .when(verb.isin("GET", "HEAD"), "read")
        .when(verb.isin("POST", "PUT", "PATCH", "DELETE"), "write")
    )


def request_cost(category: Column, sql: Column) -> Column:
    """Base cost of the category, and more for a long statement."""
    base = F.coalesce(*[F.when(category == k, v) for k, v in BASE_COST.items()], F.lit(1))
    size, extra = F.coalesce(F.char_length(sql), F.lit(0)), F.lit(0)
    for least, more in sorted(LONG_SQL):
        extra = F.when(size > least, more).otherwise(extra)
    return (base + F.when(category == "query", extra).otherwise(0)).cast("int")
