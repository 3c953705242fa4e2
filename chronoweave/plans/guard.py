"""Ad-hoc SELECT statements: what is let through."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Words that no statement may hold, not even in a literal.
BLOCKED = ["insert", "update", "delete", "drop", "alter", "create", "replace", "truncate", "attach", "detach", "pragma"]
_BLOCKED = re.compile(r"\b(" + "|".join(BLOCKED) + r")\b", re.IGNORECASE)


def is_select(sql: str) -> bool:
    """Whether the text begins with SELECT and holds no blocked word."""
    return sql.strip().lower().startswith("select") and not _BLOCKED.search(sql)


def where_fragment(sql: str) -> str | None:
    """What stands between the first WHERE and ORDER BY, LIMIT or the end."""
    found = re.search(r"\bwhere\b(.*?)(?:\border\s+by\b|\blimit\b|;|$)", sql, re.IGNORECASE | re.DOTALL)
    return found[1].strip() or None if found else None


def run_select(spark: SparkSession, sql: str, heavy: tuple[str, ...] = ("payload", "embedding")) -> DataFrame:
    """The rows of a guarded statement without heavy columns."""
    if not is_select(sql):
        raise ValueError("only SELECT statements are allowed")
    df = spark.sql(sql)
    return df.drop(*[c for c in heavy if c in df.columns])
