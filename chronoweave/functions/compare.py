"""Comparisons of two texts, and what a payload says: Arrow functions, as Spark has no expression for them."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.plans.spelling import damerau


def first_string(payload: str | None) -> str | None:
    if payload is None or not payload.strip():
        return None
    try:
        value = json.loads(payload)
    except (ValueError, RecursionError):
        value = None
    if isinstance(value, dict):
        return next((x.strip() for x in value.values() if isinstance(x, str) and x.strip()), None)
    said = value if isinstance(value, str) else payload
    return said.strip() or None


def first_payload_text(payload: Column) -> Column:
    """The first string that isn't blank of a JSON object, null if it has none; a JSON string; else the payload. Trimmed, null if blank."""

    @F.pandas_udf("string")
    def said(batch: pd.Series) -> pd.Series:
        return pd.Series([first_string(x) for x in batch], dtype="object")

    return said(payload)


def sequence_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """The Ratcliff-Obershelp ratio; 0 where the lengths alone keep it below ``least``; null counts as empty."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = x or "", y or ""
            most = 2 * min(len(x), len(y)) / max(1, len(x) + len(y)) if x or y else 1.0
            out.append(difflib.SequenceMatcher(None, x, y).ratio() if most >= least else 0.0)
        return pd.Series(out, dtype="float64")

    return ratio(a, b)


def damerau_distance(a: Column, b: Column) -> Column:
    """The Damerau-Levenshtein distance; null counts as empty."""

    @F.pandas_udf("long")
    def distance(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([damerau(x or "", y or "") for x, y in zip(left, right, strict=True)], dtype="int64")

    return distance(a, b)


def change_report(before: Column, after: Column, most: int = 8000, small: int = 1500) -> Column:
    """How a text changed: both texts if neither is longer than ``small``, else a unified diff; cut at ``most`` characters."""

    @F.pandas_udf("string")
    def report(old: pd.Series, new: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(old, new, strict=True):
            x, y = x or "", y or ""
            if max(len(x), len(y)) <= small:
                told = f"before:\n{x}\nafter:\n{y}"
            else:
                told = "\n".join(difflib.unified_diff(x.splitlines(), y.splitlines(), "before", "after", lineterm=""))
            out.append(told[:most])
        return pd.Series(out, dtype="object")

    return report(before, after)


def any_useful(*values: Column) -> Column:
    """Whether one of the values says something: not null, blank, ``none`` or an empty list."""
    return F.exists(F.array(*values), lambda v: v.isNotNull() & ~F.lower(F.trim(v)).isin("", "none", "[]"))
