"""Phrases of time to half-open ranges."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

#: Fixed values.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
UNIT_HOURS = {"hour": 1, "day": 24, "week": 168, "month": 720}


@dataclass(frozen=True)
class TimeRange:
    phrase: str
    start: datetime
    end: datetime
    granularity: str


def _day(at: datetime) -> datetime:
    return at.replace(hour=0, minute=0, second=0, microsecond=0)


def month_bounds(at: datetime, offset: int = 0) -> tuple[datetime, datetime]:
    first = lambda n: datetime(n // 12, n % 12 + 1, 1)
    n = at.year * 12 + at.month - 1 + offset
    return first(n), first(n + 1)


def week_bounds(at: datetime, offset: int = 0) -> tuple[datetime, datetime]:
    """From Monday to Monday."""
    start = _day(at) - timedelta(days=at.weekday()) + timedelta(weeks=offset)
    return start, start + timedelta(weeks=1)


def resolve(text: str, now: datetime) -> TimeRange | None:
    """The range that a question asks about, cut at ``now``; None if it names none, or one to come."""
    low = text.lower()
    found = _instant(low) or _rolling(low, now) or _calendar(low, now)
    if found is None or found.start >= now or re.search(r"\b(tomorrow|next (week|month|year))\b", low):
        return None
    return TimeRange(found.phrase, found.start, min(found.end, now), found.granularity)


def _instant(low: str) -> TimeRange | None:
    m = re.search(r"(\d{1,2})/(\d{1,2})/(\d{4})(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(am|pm)?)?", low)
    iso = re.search(r"(\d{4})-(\d{2})-(\d{2})", low)
    if m:
        month, day, year = int(m[1]), int(m[2]), int(m[3])
        if m[4] is None:
            start = datetime(year, month, day)
            return TimeRange(m[0], start, start + timedelta(days=1), "day")
        hour = int(m[4]) % 12 + (12 if m[7] == "pm" else 0) if m[7] else int(m[4])
        at, slack = datetime(year, month, day, hour, int(m[5]), int(m[6] or 0)), timedelta(seconds=2 if m[6] else 60)
        return TimeRange(m[0], at - slack, at + slack, "instant")
    if iso:
        start = datetime(int(iso[1]), int(iso[2]), int(iso[3]))
        return TimeRange(iso[0], start, start + timedelta(days=1), "day")
    return None


def _rolling(low: str, now: datetime) -> TimeRange | None:
    if m := re.search(r"\b(?:last|past)\s+(\d+)\s+(hour|day|week|month)s?\b", low):
        return TimeRange(m[0], now - timedelta(hours=int(m[1]) * UNIT_HOURS[m[2]]), now, m[2])
    if m := re.search(r"\b(\d+)\s+(day|week)s?\s+ago\b", low):
        start = _day(now - timedelta(hours=int(m[1]) * UNIT_HOURS[m[2]]))
        return TimeRange(m[0], start, start + timedelta(days=1), "day")
    return None


def _calendar(low: str, now: datetime) -> TimeRange | None:
    today = _day(now)
    days = {"today": 0, "yesterday": -1}
    for word, offset in days.items():
        if re.search(rf"\b{word}\b", low):
            return TimeRange(word, today + timedelta(days=offset), today + timedelta(days=offset + 1), "day")
    if m := re.search(r"\b(this|last)\s+weekend\b", low):
        start = week_bounds(now, 0 if m[1] == "this" or now.weekday() >= 5 else -1)[0] + timedelta(days=5)
        return TimeRange(m[0], start, start + timedelta(days=2), "weekend")
    if m := re.search(r"\b(this|last)\s+(week|month)\b", low):
        bounds = week_bounds if m[2] == "week" else month_bounds
        return TimeRange(m[0], *bounds(now, 0 if m[1] == "this" else -1), m[2])
    for k, name in enumerate(WEEKDAYS):
        if re.search(rf"\b{name}\b", low):
            start = today - timedelta(days=(now.weekday() - k) % 7)
            return TimeRange(name, start, start + timedelta(days=1), "day")
    for k, name in enumerate(MONTHS):
        if re.search(rf"\b(?:in|during|last|this)\s+{name}\b", low):
            year = now.year if k < now.month else now.year - 1
            return TimeRange(name, *month_bounds(datetime(year, k + 1, 1)), "month")
    return None


def select_tier(found: TimeRange, now: datetime) -> str:
    """Which store answers a range: events for two hours or less within a week, sessions within 90 days, else facts."""
    if found.start > now:
        return "none"
    if (found.end - found.start) <= timedelta(hours=2) and found.start >= now - timedelta(days=7):
        return "events"
    return "sessions" if found.start >= now - timedelta(days=90) else "facts"
