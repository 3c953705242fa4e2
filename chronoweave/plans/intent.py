"""What a question is after: recency, kind of artifact, route."""

from __future__ import annotations

import re

_ARTIFACTS = {
    "clipboard": r"\b(clipboard|copied|copy)\b",
    "paste": r"\bpast(e|ed|ing)\b",
    "url": r"\b(url|link|website|site|page)s?\b",
    "screen": r"\b(screen|screenshot|seen|saw)s?\b",
}
_ROUTES = {
    "aggregation": r"\b(how (many|much|long|often)|count|total|average|most)\b",
    "specific_recall": r"\b(screenshot|clipboard|copied|pasted|link|url|website)\b",
    "memory_query": r"\b(my (name|job|preference|favou?rite)|do you (know|remember)|about me)\b",
    "time_anchored": r"\b(today|yesterday|last|this (morning|week|month)|ago|on (mon|tues|wednes|thurs|fri|satur|sun)day)\b",
    "casual": r"^\s*(hi|hello|hey|thanks|thank you)\b",
}


def recency(text: str) -> str | None:
    """``window`` for an explicit recent window, ``soft`` for a hint at recency, else None."""
    low = text.lower()
    if re.search(r"\b(last|past)\s+(\d+\s+)?(minute|hour|day|week)s?\b", low):
        return "window"
    return "soft" if re.search(r"\b(recent(ly)?|latest|just now|lately)\b", low) else None


def artifact(text: str) -> str:
    """The first kind of artifact that the question names, else ``generic``."""
    return next((kind for kind, pattern in _ARTIFACTS.items() if re.search(pattern, text.lower())), "generic")


def route(text: str) -> str:
    """The route of a question by rules, in order; ``topic_search`` if none applies."""
    return next((name for name, pattern in _ROUTES.items() if re.search(pattern, text.lower())), "topic_search")
