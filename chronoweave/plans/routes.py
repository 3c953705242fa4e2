"""Which routes a question takes by the scores of a classifier, and their results together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A route fetches from this score on; casual talk never does.
FETCH_FROM = {"memory_query": 0.55, "time_anchored": 0.55, "specific_recall": 0.30, "topic_search": 0.25}
SECOND_FROM = 0.20


@dataclass(frozen=True)
class Decision:
    primary: str
    score: float
    others: dict[str, float] = field(default_factory=dict)


def decide(text: str, classify: Callable[[str], dict[str, float]] | None) -> Decision | None:
    """The route with the highest score, and the others from 0.20 on; None without a classifier."""
    scores = classify(text) if classify else {}
    if not scores:
        return None
    ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    return Decision(*ranked[0], {name: score for name, score in ranked[1:] if score >= SECOND_FROM})


def fetching(decision: Decision | None) -> list[str]:
    """The routes to fetch before the answer: those of a decision that reach their own least score, best first."""
    if decision is None or decision.primary == "casual":
        return []
    routes = {decision.primary: decision.score, **decision.others}
    return [name for name, score in routes.items() if score >= FETCH_FROM.get(name, float("inf"))]


def together(results: list[tuple[str, DataFrame]]) -> DataFrame:
    """The rows of the routes' results, which share their columns, with the route and its place."""
    out = None
    for place, (name, found) in enumerate(results):
        named = found.select(F.lit(place).alias("place"), F.lit(name).alias("route"), "*")
        out = named if out is None else out.unionByName(named)
    if out is None:
        raise ValueError("no route")
    return out
