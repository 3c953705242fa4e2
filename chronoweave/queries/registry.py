"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: The activity view in SQL, for the oracles.
ACT = """act AS (
  SELECT event_id, ts, user_id, 'app' || (user_id % 10) AS process_name, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value >= 20 AS interesting
  FROM events
)"""

#: Sessions of users in SQL.
SESSIONS = """marked AS (
  SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800 THEN 1 ELSE 0 END AS starts FROM events
), numbered AS (
  SELECT *, CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS island FROM marked
), sess AS (
  SELECT user_id, island, min(ts) AS window_start, max(ts) AS window_end, count(*) AS event_count FROM numbered GROUP BY user_id, island
)"""


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(function: Query) -> Query:
            queries[name] = function
            if sql:
                oracles[name] = sql
            return function

        return keep

    return queries, oracles, query
