"""Similar texts, comparisons, artifact searches, rendered results and scoped clearing."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.catalog import NOW, activity, facts, load, sessions
from chronoweave.functions import compare
from chronoweave.functions import vector as vec
from chronoweave.operators import curation, enrich, nearest, policies, ranking
from chronoweave.operators.sessions import number_islands, seconds_between
from chronoweave.plans import routes, temporal
from chronoweave.queries.registry import ACT, SESSIONS, registry
from chronoweave.queries.retrieval import MEMORY, tier_events_of
from chronoweave.queries.scalar import Q, WORDS, _query_vector
from chronoweave.sources import sinks
from chronoweave.sources.shared import bound_batches

QUERIES, ORACLES, query = registry()


@query("rows_useful", "SELECT doc_id, len(list_filter([lower(trim(text)), lower(trim(lang)), lower(trim(source))], lambda v: v IS NOT NULL AND v NOT IN ('', 'none', '[]'))) > 0 AS useful FROM documents")
def rows_useful(spark, d):
    return load(spark, d, "documents").select("doc_id", compare.any_useful(F.col("text"), F.col("lang"), F.col("source")).alias("useful"))


@query(
    "render_cap",
    "WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), s AS (SELECT * FROM p ORDER BY ts, event_id LIMIT 20)"
    " SELECT substr('showing ' || count(*) || ' of ' || (SELECT count(*) FROM p) || chr(10) || string_agg('event: ' || event_id || ', user: ' || user_id, chr(10) ORDER BY ts, event_id), 1, 4000) AS shown FROM s",
)
def render_cap(spark, d):
    rows = load(spark, d, "events").where("event_type = 'purchase'")
    line = F.concat(F.lit("event: "), F.col("event_id").cast("string"), F.lit(", user: "), F.col("user_id").cast("string"))
    return ranking.rendered(rows.withColumn("line", line), ["ts", "event_id"], "line", 20, 4000)


@query(
    "context_cap",
    "WITH b AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)"
    " SELECT conv_id, turn, md5(substr(text, 1, CAST(800 - before AS BIGINT))) AS kept FROM b WHERE before < 800",
)
def context_cap(spark, d):
    kept = ranking.within_budget(load(spark, d, "conversations"), "conv_id", "turn", "text", 800)
    return kept.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("kept"))


_SET = f"list_sort(list_distinct({WORDS}))"


@query(
    "join_pairwise_sim",
    f"WITH r AS (SELECT role, turn, conv_id, {_SET} AS ws FROM conversations),"
    " m AS (SELECT *, CASE WHEN len(ws) > 0 THEN md5(array_to_string(ws, ' ')) END AS cls FROM r),"
    " s AS (SELECT role, turn, ws, cls, min(conv_id) AS id FROM m WHERE cls IS NOT NULL GROUP BY role, turn, ws, cls),"
    " p AS (SELECT x.role, x.turn, x.cls AS class_a, x.id AS a, y.cls AS class_b, y.id AS b, len(list_intersect(x.ws, y.ws)) AS i, len(x.ws) + len(y.ws) AS n"
    " FROM s x JOIN s y ON x.role IS NOT DISTINCT FROM y.role AND x.turn IS NOT DISTINCT FROM y.turn AND x.cls < y.cls)"
    " SELECT 'member' AS kind, role, turn, cls AS class_a, conv_id AS a, CAST(NULL AS VARCHAR) AS class_b, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS similarity FROM m"
    " UNION ALL SELECT 'pair', role, turn, class_a, a, class_b, b, round(i / CAST(n - i AS DOUBLE), 5) FROM p WHERE i >= 0.7e0 * (n - i) - 1e-9",
)
def join_pairwise_sim(spark, d):
    """Pairs of classes of equal sets of words, and what is in each class."""
    members, pairs = curation.similar_texts(load(spark, d, "conversations"), ["role", "turn"], "conv_id", "text", 0.7)
    kinds = {"class_b": "string", "b": "bigint", "similarity": "double"}
    each = members.select(F.lit("member").alias("kind"), "role", "turn", F.col("class").alias("class_a"), F.col("item").alias("a"), *(F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
    return each.unionByName(pairs.withColumns({"kind": F.lit("pair"), "similarity": F.round("similarity", 5)}))


@query("fn_first_payload_text", "SELECT event_id, event_type AS said FROM events")
def fn_first_payload_text(spark, d):
    payload = F.to_json(F.struct("event_id", F.lit("  ").alias("blank"), F.col("event_type").alias("kind"), "user_id"))
    return load(spark, d, "events").select("event_id", compare.first_payload_text(payload).alias("said"))


def _neighbours(spark, d, table: str, key: str, value: str):
    """Each value with that of the next key."""
    rows = load(spark, d, table)
    after = rows.select((F.col(key) - 1).alias(key), F.col(value).alias("after"))
    return rows.select(key, F.col(value).alias("before")).join(after, key)


@query("fn_damerau", "SELECT a.p_partkey, damerau_levenshtein(a.p_name, b.p_name) AS edits FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def fn_damerau(spark, d):
    return _neighbours(spark, d, "part", "p_partkey", "p_name").select("p_partkey", compare.damerau_distance(F.col("before"), F.col("after")).alias("edits"))


@query("fn_seq_ratio")
def fn_seq_ratio(spark, d):
    return _neighbours(spark, d, "part", "p_partkey", "p_name").select("p_partkey", compare.sequence_ratio(F.col("before"), F.col("after"), 0.5).alias("ratio"))


@query("fn_unified_diff")
def fn_unified_diff(spark, d):
    bound_batches(spark)
    return _neighbours(spark, d, "pages", "page_id", "html").select("page_id", compare.change_report(F.col("before"), F.col("after")).alias("report"))


@query(
    "rank_url_sessions",
    f"WITH {SESSIONS}, u AS (SELECT user_id, island, min(ts) AS start, avg(CASE WHEN contains(props, '7') THEN 1e0 ELSE 0e0 END) AS kw FROM numbered GROUP BY user_id, island HAVING bool_or(event_type = 'purchase')),"
    f" v AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q}) AS cos FROM embeddings),"
    f" s AS (SELECT user_id, island, round(coalesce(cos, kw) + 0.2e0 * pow(2e0, -(epoch(TIMESTAMP '{NOW}') - epoch(start)) / 86400e0 / 14), 5) AS score FROM u LEFT JOIN v ON vec_id = user_id * 3)"
    " SELECT * FROM (SELECT * FROM s ORDER BY score DESC, user_id, island LIMIT 5) WHERE score >= 0.35e0",
)
def rank_url_sessions(spark, d):
    rows = number_islands(load(spark, d, "events"), "user_id", "ts", 1800)
    share = F.avg(F.contains("props", F.lit("7")).cast("double"))
    found = rows.groupBy("user_id", "island").agg(F.min("ts").alias("start"), share.alias("kw"), F.bool_or(F.col("event_type") == "purchase").alias("url")).where("url")
    near = load(spark, d, "embeddings").crossJoin(F.broadcast(_query_vector(spark, d))).select((F.col("vec_id") / 3).alias("user_id"), vec.cosine("embedding", "q").alias("cos"))
    days = seconds_between(F.to_timestamp_ntz(F.lit(NOW)), F.col("start")) / F.lit(86400.0)
    score = F.round(F.coalesce("cos", "kw") + F.lit(0.2) * vec.half_life(days, 14), 5)
    best = found.join(near, "user_id", "left").select("user_id", "island", score.alias("score"))
    return best.orderBy(F.desc("score"), "user_id", "island").limit(5).where("score >= 0.35")


_SHARE = "(CASE WHEN contains(lower(props), '7') THEN 1 ELSE 0 END + CASE WHEN contains(lower(props), '42') THEN 1 ELSE 0 END) / 2e0"


@query("rank_artifact_clipboard", f"SELECT event_id, {_SHARE} AS score FROM events WHERE event_type = 'purchase' AND {_SHARE} > 0 ORDER BY score DESC, ts DESC, event_id LIMIT 10")
def rank_artifact_clipboard(spark, d):
    copied = load(spark, d, "events").where("event_type = 'purchase'")
    return ranking.artifacts(copied, "props", ["7", "42"], "ts", "event_id", 10).select("event_id", "score")


@query("rank_artifact_screen", f"SELECT event_id, {_SHARE} AS score FROM events WHERE {_SHARE} > 0 ORDER BY score DESC, ts DESC, event_id LIMIT 10")
def rank_artifact_screen(spark, d):
    return ranking.artifacts(load(spark, d, "events"), "props", ["7", "42"], "ts", "event_id", 10, fall_back=False).select("event_id", "score")


@query("rank_artifact_generic", f"WITH {ACT} SELECT event_id, 0e0 AS score FROM act WHERE interesting AND (event_type NOT IN ('view', 'click') OR k >= 90) ORDER BY ts DESC, event_id LIMIT 10")
def rank_artifact_generic(spark, d):
    signal = F.col("interesting") & (~F.col("event_type").isin("view", "click") | (F.col("k") >= 90))
    return ranking.artifacts(activity(spark, d).where(signal), "event_type", [], "ts", "event_id", 10).select("event_id", "score")


def _next_of(held: str, key: str, columns: str, vector: str, source: str) -> str:
    """In SQL the next fact of ``source`` beside the nearest row of all that ``held`` has so far."""
    return (
        f"(SELECT c.{key}, {columns}, o.k AS step, o.fact_id AS new, o.embedding AS x, round(list_cosine_similarity(c.{vector}, o.embedding), 6) AS cos"
        f" FROM {held} w JOIN {source} o ON o.k = w.k + 1 CROSS JOIN recurring.{held} c QUALIFY row_number() OVER (ORDER BY cos DESC, c.{key}) = 1)"
    )


def _flat(held: str, source: str) -> str:
    """In SQL the facts of ``source`` in order: from a cosine of 0.95 with the nearest one on they are left out, from 0.8 on they take its place."""
    return (
        f"{held}(slot, id, v, k) USING KEY (slot) AS (SELECT k, fact_id, embedding, k FROM {source} WHERE k = 1"
        " UNION ALL SELECT CASE WHEN cos >= 0.8e0 THEN slot ELSE step END, CASE WHEN cos >= 0.95e0 THEN id ELSE new END, CASE WHEN cos >= 0.95e0 THEN v ELSE x END, step"
        f" FROM {_next_of(held, 'slot', 'c.id, c.v', 'v', source)})"
    )


#: Clusters that grow: a fact joins the nearest centroid from 0.62 on, which moves by its share, or begins one.
_GROWN = (
    "g(cluster_id, centroid, n, ids, k) USING KEY (cluster_id) AS (SELECT k, embedding, 1, [fact_id], k FROM o WHERE k = 1"
    " UNION ALL SELECT CASE WHEN cos >= 0.62e0 THEN cluster_id ELSE step END, CASE WHEN cos >= 0.62e0 THEN list_transform(list_zip(centroid, x), lambda e: (e[1] * n + e[2]) / (n + 1)) ELSE x END,"
    " CASE WHEN cos >= 0.62e0 THEN n + 1 ELSE 1 END, CASE WHEN cos >= 0.62e0 THEN list_append(ids, new) ELSE [new] END, step"
    f" FROM {_next_of('g', 'cluster_id', 'c.centroid, c.n, c.ids', 'centroid', 'o')})"
)
#: The same with the decision of _flat among the facts of the cluster; centroids are means of what is held.
_MERGED = (
    "h(cluster_id, centroid, held, k) USING KEY (cluster_id) AS (SELECT k, embedding, [struct_pack(id := fact_id, v := embedding)], k FROM o WHERE k = 1"
    " UNION ALL SELECT CASE WHEN cos >= 0.62e0 THEN cluster_id ELSE step END, list_transform(range(1, len(x) + 1), lambda j: list_avg(list_transform(kept, lambda i: i.v[j]))), kept, step FROM (SELECT *,"
    " CASE WHEN cos < 0.62e0 THEN [struct_pack(id := new, v := x)] WHEN list_max(cs) >= 0.95e0 THEN held"
    " WHEN list_max(cs) >= 0.8e0 THEN list_transform(held, lambda i, p: CASE WHEN p = list_position(cs, list_max(cs)) THEN struct_pack(id := new, v := x) ELSE i END)"
    " ELSE list_append(held, struct_pack(id := new, v := x)) END AS kept"
    " FROM (SELECT *, list_transform(held, lambda i: round(list_cosine_similarity(i.v, x), 6)) AS cs"
    f" FROM {_next_of('h', 'cluster_id', 'c.centroid, c.held', 'centroid', 'o')})))"
)


def _routed(clusters: str) -> str:
    return f"SELECT query_id, cluster_id FROM q, {clusters} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(centroid, q), 6) DESC, cluster_id) <= 2"


def _best(name: str, pool: str) -> str:
    return f"SELECT '{name}' AS strategy, query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, fact_id) AS place FROM s {pool} QUALIFY place <= 5"


@query(
    "memory_strategies",
    f"WITH RECURSIVE {MEMORY}, o AS (SELECT row_number() OVER (ORDER BY valid_from, fact_id) AS k, fact_id, embedding FROM fa WHERE embedding IS NOT NULL),"
    " l AS (SELECT row_number() OVER (ORDER BY valid_from, fact_id) AS k, fact_id, embedding FROM fa WHERE embedding IS NOT NULL AND (cluster_id IS NULL OR cluster_id NOT BETWEEN 0 AND 7)),"
    f" {_GROWN}, {_MERGED}, {_flat('f', 'o')}, {_flat('t', 'l')},"
    " q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),"
    f" gr AS ({_routed('g')}), gm AS (SELECT cluster_id, unnest(ids) AS fact_id FROM g), hr AS ({_routed('h')}), hm AS (SELECT cluster_id, unnest(held).id AS fact_id FROM h),"
    " ty AS (SELECT id AS fact_id FROM t"
    " UNION ALL (SELECT fact_id FROM fa WHERE cluster_id BETWEEN 0 AND 6 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY valid_from DESC, fact_id DESC) = 1)"
    " UNION ALL (SELECT fact_id FROM fa WHERE cluster_id = 7 QUALIFY row_number() OVER (PARTITION BY embedding ORDER BY valid_from, fact_id) = 1)),"
    " s AS (SELECT query_id, fact_id, round(list_cosine_similarity(embedding, q), 6) AS cos FROM fa, q) "
    + " UNION ALL ".join(
        _best(name, pool)
        for name, pool in (
            ("append", ""),
            ("clusters", "JOIN gm USING (fact_id) SEMI JOIN gr USING (query_id, cluster_id)"),
            ("merge", "JOIN hm USING (fact_id) SEMI JOIN hr USING (query_id, cluster_id)"),
            ("flat", "SEMI JOIN (SELECT id AS fact_id FROM f) USING (fact_id)"),
            ("typed", "SEMI JOIN ty USING (fact_id)"),
        )
    ),
)
def memory_strategies(spark, d):
    """Five ways to write the same facts in order; labels stand for the typed slots, cosines for the decisions of a language model."""
    known = facts(spark, d).select("fact_id", "cluster_id", "embedding", "valid_from")
    asked = known.where("fact_id % 50 = 0").select(F.col("fact_id").alias("query_id"), F.col("embedding").alias("q"))
    order, decide = ["valid_from", "fact_id"], policies.write_decision(0.95, 0.8)

    def routed(clusters):
        return nearest.nearest_rows(clusters, asked, "slot", "vector", 2).select("query_id", F.col("item").alias("group"))

    written, grown = policies.grown_clusters(known, order, "fact_id", "embedding", 0.62)
    members = known.join(written.select(F.col("item").alias("fact_id"), "slot"), "fact_id")
    merged, means = policies.merged_clusters(known, order, "fact_id", "embedding", decide, 3, 0.62)
    _, flat = policies.folded(known, order, "fact_id", "embedding", decide, 3, 0.8)
    typed = policies.typed_slots(known, order, "fact_id", "embedding", "cluster_id", list(range(7)), [7], "embedding", decide, 3, 0.8)
    found = {
        "append": nearest.nearest_rows(known, asked, "fact_id", "embedding", 5),
        "clusters": nearest.nearest_rows(members, asked, "fact_id", "embedding", 5, "slot", routed(grown)),
        "merge": nearest.nearest_rows(merged, asked, "item", "vector", 5, "cluster", routed(means)),
        "flat": nearest.nearest_rows(flat, asked, "item", "vector", 5),
        "typed": nearest.nearest_rows(typed, asked, "item", "vector", 5),
    }
    out = [best.select(F.lit(name).alias("strategy"), "query_id", F.col("item").alias("fact_id"), "place") for name, best in found.items()]
    return reduce(DataFrame.unionByName, out)


@query(
    "sink_clear_scoped",
    f"WITH {MEMORY}, k AS (SELECT * FROM fa WHERE source <> 'distiller'), m AS (SELECT cluster_id, pos, avg(x) AS m FROM (SELECT cluster_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM k) GROUP BY cluster_id, pos)"
    " SELECT cluster_id, (SELECT count(*) FROM k WHERE k.cluster_id = m.cluster_id) AS fact_count, round(sum(m), 4) AS total FROM m GROUP BY cluster_id",
)
def sink_clear_scoped(spark, d):
    tables = {"events": load(spark, d, "events"), "sessions": sessions(spark, d), "conversations": load(spark, d, "conversations"), "facts": facts(spark, d)}
    left = sinks.cleared(tables, ["events"])
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    return left["clusters"].select("cluster_id", "fact_count", F.round(total, 4).alias("total"))


@query(
    "tier2_pluggable",
    "WITH l AS (SELECT event_id, value, event_type, list_filter([lag(event_type, 3) OVER w, lag(event_type, 2) OVER w, lag(event_type) OVER w], lambda x: x IS NOT NULL) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
    " SELECT event_id, CASE WHEN value >= 28 THEN 'interesting' WHEN value < 8 THEN 'not_interesting' WHEN len(before) = 0 THEN NULL WHEN list_contains(before, event_type) THEN 'not_interesting' ELSE 'interesting' END AS verdict FROM l",
)
def tier2_pluggable(spark, d):
    first = F.when(F.col("value") >= 28, "interesting").when(F.col("value") < 8, "not_interesting")
    return enrich.tier2(load(spark, d, "events").withColumn("verdict", first), "user_id", ["ts", "event_id"], "event_type").select("event_id", "verdict")


@query(
    "plan_multi_route",
    f"WITH {ACT}, {SESSIONS} SELECT 0 AS place, 'time_anchored' AS route, * FROM (SELECT event_id AS item, ts AS at FROM act WHERE interesting AND (event_type NOT IN ('view', 'click') OR k >= 90)"
    " AND ts >= TIMESTAMP '2024-01-28 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' ORDER BY ts, event_id LIMIT 30)"
    " UNION ALL SELECT 1, 'topic_search', user_id, window_start FROM sess WHERE window_start >= TIMESTAMP '2024-01-28 00:00:00' AND window_start < TIMESTAMP '2024-01-31 00:00:00'",
)
def plan_multi_route(spark, d):
    asked = temporal.resolve("the last 3 days", datetime.fromisoformat(NOW))  # once, for all routes
    start, end = (F.to_timestamp_ntz(F.lit(str(x))) for x in (asked.start, asked.end))
    found = tier_events_of(activity(spark, d), str(asked.start), str(asked.end), 30).select(F.col("event_id").alias("item"), F.col("ts").alias("at"))
    held = sessions(spark, d).where((F.col("window_start") >= start) & (F.col("window_start") < end)).select(F.col("user_id").alias("item"), F.col("window_start").alias("at"))
    return routes.together([("time_anchored", found), ("topic_search", held)])
