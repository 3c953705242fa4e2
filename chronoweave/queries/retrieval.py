"""Retrieval, enrichment and memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.catalog import NOW, activity, clusters, facts, load
from chronoweave.functions import vector as vec
from chronoweave.operators import enrich, joins, ranking, scans
from chronoweave.operators.sessions import seconds_between
from chronoweave.queries.registry import ACT, registry
from chronoweave.queries.scalar import Q, WORDS, _query_vector
from chronoweave.sources.shared import scratch

QUERIES, ORACLES, query = registry()
TERMS = ["trash", "und", "que"]
#: Clusters and facts in SQL.
MEMORY = """cl AS (
  SELECT label AS cluster_id, list(m ORDER BY pos) AS centroid, max(n) AS fact_count FROM (
    SELECT label, pos, avg(x) AS m, count(*) AS n
    FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY label, pos
  ) GROUP BY label
), fa AS (
  SELECT vec_id AS fact_id, label AS cluster_id, CAST(embedding AS DOUBLE[]) AS embedding,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(vec_id % 700 AS INTEGER)) AS valid_from,
         CASE WHEN label <= 2 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(vec_id % 700 AS INTEGER)) + INTERVAL 10 DAY END AS valid_to,
         CASE WHEN label % 2 = 0 THEN 'distiller' ELSE 'agent' END AS source
  FROM embeddings
)"""


def tier_events_of(df, start: str, end: str, k: int):
    """The first ``k`` interesting events of a half-open range that aren't noise."""
    signal = ~F.col("event_type").isin("view", "click") | (F.col("k") >= 90)
    inside = (F.col("ts") >= F.to_timestamp_ntz(F.lit(start))) & (F.col("ts") < F.to_timestamp_ntz(F.lit(end)))
    return df.where(F.col("interesting") & signal & inside).orderBy("ts", "event_id").limit(k)


@query(
    "tier_events",
    f"WITH {ACT} SELECT event_id, ts, event_type, value FROM act WHERE interesting AND (event_type NOT IN ('view', 'click') OR k >= 90)"
    " AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00' ORDER BY ts, event_id LIMIT 30",
)
def tier_events(spark, d):
    found = tier_events_of(activity(spark, d), "2024-01-10 00:00:00", "2024-01-11 00:00:00", 30)
    return found.select("event_id", "ts", "event_type", "value")


@query("index_maintain", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY term")
def index_maintain(spark, d):
    index = ranking.postings(load(spark, d, "documents"), "doc_id", "text")
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_BM25 = (
    f"WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), f AS (SELECT doc_id, CAST(len(ws) AS DOUBLE) AS dl, "
    + ", ".join(f"CAST(len(list_filter(ws, lambda x: x = '{t}')) AS DOUBLE) AS f{i}" for i, t in enumerate(TERMS))
    + " FROM w), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS mean, "
    + ", ".join(f"CAST(count(*) FILTER (WHERE f{i} > 0) AS DOUBLE) AS n{i}" for i in range(len(TERMS)))
    + " FROM f), p AS (SELECT doc_id, "
    + " + ".join(
        f"CASE WHEN ln((n - n{i} + 0.5e0) / (n{i} + 0.5e0)) > 0 THEN ln((n - n{i} + 0.5e0) / (n{i} + 0.5e0)) ELSE 1e-6 END"
        f" * f{i} * 2.2e0 / (f{i} + 1.2e0 * (0.25e0 + 0.75e0 * dl / mean))"
        for i in range(len(TERMS))
    )
    + " AS score FROM f, s WHERE f0 + f1 + f2 > 0)"
)


@query("rank_bm25", _BM25 + " SELECT doc_id, round(score, 5) AS score FROM p ORDER BY p.score DESC, doc_id LIMIT 20")
def rank_bm25(spark, d):
    return ranking.bm25(load(spark, d, "documents"), "doc_id", "text", TERMS).select("doc_id", F.round("score", 5).alias("score"))


@query(
    "rank_url_events",
    f"WITH {ACT}, c AS (SELECT * FROM act WHERE interesting AND event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 20), m AS (SELECT min(ts) AS lo, max(ts) AS hi FROM c)"
    " SELECT event_id, round(value + 0.4e0 * (epoch(ts) - epoch(lo)) / greatest(epoch(hi) - epoch(lo), 1e0), 5) AS score FROM c, m ORDER BY score DESC, event_id LIMIT 5",
)
def rank_url_events(spark, d):
    top = activity(spark, d).where("interesting and event_type = 'purchase'").orderBy(F.desc("value"), "event_id").limit(20)
    scored = ranking.recency_in_set(top, "ts").select("event_id", F.round(F.col("value") + F.lit(0.4) * F.col("recency"), 5).alias("score"))
    return scored.orderBy(F.desc("score"), "event_id").limit(5)


@query(
    "win_minmax_norm",
    "WITH c AS (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 20), m AS (SELECT min(ts) AS lo, max(ts) AS hi FROM c)"
    " SELECT event_id, round((epoch(ts) - epoch(lo)) / greatest(epoch(hi) - epoch(lo), 1e0), 5) AS recency FROM c, m",
)
def win_minmax_norm(spark, d):
    top = load(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(20)
    return ranking.recency_in_set(top, "ts").select("event_id", F.round("recency", 5).alias("recency"))


@query("rank_sessions_semantic", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q}), 5) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q}) DESC, vec_id LIMIT 20")
def rank_sessions_semantic(spark, d):
    scored = load(spark, d, "embeddings").crossJoin(F.broadcast(_query_vector(spark, d))).select("vec_id", vec.cosine("embedding", "q").alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(20).select("vec_id", F.round("score", 5).alias("score"))


@query(
    "rank_event_hybrid",
    f"WITH s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q}) AS cos, label / 9e0 AS kw FROM embeddings),"
    " t AS (SELECT vec_id, 0.96e0 * (0.78e0 * cos + 0.22e0 * kw) + 0.04e0 * pow(2e0, -vec_id / 24e0 / 30e0) AS score FROM s WHERE cos <> 0 OR kw <> 0)"
    " SELECT vec_id, round(score, 5) AS score FROM t ORDER BY t.score DESC, vec_id LIMIT 20",
)
def rank_event_hybrid(spark, d):
    rows = load(spark, d, "embeddings").crossJoin(F.broadcast(_query_vector(spark, d)))
    parts = rows.select("vec_id", vec.cosine("embedding", "q").alias("cos"), (F.col("label") / F.lit(9.0)).alias("kw")).where("cos != 0 or kw != 0")
    fresh = vec.half_life(F.col("vec_id") / F.lit(24.0), 30)
    score = F.lit(0.96) * (F.lit(0.78) * F.col("cos") + F.lit(0.22) * F.col("kw")) + F.lit(0.04) * fresh
    return parts.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(20).select("vec_id", F.round("score", 5).alias("score"))


@query("topk_then_threshold", f"SELECT * FROM (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q}), 5) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 5) WHERE score >= 0.35")
def topk_then_threshold(spark, d):
    rows = load(spark, d, "embeddings").crossJoin(F.broadcast(_query_vector(spark, d))).select("vec_id", F.round(vec.cosine("embedding", "q"), 5).alias("score"))
    return rows.orderBy(F.desc("score"), "vec_id").limit(5).where("score >= 0.35")


@query(
    "win_topk_per_group",
    f"SELECT label, vec_id, place FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q}), 6) DESC, vec_id) AS place FROM embeddings) WHERE place <= 5",
)
def win_topk_per_group(spark, d):
    rows = load(spark, d, "embeddings").crossJoin(F.broadcast(_query_vector(spark, d))).withColumn("score", F.round(vec.cosine("embedding", "q"), 6))
    return ranking.top_per_group(rows, "label", "score", "vec_id", 5).select("label", "vec_id", F.col("place").cast("long").alias("place"))


@query("agg_vector_mean", f"WITH {MEMORY} SELECT cluster_id, fact_count, round(list_sum(centroid), 4) AS total, len(centroid) AS dim FROM cl")
def agg_vector_mean(spark, d):
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    return clusters(spark, d).select("cluster_id", "fact_count", F.round(total, 4).alias("total"), F.size("centroid").cast("long").alias("dim"))


@query("centroid_recompute", f"WITH {MEMORY} SELECT cluster_id, round(sqrt(list_sum(list_transform(centroid, lambda x: x * x))), 5) AS length FROM cl")
def centroid_recompute(spark, d):
    return clusters(spark, d).select("cluster_id", F.round(vec.norm("centroid"), 5).alias("length"))


@query(
    "join_nearest_centroid",
    f"WITH {MEMORY}, s AS (SELECT fact_id, cl.cluster_id, list_cosine_similarity(fa.embedding, cl.centroid) AS cos FROM fa, cl)"
    " SELECT fact_id, arg_max(cluster_id, cos) AS cluster_id, round(max(cos), 5) AS score FROM s GROUP BY fact_id",
)
def join_nearest_centroid(spark, d):
    # There is one centroid for each label, of which there are few.
    near = facts(spark, d).select("fact_id", "embedding").crossJoin(clusters(spark, d).select("cluster_id", "centroid"))
    scored = near.withColumn("cos", vec.cosine("embedding", "centroid"))
    return scored.groupBy("fact_id").agg(F.max_by("cluster_id", "cos").alias("cluster_id"), F.round(F.max("cos"), 5).alias("score"))


@query(
    "memory_two_stage",
    f"WITH {MEMORY}, g AS (SELECT cluster_id FROM cl WHERE list_cosine_similarity(centroid, {Q}) >= 0.05), s AS (SELECT fact_id, cluster_id, list_cosine_similarity(embedding, {Q}) AS cos"
    " FROM fa WHERE cluster_id IN (SELECT cluster_id FROM g) AND valid_to IS NULL) SELECT fact_id, cluster_id, round(cos, 5) AS score FROM s WHERE cos >= 0.1 ORDER BY cos DESC, fact_id LIMIT 8",
)
def memory_two_stage(spark, d):
    active = facts(spark, d).where("valid_to is null")
    found = joins.gated_facts(active, clusters(spark, d), _query_vector(spark, d), 0.05, 0.1, 8)
    return found.select("fact_id", "cluster_id", F.round("score", 5).alias("score"))


@query(
    "tier_facts",
    f"WITH {MEMORY}, g AS (SELECT cluster_id FROM cl WHERE list_cosine_similarity(centroid, {Q}) >= 0), s AS (SELECT fact_id, list_cosine_similarity(embedding, {Q}) AS cos FROM fa"
    " WHERE cluster_id IN (SELECT cluster_id FROM g) AND source = 'distiller' AND valid_from <= TIMESTAMP '2024-01-20 00:00:00' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '2024-01-10 00:00:00'))"
    " SELECT fact_id, round(cos, 5) AS score FROM s WHERE cos >= 0.05 ORDER BY cos DESC, fact_id LIMIT 20",
)
def tier_facts(spark, d):
    start, end = F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")), F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    valid = facts(spark, d).where((F.col("source") == "distiller") & (F.col("valid_from") <= end) & (F.col("valid_to").isNull() | (F.col("valid_to") >= start)))
    found = joins.gated_facts(valid, clusters(spark, d), _query_vector(spark, d), 0.0, 0.05, 20)
    return found.select("fact_id", F.round("score", 5).alias("score"))


@query("filter_valid_at", f"WITH {MEMORY} SELECT fact_id FROM fa WHERE valid_from <= TIMESTAMP '2024-01-20 00:00:00' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '2024-01-15 00:00:00')")
def filter_valid_at(spark, d):
    start, end = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")), F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    return facts(spark, d).where((F.col("valid_from") <= end) & (F.col("valid_to").isNull() | (F.col("valid_to") >= start))).select("fact_id")


@query("filter_active", f"WITH {MEMORY} SELECT fact_id FROM fa WHERE valid_to IS NULL")
def filter_active(spark, d):
    return facts(spark, d).where(F.col("valid_to").isNull()).select("fact_id")


@query("fact_delta", f"WITH {MEMORY} SELECT fact_id, valid_from FROM fa WHERE valid_to IS NULL AND valid_from > TIMESTAMP '2024-01-20 00:00:00' ORDER BY valid_from DESC, fact_id LIMIT 40")
def fact_delta(spark, d):
    fresh = facts(spark, d).where(F.col("valid_to").isNull() & (F.col("valid_from") > F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))))
    return fresh.orderBy(F.desc("valid_from"), "fact_id").limit(40).select("fact_id", "valid_from")


@query("memory_list", f"WITH {MEMORY} SELECT cluster_id, fact_count FROM cl ORDER BY fact_count DESC, cluster_id")
def memory_list(spark, d):
    return clusters(spark, d).orderBy(F.desc("fact_count"), "cluster_id").select("cluster_id", "fact_count")


@query("memory_delete_note", f"WITH {MEMORY} SELECT fact_id, CASE WHEN source = 'agent' AND valid_to IS NULL THEN TIMESTAMP '{NOW}' ELSE valid_to END AS valid_to FROM fa")
def memory_delete_note(spark, d):
    from chronoweave.sources.sinks import update_where

    active = (F.col("source") == "agent") & F.col("valid_to").isNull()
    return update_where(facts(spark, d), active, {"valid_to": F.to_timestamp_ntz(F.lit(NOW))}).select("fact_id", "valid_to")


@query("summary_cadence", "SELECT conv_id, count(*) >= 5 AND count(*) % 5 = 0 AS due FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def summary_cadence(spark, d):
    turns = load(spark, d, "conversations").where("role != 'system'").groupBy("conv_id").agg(F.count("*").alias("n"))
    return turns.select("conv_id", ((F.col("n") >= 5) & (F.col("n") % 5 == 0)).alias("due"))


@query("tier0_rules", "SELECT event_id, CASE WHEN event_type = 'view' AND value < 2 THEN 'not_interesting' WHEN event_type = 'click' AND before = 'click' THEN 'not_interesting' WHEN event_type = 'signup' AND value < 3 THEN 'not_interesting' WHEN event_type = 'error' AND value > 40 THEN 'interesting' END AS verdict FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)")
def tier0_rules(spark, d):
    same = F.coalesce(F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts")) == F.col("event_type"), F.lit(False))
    rows = load(spark, d, "events").withColumn("same", same)
    return rows.select("event_id", enrich.tier0(F.col("event_type"), F.col("value"), F.col("same"))["verdict"].alias("verdict"))


@query(
    "tier1_score",
    "WITH n AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) - 1 AS seen FROM events),"
    " s AS (SELECT event_id, 5 + CASE WHEN seen = 0 THEN 2.5e0 WHEN seen < 5 THEN 1.5e0 WHEN seen < 50 THEN 1e0 ELSE 0.5e0 END + CASE WHEN value > 30 THEN 2e0 WHEN value < 2 THEN -3e0 ELSE 0e0 END AS raw FROM n)"
    " SELECT event_id, CAST(greatest(0, floor(least(10e0, raw))) AS INTEGER) AS score,"
    " CASE WHEN floor(least(10e0, raw)) >= 7 THEN 'interesting' WHEN floor(least(10e0, raw)) <= 4 THEN 'not_interesting' END AS verdict FROM s",
)
def tier1_score(spark, d):
    events = load(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    new = F.when(F.col("seen") == 0, 2.5).when(F.col("seen") < 5, 1.5).when(F.col("seen") < 50, 1.0).otherwise(0.5)
    size = F.when(F.col("value") > 30, 2.0).when(F.col("value") < 2, -3.0).otherwise(0.0)
    counted = scans.trailing_counts(events, ["user_id", "event_type"], "ts", 7 * 86_400, "n").withColumn("seen", F.col("n") - 1)
    rows = counted.select("event_id", (F.lit(5) + new + size).alias("raw"))
    return rows.select("event_id", enrich.clamp_floor(F.col("raw")).alias("score"), enrich.tier1(F.col("raw")).alias("verdict"))


@query(
    "dup_cache",
    "WITH n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS place, sha1(concat_ws('|', lower(event_type), CAST(user_id AS VARCHAR))) AS fp FROM events),"
    " l AS (SELECT event_id, ts, place, lag(event_id) OVER w AS b, lag(place) OVER w AS bp, lag(ts) OVER w AS bt FROM n WINDOW w AS (PARTITION BY fp ORDER BY place))"
    " SELECT event_id, b AS duplicate_of FROM l WHERE place - bp <= 40 AND epoch_us(ts) - epoch_us(bt) <= 1800000000",
)
def dup_cache(spark, d):
    from chronoweave.functions.text import fingerprint

    rows = load(spark, d, "events").withColumn("fp", fingerprint(F.col("event_type"), F.col("user_id").cast("string")))
    found = enrich.recent_duplicates(rows, 1800, 40, "fp", "ts", "event_id")
    return found.where("duplicate_of is not null").select("event_id", "duplicate_of")


@query(
    "baseline_ewma",
    "WITH g AS (SELECT user_id, list(value ORDER BY event_id) AS xs FROM events GROUP BY user_id)"
    " SELECT user_id, CAST(len(xs) - 1 AS BIGINT) AS n, round(list_reduce(xs, lambda m, x: 0.05e0 * x + 0.95e0 * m), 4) AS mean FROM g",
)
def baseline_ewma(spark, d):
    states = scans.ewma_scan(load(spark, d, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], "value", scratch(spark, "baseline"), enrich.ALPHA)
    last = states.groupBy("user_id").agg(F.max_by(F.struct("n", "mean"), "event_id").alias("last"))
    return last.select("user_id", "last.n", F.round("last.mean", 4).alias("mean"))


@query(
    "baseline_deviation",
    "WITH g AS (SELECT user_id, list({'m': value, 'v': 0e0, 'n': 0} ORDER BY event_id) AS xs, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id), i AS (SELECT user_id, xs, ids, unnest(range(1, len(xs) + 1)) AS k FROM g),"
    " s AS (SELECT user_id, ids[k] AS event_id, xs[k].m AS x, list_reduce(xs[1:k], lambda s, r: {'m': 0.05e0 * r.m + 0.95e0 * s.m, 'v': 0.95e0 * (s.v + 0.05e0 * (r.m - s.m) * (r.m - s.m)), 'n': s.n + 1}) AS s FROM i)"
    " SELECT user_id, event_id, round((x - s.m) / sqrt(s.v), 2) + 0e0 AS z FROM s WHERE s.n >= 30 AND s.v > 1e-6",
)
def baseline_deviation(spark, d):
    states = scans.ewma_scan(load(spark, d, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], "value", scratch(spark, "baseline"), enrich.ALPHA)
    z = enrich.z_score(F.col("value"), F.col("mean"), F.col("var"), F.col("n"))
    return states.select("user_id", "event_id", (z + F.lit(0.0)).alias("z")).where("z is not null")


@query(
    "burst_segment",
    "WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) > 600000000 THEN 1 ELSE 0 END AS s FROM events),"
    " n AS (SELECT *, CAST(sum(s) OVER (PARTITION BY event_type ORDER BY ts) AS BIGINT) AS island FROM m)"
    " SELECT event_type, island, min(ts) AS window_start, max(ts) AS window_end, count(*) AS event_count FROM n GROUP BY event_type, island HAVING count(*) >= 3",
)
def burst_segment(spark, d):
    return enrich.bursts(load(spark, d, "events"), "event_type", "ts", 600, 3)


@query(
    "cascade",
    "WITH t AS (SELECT event_id, CASE WHEN event_type = 'view' AND value < 2 THEN 'not_interesting' WHEN event_type = 'error' AND value > 40 THEN 'interesting' END AS t0,"
    " CASE WHEN floor(least(10e0, value / 4)) >= 7 THEN 'interesting' WHEN floor(least(10e0, value / 4)) <= 1 THEN 'not_interesting' END AS t1 FROM events)"
    " SELECT coalesce(t0, t1, 'deferred') AS status, count(*) AS n FROM t GROUP BY 1",
)
def cascade(spark, d):
    rows = load(spark, d, "events")
    first = enrich.tier0(F.col("event_type"), F.col("value"), F.lit(False))
    whole = F.floor(F.least(F.lit(10.0), F.col("value") / 4))
    rule = F.when(first["reason"].isin("too short", "anomaly"), first["verdict"])
    second = F.when(whole >= 7, "interesting").when(whole <= 1, "not_interesting")
    return rows.select(F.coalesce(rule, second, F.lit("deferred")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("recall_exact_instant", "SELECT event_id FROM events WHERE abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) <= 60000000 ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')), event_id LIMIT 1")
def recall_exact_instant(spark, d):
    at, minute = F.to_timestamp_ntz(F.lit("2024-01-10 12:00:00")), F.expr("interval 1 minute")
    near = load(spark, d, "events").where(F.col("ts").between(at - minute, at + minute))
    return near.orderBy(F.abs(seconds_between(F.col("ts"), at)), "event_id").limit(1).select("event_id")


@query("watch_literal", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'trash') OR contains(lower(text), 'scum')) AND contains(lower(text), 'the')")
def watch_literal(spark, d):
    text = F.col("text")
    any_word, every = enrich.phrases_found(text, ["trash", "scum"]), enrich.phrases_found(text, ["the"])
    return load(spark, d, "documents").where((F.size(any_word) > 0) & (F.size(every) == 1)).select("doc_id")
