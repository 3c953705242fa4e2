"""Captured text, watch rules, profiles, hybrid searches and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.catalog import NOW, activity, clusters, facts, load, sessions
from chronoweave.functions import text as tx
from chronoweave.functions import vector as vec
from chronoweave.operators import enrich, memory, nearest, ranking, scans
from chronoweave.operators.sessions import number_islands, seconds_between
from chronoweave.queries.registry import ACT, SESSIONS, registry
from chronoweave.queries.retrieval import MEMORY
from chronoweave.queries.scalar import Q, _query_vector
from chronoweave.sources.readers import parse_numstat
from chronoweave.sources.shared import bound_batches, scratch

QUERIES, ORACLES, query = registry()
COS = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q})"
MENU = (
    "len(ls) >= 6 AND coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) < 28 * len(ls)"
    " AND len(list_filter(ls, lambda x: len(regexp_split_to_array(trim(x), ' +')) <= 4)) >= 0.7e0 * len(ls)"
)
LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
USEFUL = (
    f"NOT ({MENU}) AND length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 40"
    " AND len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) >= 4"
)


def _ntz(text: str):
    return F.to_timestamp_ntz(F.lit(text))


def _scored(spark, d):
    return load(spark, d, "embeddings").crossJoin(F.broadcast(_query_vector(spark, d))).withColumn("cos", vec.cosine("embedding", "q"))


@query("win_novelty_range", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) - 1 AS seen FROM events")
def win_novelty_range(spark, d):
    counted = scans.trailing_counts(load(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", 7 * 86_400, "seen")
    return counted.select("event_id", (F.col("seen") - 1).alias("seen"))


@query("win_running_budget", "SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 2000")
def win_running_budget(spark, d):
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    used = load(spark, d, "conversations").withColumn("used", F.sum(F.length("text")).over(order).cast("long"))
    return used.where("used <= 2000").select("conv_id", "turn", "used")


@query(
    "win_ewma",
    "WITH g AS (SELECT user_id, list(value ORDER BY event_id) AS xs, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id), i AS (SELECT user_id, xs, ids, unnest(range(1, len(xs) + 1)) AS k FROM g)"
    " SELECT user_id, ids[k] AS event_id, round(list_reduce(xs[1:k], lambda m, x: 0.05e0 * x + 0.95e0 * m) + 0.0000137e0, 4) AS mean FROM i",  # means have few decimals: the shift keeps them off ties
)
def win_ewma(spark, d):
    states = scans.ewma_scan(load(spark, d, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], "value", scratch(spark, "ewma"), enrich.ALPHA)
    return states.select("user_id", "event_id", F.round(F.col("mean") + F.lit(0.0000137), 4).alias("mean"))


@query("fn_ewma_step", "SELECT event_id, round(0.05e0 * value + 0.95e0 * b, 6) AS mean, round(0.95e0 * (0.05e0 * (value - b) * (value - b)), 9) AS var FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) WHERE b IS NOT NULL")
def fn_ewma_step(spark, d):
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts"))
    rows = load(spark, d, "events").select("event_id", "value", before.alias("before")).where("before is not null")
    delta = F.col("value") - F.col("before")
    a = enrich.ALPHA
    return rows.select("event_id", F.round(a * F.col("value") + (1 - a) * F.col("before"), 6).alias("mean"), F.round((1 - a) * (a * delta * delta), 9).alias("var"))


@query(
    "fn_zscore_rms",
    f"WITH {ACT}, s AS (SELECT event_type, count(*) AS n, avg(value) AS mv, var_pop(value) AS vv, avg(k) AS mk, var_pop(k) AS vk FROM act GROUP BY event_type),"
    " z AS (SELECT event_id, round((value - mv) / sqrt(vv), 2) AS zv, round((k - mk) / sqrt(vk), 2) AS zk FROM act JOIN s USING (event_type) WHERE n >= 30)"
    " SELECT event_id, CASE WHEN zv = 0 THEN 0e0 ELSE zv END AS zv, CASE WHEN zk = 0 THEN 0e0 ELSE zk END AS zk, round(sqrt((zv * zv + zk * zk) / 2), 2) AS overall, round(sqrt((zv * zv + zk * zk) / 2), 2) > 2 AS anomaly FROM z",
)
def fn_zscore_rms(spark, d):
    rows = activity(spark, d).select("event_id", "event_type", "value", "k")
    stats = rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.avg("value").alias("mv"), F.var_pop("value").alias("vv"), F.avg("k").alias("mk"), F.var_pop("k").alias("vk")
    )
    z = rows.join(stats, "event_type").where("n >= 30").select(
        "event_id", enrich.z_score(F.col("value"), F.col("mv"), F.col("vv"), F.col("n")).alias("zv"), enrich.z_score(F.col("k"), F.col("mk"), F.col("vk"), F.col("n")).alias("zk")
    )
    overall = F.round(F.sqrt((F.col("zv") * F.col("zv") + F.col("zk") * F.col("zk")) / 2), 2)
    plain = {c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)) for c in ("zv", "zk")}  # no negative zero
    return z.withColumn("overall", overall).withColumn("anomaly", F.col("overall") > 2).withColumns(plain)


@query("win_carry_header", "SELECT conv_id, turn, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS header FROM conversations")
def win_carry_header(spark, d):
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    header = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(order)
    return load(spark, d, "conversations").select("conv_id", "turn", F.md5(header.cast("binary")).alias("header"))


@query("sort_expr", "SELECT event_id, ts FROM events ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), event_id LIMIT 10")
def sort_expr(spark, d):
    return load(spark, d, "events").orderBy(F.abs(seconds_between(F.col("ts"), _ntz("2024-01-15 12:00:00"))), "event_id").limit(10).select("event_id", "ts")


@query("topk_score", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def topk_score(spark, d):
    return load(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "value")


@query("limit_clamp", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 3")
def limit_clamp(spark, d):
    return ranking.page(load(spark, d, "events").orderBy(F.desc("ts"), "event_id"), 500, 3, 20).select("event_id", "ts")


@query("set_concat_tracks", f"WITH {SESSIONS} SELECT 'session' AS track, user_id, window_start AS at FROM sess UNION ALL SELECT 'event', user_id, ts FROM events")
def set_concat_tracks(spark, d):
    first = sessions(spark, d).select(F.lit("session").alias("track"), "user_id", F.col("window_start").alias("at"))
    return first.unionByName(load(spark, d, "events").select(F.lit("event").alias("track"), "user_id", F.col("ts").alias("at")))


@query(
    "set_dedupe_ordered",
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)"
    " SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, md5(arg_min(line, pos)) AS line FROM l GROUP BY doc_id, lower(line)",
)
def set_dedupe_ordered(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    first = lines.groupBy("doc_id", F.lower("line").alias("folded")).agg(F.min("pos").alias("pos"), F.min_by("line", "pos").alias("line"))
    return first.select("doc_id", "pos", F.md5(F.col("line").cast("binary")).alias("line"))


@query(
    "fn_fts_sanitize",
    r"SELECT p_partkey, array_to_string(list_transform(list_filter(list_transform(string_split(p_name, ' '), lambda w: regexp_replace(w, '[^\p{L}\p{N}_]', '', 'g')), lambda w: w <> ''), lambda w: '"
    "\"' || w || '\"'), ' OR ') AS terms FROM part",
)
def fn_fts_sanitize(spark, d):
    return load(spark, d, "part").select("p_partkey", tx.match_expression(F.col("p_name")).alias("terms"))


@query(
    "fn_strip_chrome",
    r"SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(html, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '' AND NOT list_contains(['</html>', '<html>', '<body>', '</body>'], lower(x))), chr(10))) AS plain FROM pages",
)
def fn_strip_chrome(spark, d):
    plain = tx.without_lines(F.col("html"), ["</html>", "<html>", "<body>", "</body>"])
    return load(spark, d, "pages").select("page_id", F.md5(plain.cast("binary")).alias("plain"))


@query("fn_useful_text", f"SELECT doc_id, {USEFUL} AS useful FROM (SELECT doc_id, text, {LINES} AS ls FROM documents)")
def fn_useful_text(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.useful(F.col("text")).alias("useful"))


@query("fn_choose_text", f"SELECT doc_id, md5(CASE WHEN {USEFUL} THEN text ELSE source END) AS chosen FROM (SELECT doc_id, text, source, {LINES} AS ls FROM documents)")
def fn_choose_text(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(tx.choose(F.col("text"), F.col("source")).cast("binary")).alias("chosen"))


@query(
    "fn_region_score",
    f"SELECT doc_id, round(length(text) * (0.35e0 + 0.65e0 * least(coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) / CAST(greatest(len(ls), 1) AS DOUBLE) / 36, 1e0))"
    f" * (0.45e0 + 0.55e0 * least(n_chars / 180000e0, 1e0)) * CASE WHEN {MENU} THEN 0.25e0 ELSE 1e0 END, 4) AS score FROM (SELECT doc_id, text, n_chars, {LINES} AS ls FROM documents)",
)
def fn_region_score(spark, d):
    return load(spark, d, "documents").select("doc_id", F.round(tx.region_score(F.col("text"), F.col("n_chars")), 4).alias("score"))


@query("fn_rolling_window", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00'")
def fn_rolling_window(spark, d):
    from datetime import datetime

    from chronoweave.plans.temporal import resolve

    found = resolve("the last 3 weeks", datetime.fromisoformat(NOW))
    return load(spark, d, "events").where((F.col("ts") >= F.lit(str(found.start)).cast("timestamp_ntz")) & (F.col("ts") < F.lit(str(found.end)).cast("timestamp_ntz"))).select("event_id")


@query("fn_sqlite_date_modifiers", "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day_start, CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 7 DAY AS week_before, CAST(date_trunc('week', ts) AS TIMESTAMP) AS monday FROM events")
def fn_sqlite_date_modifiers(spark, d):
    cut = lambda unit: F.date_trunc(unit, F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return load(spark, d, "events").select("event_id", cut("day").alias("day_start"), (cut("day") - F.expr("interval 7 days")).alias("week_before"), cut("week").alias("monday"))


@query("fn_cosine_guard", f"SELECT doc_id, round(coalesce({COS}, 0), 5) AS cos FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def fn_cosine_guard(spark, d):
    docs = load(spark, d, "documents").select("doc_id").join(load(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    return docs.crossJoin(F.broadcast(_query_vector(spark, d))).select("doc_id", F.round(vec.cosine("embedding", "q"), 5).alias("cos"))


@query("fn_vector_decode", "SELECT vec_id, len(embedding) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def fn_vector_decode(spark, d):
    decoded = F.from_json(F.to_json("embedding"), "array<double>")
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    return load(spark, d, "embeddings").select("vec_id", decoded.alias("e")).select("vec_id", F.size("e").cast("long").alias("dim"), F.round(total, 4).alias("total"))


_ITEMS = "i AS (SELECT user_id, event_type, count(*) AS n, max(ts) AS seen FROM events GROUP BY user_id, event_type)"


def _items(events, condition):
    counted = events.where(condition).groupBy("user_id", "event_type").agg(F.count("*").alias("count"), F.max("ts").alias("last_seen"))
    return counted.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("count", "last_seen")))).alias("items"))


@query("fn_list_active_sorted", f"WITH {_ITEMS} SELECT user_id, coalesce(string_agg(event_type, ', ' ORDER BY n DESC, event_type) FILTER (WHERE seen > TIMESTAMP '2024-01-20 00:00:00'), '') AS active FROM i GROUP BY user_id")
def fn_list_active_sorted(spark, d):
    return _items(load(spark, d, "events"), F.lit(True)).select("user_id", memory.active_names(F.col("items"), _ntz("2024-01-20 00:00:00")).alias("active"))


@query("fn_map_upsert_items", f"WITH {_ITEMS} SELECT user_id, event_type, n, seen FROM i")
def fn_map_upsert_items(spark, d):
    events, noon = load(spark, d, "events"), _ntz("2024-01-15 00:00:00")
    old, new = _items(events, F.col("ts") < noon), _items(events, F.col("ts") >= noon).withColumnRenamed("items", "fresh")
    items = old.join(new, "user_id", "full_outer").select("user_id", F.explode(memory.merged_items(F.col("items"), F.col("fresh"))).alias("event_type", "v"))
    return items.select("user_id", "event_type", F.col("v.count").alias("n"), F.col("v.last_seen").alias("seen"))


@query("identity_ops", f"WITH {_ITEMS} SELECT user_id, event_type, n, event_type <> 'error' AND seen > TIMESTAMP '2024-01-20 00:00:00' AS active FROM i")
def identity_ops(spark, d):
    items = _items(load(spark, d, "events"), F.lit(True)).select("user_id", F.explode("items").alias("event_type", "v"))
    active = (F.col("event_type") != "error") & (F.col("v.last_seen") > _ntz("2024-01-20 00:00:00"))
    return items.select("user_id", "event_type", F.col("v.count").alias("n"), active.alias("active"))


@query(
    "fn_scalar_protect",
    "WITH g AS (SELECT user_id, list({'v': event_type, 'n': 1::BIGINT} ORDER BY ts) AS xs FROM events GROUP BY user_id),"
    " r AS (SELECT user_id, list_reduce(xs, lambda a, b: {'v': CASE WHEN a.n >= 5 THEN a.v ELSE b.v END, 'n': a.n + 1}) AS s FROM g) SELECT user_id, s.v AS value, s.n AS mentions FROM r",
)
def fn_scalar_protect(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_type"))), lambda x: x["event_type"])
    return load(spark, d, "events").groupBy("user_id").agg(ordered.alias("xs")).select("user_id", memory.settled_scalar(F.col("xs")).alias("s")).select("user_id", "s.value", "s.mentions")


_SOURCE = "CASE WHEN k % 3 = 0 THEN 'distiller' WHEN k % 3 = 1 THEN 'agent' ELSE 'user' END"


@query(
    "fn_source_precedence",
    f"WITH {ACT}, s AS (SELECT event_id, {_SOURCE} AS n, lag({_SOURCE}) OVER (PARTITION BY user_id ORDER BY ts) AS o FROM act) SELECT event_id, NOT (n = 'distiller' AND coalesce(o, '') = 'agent') AS takes FROM s",
)
def fn_source_precedence(spark, d):
    source = F.when(F.col("k") % 3 == 0, "distiller").when(F.col("k") % 3 == 1, "agent").otherwise("user")
    old = F.lag(source).over(Window.partitionBy("user_id").orderBy("ts"))
    return activity(spark, d).select("event_id", memory.takes_precedence(old, source).alias("takes"))


@query(
    "rank_topic",
    f"WITH s AS (SELECT vec_id, {COS} + CASE WHEN label = 3 THEN 0.2e0 ELSE 0 END AS score FROM embeddings) SELECT vec_id, round(score, 5) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 5",
)
def rank_topic(spark, d):
    score = F.col("cos") + F.when(F.col("label") == 3, 0.2).otherwise(0.0)
    return _scored(spark, d).select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(5).select("vec_id", F.round("score", 5).alias("score"))


@query(
    "rank_screenshots",
    f"WITH n AS (SELECT * FROM embeddings ORDER BY vec_id DESC LIMIT 3000), s AS (SELECT vec_id, label / 9e0 AS kw, {COS} AS cos, -{COS} AS vis, pow(2e0, -vec_id / 24e0 / 30e0) AS fresh FROM n),"
    " t AS (SELECT vec_id, 0.35e0 * kw + 0.45e0 * greatest(0, cos) + 0.20e0 * greatest(0, vis) + 0.04e0 * fresh AS score FROM s WHERE kw <> 0 OR cos <> 0 OR vis <> 0)"
    " SELECT vec_id, round(score, 5) AS score FROM t ORDER BY t.score DESC, vec_id LIMIT 20 OFFSET 5",
)
def rank_screenshots(spark, d):
    newest = load(spark, d, "embeddings").orderBy(F.desc("vec_id")).limit(3000).crossJoin(F.broadcast(_query_vector(spark, d)))
    seen = F.transform(F.col("q").cast("array<double>"), lambda x: -x)
    parts = newest.select("vec_id", (F.col("label") / F.lit(9.0)).alias("kw"), vec.cosine("embedding", "q").alias("cos"), vec.cosine("embedding", seen).alias("vis"))
    score = 0.35 * F.col("kw") + 0.45 * F.greatest(F.lit(0.0), F.col("cos")) + 0.20 * F.greatest(F.lit(0.0), F.col("vis")) + 0.04 * vec.half_life(F.col("vec_id") / F.lit(24.0), 30)
    some = parts.where("kw != 0 or cos != 0 or vis != 0").select("vec_id", score.alias("score"))
    return ranking.page(some.orderBy(F.desc("score"), "vec_id"), 20, 5, 100).select("vec_id", F.round("score", 5).alias("score"))


_TURNS = f"t AS (SELECT conv_id, turn, role, text, {COS} AS cos FROM conversations JOIN embeddings ON vec_id = (conv_id * 7 + turn) % (SELECT count(*) FROM embeddings))"


def _turns(spark, d):
    vectors = load(spark, d, "embeddings").agg(F.count("*").alias("vectors"))  # one row
    turns = load(spark, d, "conversations").crossJoin(F.broadcast(vectors)).withColumn("vec_id", (F.col("conv_id") * 7 + F.col("turn")) % F.col("vectors"))
    return turns.join(_scored(spark, d).select("vec_id", "cos"), "vec_id")


@query(
    "rank_conversations",
    f"WITH {_TURNS}, c AS (SELECT conv_id, max(least(cos + CASE WHEN contains(lower(text), 'the') THEN 0.08e0 ELSE 0 END, 1)) AS sim, max(turn) AS age FROM t GROUP BY conv_id)"
    " SELECT conv_id, round(0.72e0 * sim + 0.28e0 * pow(2e0, -age / 14e0), 5) AS score FROM c WHERE sim >= 0.22e0",
)
def rank_conversations(spark, d):
    phrase = F.when(F.contains(F.lower("text"), F.lit("the")), 0.08).otherwise(0.0)
    best = _turns(spark, d).groupBy("conv_id").agg(F.max(F.least(F.col("cos") + phrase, F.lit(1.0))).alias("sim"), F.max("turn").alias("age"))
    return best.where("sim >= 0.22").select("conv_id", F.round(0.72 * F.col("sim") + 0.28 * vec.half_life(F.col("age").cast("double"), 14), 5).alias("score"))


@query(
    "rank_deep_summaries",
    f"WITH {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM t), s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY round(cos, 6) DESC, turn) AS place FROM n WHERE back > 2 AND cos >= 0.1e0)"
    " SELECT conv_id, turn, place FROM s WHERE place <= 2",
)
def rank_deep_summaries(spark, d):
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    old = _turns(spark, d).withColumn("back", back).where("back > 2 and cos >= 0.1").withColumn("score", F.round("cos", 6))
    return ranking.top_per_group(old, "conv_id", "score", "turn", 2).select("conv_id", "turn", F.col("place").cast("long").alias("place"))


@query("tier_select", f"WITH {SESSIONS} SELECT user_id, island, CASE WHEN epoch_us(window_end) - epoch_us(window_start) <= 7200000000 AND window_start >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'events' WHEN window_start >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY THEN 'sessions' ELSE 'facts' END AS tier FROM sess")
def tier_select(spark, d):
    now = _ntz(NOW)
    short = seconds_between(F.col("window_end"), F.col("window_start")) <= 7200
    tier = F.when(F.col("window_start") > now, "none").when(short & (F.col("window_start") >= now - F.expr("interval 7 days")), "events")
    return sessions(spark, d).select("user_id", "island", tier.when(F.col("window_start") >= now - F.expr("interval 90 days"), "sessions").otherwise("facts").alias("tier"))


@query("memory_flat", f"SELECT vec_id, round({COS}, 5) AS score FROM embeddings WHERE {COS} >= 0.1e0 ORDER BY {COS} DESC, vec_id LIMIT 8")
def memory_flat(spark, d):
    return _scored(spark, d).where("cos >= 0.1").orderBy(F.desc("cos"), "vec_id").limit(8).select("vec_id", F.round("cos", 5).alias("score"))


@query(
    "profile_slice",
    f"SELECT vec_id, true AS always FROM embeddings WHERE label = 9 AND vec_id < 100 UNION ALL SELECT vec_id, false FROM (SELECT vec_id, {COS} AS c FROM embeddings WHERE NOT (label = 9 AND vec_id < 100) ORDER BY c DESC, vec_id LIMIT 5) WHERE c >= 0.25e0",
)
def profile_slice(spark, d):
    fixed = (F.col("label") == 9) & (F.col("vec_id") < 100)
    best = _scored(spark, d).where(~fixed).orderBy(F.desc("cos"), "vec_id").limit(5).where("cos >= 0.25")
    return load(spark, d, "embeddings").where(fixed).select("vec_id", F.lit(True).alias("always")).unionByName(best.select("vec_id", F.lit(False).alias("always")))


@query("join_cross_topk", "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) DESC, vec_id) AS place FROM embeddings, q) SELECT * FROM s WHERE place <= 5")
def join_cross_topk(spark, d):
    rows = load(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return nearest.nearest_rows(rows, asked, "vec_id", "embedding", 5).select("query_id", F.col("item").alias("vec_id"), "place")


@query("join_fts_rowid", r"WITH h AS (SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: w = 'trash')) AS tf FROM documents) SELECT doc_id, source, tf FROM documents JOIN h USING (doc_id) WHERE tf > 0")
def join_fts_rowid(spark, d):
    docs = load(spark, d, "documents")
    hits = ranking.postings(docs, "doc_id", "text").where("term = 'trash'")
    return docs.select("doc_id", "source").join(hits, "doc_id").select("doc_id", "source", "tf")


@query(
    "join_lookup_recent_dup",
    "WITH n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS place, sha1(concat_ws('|', lower(event_type), CAST(user_id AS VARCHAR))) AS fp FROM events),"
    " l AS (SELECT event_id, ts, place, lag(event_id) OVER w AS b, lag(place) OVER w AS bp, lag(ts) OVER w AS bt, lag(value) OVER w AS bv FROM n WINDOW w AS (PARTITION BY fp ORDER BY place))"
    " SELECT event_id, bv >= 20 AS verdict FROM l WHERE place - bp <= 40 AND epoch_us(ts) - epoch_us(bt) <= 1800000000",
)
def join_lookup_recent_dup(spark, d):
    rows = load(spark, d, "events").withColumn("fp", tx.fingerprint(F.col("event_type"), F.col("user_id").cast("string")))
    found = enrich.recent_duplicates(rows, 1800, 40, "fp", "ts", "event_id").where("duplicate_of is not null").select("event_id", "duplicate_of")
    verdicts = load(spark, d, "events").select(F.col("event_id").alias("duplicate_of"), (F.col("value") >= 20).alias("verdict"))
    return found.join(verdicts, "duplicate_of").select("event_id", "verdict")


@query("agg_group_top", f"WITH s AS (SELECT label, vec_id, round({COS}, 6) AS c FROM embeddings) SELECT label, max(c) AS best, arg_max(vec_id, c) AS vec_id, count(*) AS n FROM s WHERE c >= 0.1e0 GROUP BY label")
def agg_group_top(spark, d):
    near = _scored(spark, d).withColumn("c", F.round("cos", 6)).where("c >= 0.1")
    return near.groupBy("label").agg(F.max("c").alias("best"), F.max_by("vec_id", "c").alias("vec_id"), F.count("*").alias("n"))


@query("agg_group_concat", "SELECT n_regionkey, string_agg('- ' || n_name, chr(10) ORDER BY n_nationkey) AS bullets FROM nation GROUP BY n_regionkey")
def agg_group_concat(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("- "), x["n_name"]))
    return load(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(ordered, "\n").alias("bullets"))


_IMPACT = "CASE WHEN n_chars < 200 THEN 'not fired' WHEN quality = 1 AND toxic = 0 THEN 'exact' WHEN quality = 1 THEN 'benign' WHEN toxic = 0 THEN 'useless' ELSE 'harmful' END"


@query("agg_gate_impact", f"SELECT {_IMPACT} AS impact, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def agg_gate_impact(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "n_chars").join(load(spark, d, "labels"), "doc_id")
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    impact = F.when(F.col("n_chars") < 200, "not fired").when(good & clean, "exact").when(good, "benign").when(clean, "useless").otherwise("harmful")
    return rows.groupBy(impact.alias("impact")).agg(F.count("*").alias("n"))


@query(
    "agg_bench_scoreboard",
    "SELECT lang, round(avg(CAST(quality AS DOUBLE)), 6) AS hits, round(avg(1e0 - toxic), 6) AS superseded, count(*) AS size, round(count(*) / CAST(count(DISTINCT text) AS DOUBLE), 6) AS bloat FROM documents JOIN labels USING (doc_id) GROUP BY lang",
)
def agg_bench_scoreboard(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("print")).join(load(spark, d, "labels"), "doc_id")
    counts = rows.groupBy("lang", "print").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("bad"))
    return counts.groupBy("lang").agg(
        F.round(F.sum("good") / F.sum("n"), 6).alias("hits"), F.round(1 - F.sum("bad") / F.sum("n"), 6).alias("superseded"),
        F.sum("n").alias("size"), F.round(F.sum("n") / F.count("*"), 6).alias("bloat"),
    )


@query(
    "agg_cascade_rates",
    "WITH t AS (SELECT CASE WHEN (event_type = 'view' AND value < 2) OR (event_type = 'error' AND value > 40) THEN 0 WHEN value >= 28 OR value < 8 THEN 1 ELSE 2 END AS tier FROM events)"
    " SELECT tier, count(*) AS n, round(100e0 * count(*) / (SELECT count(*) FROM t), 4) AS share FROM t GROUP BY tier",
)
def agg_cascade_rates(spark, d):
    first = ((F.col("event_type") == "view") & (F.col("value") < 2)) | ((F.col("event_type") == "error") & (F.col("value") > 40))
    tier = F.when(first, 0).when((F.col("value") >= 28) | (F.col("value") < 8), 1).otherwise(2)
    counts = load(spark, d, "events").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("tier", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))


@query("agg_dedupe_ratio", "WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS total, max(n) AS largest, round(count(*) / CAST(sum(n) AS DOUBLE), 6) AS ratio FROM g")
def agg_dedupe_ratio(spark, d):
    groups = load(spark, d, "documents").groupBy(F.sha2("text", 256).alias("print")).agg(F.count("*").alias("n"))
    return groups.agg(F.count("*").alias("groups"), F.sum("n").alias("total"), F.max("n").alias("largest"), F.round(F.count("*") / F.sum("n"), 6).alias("ratio"))


_CHANGES = "SELECT CAST(o_custkey AS VARCHAR) AS author, count(DISTINCT o_orderkey) AS commits, CAST(coalesce(sum(CAST(floor(l_quantity) AS BIGINT)), 0) AS BIGINT) AS added, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS deleted FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey"


def _change_log(spark, d):
    """Orders as a log of changes: a header line for each, then a line for each of its items."""
    heads = load(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.lit(-1).cast("long").alias("position"), F.concat(F.col("o_custkey").cast("string"), F.lit("|mail")).alias("value"))
    items = load(spark, d, "lineitem")
    line = F.concat_ws("\t", F.floor("l_quantity").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    return heads.unionByName(items.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("position"), line.alias("value")))


@query("agg_numstat", _CHANGES)
def agg_numstat(spark, d):
    return parse_numstat(_change_log(spark, d))


@query("grade_substring", "SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'a') AND NOT contains(lower(text), 'trash') AS correct, NOT contains(lower(text), 'trash') AS superseded FROM documents")
def grade_substring(spark, d):
    text = F.col("text")
    wanted, banned = enrich.phrases_found(text, ["the", "a"]), enrich.phrases_found(text, ["trash"])
    clear = F.size(banned) == 0
    return load(spark, d, "documents").select("doc_id", ((F.size(wanted) == 2) & clear).alias("correct"), clear.alias("superseded"))


@query("text_verdict", f"WITH {ACT} SELECT event_id, coalesce(nullif(concat_ws(' - ', process_name, nullif(event_type, '')), ''), 'activity') AS activity FROM act")
def text_verdict(spark, d):
    named = F.concat_ws(" - ", "process_name", F.nullif(F.col("event_type"), F.lit("")))
    return activity(spark, d).select("event_id", F.coalesce(F.nullif(named, F.lit("")), F.lit("activity")).alias("activity"))


@query("meaningful_typing", r"SELECT conv_id, turn, len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) >= 2 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 0.30e0 * length(text) AS meaningful FROM conversations")
def meaningful_typing(spark, d):
    many = F.size(F.split(tx.collapse(F.col("text")), " ")) >= 2
    share = F.length(F.regexp_replace("text", r"[^\p{L}]", "")) >= F.lit(0.30) * F.length("text")
    return load(spark, d, "conversations").select("conv_id", "turn", (many & share).alias("meaningful"))


@query(
    "burst_metrics",
    f"WITH {SESSIONS}, n AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, island ORDER BY ts)) AS gap FROM numbered)"
    " SELECT user_id, island, count(*) AS keys, round(avg(gap) / 1000e0, 2) AS avg_ms, round(min(gap) / 1000e0, 2) AS min_ms, round(max(gap) / 1000e0, 2) AS max_ms,"
    " round(count(*) FILTER (WHERE event_type = 'error') / CAST(count(*) AS DOUBLE), 2) AS revision FROM n GROUP BY user_id, island",
)
def burst_metrics(spark, d):
    rows = number_islands(load(spark, d, "events"), "user_id", "ts", 1800)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(Window.partitionBy("user_id", "island").orderBy("ts"))
    ms = lambda c: F.round(c / F.lit(1000.0), 2)
    return rows.withColumn("gap", gap).groupBy("user_id", "island").agg(
        F.count("*").alias("keys"), ms(F.avg("gap")).alias("avg_ms"), ms(F.min("gap")).alias("min_ms"), ms(F.max("gap")).alias("max_ms"),
        F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 2).alias("revision"),
    )


@query(
    "watch_eval",
    "WITH s AS (SELECT user_id, event_id, ts, props, lag(props) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),"
    " g AS (SELECT user_id, list({'t': epoch_us(ts), 'n': 1::BIGINT} ORDER BY ts) AS xs FROM s WHERE b IS NOT NULL AND b <> props AND contains(props, '1') GROUP BY user_id),"
    " r AS (SELECT user_id, list_reduce(xs, lambda a, b: CASE WHEN b.t - a.t >= 86400000000 THEN {'t': b.t, 'n': a.n + 1} ELSE a END) AS s FROM g) SELECT user_id, s.n AS alerts FROM r",
)
def watch_eval(spark, d):
    before = F.lag("props").over(Window.partitionBy("user_id").orderBy("ts"))
    changed = load(spark, d, "events").withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col("props")))
    hits = changed.where(F.contains("props", F.lit("1"))).groupBy("user_id").agg(F.array_sort(F.collect_list(F.unix_micros(F.col("ts").cast("timestamp")))).alias("at"))
    return hits.select("user_id", enrich.fires(F.col("at"), 86_400_000_000).alias("alerts"))


@query("watch_due", f"SELECT user_id, epoch(TIMESTAMP '{NOW}') - epoch(max(ts)) >= greatest(15, max(value)) AS due FROM events GROUP BY user_id")
def watch_due(spark, d):
    last = load(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.max("value").alias("poll"))
    return last.select("user_id", (seconds_between(_ntz(NOW), F.col("last")) >= F.greatest(F.lit(15.0), F.col("poll"))).alias("due"))


@query(
    "ocr_line_filter",
    "WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) % 10 >= 6) AS ls FROM documents) SELECT doc_id, len(list_distinct(ls)) AS lines, least(4000, coalesce(list_sum(list_transform(list_distinct(ls), lambda x: length(x))), 0) + greatest(len(list_distinct(ls)) - 1, 0))::BIGINT AS chars FROM l",
)
def ocr_line_filter(spark, d):
    lines = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.length(x) % 10 >= 6))
    kept = load(spark, d, "documents").select("doc_id", lines.alias("ls"))
    return kept.select("doc_id", F.size("ls").cast("long").alias("lines"), F.length(F.substring(F.array_join("ls", "\n"), 1, 4000)).cast("long").alias("chars"))


@query(
    "crop_box",
    "WITH b AS (SELECT p_partkey, greatest(0, least(2000, p_size * 20)) AS l, greatest(0, least(1200, p_size * 6)) AS t, greatest(0, least(2000, p_size * 20 + p_partkey % 600)) AS r, greatest(0, least(1200, p_size * 6 + p_partkey % 400)) AS m FROM part)"
    " SELECT p_partkey, r - l AS width, m - t AS height FROM b WHERE r - l >= 160 AND m - t >= 100",
)
def crop_box(spark, d):
    within = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), c))
    left, top, part = F.col("p_size") * 20, F.col("p_size") * 6, F.col("p_partkey")
    box = load(spark, d, "part").select("p_partkey", (within(left + part % 600, 2000) - within(left, 2000)).alias("width"), (within(top + part % 400, 1200) - within(top, 1200)).alias("height"))
    return box.where("width >= 160 and height >= 100")


@query("distil_trigger", f"WITH {SESSIONS} SELECT user_id, count(*) FILTER (WHERE window_start > TIMESTAMP '2024-01-25 00:00:00') >= 5 AS due FROM sess GROUP BY user_id")
def distil_trigger(spark, d):
    fresh = F.count_if(F.col("window_start") > _ntz("2024-01-25 00:00:00"))
    return sessions(spark, d).groupBy("user_id").agg((fresh >= 5).alias("due"))


@query(
    "distil_route",
    f"WITH {MEMORY}, g AS (SELECT grp, list(m ORDER BY pos) AS c FROM (SELECT label * 100 + vec_id % 7 AS grp, pos, avg(x) AS m FROM (SELECT label, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY grp, pos) GROUP BY grp),"
    " s AS (SELECT grp, cluster_id, list_cosine_similarity(c, centroid) AS cos FROM g, cl) SELECT grp, CASE WHEN max(cos) >= 0.5e0 THEN arg_max(cluster_id, cos) END AS cluster_id FROM s GROUP BY grp",
)
def distil_route(spark, d):
    grouped = load(spark, d, "embeddings").select((F.col("label") * 100 + F.col("vec_id") % 7).alias("grp"), "embedding")
    groups = vec.mean_vector(grouped, "grp", "embedding").select("grp", F.col("centroid").alias("c"))
    scored = groups.crossJoin(F.broadcast(clusters(spark, d).select("cluster_id", "centroid"))).withColumn("cos", vec.cosine("c", "centroid"))  # ten centroids
    best = scored.groupBy("grp").agg(F.max("cos").alias("cos"), F.max_by("cluster_id", "cos").alias("best"))
    return best.select("grp", F.when(F.col("cos") >= 0.5, F.col("best")).alias("cluster_id"))


@query("intro_gate", f"WITH {MEMORY} SELECT cluster_id, count(*) FILTER (WHERE valid_from > TIMESTAMP '2024-01-24 00:00:00') >= 8 OR bool_or(source = 'agent') AS rebuild FROM fa GROUP BY cluster_id")
def intro_gate(spark, d):
    fresh = F.count_if(F.col("valid_from") > _ntz("2024-01-24 00:00:00")) >= 8
    return facts(spark, d).groupBy("cluster_id").agg((fresh | F.bool_or(F.col("source") == "agent")).alias("rebuild"))


@query(
    "backlog_gate",
    f"SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS deferred, count(*) FILTER (WHERE event_type = 'view') AS pending, count(*) FILTER (WHERE event_type = 'error') >= 80 OR (count(*) FILTER (WHERE event_type = 'error') > 0"
    f" AND epoch(TIMESTAMP '{NOW}') - epoch(min(ts) FILTER (WHERE event_type = 'error')) >= 1209600) AS recommend FROM events GROUP BY user_id",
)
def backlog_gate(spark, d):
    return enrich.backlog(load(spark, d, "events"), "user_id", F.col("event_type") == "error", F.col("event_type") == "view", "ts", _ntz(NOW), 80, 1_209_600)


@query("fn_hash_embed")
def fn_hash_embed(spark, d):
    bound_batches(spark)
    return load(spark, d, "conversations").select("conv_id", "turn", tx.hashed_embedding(F.col("text")).alias("embedding"))


@query("phash_groups")
def phash_groups(spark, d):
    frames = _frames(spark, d)
    return memory.frame_groups(frames, ["user_id", "week"], "ts_ms", "mark", 2, 3_600_000).select("event_id", "frame_group")


@query("frame_dedupe_live")
def frame_dedupe_live(spark, d):
    return memory.kept_frames(_frames(spark, d), ["user_id", "week"], "ts_ms", "mark", 2).select("event_id", "kept")


def _frames(spark, d):
    """Events as frames of a screen, whose mark is the hash of their type; a user's week is a bounded group."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return load(spark, d, "events").select("event_id", "user_id", F.trunc("ts", "week").alias("week"), at.alias("ts_ms"), F.xxhash64("event_type").alias("mark"))


@query("distil_batch_cluster")
def distil_batch_cluster(spark, d):
    batch = load(spark, d, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 200).alias("batch"))
    return memory.leader_clusters(batch, ["batch"], "vec_id", "embedding", 0.75).select("vec_id", "leader")


@query("tier_sessions_compress")
def tier_sessions_compress(spark, d):
    rows = load(spark, d, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 200).alias("batch"))
    led = memory.leader_clusters(rows, ["batch"], "vec_id", "embedding", 0.86)
    return led.groupBy("batch", "leader").agg(F.max("vec_id").alias("shown"), F.count("*").alias("n"))
