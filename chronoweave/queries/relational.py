"""Scans, filters, joins, aggregates, windows, sorts, set operations and changes of tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.catalog import NOW, activity, load, sessions
from chronoweave.operators import joins, scans
from chronoweave.operators.sessions import capped_sessions, seconds_between, uncovered
from chronoweave.queries.registry import ACT, SESSIONS, registry
from chronoweave.sources import sinks

QUERIES, ORACLES, query = registry()
DAY = ("2024-01-10 00:00:00", "2024-01-11 00:00:00")


def _ts(text: str):
    return F.to_timestamp_ntz(F.lit(text))


@query("scan_table", "SELECT event_id, ts, event_type, value FROM events")
def scan_table(spark, d):
    return load(spark, d, "events").select("event_id", "ts", "event_type", "value")


@query("filter_time_halfopen", f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{DAY[0]}' AND ts < TIMESTAMP '{DAY[1]}'")
def filter_time_halfopen(spark, d):
    return load(spark, d, "events").where((F.col("ts") >= _ts(DAY[0])) & (F.col("ts") < _ts(DAY[1]))).select("event_id", "ts")


@query("filter_time_closed", f"SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '{DAY[0]}' AND TIMESTAMP '{DAY[1]}'")
def filter_time_closed(spark, d):
    return load(spark, d, "events").where(F.col("ts").between(_ts(DAY[0]), _ts(DAY[1]))).select("event_id", "ts")


@query("filter_time_closed_end", f"SELECT event_id, ts FROM events WHERE ts <= TIMESTAMP '{DAY[1]}'")
def filter_time_closed_end(spark, d):
    return load(spark, d, "events").where(F.col("ts") <= _ts(DAY[1])).select("event_id", "ts")


@query("filter_open_since", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00'")
def filter_open_since(spark, d):
    return load(spark, d, "events").where(F.col("ts") > _ts("2024-01-25 00:00:00")).select("event_id", "ts")


@query("filter_in_list", f"WITH {ACT} SELECT event_id, event_type, k FROM act WHERE event_type NOT IN ('view', 'click') OR k >= 90")
def filter_in_list(spark, d):
    return activity(spark, d).where(~F.col("event_type").isin("view", "click") | (F.col("k") >= 90)).select("event_id", "event_type", "k")


@query("filter_nonempty", "SELECT doc_id, source FROM documents WHERE source IS NOT NULL AND source <> ''")
def filter_nonempty(spark, d):
    return load(spark, d, "documents").where(F.col("source").isNotNull() & (F.col("source") != "")).select("doc_id", "source")


@query("filter_like_prefix", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'auto%'")
def filter_like_prefix(spark, d):
    return load(spark, d, "customer").where(F.col("c_mktsegment").ilike("auto%")).select("c_custkey", "c_mktsegment")


@query("filter_like_contains", "SELECT doc_id FROM documents WHERE text ILIKE '%trash%' OR source ILIKE '%src1%'")
def filter_like_contains(spark, d):
    return load(spark, d, "documents").where(F.col("text").ilike("%trash%") | F.col("source").ilike("%src1%")).select("doc_id")


@query("filter_abs_window", "SELECT event_id, ts FROM events WHERE abs(epoch(ts) - epoch(TIMESTAMP '2024-01-10 12:00:00')) <= 600")
def filter_abs_window(spark, d):
    at = _ts("2024-01-10 12:00:00")
    ten = F.expr("interval 10 minutes")
    return load(spark, d, "events").where(F.col("ts").between(at - ten, at + ten)).select("event_id", "ts")


@query("filter_dynamic", f"WITH {ACT} SELECT event_id FROM act WHERE event_type = 'error' AND value >= 10 AND process_name = 'app3'")
def filter_dynamic(spark, d):
    wanted = {"event_type": "error", "process_name": "app3"}
    condition = F.col("value") >= 10
    for name, value in wanted.items():
        condition = condition & (F.col(name) == value)
    return activity(spark, d).where(condition).select("event_id")


@query("project_drop_heavy", "SELECT vec_id, label FROM embeddings")
def project_drop_heavy(spark, d):
    return load(spark, d, "embeddings").drop("embedding")


@query("project_case_null_guard", "SELECT event_id, CASE WHEN event_type = 'error' THEN value ELSE value * 2 END AS value FROM events")
def project_case_null_guard(spark, d):
    return sinks.update_where(load(spark, d, "events"), F.col("event_type") != "error", {"value": F.col("value") * 2}).select("event_id", "value")


@query("project_bool_cast", "SELECT doc_id, coalesce(toxic, 0) <> 0 AS is_toxic FROM documents LEFT JOIN labels USING (doc_id)")
def project_bool_cast(spark, d):
    joined = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", (F.coalesce("toxic", F.lit(0)) != 0).alias("is_toxic"))


@query("project_json_decode", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def project_json_decode(spark, d):
    return load(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("join_inner_fk", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner_fk(spark, d):
    orders, customer = load(spark, d, "orders"), load(spark, d, "customer")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select("o_orderkey", "c_name")


@query(
    "join_inner_self2",
    "SELECT l.l_orderkey, l.l_linenumber, p.p_name, s.s_name FROM lineitem l JOIN part p ON l_partkey = p_partkey"
    " JOIN supplier s ON l_suppkey = s_suppkey WHERE p_size >= 45",
)
def join_inner_self2(spark, d):
    line, part, supplier = (load(spark, d, t) for t in ("lineitem", "part", "supplier"))
    joined = line.join(part.where("p_size >= 45"), line["l_partkey"] == part["p_partkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    return joined.select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query(
    "join_anti_exists_range",
    f"WITH {SESSIONS} SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM sess s WHERE s.user_id = e.user_id"
    " AND s.event_count >= 2 AND e.ts BETWEEN s.window_start AND s.window_end)",
)
def join_anti_exists_range(spark, d):
    return uncovered(load(spark, d, "events"), sessions(spark, d).where("event_count >= 2"), "user_id", "ts").select("event_id")


@query(
    "join_semi_exists_range",
    f"WITH {SESSIONS} SELECT user_id, island, window_start FROM sess s WHERE event_count >= 2 AND EXISTS"
    " (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.value >= 30 AND e.ts BETWEEN s.window_start AND s.window_end)",
)
def join_semi_exists_range(spark, d):
    from chronoweave.operators.sessions import with_day

    some = load(spark, d, "events").where("event_type = 'purchase' and value >= 30").select(F.to_date("ts").alias("day"), "ts")
    days = with_day(sessions(spark, d).where("event_count >= 2"), "window_start", "window_end")
    return days.join(some, "day").where("ts between window_start and window_end").select("user_id", "island", "window_start").distinct()


@query("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti_not_exists(spark, d):
    customer, orders = load(spark, d, "customer"), load(spark, d, "orders")
    return customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left_anti").select("c_custkey")


@query("join_anti_not_in", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def join_anti_not_in(spark, d):
    return load(spark, d, "documents").join(load(spark, d, "labels").where("doc_id is not null"), "doc_id", "left_anti").select("doc_id")


@query("join_in_list", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def join_in_list(spark, d):
    supplier, nation = load(spark, d, "supplier"), load(spark, d, "nation").where("n_regionkey = 2")
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"], "left_semi").select("s_suppkey")


@query(
    "join_asof_backward",
    "SELECT p.event_id, c.event_id AS context_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p"
    " ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') c ON p.user_id = c.user_id AND p.ts >= c.ts",
)
def join_asof_backward(spark, d):
    events = load(spark, d, "events")
    found = joins.asof_backward(events.where("event_type = 'purchase'"), events.where("event_type = 'view'"), "user_id", "ts", "event_id", "context_id")
    return found.select("event_id", "context_id")


@query(
    "join_nearest_tolerance",
    "SELECT p_id, v_id FROM (SELECT p.event_id AS p_id, v.event_id AS v_id, row_number() OVER (PARTITION BY p.event_id"
    " ORDER BY abs(epoch_us(v.ts) - epoch_us(p.ts)), v.event_id) AS place FROM events p JOIN events v"
    " ON abs(epoch_us(v.ts) - epoch_us(p.ts)) <= 300000000 WHERE p.event_type = 'purchase' AND v.event_type = 'view') WHERE place = 1",
)
def join_nearest_tolerance(spark, d):
    events = load(spark, d, "events")
    left = events.where("event_type = 'purchase'").select(F.col("event_id").alias("p_id"), F.col("ts").alias("p_ts"))
    right = events.where("event_type = 'view'").select(F.col("event_id").alias("v_id"), F.col("ts").alias("v_ts"))
    return joins.nearest(left, right, "p_id", "p_ts", "v_id", "v_ts", 300).select("p_id", "v_id")


@query(
    "join_asym_window",
    "SELECT p.event_id AS p_id, v.event_id AS v_id FROM events p JOIN events v ON epoch_us(v.ts) - epoch_us(p.ts)"
    " BETWEEN -450000000 AND 100000000 WHERE p.event_type = 'purchase' AND v.event_type = 'view'",
)
def join_asym_window(spark, d):
    events = load(spark, d, "events")
    left = events.where("event_type = 'purchase'").select(F.col("event_id").alias("p_id"), F.col("ts").alias("p_ts"))
    right = events.where("event_type = 'view'").select(F.col("event_id").alias("v_id"), F.col("ts").alias("v_ts"))
    return joins.range_join(left, right, "p_ts", "v_ts", 450, 100).select("p_id", "v_id")


@query(
    "join_nearest_in_range",
    f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{DAY[0]}' AND ts < TIMESTAMP '{DAY[1]}'"
    " ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')), event_id LIMIT 1",
)
def join_nearest_in_range(spark, d):
    day = load(spark, d, "events").where((F.col("ts") >= _ts(DAY[0])) & (F.col("ts") < _ts(DAY[1])))
    return day.orderBy(F.abs(seconds_between(F.col("ts"), _ts("2024-01-10 12:00:00"))), "event_id").limit(1).select("event_id", "ts")


@query(
    "join_prev_k",
    "SELECT event_id, list_aggregate(list_transform(previous, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS previous FROM"
    " (SELECT event_id, list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
    " AS previous FROM events) WHERE len(previous) > 0",
)
def join_prev_k(spark, d):
    found = joins.previous_k(load(spark, d, "events"), "user_id", "ts", "event_id", 3).where(F.size("previous") > 0)
    return found.select("event_id", F.array_join(F.transform("previous", lambda x: x.cast("string")), ",").alias("previous"))


@query(
    "agg_count_all",
    " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("events", "documents", "conversations", "pages")),
)
def agg_count_all(spark, d):
    parts = [load(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("events", "documents", "conversations", "pages")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("agg_count_where", "SELECT count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' AND event_type = 'error'")
def agg_count_where(spark, d):
    return load(spark, d, "events").where((F.col("ts") > _ts("2024-01-20 00:00:00")) & (F.col("event_type") == "error")).agg(F.count("*").alias("n"))


@query(
    "agg_conditional",
    "SELECT count(*) FILTER (WHERE event_type = 'error') AS deferred, min(ts) FILTER (WHERE event_type = 'error') AS oldest,"
    " count(*) FILTER (WHERE event_type = 'error') >= 50 AS recommend FROM events",
)
def agg_conditional(spark, d):
    error = F.col("event_type") == "error"
    return load(spark, d, "events").agg(
        F.count_if(error).alias("deferred"), F.min(F.when(error, F.col("ts"))).alias("oldest"), (F.count_if(error) >= 50).alias("recommend")
    )


@query("agg_group_count_min", "SELECT event_type, count(*) AS n, min(ts) AS oldest FROM events GROUP BY event_type")
def agg_group_count_min(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


@query("agg_max_fallback", f"SELECT coalesce(max(ts) FILTER (WHERE user_id = -1), max(ts), TIMESTAMP '{NOW}') AS last FROM events")
def agg_max_fallback(spark, d):
    return load(spark, d, "events").agg(F.coalesce(F.max(F.when(F.col("user_id") == -1, F.col("ts"))), F.max("ts"), _ts(NOW)).alias("last"))


@query(
    "agg_group_first_by",
    "SELECT conv_id, max(turn) AS last_turn, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_user, arg_min(text, turn) AS first_any"
    " FROM conversations GROUP BY conv_id",
)
def agg_group_first_by(spark, d):
    user = F.col("role") == "user"
    return load(spark, d, "conversations").groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"),
        F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("first_user"),
        F.min_by("text", "turn").alias("first_any"),
    )


@query(
    "agg_novelty_count",
    "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) - 1 AS n FROM events",
)
def agg_novelty_count(spark, d):
    counted = scans.trailing_counts(load(spark, d, "events").select("event_id", "event_type", "ts"), ["event_type"], "ts", 7 * 86_400, "seen")
    return counted.select("event_id", (F.col("seen") - 1).alias("n"))


@query(
    "agg_session_count",
    f"WITH {SESSIONS}, placed AS (SELECT user_id, island, (row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1) // 20 AS part"
    " FROM numbered) SELECT user_id, count(DISTINCT (island, part)) AS sessions FROM placed GROUP BY user_id",
)
def agg_session_count(spark, d):
    return capped_sessions(load(spark, d, "events"), "user_id", "ts", "event_id", 1800, 20)


@query(
    "agg_group_min3",
    f"WITH {SESSIONS} SELECT user_id, island, event_count FROM sess WHERE event_count >= 3 ORDER BY window_start, user_id LIMIT 3",
)
def agg_group_min3(spark, d):
    return sessions(spark, d).where("event_count >= 3").orderBy("window_start", "user_id").limit(3).select("user_id", "island", "event_count")


@query(
    "agg_char_budget",
    "WITH run AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations)"
    " SELECT conv_id, turn FROM run WHERE total <= 2000",
)
def agg_char_budget(spark, d):
    total = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return load(spark, d, "conversations").select("conv_id", "turn", total.alias("total")).where("total <= 2000").select("conv_id", "turn")


#: Labels against a prediction by length, in SQL.
GRADED = "graded AS (SELECT l.quality AS gold, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS pred, n_chars, lang FROM labels l JOIN documents USING (doc_id))"


def _graded(spark, d):
    joined = load(spark, d, "labels").join(load(spark, d, "documents"), "doc_id")
    return joined.select(F.col("quality").alias("gold"), (F.col("n_chars") >= 400).cast("int").alias("pred"), "n_chars", "lang")


@query(
    "agg_precision_recall_f1",
    f"WITH {GRADED}, c AS (SELECT k AS class, count(*) FILTER (WHERE gold = k AND pred = k) AS tp, count(*) FILTER (WHERE gold <> k AND pred = k) AS fp,"
    " count(*) FILTER (WHERE gold = k AND pred <> k) AS fn FROM graded, (VALUES (0), (1)) v(k) GROUP BY k)"
    " SELECT class, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS prec, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM c",
)
def agg_precision_recall_f1(spark, d):
    from chronoweave.operators.metrics import per_class

    return per_class(_graded(spark, d), "gold", "pred", [0, 1]).select("class", "tp", "fp", "fn", "prec", "recall")


@query("agg_confusion", f"WITH {GRADED} SELECT gold, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1 FROM graded GROUP BY gold")
def agg_confusion(spark, d):
    counts = _graded(spark, d).groupBy("gold").pivot("pred", [0, 1]).count().na.fill(0)
    return counts.select("gold", F.col("0").alias("pred_0"), F.col("1").alias("pred_1"))


@query("agg_accuracy_by_tag", f"WITH {GRADED} SELECT lang, count(*) AS n, round(avg(CASE WHEN gold = pred THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM graded GROUP BY lang")
def agg_accuracy_by_tag(spark, d):
    return _graded(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 6).alias("accuracy"))


@query(
    "agg_calibration",
    f"WITH {GRADED}, b AS (SELECT *, CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 2000 THEN 2 ELSE 3 END AS bucket FROM graded)"
    " SELECT bucket, count(*) AS n, round(avg(CASE WHEN gold = pred THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM b GROUP BY bucket",
)
def agg_calibration(spark, d):
    from chronoweave.operators.metrics import calibration

    return calibration(_graded(spark, d), "n_chars", [500, 1000, 2000], "gold", "pred")


@query(
    "agg_threshold_sweep",
    f"WITH {GRADED} SELECT t AS threshold, count(*) FILTER (WHERE n_chars >= t) AS fired,"
    " round(avg(gold) FILTER (WHERE n_chars >= t), 6) AS prec FROM graded, (VALUES (200), (500), (1000), (2000)) v(t) GROUP BY t",
)
def agg_threshold_sweep(spark, d):
    from chronoweave.operators.metrics import threshold_sweep

    return threshold_sweep(_graded(spark, d), "n_chars", "gold", [200, 500, 1000, 2000])


@query("agg_class_weights", "SELECT quality, round((SELECT count(*) FROM labels) / (2e0 * count(*)), 6) AS weight FROM labels GROUP BY quality")
def agg_class_weights(spark, d):
    from chronoweave.operators.metrics import class_weights

    return class_weights(load(spark, d, "labels"), "quality")


@query(
    "agg_topn_ngrams",
    "SELECT gram, count(*) AS n FROM (SELECT array_to_string(string_split(lower(text), ' ')[1:3], ' ') AS gram FROM documents)"
    " GROUP BY gram ORDER BY n DESC, gram LIMIT 20",
)
def agg_topn_ngrams(spark, d):
    gram = F.array_join(F.slice(F.split(F.lower("text"), " "), 1, 3), " ").alias("gram")
    return load(spark, d, "documents").select(gram).groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(20)


@query("agg_percentile_latency", "SELECT event_type, round(avg(value), 4) AS mean, list_sort(list(value))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS p50 FROM events GROUP BY event_type")
def agg_percentile_latency(spark, d):
    order = Window.partitionBy("event_type").orderBy("value")
    n = F.count("*").over(Window.partitionBy("event_type"))
    placed = load(spark, d, "events").select("event_type", "value", (F.row_number().over(order) - 1).alias("place"), n.alias("n"))
    return placed.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.max(F.when(F.col("place") == F.floor(F.col("n") / 2), F.col("value"))).alias("p50"))


@query("agg_adhoc", "SELECT dayofweek(ts) AS weekday, hour(ts) AS hour, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def agg_adhoc(spark, d):
    from chronoweave.plans.guard import run_select

    load(spark, d, "events").createOrReplaceTempView("adhoc_events")
    return run_select(
        spark, "SELECT CAST(dayofweek(ts) - 1 AS BIGINT) AS weekday, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n, round(avg(value), 4) AS mean FROM adhoc_events GROUP BY 1, 2"
    )


@query("win_gap_island", f"WITH {SESSIONS} SELECT user_id, island, window_start, window_end, event_count FROM sess")
def win_gap_island(spark, d):
    return sessions(spark, d)


@query("win_prev_value", "SELECT event_id, lag(event_type) OVER w AS before, round(epoch(ts) - epoch(lag(ts) OVER w), 3) AS dwell_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def win_prev_value(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    return load(spark, d, "events").select(
        "event_id", F.lag("event_type").over(w).alias("before"), F.round(seconds_between(F.col("ts"), F.lag("ts").over(w)), 3).alias("dwell_s")
    )


@query("win_prev_title_dup", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) WHERE b = event_type")
def win_prev_title_dup(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts"))
    return load(spark, d, "events").withColumn("before", before).where("before = event_type").select("event_id")


@query("win_recent_n", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def win_recent_n(spark, d):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return load(spark, d, "conversations").withColumn("place", place).where("place <= 3").orderBy("conv_id", "turn").select("conv_id", "turn")


@query("win_exclude_last_n", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 2")
def win_exclude_last_n(spark, d):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return load(spark, d, "conversations").withColumn("place", place).where("place > 2").select("conv_id", "turn")


@query("win_first_last_day", "SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_id, ts) AS first, arg_max(event_id, ts) AS last FROM events GROUP BY ALL")
def win_first_last_day(spark, d):
    return load(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("event_id", "ts").alias("first"), F.max_by("event_id", "ts").alias("last"))


@query("win_lead_after", "SELECT event_id, after FROM (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events) WHERE event_type = 'purchase'")
def win_lead_after(spark, d):
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts"))
    return load(spark, d, "events").withColumn("after", after).where("event_type = 'purchase'").select("event_id", "after")


@query("win_idle_gaps", "SELECT event_id FROM (SELECT event_id, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch(ts) AS gap FROM events) WHERE gap > 36000")
def win_idle_gaps(spark, d):
    gap = seconds_between(F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts")), F.col("ts"))
    return load(spark, d, "events").withColumn("gap", gap).where("gap > 36000").select("event_id")


@query("sort_desc", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")
def sort_desc(spark, d):
    return load(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts")


@query("topk_then_resort", f"WITH {SESSIONS} SELECT user_id, island, event_count, window_start FROM sess ORDER BY event_count DESC, window_start DESC, user_id LIMIT 15")
def topk_then_resort(spark, d):
    top = sessions(spark, d).orderBy(F.desc("event_count"), F.desc("window_start"), "user_id").limit(15)
    return top.orderBy("window_start").select("user_id", "island", "event_count", "window_start")


@query("paginate", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def paginate(spark, d):
    return load(spark, d, "events").orderBy(F.desc("ts"), "event_id").offset(40).limit(20).select("event_id", "ts")


@query("candidate_cap", f"SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '{DAY[0]}' ORDER BY ts DESC, event_id LIMIT 900")
def candidate_cap(spark, d):
    return load(spark, d, "events").where(F.col("ts") < _ts(DAY[0])).orderBy(F.desc("ts"), "event_id").limit(900).select("event_id", "ts")


@query("set_union_ids", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.n_chars, b.toxic FROM (SELECT * FROM documents WHERE lang = 'de') a FULL JOIN labels b ON a.doc_id = b.doc_id")
def set_union_ids(spark, d):
    return load(spark, d, "documents").where("lang = 'de'").select("doc_id", "n_chars").join(load(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "full_outer")


@query("set_concat_routes", "SELECT 1 AS route, doc_id AS id FROM documents WHERE lang = 'es' UNION ALL SELECT 2, conv_id FROM conversations WHERE role = 'system'")
def set_concat_routes(spark, d):
    first = load(spark, d, "documents").where("lang = 'es'").select(F.lit(1).alias("route"), F.col("doc_id").alias("id"))
    return first.unionByName(load(spark, d, "conversations").where("role = 'system'").select(F.lit(2).alias("route"), F.col("conv_id").alias("id")))


@query("set_leak_guard", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE lower(trim(b.text)) = lower(trim(documents.text)))")
def set_leak_guard(spark, d):
    docs, frozen = load(spark, d, "documents"), load(spark, d, "benchmark").select(F.lower(F.trim("text")).alias("frozen"))
    return docs.join(frozen, F.lower(F.trim(docs["text"])) == frozen["frozen"], "left_anti").select("doc_id")


@query(
    "sink_insert_ignore",
    "SELECT event_id, value FROM events WHERE event_type <> 'signup' UNION ALL SELECT event_id, value * 2 FROM events e WHERE value >= 10"
    " AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type <> 'signup' AND o.event_id = e.event_id)",
)
def sink_insert_ignore(spark, d):
    events = load(spark, d, "events")
    new = events.where("value >= 10").select("event_id", (F.col("value") * 2).alias("value"))
    return sinks.insert_ignore(events.where("event_type <> 'signup'").select("event_id", "value"), new, "event_id")


@query("sink_upsert_replace", "SELECT event_id, CASE WHEN value >= 10 THEN value * 2 ELSE value END AS value FROM events")
def sink_upsert_replace(spark, d):
    events = load(spark, d, "events").select("event_id", "value")
    return sinks.upsert_replace(events, events.where("value >= 10").withColumn("value", F.col("value") * 2), "event_id")


@query("sink_upsert_column", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'NEW' ELSE c_name END AS c_name FROM customer")
def sink_upsert_column(spark, d):
    customer = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = customer.where("c_acctbal < 0").select("c_custkey", F.lit("NEW").alias("c_name"))
    return sinks.upsert_column(customer, new, "c_custkey", "c_name").select("c_custkey", "c_name")


@query("sink_update_where", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def sink_update_where(spark, d):
    return sinks.update_where(load(spark, d, "orders"), F.col("o_orderstatus") == "P", {"o_orderstatus": F.lit("F")}).select("o_orderkey", "o_orderstatus")


@query("sink_update_batch", "SELECT p_partkey, coalesce(m.top, p_retailprice) AS price FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS top FROM lineitem GROUP BY l_partkey) m ON p_partkey = l_partkey")
def sink_update_batch(spark, d):
    new = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("top"))
    return load(spark, d, "part").join(new, "p_partkey", "left").select("p_partkey", F.coalesce("top", "p_retailprice").alias("price"))


@query("sink_delete_where", "SELECT event_id FROM events WHERE NOT coalesce(ts < TIMESTAMP '2024-01-15 00:00:00', false)")
def sink_delete_where(spark, d):
    return sinks.delete_where(load(spark, d, "events"), F.col("ts") < _ts("2024-01-15 00:00:00")).select("event_id")


@query("sink_export")
def sink_export(spark, d):
    return sinks.export_document({"conversations": (load(spark, d, "conversations"), ["conv_id", "turn"]), "nation": (load(spark, d, "nation"), ["n_nationkey"])})


@query("ext_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def ext_rollup(spark, d):
    return load(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("ext_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, d):
    return load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("ext_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_tumbling(spark, d):
    return load(spark, d, "events").groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "event_type").agg(F.count("*").alias("n"))
