"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.catalog import NOW, activity, load
from chronoweave.functions import text as tx
from chronoweave.functions import vector as vec
from chronoweave.operators.enrich import clamp_floor, first_hit, phrases_found
from chronoweave.operators.sessions import seconds_between
from chronoweave.queries.registry import ACT, registry

QUERIES, ORACLES, query = registry()
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"


def _query_vector(spark, d):
    return load(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


@query("fn_keywords", f"SELECT conv_id, turn, array_to_string(list_filter({WORDS}, lambda w: length(w) > 2 AND NOT list_contains({STOP}, w)), ' ') AS words FROM conversations")
def fn_keywords(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.array_join(tx.keywords(F.col("text")), " ").alias("words"))


@query("fn_query_terms", "SELECT page_id, array_to_string(regexp_extract_all(lower(url), '[a-z0-9][a-z0-9_.:/-]{2,}'), ' ') AS terms FROM pages")
def fn_query_terms(spark, d):
    terms = F.regexp_extract_all(F.lower("url"), F.lit(r"([a-z0-9][a-z0-9_.:/-]{2,})"), F.lit(1))
    return load(spark, d, "pages").select("page_id", F.array_join(terms, " ").alias("terms"))


@query(
    "fn_keyword_score",
    "SELECT doc_id, round((contains(lower(text), 'the')::INT + contains(lower(text), 'trash')::INT + contains(lower(text), 'und')::INT) / 3e0, 6) AS score FROM documents",
)
def fn_keyword_score(spark, d):
    return load(spark, d, "documents").select("doc_id", F.round(tx.keyword_share(F.col("text"), ["the", "trash", "und"]), 6).alias("score"))


@query("fn_url_detect", r"SELECT page_id, regexp_matches(url, '^https?://([a-z0-9.-]+)\.(com|org|net)(/|$)') AS is_url FROM pages")
def fn_url_detect(spark, d):
    return load(spark, d, "pages").select("page_id", F.col("url").rlike(r"^https?://([a-z0-9.-]+)\.(com|org|net)(/|$)").alias("is_url"))


@query("fn_event_text", "SELECT event_id, substr(concat_ws(' | ', nullif(trim(event_type), ''), CAST(user_id AS VARCHAR), nullif(trim(props), '')), 1, 3000) AS text FROM events")
def fn_event_text(spark, d):
    parts = [F.nullif(F.trim("event_type"), F.lit("")), F.col("user_id").cast("string"), F.nullif(F.trim("props"), F.lit(""))]
    return load(spark, d, "events").select("event_id", F.substring(F.concat_ws(" | ", *parts), 1, 3000).alias("text"))


@query("fn_fingerprint", "SELECT event_id, sha1(concat_ws('|', lower(trim(event_type)), coalesce(lower(trim(props)), ''))) AS print FROM events")
def fn_fingerprint(spark, d):
    return load(spark, d, "events").select("event_id", tx.fingerprint(F.col("event_type"), F.col("props")).alias("print"))


@query("fn_content_id", "SELECT page_id, substr(sha1(concat_ws('|', url, html)), 1, 16) AS id FROM pages")
def fn_content_id(spark, d):
    return load(spark, d, "pages").select("page_id", tx.content_id(F.col("url"), F.col("html")).alias("id"))


@query("fn_screen_fingerprint", r"SELECT doc_id, sha1(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS print FROM documents")
def fn_screen_fingerprint(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.fingerprint(tx.collapse(F.col("text"))).alias("print"))


@query(
    "fn_normalize_lines",
    r"SELECT doc_id, len(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 2))) AS lines FROM documents",
)
def fn_normalize_lines(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(tx.long_lines(F.col("text"))).cast("long").alias("lines"))


@query(
    "fn_nav_soup",
    "WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)"
    " SELECT doc_id, len(ls) >= 6 AND coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) < 28 * len(ls)"
    " AND len(list_filter(ls, lambda x: len(regexp_split_to_array(trim(x), ' +')) <= 4)) >= 0.7e0 * len(ls) AS menu FROM l",
)
def fn_nav_soup(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.is_menu(F.col("text")).alias("menu"))


@query(
    "fn_truncate_title",
    r"WITH p AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)"
    " SELECT doc_id, CASE WHEN t = '' THEN 'New chat' WHEN length(t) > 72 THEN rtrim(substr(t, 1, 69)) || '…' ELSE t END AS title FROM p",
)
def fn_truncate_title(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.truncate_title(F.col("text"), "New chat").alias("title"))


@query("fn_norm_alnum", "SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS plain FROM conversations")
def fn_norm_alnum(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", tx.alphanumeric(F.col("text")).alias("plain"))


@query("fn_last_user_turn", "SELECT doc_id, string_split(text, chr(10))[-1] AS last FROM documents")
def fn_last_user_turn(spark, d):
    return load(spark, d, "documents").select("doc_id", F.element_at(F.split("text", "\n"), -1).alias("last"))


@query("fn_word_boundary_hit", r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\btrash\b') THEN length(regexp_extract(text, '(?is)^(.*?)\btrash\b', 1)) END AS at FROM documents")
def fn_word_boundary_hit(spark, d):
    return load(spark, d, "documents").select("doc_id", first_hit(F.col("text"), "trash").cast("long").alias("at"))


@query(
    "fn_proximity",
    r"WITH h AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\bthe\b') THEN length(regexp_extract(text, '(?is)^(.*?)\bthe\b', 1)) END AS a,"
    r" CASE WHEN regexp_matches(text, '(?i)\bof\b') THEN length(regexp_extract(text, '(?is)^(.*?)\bof\b', 1)) END AS b FROM documents)"
    " SELECT doc_id, coalesce(abs(a - b) <= 100, false) AS near FROM h",
)
def fn_proximity(spark, d):
    hits = load(spark, d, "documents").select("doc_id", first_hit(F.col("text"), "the").alias("a"), first_hit(F.col("text"), "of").alias("b"))
    return hits.select("doc_id", F.coalesce(F.abs(F.col("a") - F.col("b")) <= 100, F.lit(False)).alias("near"))


@query("fn_event_summary", "SELECT event_id, CASE event_type WHEN 'error' THEN 'Error of ' || CAST(user_id AS VARCHAR) WHEN 'purchase' THEN 'Purchase by ' || CAST(user_id AS VARCHAR) ELSE event_type END AS summary FROM events")
def fn_event_summary(spark, d):
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    text = F.when(kind == "error", F.concat(F.lit("Error of "), user)).when(kind == "purchase", F.concat(F.lit("Purchase by "), user)).otherwise(kind)
    return load(spark, d, "events").select("event_id", text.alias("summary"))


@query("fn_local_format", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS at FROM events")
def fn_local_format(spark, d):
    return load(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"))


@query("fn_day_week_month_bounds", "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month FROM events")
def fn_day_week_month_bounds(spark, d):
    return load(spark, d, "events").select("event_id", *[F.date_trunc(u, "ts").cast("timestamp_ntz").alias(u) for u in ("day", "week", "month")])


@query("fn_weekday_hour", "SELECT event_id, dayofweek(ts) AS weekday, hour(ts) AS hour FROM events")
def fn_weekday_hour(spark, d):
    return load(spark, d, "events").select("event_id", (F.dayofweek("ts") - 1).cast("long").alias("weekday"), F.hour("ts").cast("long").alias("hour"))


@query("fn_cosine_zip", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q}), 5) AS score FROM embeddings")
def fn_cosine_zip(spark, d):
    rows = load(spark, d, "embeddings").crossJoin(F.broadcast(_query_vector(spark, d)))
    return rows.select("vec_id", F.round(vec.cosine("embedding", "q"), 5).alias("score"))


@query("fn_cosine_trunc", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding[1:32] AS DOUBLE[]), ({Q})[1:32]), 5) AS score FROM embeddings")
def fn_cosine_trunc(spark, d):
    rows = load(spark, d, "embeddings").crossJoin(F.broadcast(_query_vector(spark, d).select(F.slice("q", 1, 32).alias("q"))))
    return rows.select("vec_id", F.round(vec.cosine_cut("embedding", "q"), 5).alias("score"))


@query("fn_half_life", f"SELECT event_id, round(exp(-ln(2e0) * (epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 86400e0 / 30e0), 6) AS weight FROM events")
def fn_half_life(spark, d):
    age = seconds_between(F.to_timestamp_ntz(F.lit(NOW)), F.col("ts")) / F.lit(86400.0)
    return load(spark, d, "events").select("event_id", F.round(vec.half_life(age, 30), 6).alias("weight"))


@query("fn_clamp_floor", "SELECT event_id, CAST(greatest(0, floor(least(10e0, value / 5))) AS INTEGER) AS score FROM events")
def fn_clamp_floor(spark, d):
    return load(spark, d, "events").select("event_id", clamp_floor(F.col("value") / 5).alias("score"))


@query("fn_backoff", f"WITH {ACT} SELECT event_id, least(1800e0, 120e0 * pow(2e0, k - 1)) AS wait_s FROM act")
def fn_backoff(spark, d):
    return activity(spark, d).select("event_id", F.least(F.lit(1800.0), F.lit(120.0) * F.pow(F.lit(2.0), F.col("k") - 1)).alias("wait_s"))


@query("fn_bucket_floor", f"WITH {ACT} SELECT event_id, least(90, greatest(1, k)) AS days FROM act")
def fn_bucket_floor(spark, d):
    return activity(spark, d).select("event_id", F.least(F.lit(90), F.greatest(F.lit(1), "k")).alias("days"))


@query("fn_phash_distance", "SELECT event_id, bit_count(xor(user_id, event_id)) <= 2 AS near FROM events")
def fn_phash_distance(spark, d):
    return load(spark, d, "events").select("event_id", (F.bit_count(F.col("user_id").bitwiseXOR(F.col("event_id"))) <= 2).alias("near"))


@query(
    "fn_entity_boost",
    f"SELECT doc_id, least(0.05e0 * (list_contains(w, 'the')::INT + list_contains(w, 'und')::INT + list_contains(w, 'que')::INT + list_contains(w, 'of')::INT), 0.15e0) AS boost FROM (SELECT doc_id, {WORDS} AS w FROM documents)",
)
def fn_entity_boost(spark, d):
    has = tx.words(F.col("text"))
    keys = F.array(*[F.lit(w) for w in ("the", "und", "que", "of")])
    hits = F.size(F.filter(keys, lambda k: F.array_contains(has, k)))
    return load(spark, d, "documents").select("doc_id", F.least(F.lit(0.05) * hits, F.lit(0.15)).alias("boost"))


@query("set_subset", "SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'ing') AS all_found FROM documents")
def set_subset(spark, d):
    need = ["the", "ing"]
    found = phrases_found(F.col("text"), need)
    return load(spark, d, "documents").select("doc_id", (F.size(F.array_except(F.array(*[F.lit(p) for p in need]), found)) == 0).alias("all_found"))


@query(
    "src_html_text",
    r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,"
    r" sha1(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,"
    r" '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '<[^>]+>', ' ', 'g'),"
    r" '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS body FROM pages",
)
def src_html_text(spark, d):
    return load(spark, d, "pages").select("page_id", tx.page_title(F.col("html")).alias("title"), F.sha1(tx.visible_text(F.col("html"))).alias("body"))
