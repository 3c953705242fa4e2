"""Tables of rules, and searches of an index that is kept up to date."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.catalog import load
from chronoweave.operators import curation, rules
from chronoweave.operators.index import SegmentedIndex
from chronoweave.queries.registry import registry
from chronoweave.queries.retrieval import _BM25, TERMS
from chronoweave.queries.scalar import WORDS
from chronoweave.sources.shared import scratch

QUERIES, ORACLES, query = registry()

_PARTS = r"regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^www\.', '') AS host, CASE WHEN rtrim(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/') END AS path"


@query(
    "join_url_prefix",
    f"WITH p AS (SELECT page_id, {_PARTS} FROM pages), r AS (SELECT host || '/' || split_part(path, '/', 2) AS rule, host, '/' || split_part(path, '/', 2) AS folder FROM p WHERE host <> '' GROUP BY ALL HAVING count(*) >= 2)"
    " SELECT page_id, rule FROM p JOIN r ON p.host = r.host AND (path = folder OR starts_with(path, rtrim(folder, '/') || '/'))",
)
def join_url_prefix(spark, d):
    """Rules: the first folders that have two pages or more."""
    pages = load(spark, d, "pages")
    host, path = rules.address_parts(F.col("url"))
    first = F.split(F.concat(path, F.lit("/")), "/")[1]
    known = pages.select(F.concat_ws("/", host, first).alias("rule")).where("not startswith(rule, '/')").groupBy("rule").agg(F.count("*").alias("n")).where("n >= 2")
    return rules.url_matches(pages, "page_id", "url", known.select("rule", F.col("rule").alias("url"))).withColumnRenamed("item", "page_id")


#: Names: the sources of more than a few toxic documents. Texts: how the passages of the benchmark begin.
_RULES = (
    "r AS (SELECT 'name' AS kind, source AS rule, lower(source) AS pattern FROM documents JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) USING (doc_id) GROUP BY source HAVING count(*) >= 3"
    " UNION ALL SELECT 'text', 'b' || item_id, lower(substr(text, 1, 40)) FROM benchmark),"
    " m AS (SELECT doc_id, rule FROM documents JOIN r ON kind = 'name' AND lower(source) = pattern UNION SELECT doc_id, rule FROM documents JOIN r ON kind = 'text' AND contains(lower(text), pattern))"
)


def _rules(spark, d):
    toxic = load(spark, d, "labels").where("toxic = 1").select("doc_id").distinct()
    names = load(spark, d, "documents").join(toxic, "doc_id").groupBy("source").agg(F.count("*").alias("n")).where("n >= 3")
    texts = load(spark, d, "benchmark").select(F.lit("text").alias("kind"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("rule"), F.substring("text", 1, 40).alias("pattern"))
    return names.select(F.lit("name").alias("kind"), F.col("source").alias("rule"), F.col("source").alias("pattern")).unionByName(texts)


@query("join_substring_rules", f"WITH {_RULES} SELECT doc_id, rule FROM m")
def join_substring_rules(spark, d):
    return rules.rule_matches(load(spark, d, "documents"), "doc_id", "source", "text", _rules(spark, d)).withColumnRenamed("item", "doc_id")


@query("redaction", f"WITH {_RULES} SELECT doc_id, md5(CASE WHEN doc_id IN (SELECT doc_id FROM m) THEN '' ELSE text END) AS shown FROM documents")
def redaction(spark, d):
    hidden = rules.redacted(load(spark, d, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text", _rules(spark, d))
    return hidden.select("doc_id", F.md5(F.col("text").cast("binary")).alias("shown"))


#: Documents after changes: toxic ones have another text, those of low quality are gone.
_CHANGED = (
    "changed AS (SELECT doc_id, CASE WHEN coalesce(toxic, 0) = 1 THEN concat('trash of ', source, ' in ', lang) ELSE text END AS text"
    " FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) WHERE coalesce(quality, 1) <> 0)"
)


def _changed_index(spark, d) -> SegmentedIndex:
    """An index of the documents, half of them inserted after the others, with updates and deletions."""
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    index = SegmentedIndex(spark, scratch(spark, "index"))
    late = F.col("lang") == "en"
    index.insert(docs.where(~late | F.col("lang").isNull()).select("doc_id", "text"))
    index.insert(docs.where(late).select("doc_id", "text"))
    toxic = docs.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id")
    index.update(toxic.select("doc_id", F.concat(F.lit("trash of "), F.coalesce("source", F.lit("")), F.lit(" in "), F.coalesce("lang", F.lit(""))).alias("text")))
    index.delete(labels.where("quality = 0").select("doc_id"))
    return index


@query("index_update", f"WITH {_CHANGED} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM changed) GROUP BY term")
def index_update(spark, d):
    return _changed_index(spark, d).terms()


@query("index_search", f"WITH {_CHANGED}, " + _BM25.removeprefix("WITH ").replace("FROM documents", "FROM changed") + " SELECT doc_id, round(score, 5) AS score FROM p")
def index_search(spark, d):
    """All documents with a score, of an index that was changed and then merged."""
    index = _changed_index(spark, d)
    index.merge()
    return index.search(TERMS).select("doc_id", F.round("score", 5).alias("score"))


@query("curate_pipeline")
def curate_pipeline(spark, d):
    """Turns as examples of their role; those that open a conversation are seeds, the benchmark is the golden set."""
    turns = load(spark, d, "conversations").where("conv_id is not null and turn is not null")
    item = (F.col("conv_id") * F.lit(1 << 20) + F.col("turn")).alias("item")
    rows = turns.groupBy(item).agg(F.min("role").alias("label"), F.min("text").alias("text"), (F.min("turn") == 0).alias("seed"))
    return curation.curate(rows, load(spark, d, "benchmark").select("text"), scratch(spark, "curate"))
