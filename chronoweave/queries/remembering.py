"""Conversation turns as new facts: merged into memory, conflicts listed and resolved, centroids and facts read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.catalog import NOW, clusters, facts, load
from chronoweave.functions import vector as vec
from chronoweave.operators import merging
from chronoweave.queries.registry import registry
from chronoweave.queries.retrieval import MEMORY

QUERIES, ORACLES, query = registry()

#: Turns as proposals, aimed at facts all over memory, and what comes of each, in SQL.
MERGE = f"""{MEMORY}, kn AS (SELECT CAST(fact_id AS VARCHAR) AS fact_id, cluster_id, embedding, valid_from, valid_to, source FROM fa), pr AS (
  SELECT 'c' || conv_id || '-' || turn AS fact_id, label + CASE WHEN turn % 6 = 5 THEN 1 ELSE 0 END AS cluster_id, CAST(embedding AS DOUBLE[]) AS embedding,
         TIMESTAMP '2024-01-25 00:00:00' + to_seconds(conv_id * 60 + turn) AS "at", CAST(vec_id AS VARCHAR) AS target,
         CASE WHEN role = 'system' THEN 'noop' WHEN length(text) % 3 = 0 THEN 'update' WHEN length(text) % 3 = 1 THEN 'CONFLICT' END AS action
  FROM conversations JOIN embeddings ON vec_id = (conv_id * 7 + turn * 3) % (SELECT count(*) FROM embeddings)
), wa AS (
  SELECT pr.*, upper(action) AS wanted, kn.fact_id IS NOT NULL AS known,
         count(*) FILTER (WHERE upper(action) = 'UPDATE') OVER (PARTITION BY target, pr.cluster_id ORDER BY pr."at", pr.fact_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed
  FROM pr LEFT JOIN kn ON kn.fact_id = target AND kn.cluster_id = pr.cluster_id AND valid_to IS NULL
), de AS (
  SELECT *, CASE WHEN wanted = 'NOOP' THEN 'NOOP' WHEN wanted IN ('UPDATE', 'CONFLICT') AND known AND closed = 0 THEN wanted ELSE 'ADD' END AS decision FROM wa
), me AS (
  SELECT kn.fact_id, kn.cluster_id, kn.embedding, valid_from, coalesce(de."at", valid_to) AS valid_to, de.fact_id AS superseded_by
  FROM kn LEFT JOIN de ON de.target = kn.fact_id AND decision = 'UPDATE'
  UNION ALL SELECT fact_id, cluster_id, embedding, "at", NULL, NULL FROM de WHERE decision <> 'NOOP'
), ed AS (
  SELECT target || '~' || fact_id AS conflict_id, target AS fact_id_a, fact_id AS fact_id_b, cluster_id, "at" AS created_at FROM de WHERE decision = 'CONFLICT'
)"""


def known_facts(spark, d):
    rows = facts(spark, d).withColumn("fact_id", F.col("fact_id").cast("string"))
    return rows.withColumn("superseded_by", F.lit(None).cast("string"))


def decisions(spark, d):
    """Each turn says what a fact of its own says, and updates or contradicts it by the length of its text."""
    vectors = load(spark, d, "embeddings")
    count = F.broadcast(vectors.agg(F.count("*").alias("n")))  # one row
    aimed = load(spark, d, "conversations").crossJoin(count).withColumn("vec_id", (F.col("conv_id") * 7 + F.col("turn") * 3) % F.col("n"))
    rest = F.length("text") % 3
    proposals = aimed.join(vectors, "vec_id").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("fact_id"),
        (F.col("label") + (F.col("turn") % 6 == 5).cast("int")).alias("cluster_id"),
        "embedding",
        (F.to_timestamp_ntz(F.lit("2024-01-25 00:00:00")) + F.make_interval(secs=F.col("conv_id") * 60 + F.col("turn"))).alias("at"),
        F.lit("agent").alias("source"),
        F.when(F.col("role") == "system", "noop").when(rest == 0, "update").when(rest == 1, "CONFLICT").alias("action"),
        F.col("vec_id").cast("string").alias("target"),
    )
    return merging.decided(known_facts(spark, d), proposals)


@query("fact_add", f"WITH {MERGE} SELECT fact_id, cluster_id, valid_from FROM me WHERE fact_id LIKE 'c%'")
def fact_add(spark, d):
    after = merging.merged(known_facts(spark, d), decisions(spark, d))
    return after.where(F.col("fact_id").startswith("c")).select("fact_id", "cluster_id", "valid_from")


@query("fact_update", f"WITH {MERGE} SELECT fact_id, valid_to, superseded_by FROM me WHERE fact_id NOT LIKE 'c%'")
def fact_update(spark, d):
    after = merging.merged(known_facts(spark, d), decisions(spark, d))
    return after.where(~F.col("fact_id").startswith("c")).select("fact_id", "valid_to", "superseded_by")


@query("fact_noop", f"WITH {MERGE} SELECT decision, count(*) AS n FROM de GROUP BY decision")
def fact_noop(spark, d):
    return decisions(spark, d).groupBy("decision").agg(F.count("*").alias("n"))


@query("fact_conflict", f"WITH {MERGE} SELECT conflict_id, fact_id_a, fact_id_b, cluster_id, created_at FROM ed")
def fact_conflict(spark, d):
    return merging.conflicts(decisions(spark, d)).drop("resolved_at", "resolution")


@query(
    "conflict_list",
    f"WITH {MERGE} SELECT conflict_id, a.source AS fact_a, coalesce(b.source, 'agent') AS fact_b FROM ed JOIN kn a ON a.fact_id = fact_id_a LEFT JOIN kn b ON b.fact_id = fact_id_b ORDER BY created_at DESC, conflict_id LIMIT 3",
)
def conflict_list(spark, d):
    found = decisions(spark, d)
    return merging.open_conflicts(merging.conflicts(found), merging.merged(known_facts(spark, d), found), "source", 3)


@query(
    "conflict_resolve",
    f"WITH {MERGE} SELECT conflict_id, resolved_at, CASE WHEN resolved_at IS NOT NULL THEN 'superseded' END AS resolution FROM (SELECT conflict_id,"
    f" CASE WHEN fact_id_a IN (SELECT fact_id FROM me WHERE superseded_by IS NOT NULL) OR fact_id_b IN (SELECT fact_id FROM me WHERE superseded_by IS NOT NULL) THEN TIMESTAMP '{NOW}' END AS resolved_at FROM ed)",
)
def conflict_resolve(spark, d):
    found = decisions(spark, d)
    gone = merging.merged(known_facts(spark, d), found).where("superseded_by is not null")
    return merging.resolved(merging.conflicts(found), gone, F.to_timestamp_ntz(F.lit(NOW)), "superseded").select("conflict_id", "resolved_at", "resolution")


@query(
    "fact_merge_centroids",
    f"WITH {MERGE}, ac AS (SELECT * FROM me WHERE valid_to IS NULL AND cluster_id IN (SELECT cluster_id FROM de WHERE decision <> 'NOOP')),"
    " mm AS (SELECT cluster_id, pos, avg(x) AS m, count(*) AS n FROM (SELECT cluster_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM ac) GROUP BY cluster_id, pos)"
    " SELECT cluster_id, max(n) AS fact_count, round(sqrt(sum(m * m)), 5) AS length FROM mm GROUP BY cluster_id",
)
def fact_merge_centroids(spark, d):
    found = decisions(spark, d)
    after = merging.touched_centroids(merging.merged(known_facts(spark, d), found), found)
    return after.select("cluster_id", "fact_count", F.round(vec.norm("centroid"), 5).alias("length"))


@query("memory_fetch", f"WITH {MEMORY} SELECT fact_id, valid_from FROM fa WHERE 'cluster ' || cluster_id = 'cluster 5' AND valid_to IS NULL ORDER BY valid_from, fact_id")
def memory_fetch(spark, d):
    named = clusters(spark, d).withColumn("label", F.concat(F.lit("cluster "), F.col("cluster_id").cast("string")))
    return merging.active_facts(facts(spark, d), named, "Cluster 5").select("fact_id", "valid_from")
