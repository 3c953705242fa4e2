"""New facts merged into memory: valid-time rows that are added, replaced, dropped or set against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.vector import mean_vector


def decided(facts: DataFrame, proposals: DataFrame) -> DataFrame:
    """``proposals(fact_id, cluster_id, at, action, target, ...)`` with decision: ADD, UPDATE, NOOP or CONFLICT.

    They are taken in the order of (at, fact_id), neither of them null. An update or conflict needs an active
    fact of its own cluster as target, else it adds; as an update closes its target, later ones of the same
    target add. A null or unknown action adds. Targets are facts from before these proposals.
    """
    wanted, place = F.upper("action"), F.struct("at", "fact_id")
    first = proposals.where(wanted == "UPDATE").groupBy("target", "cluster_id").agg(F.min(place).alias("closes"))
    active = facts.where("valid_to is null").select(F.col("fact_id").alias("target"), "cluster_id")
    open_to = active.join(first, ["target", "cluster_id"], "left").withColumn("is_open", F.lit(True))
    met = proposals.join(open_to, ["target", "cluster_id"], "left")
    in_time = F.col("is_open") & (F.col("closes").isNull() | (place <= F.col("closes")))
    decision = F.when(wanted == "NOOP", "NOOP").when(wanted.isin("UPDATE", "CONFLICT") & in_time, wanted).otherwise("ADD")
    return met.select(*proposals.columns, decision.alias("decision"))


def merged(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """``facts(..., valid_from, valid_to, superseded_by)`` after ``decisions``: updated ones are closed, new ones are there."""
    new = decisions.where("decision != 'NOOP'").withColumns(
        {"valid_from": F.col("at"), "valid_to": F.lit(None).cast("timestamp_ntz"), "superseded_by": F.lit(None).cast("string")}
    )
    by = decisions.where("decision = 'UPDATE'").select(F.col("target").alias("fact_id"), F.col("fact_id").alias("by"), F.col("at").alias("closed"))
    changed = {"valid_to": F.coalesce("closed", "valid_to"), "superseded_by": F.coalesce("by", "superseded_by")}
    return facts.join(by, "fact_id", "left").withColumns(changed).select(*facts.columns).unionByName(new.select(*facts.columns))


def conflicts(decisions: DataFrame) -> DataFrame:
    """An edge for each conflict of ``decisions``: the fact that was there, the new one, and that it is open."""
    return decisions.where("decision = 'CONFLICT'").select(
        F.concat_ws("~", "target", "fact_id").alias("conflict_id"),
        F.col("target").alias("fact_id_a"),
        F.col("fact_id").alias("fact_id_b"),
        "cluster_id",
        F.col("at").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        F.lit(None).cast("string").alias("resolution"),
    )


def open_conflicts(edges: DataFrame, facts: DataFrame, said: str, k: int) -> DataFrame:
    """(conflict_id, fact_a, fact_b): the newest ``k`` open conflicts with what both facts say; both facts must be known."""
    side = {x: facts.select(F.col("fact_id").alias(f"fact_id_{x}"), F.col(said).alias(f"fact_{x}")) for x in "ab"}
    told = edges.where("resolved_at is null").join(side["a"], "fact_id_a").join(side["b"], "fact_id_b")
    return told.orderBy(F.desc("created_at"), "conflict_id").limit(k).select("conflict_id", "fact_a", "fact_b")


def resolved(edges: DataFrame, settled: DataFrame, at: Column, resolution: str) -> DataFrame:
    """``edges`` with every open conflict closed that touches a fact of ``settled(fact_id)``."""
    ids = settled.select("fact_id").distinct()
    out = edges
    for x in "ab":
        out = out.join(ids.select(F.col("fact_id").alias(f"fact_id_{x}"), F.lit(True).alias(f"met_{x}")), f"fact_id_{x}", "left")
    closes = F.col("resolved_at").isNull() & (F.col("met_a").isNotNull() | F.col("met_b").isNotNull())
    changed = {"resolved_at": F.when(closes, at).otherwise(F.col("resolved_at")), "resolution": F.when(closes, resolution).otherwise(F.col("resolution"))}
    return out.withColumns(changed).select(*edges.columns)


def touched_centroids(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(cluster_id, centroid, fact_count) of the active facts, for the clusters that ``decisions`` changed alone."""
    touched = decisions.where("decision != 'NOOP'").select("cluster_id").distinct()
    return mean_vector(facts.where("valid_to is null").join(touched, "cluster_id", "left_semi"), "cluster_id", "embedding")


def active_facts(facts: DataFrame, clusters: DataFrame, label: str) -> DataFrame:
    """The active facts of the clusters of a label, whatever its case, the oldest first."""
    named = clusters.where(F.lower("label") == label.lower()).select("cluster_id")
    return facts.where("valid_to is null").join(named, "cluster_id", "left_semi").orderBy("valid_from", "fact_id")
