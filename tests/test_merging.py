"""The merge of a batch of facts gives what taking them one at a time gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import merging

START = datetime(2024, 1, 1)
FACTS = "fact_id string, cluster_id int, embedding array<double>, valid_from timestamp_ntz, valid_to timestamp_ntz, superseded_by string, source string"
NEW = "fact_id string, cluster_id int, embedding array<double>, at timestamp_ntz, source string, action string, target string"


def one_by_one(facts, proposals):
    held = {x[0]: dict(cluster=x[1], valid_to=x[4], by=x[5]) for x in facts}
    old, edges, dropped = set(held), [], 0
    for name, cluster, _, at, _, action, target in sorted(proposals, key=lambda x: (x[3], x[0])):
        wanted = (action or "ADD").upper()
        if wanted == "NOOP":
            dropped += 1
            continue
        known = target in old and held[target]["cluster"] == cluster and held[target]["valid_to"] is None
        if wanted == "UPDATE" and known:
            held[target].update(valid_to=at, by=name)
        if wanted == "CONFLICT" and known:
            edges.append((target, name))
        held[name] = dict(cluster=cluster, valid_to=None, by=None)
    return held, edges, dropped


@pytest.fixture(scope="module")
def tables(spark):
    dice = random.Random(5)
    facts = [(f"f{k}", k % 4, [float(k), 1.0], START, START if k % 9 == 0 else None, None, "agent") for k in range(40)]
    actions = ["update", "UPDATE", "Conflict", "NOOP", "add", None, "other"]
    new = [
        (f"n{k}", dice.randrange(4), [1.0, float(k)], START + timedelta(hours=dice.randrange(60)), "agent", dice.choice(actions), dice.choice(["f1", "f2", f"f{dice.randrange(50)}", None]))
        for k in range(300)
    ]
    return facts, new, spark.createDataFrame(facts, FACTS), spark.createDataFrame(new, NEW)


def test_merge(tables):
    facts, new, known, proposals = tables
    held, edges, dropped = one_by_one(facts, new)
    found = merging.decided(known, proposals)
    assert found.count() == len(new) and found.where("decision = 'NOOP'").count() == dropped
    after = {x.fact_id: dict(cluster=x.cluster_id, valid_to=x.valid_to, by=x.superseded_by) for x in merging.merged(known, found).collect()}
    assert after == held
    assert any(x["by"] for x in held.values()) and edges
    assert sorted((x.fact_id_a, x.fact_id_b) for x in merging.conflicts(found).collect()) == sorted(edges)


def test_conflicts_and_centroids(tables):
    facts, new, known, proposals = tables
    held, edges, _ = one_by_one(facts, new)
    found = merging.decided(known, proposals)
    after, open_edges = merging.merged(known, found), merging.conflicts(found)
    newest = [x.conflict_id for x in merging.open_conflicts(open_edges, after, "source", 3).collect()]
    at = {x[0]: x[3] for x in new}
    assert newest == ["~".join(e) for e in sorted(edges, key=lambda e: (-at[e[1]].timestamp(), "~".join(e)))][:3]
    settled = after.where("fact_id = 'f1'").select("fact_id")
    closed = merging.resolved(open_edges, settled, F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")), "override").where("resolved_at is not null")
    assert sorted((x.fact_id_a, x.fact_id_b) for x in closed.collect()) == sorted(e for e in edges if "f1" in e)
    counts = {x.cluster_id: x.fact_count for x in merging.touched_centroids(after, found).collect()}
    active = [x["cluster"] for x in held.values() if x["valid_to"] is None]
    assert counts == {k: active.count(k) for k in set(active)}


def test_nothing(tables):
    _, _, known, proposals = tables
    none = merging.decided(known, proposals.where("false"))
    assert none.count() == 0
    assert merging.merged(known, none).count() == known.count()
    assert merging.touched_centroids(known, none).count() == 0
    alone = merging.decided(known.where("false"), proposals).groupBy("decision").count().collect()
    assert {x.decision for x in alone} == {"ADD", "NOOP"}
