"""Running states against a fold over each key's rows, with a hot key over many partitions."""

import math
import re

import numpy as np
import pytest

from chronoweave.operators import joins, memory, scans
from chronoweave.sources.shared import scratch


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small partitions stay apart, as large ones do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def fold(rows, alpha):
    out, state = {}, {}
    for key, place, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if x is None:
            continue
        n, mean, var = state.get(key, (-1, 0.0, 0.0))
        if n < 0:
            mean, var = x, 0.0
        else:
            delta = x - mean
            mean, var = alpha * x + (1 - alpha) * mean, (1 - alpha) * (var + alpha * delta * delta)
        state[key] = n + 1, mean, var
        out[place] = state[key]
    return out


@pytest.mark.parametrize("share", [0.2, 0.98])
def test_means_and_variances(spark, share):
    rng = np.random.default_rng(int(share * 100))
    keys = [5 if rng.random() < share else None if rng.random() < 0.1 else int(rng.integers(0, 40)) for _ in range(6000)]
    rows = [(k, int(p), None if p % 97 == 0 else float(rng.normal() * 10 + 3)) for k, p in zip(keys, rng.permutation(6000), strict=True)]
    df = spark.createDataFrame(rows, "key long, place long, x double").repartition(5)
    found = {r.place: (r.n, r["mean"], r["var"]) for r in scans.ewma_scan(df, "key", ["place"], "x", scratch(spark, "test-scan"), 0.05).collect()}
    want = fold(rows, 0.05)
    assert set(found) == set(want)
    assert all(found[p][0] == n and math.isclose(found[p][1], m, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(found[p][2], v, rel_tol=1e-9, abs_tol=1e-9) for p, (n, m, v) in want.items())


def test_a_hot_key_is_dealt_to_many_tasks(spark):
    df = spark.range(200_000).selectExpr("1L key", "id", "cast(id % 7 as double) x")
    done = scans.affine_scan(df.selectExpr("*", "1.0D one"), "key", ["id"], "one", "x", "x", scratch(spark, "test-sum"), "total")
    parts = spark.read.parquet(done.inputFiles()[0].rsplit("/", 1)[0]).groupBy("total_part").count().collect()
    assert len(parts) >= 4 and max(x["count"] for x in parts) < 80_000
    last = done.where("id = 199999").first()
    assert last.total == sum(k % 7 for k in range(200_000)) and last.total_n == 199_999
    assert scans.affine_scan(df.limit(0).selectExpr("*", "1.0D one"), "key", ["id"], "one", "x", "x", scratch(spark, "test-sum"), "total").count() == 0


def test_trailing_counts(spark):
    rng = np.random.default_rng(7)
    rows = [(k, None if rng.random() < 0.3 else "a", None if rng.random() < 0.05 else int(rng.integers(0, 40)) * 500_000) for k in range(300)] + [(300, "b", None)]
    df = spark.createDataFrame(rows, "id long, key string, us long").selectExpr("*", "cast(timestamp_micros(us) as timestamp_ntz) ts")
    for span, bucket in ((5, 3600), (5, 2), (0, 1)):
        found = {x.id: x.n for x in scans.trailing_counts(df, ["key"], "ts", span, "n", bucket).collect()}
        want = {k: sum(g == key and (u is None if us is None else u is not None and us - span * 1_000_000 <= u <= us) for _, g, u in rows) for k, key, us in rows}
        assert found == want


def test_counts_have_no_frame_of_a_range(spark):
    """A frame of seven days counts its rows anew for each row."""
    from chronoweave.queries import QUERIES

    for name in ("agg_novelty_count", "win_novelty_range", "tier1_score"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
        assert set(re.findall(r"specifiedwindowframe\(RangeFrame, (.*?), ", plan)) <= {"unboundedpreceding$()"}, name


@pytest.mark.parametrize("tolerance", [0, 3])
def test_nearest_makes_no_pairs(spark, tolerance):
    rng = np.random.default_rng(11)
    left = [(k // 2, None if k % 50 == 0 else int(rng.integers(0, 400)) * 250_000) for k in range(200)]
    right = [(None if k % 40 == 0 else 300 - k, None if k % 60 == 1 else int(rng.integers(0, 400)) * 250_000) for k in range(150)]
    make = lambda rows, a: spark.createDataFrame(rows, f"{a} long, us long").selectExpr(a, f"cast(timestamp_micros(us) as timestamp_ntz) {a}_ts")
    done = joins.nearest(make(left, "p"), make(right, "v"), "p", "p_ts", "v", "v_ts", tolerance)
    assert done.columns == ["p", "p_ts", "v", "v_ts", "delta_s"]
    want = {}
    for p, at in left:
        for v, us in right:
            if at is not None and us is not None and abs(us - at) <= tolerance * 1_000_000:
                want[p] = min(want.get(p, (1 << 60, True, 0)), (abs(us - at), v is None, v or 0))
    assert {x.p: (round(abs(x.delta_s) * 1e6), x.v is None, x.v or 0) for x in done.collect()} == want
    instants = spark.range(4000).selectExpr("id", "cast(timestamp_micros(id * 10) as timestamp_ntz) ts")
    crowd = joins.nearest(instants.toDF("p", "p_ts"), instants.toDF("v", "v_ts"), "p", "p_ts", "v", "v_ts", 300)
    assert crowd.where("p = v").count() == 4000 and " Join " not in crowd._jdf.queryExecution().optimizedPlan().toString().replace("\n", " ")


def test_frames_in_batches_of_many_groups(spark):
    """Batches of 7 rows cut groups anywhere; a group of frames is not one call of Python."""
    rng = np.random.default_rng(3)
    rows = [(k, None if k % 9 == 0 else int(rng.integers(0, 6)), int(t), int(rng.choice([0, 1, 7, 255]))) for k, t in enumerate(rng.permutation(4000)[:500] * 3)]
    df = spark.createDataFrame(rows, "id long, g long, at long, mark long").repartition(5)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        for span, gap in ((60, 0), (500, 40)):
            groups, kept = memory.frame_groups(df, ["g"], "at", "mark", 2, span), memory.kept_frames(df, ["g"], "at", "mark", 2, gap)
            assert "FlatMapGroupsInPandas" not in groups._jdf.queryExecution().toString() + kept._jdf.queryExecution().toString()
            found = {x.id: x.frame_group for x in groups.collect()}, {x.id: x.kept for x in kept.collect()}
            want = {}, {}
            for key in {g for _, g, _, _ in rows}:
                own = sorted((r for r in rows if r[1] == key), key=lambda r: r[2])
                root, last = {r[0]: [r] for r in own}, None
                for i, a in enumerate(own):
                    for b in own[i + 1 :]:
                        both = root[a[0]] + root[b[0]]
                        if root[a[0]] is not root[b[0]] and b[2] - a[2] <= span and (a[3] ^ b[3]).bit_count() <= 2 and max(r[2] for r in both) - min(r[2] for r in both) <= span:
                            root |= {r[0]: both for r in both}
                    want[1][a[0]] = last is None or (a[2] - last[2] >= gap and (a[3] ^ last[3]).bit_count() > 2)
                    last = a if want[1][a[0]] else last
                want[0].update({r[0]: min(x[2] for x in root[r[0]]) for r in own})
            assert found == want
    finally:
        spark.conf.set(name, before)


def test_frames_without_mark_or_instant(spark):
    df = spark.createDataFrame([(0, 1, None, 5), (1, 1, 10, None), (2, 1, 11, 5), (3, 1, 12, 5)], "id long, g long, at long, mark long")
    assert {x.id: x.frame_group for x in memory.frame_groups(df, ["g"], "at", "mark").collect()} == {0: None, 1: 10, 2: 11, 3: 11}
    assert {x.id: x.kept for x in memory.kept_frames(df, ["g"], "at", "mark").collect()} == {0: True, 1: True, 2: True, 3: False}
