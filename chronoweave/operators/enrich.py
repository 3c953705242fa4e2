"""Enrichment of events: rules, scores, baselines, cached verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.05
WARM_UP = 30


def ewma_states(df: DataFrame, key: str, order: str, value: str, alpha: float = ALPHA) -> DataFrame:
    """(key, states): for each row of a key in order the struct (order, value, count, mean, var) after it.

    The first value sets the mean and counts for nothing; each later one moves mean and variance.
    """
    item = F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("x"))
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    empty = F.array().cast("array<struct<o: bigint, x: double, n: bigint, mean: double, var: double>>")

    def step(states: Column, row: Column) -> Column:
        last = F.element_at(states, -1)
        delta = row["x"] - last["mean"]
        after = F.struct(
            row["o"].cast("bigint").alias("o"),
            row["x"].alias("x"),
            (last["n"] + 1).cast("bigint").alias("n"),
            (alpha * row["x"] + (1 - alpha) * last["mean"]).alias("mean"),
            ((1 - alpha) * (last["var"] + alpha * delta * delta)).alias("var"),
        )
        first = F.struct(
            row["o"].cast("bigint").alias("o"), row["x"].alias("x"), F.lit(0).cast("bigint").alias("n"), row["x"].alias("mean"), F.lit(0.0).alias("var")
        )
        return F.concat(states, F.array(F.when(F.size(states) == 0, first).otherwise(after)))

    return rows.select(key, F.aggregate("rows", empty, step).alias("states"))


def ewma_last(df: DataFrame, key: str, order: str, value: str, alpha: float = ALPHA) -> DataFrame:
    """(key, n, mean, var) after all rows of each key; the state is one struct, whatever the rows."""
    item = F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("x"))
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    start = F.struct(
        F.lit(-1).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("var")
    )

    def step(s: Column, row: Column) -> Column:
        delta = row["x"] - s["mean"]
        first = s["n"] < 0
        return F.struct(
            (s["n"] + 1).cast("bigint").alias("n"),
            F.when(first, row["x"]).otherwise(alpha * row["x"] + (1 - alpha) * s["mean"]).alias("mean"),
            F.when(first, F.lit(0.0)).otherwise((1 - alpha) * (s["var"] + alpha * delta * delta)).alias("var"),
        )

    return rows.select(key, F.aggregate("rows", start, step).alias("s")).select(key, "s.n", "s.mean", "s.var")


def z_score(x: Column, mean: Column, var: Column, n: Column) -> Column:
    """The deviation from the baseline in standard deviations, two digits; null before 30 samples or without variance."""
    return F.when((n >= WARM_UP) & (var > 1e-6), F.round((x - mean) / F.sqrt(var), 2))


def tier0(event_type: Column, value: Column, same_as_before: Column) -> Column:
    """The verdict of ordered rules as a struct (verdict, score, reason), or null where none decides."""
    verdict = lambda v, s, r: F.struct(F.lit(v).alias("verdict"), F.lit(s).alias("score"), F.lit(r).alias("reason"))
    return (
        F.when((event_type == "view") & (value < 2), verdict("not_interesting", 0, "too short"))
        .when((event_type == "click") & same_as_before, verdict("not_interesting", 0, "same window"))
        .when((event_type == "signup") & (value < 3), verdict("not_interesting", 1, "short text"))
        .when((event_type == "error") & (value > 40), verdict("interesting", 9, "anomaly"))
    )


def tier1(score: Column) -> Column:
    """The verdict of a feature score: floor within 0 to 10; 7 or more is interesting, 4 or fewer isn't, else null."""
    whole = clamp_floor(score)
    return F.when(whole >= 7, "interesting").when(whole <= 4, "not_interesting")


def clamp_floor(score: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.least(F.lit(10.0), score))).cast("int")


def recent_duplicates(df: DataFrame, look_back_s: int, most: int, fingerprint: str, ts: str, item: str) -> DataFrame:
    """``df`` with duplicate_of, the newest earlier row of the same fingerprint within ``look_back_s``.

    It must be among the ``most`` rows before this one in time. Rows get their number in time once;
    then each looks back within its fingerprint only.
    """
    # The number in time needs a global order: counts of ranges of time come first, then places in a range.
    spot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(3_600_000_000)).alias("spot")
    rows = df.withColumn("spot", spot)
    counts = rows.groupBy("spot").agg(F.count("*").alias("n"))
    before = counts.select("spot", F.coalesce(F.sum("n").over(Window.orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("spot").orderBy(ts, item)) + F.col("before")
    numbered = rows.join(before, "spot").withColumn("place", place).drop("spot", "before")
    own = Window.partitionBy(fingerprint).orderBy("place")
    last, last_place, last_ts = (F.lag(c).over(own) for c in (item, "place", ts))
    fresh = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(last_ts.cast("timestamp")) <= look_back_s * 1_000_000
    return numbered.withColumn("duplicate_of", F.when(fresh & (F.col("place") - last_place <= most), last)).drop("place")


def bursts(df: DataFrame, key: str, ts: str, gap_s: float, least: int) -> DataFrame:
    """Bursts of at least ``least`` rows of a key without a gap over ``gap_s``."""
    from chronoweave.operators.sessions import gap_sessions

    return gap_sessions(df, key, ts, gap_s).where(F.col("event_count") >= least)


def phrases_found(text: Column, phrases: list[str]) -> Column:
    """The phrases that the lower-cased text contains, in their order."""
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower(text), p))


def first_hit(text: Column, term: str) -> Column:
    """The offset, from 0, of the first match of a term as a whole word, or null."""
    at = F.regexp_instr(text, F.lit(rf"(?i)\b{term}\b"))
    return F.when(at > 0, at - 1)


def fires(at: Column, cooldown: int) -> Column:
    """How many of the sorted instants of an array fire, when none does within ``cooldown`` of the last that did."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        on = s["last"].isNull() | (x - s["last"] >= cooldown)
        return F.struct(F.when(on, x).otherwise(s["last"]).alias("last"), (s["n"] + on.cast("long")).alias("n"))

    return F.aggregate(at, start, step, lambda s: s["n"])


def backlog(df: DataFrame, key: str, deferred: Column, pending: Column, ts: str, now: Column, many: int, old_s: int) -> DataFrame:
    """(key, deferred, pending, recommend): catching up is due with ``many`` deferred rows, or one ``old_s`` old."""
    from chronoweave.operators.sessions import seconds_between

    counts = df.groupBy(key).agg(F.count_if(deferred).alias("deferred"), F.count_if(pending).alias("pending"), F.min(F.when(deferred, F.col(ts))).alias("oldest"))
    due = (F.col("deferred") >= many) | ((F.col("deferred") > 0) & (seconds_between(now, F.col("oldest")) >= old_s))
    return counts.select(key, "deferred", "pending", F.coalesce(due, F.lit(False)).alias("recommend"))


def seen_before(text: Column, before: Column) -> Column:
    """A verdict without a model: what the rows before say already isn't interesting; without such rows none."""
    return F.when(F.size(before) == 0, F.lit(None)).when(F.array_contains(before, text), "not_interesting").otherwise("interesting")


def tier2(df: DataFrame, key: str, order: list[str], text: str, decide: Callable[[Column, Column], Column] = seen_before, context: int = 3) -> DataFrame:
    """``df`` with a verdict where it was null, by ``decide(text, texts of up to ``context`` rows before)``.

    A null of ``decide`` leaves the row deferred.
    """
    own = Window.partitionBy(key).orderBy(*order)
    before = F.array_compact(F.array(*[F.lag(text, n).over(own) for n in range(context, 0, -1)]))
    rows = df.withColumn("before", before)
    return rows.withColumn("verdict", F.coalesce("verdict", decide(F.col(text), F.col("before")))).drop("before")
