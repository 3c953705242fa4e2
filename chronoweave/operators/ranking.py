"""Ranking: inverted index, BM25, hybrids of similarity and recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.text import words


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(term, doc_id, tf): how often each term is in each document."""
    terms = docs.select(F.col(doc_id).alias("doc_id"), F.explode(words(F.col(text))).alias("term"))
    return terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def _times(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda word: word == term))


def bm25(docs: DataFrame, doc_id: str, text: str, terms: list[str], k: int = 20) -> DataFrame:
    """(doc_id, score): the k best documents for any of ``terms``, ties to the smaller id.

    k1 = 1.2, b = 0.75; an idf that isn't positive counts as 1e-6. Terms are counted where the texts
    lie, and only documents that have one are shuffled.
    """
    # The explode of one element keeps the optimizer from tokenizing again for each term.
    tokens = F.col("tokens")
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(words(F.col(text)))).alias("tokens")).select(
        "doc_id",
        F.size(tokens).alias("len"),
        *[_times(tokens, t).cast("double").alias(f"f{i}") for i, t in enumerate(terms)],
    )
    stats = counted.agg(
        F.count("*").cast("double").alias("docs"),
        F.avg("len").alias("mean"),
        *[F.sum((F.col(f"f{i}") > 0).cast("double")).alias(f"n{i}") for i in range(len(terms))],
    )
    any_hit = sum((F.col(f"f{i}") for i in range(len(terms))), F.lit(0.0)) > 0
    joined = counted.where(any_hit).crossJoin(F.broadcast(stats))  # stats is one row

    def part(i: int) -> Column:
        raw = F.log((F.col("docs") - F.col(f"n{i}") + F.lit(0.5)) / (F.col(f"n{i}") + F.lit(0.5)))
        idf = F.when(raw > 0, raw).otherwise(F.lit(1e-6))
        f = F.col(f"f{i}")
        return idf * f * F.lit(2.2) / (f + F.lit(1.2) * (F.lit(0.25) + F.lit(0.75) * F.col("len") / F.col("mean")))

    score = sum((part(i) for i in range(len(terms))), F.lit(0.0))
    return joined.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def top_per_group(df: DataFrame, group: str, score: str, item: str, k: int) -> DataFrame:
    """The k rows with the highest score of each group, ties to the smaller item, with their place."""
    order = Window.partitionBy(group).orderBy(F.desc(score), item)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def recency_in_set(df: DataFrame, ts: str) -> DataFrame:
    """``df`` with recency from 0 (oldest row) to 1 (newest) of its own rows, which are few."""
    from chronoweave.operators.sessions import seconds_between

    ends = df.agg(F.min(ts).alias("oldest"), F.max(ts).alias("newest"))
    span = F.greatest(seconds_between(F.col("newest"), F.col("oldest")), F.lit(1.0))
    return df.crossJoin(F.broadcast(ends)).withColumn("recency", seconds_between(F.col(ts), F.col("oldest")) / span).drop("oldest", "newest")


def page(ordered: DataFrame, limit: int, offset: int, most: int) -> DataFrame:
    """Rows of an ordered frame from ``offset`` on; the limit is cut to 1 to ``most``, the offset to 0 or more."""
    return ordered.offset(max(0, offset)).limit(max(1, min(most, limit)))


def rendered(rows: DataFrame, order: list[str], line: str, most_rows: int, most_chars: int) -> DataFrame:
    """One row, shown: how many of how many rows are shown, and the first rows' lines, cut at ``most_chars``."""
    total = rows.agg(F.count("*").alias("total"))
    top = rows.select(*order, line).orderBy(*order).limit(most_rows)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda x: x[line])
    text = F.concat(F.lit("showing "), F.size("lines").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit("\n"), F.array_join("lines", "\n"))
    return top.agg(lines.alias("lines")).crossJoin(F.broadcast(total)).select(F.substring(text, 1, most_chars).alias("shown"))  # one row each


def within_budget(df: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """Rows of a key in order until their texts have ``most`` characters; the last one is cut. A null text has none."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = df.withColumn("used", F.coalesce(F.sum(F.length(text)).over(before), F.lit(0)))
    return used.where(F.col("used") < most).withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(most) - F.col("used")).cast("int"))).drop("used")


def artifacts(df: DataFrame, text: str, terms: list[str], ts: str, item: str, k: int, fall_back: bool = True) -> DataFrame:
    """The ``k`` rows with the most of ``terms`` in their text, newest first among equals, with score, that share.

    Rows without text don't count, nor rows without any term. Without terms the newest rows come, with
    score 0, if ``fall_back``, else none.
    """
    from chronoweave.functions.text import keyword_share

    shown = df.where(F.trim(F.col(text)) != "").withColumn("score", keyword_share(F.col(text), terms))
    wanted = shown.where("score > 0") if terms else shown.where(F.lit(fall_back))
    return wanted.orderBy(F.desc("score"), F.desc(ts), item).limit(k)
