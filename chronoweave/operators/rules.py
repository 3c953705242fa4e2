"""Tables of rules met by texts and addresses: many substrings at once, and prefixes of paths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the patterns' characters in one automaton; more are met in several passes.
AUTOMATON_CHARS = 8_000_000


def substring_matches(items: DataFrame, item: str, text: str, rules: DataFrame, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(item, rule): each rule of ``rules(rule, pattern)`` whose pattern is within the text of an item, once; case doesn't count.

    All patterns are looked for in one pass over a text, by an Aho-Corasick automaton that each worker builds of
    the broadcast rules. Patterns of more than ``most_chars`` characters are split by hash into
    blocks of about that size, with a pass over the items for each. Null or empty patterns and null texts match nothing.
    """
    known = rules.where(F.length("pattern") > 0).select("rule", F.lower("pattern").alias("pattern")).distinct()
    chars = known.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-chars // most_chars))
    lowered = items.where(F.col(text).isNotNull()).select(F.col(item).alias("item"), F.lower(text).alias("text"))
    kinds = f"item {lowered.schema['item'].dataType.simpleString()}, rule {known.schema['rule'].dataType.simpleString()}"
    found = None
    for block in range(blocks):
        own = known.where(F.pmod(F.xxhash64("rule"), F.lit(blocks)) == block).toArrow()
        shared = items.sparkSession.sparkContext.broadcast((own["rule"].combine_chunks(), own["pattern"].to_pylist()))

        def meet(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            rules, patterns = shared.value
            coded = rules.dictionary_encode()
            names, machine, numbers = coded.dictionary, ahocorasick.Automaton(), {}
            for number, pattern in zip(coded.indices.to_pylist(), patterns, strict=True):
                numbers.setdefault(pattern, []).append(number)
            for pattern, own in numbers.items():
                machine.add_word(pattern, own)
            machine.make_automaton()
            for batch in batches:
                at, hits = [], []
                for row, value in enumerate(batch["text"].to_pylist()):
                    met = {number for _, own in machine.iter(value) for number in own} if patterns else ()
                    at += [row] * len(met)
                    hits += met
                yield pa.RecordBatch.from_arrays([batch["item"].take(pa.array(at, pa.int64())), names.take(pa.array(hits, pa.int64()))], names=["item", "rule"])

        part = lowered.mapInArrow(meet, kinds)
        found = part if found is None else found.unionByName(part)
    return found


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without ``www.``) and path (without slashes at its end, at least ``/``) of an address; https where no scheme is given."""
    text = F.trim(url)
    whole = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.regexp_replace(F.lower(F.regexp_extract(whole, r"^[^:/?#]+://([^/?#]*)", 1)), r"^www\.", "")
    path = F.rtrim(F.regexp_extract(whole, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.lit("/"))
    return host, F.when(path == "", "/").otherwise(path)


def url_matches(items: DataFrame, item: str, url: str, rules: DataFrame) -> DataFrame:
    """(item, rule): each rule of ``rules(rule, url)`` with the host of an item's address and the path of it or of a folder above.

    Each item is joined by its host and all folders of its path, down to the depth of the deepest rule; a rule's path is one key.
    Addresses without a host match nothing.
    """
    host, path = address_parts(F.col("url"))
    known = rules.select("rule", host.alias("host"), path.alias("path")).where("host != ''").distinct()
    depth = F.when(F.col("path") == "/", 0).otherwise(F.size(F.split("path", "/")) - 1)
    deepest = known.agg(F.coalesce(F.max(depth), F.lit(0)).alias("n")).first().n
    host, path = address_parts(F.col(url))
    parts = items.select(F.col(item).alias("item"), host.alias("host"), path.alias("whole")).where("host != ''")
    names = F.split(F.substring_index("whole", "/", deepest + 1), "/")
    folders = F.when(F.col("whole") == "/", F.array(F.lit("/"))).otherwise(
        F.concat(F.array(F.lit("/")), F.transform(F.sequence(F.lit(2), F.size(names)), lambda k: F.array_join(F.slice(names, 1, k), "/")))
    )
    each = parts.select("item", "host", F.explode(folders).alias("path"))
    return each.join(known, ["host", "path"]).select("item", "rule").distinct()


def rule_matches(items: DataFrame, item: str, name: str, text: str, rules: DataFrame) -> DataFrame:
    """(item, rule): rules of ``rules(rule, kind, pattern)`` whose pattern equals the name (kind ``name``) or is within the text (kind ``text``), case aside."""
    named = rules.where("kind = 'name'").select("rule", F.lower("pattern").alias("name")).distinct()
    by_name = items.select(F.col(item).alias("item"), F.lower(name).alias("name")).join(named, "name").select("item", "rule")
    return by_name.unionByName(substring_matches(items, item, text, rules.where("kind = 'text'").select("rule", "pattern"))).distinct()


def redacted(items: DataFrame, item: str, name: str, text: str, rules: DataFrame) -> DataFrame:
    """``items`` with an empty ``text`` where any of ``rules`` matches; ids are distinct."""
    hit = rule_matches(items, item, name, text, rules).select(F.col("item").alias("hit")).distinct()
    shown = items.join(hit, items[item] == hit["hit"], "left")
    return shown.withColumn(text, F.when(F.col("hit").isNotNull(), "").otherwise(F.col(text))).drop("hit")
