"""Text expressions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic.
STOPWORDS = ["the", "and", "for", "that", "with", "was", "what", "did", "about", "from", "this", "have"]


def words(text: Column) -> Column:
    """Runs of letters and digits of any script, lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def keywords(text: Column) -> Column:
    """Words of three characters or more that aren't stop words; repeats stay."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(words(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def keyword_share(text: Column, terms: list[str]) -> Column:
    """The share of ``terms`` that occur within the lower-cased text; 0 without terms."""
    hits = sum((F.when(F.contains(F.lower(text), F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    return hits / F.lit(float(len(terms))) if terms else F.lit(0.0)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fingerprint(*parts: Column) -> Column:
    """SHA-1 of the trimmed, lower-cased parts joined by a bar; null is empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(F.lower(F.trim(p)), F.lit("")) for p in parts]))


def content_id(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-1 of the parts joined by a bar."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])), 1, 16)


def truncate_title(text: Column, empty: str) -> Column:
    """White space collapsed; beyond 72 characters 69 and an ellipsis; ``empty`` for none."""
    plain = F.coalesce(collapse(text), F.lit(""))
    return (
        F.when(plain == "", F.lit(empty)).when(F.length(plain) > 72, F.concat(F.rtrim(F.substring(plain, 1, 69)), F.lit("…"))).otherwise(plain)
    )


def alphanumeric(text: Column) -> Column:
    """Lower case, with a-z, 0-9 and blanks only, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""))


def long_lines(text: Column, least: int = 2) -> Column:
    """Trimmed lines of ``least`` characters or more, each once, in order."""
    lines = F.transform(F.split(text, "\n"), lambda x: collapse(x))
    return F.array_distinct(F.filter(lines, lambda x: F.length(x) >= least))


def is_menu(text: Column) -> Column:
    """Whether a text looks like navigation: 6 lines or more, shorter than 28 on average, 7 of 10 with 4 words at most."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n = F.size(lines)
    total = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x))
    few = F.size(F.filter(lines, lambda x: F.size(F.split(F.trim(x), " +")) <= 4))
    return (n >= 6) & (total < F.lit(28) * n) & (few >= F.lit(0.7) * n)


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags, with entities decoded and white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return collapse(out)


def page_title(html: Column) -> Column:
    return collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def useful(text: Column) -> Column:
    """Whether a text tells something: no menu, 40 letters and digits or more, 4 words or more."""
    plain = F.coalesce(text, F.lit(""))
    signs = F.length(F.regexp_replace(plain, r"[^\p{L}\p{N}]", ""))
    return ~is_menu(plain) & (signs >= 40) & (F.size(F.split(collapse(plain), " ")) >= 4)


def choose(first: Column, second: Column) -> Column:
    """The first of two texts that is useful, ``first`` before ``second``; else ``second``, else ``first``."""
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    return F.when(useful(first), first).when(useful(second), second).otherwise(F.coalesce(blank(second), blank(first), F.lit("")))


def without_lines(text: Column, known: list[str]) -> Column:
    """The text without blank lines and without lines that, lower-cased, are ``known``; blanks collapsed."""
    gone = F.array(*[F.lit(x) for x in known])
    lines = F.transform(F.split(text, "\n"), lambda x: collapse(x))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~F.array_contains(gone, F.lower(x))), "\n")


def match_expression(text: Column) -> Column:
    """The words of a text in quotes, joined by OR, as a full-text index takes them."""
    plain = F.transform(F.split(text, " "), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    return F.array_join(F.transform(F.filter(plain, lambda w: w != ""), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def region_score(text: Column, area: Column) -> Column:
    """How much a region of a screen tells: its length, weighed by the mean line and the area; a quarter for menus."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    total = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x)).cast("double")
    mean = total / F.greatest(F.size(lines), F.lit(1))
    shape = F.lit(0.35) + F.lit(0.65) * F.least(mean / 36, F.lit(1.0))
    size = F.lit(0.45) + F.lit(0.55) * F.least(area / F.lit(180000.0), F.lit(1.0))
    return F.length(text) * shape * size * F.when(is_menu(text), 0.25).otherwise(1.0)


def hashed_embedding(text: Column, size: int = 384) -> Column:
    """A unit vector of signed hashed words, and of pairs of words by half; zeros for a text without words."""
    word = re.compile(r"\w+")

    @F.pandas_udf("array<double>")
    def embedded(texts: pd.Series) -> pd.Series:
        out = []
        for one in texts:
            tokens, vector = word.findall((one or "").casefold()), np.zeros(size)
            pairs = [f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)]
            for weight, terms in ((1.0, tokens), (0.5, pairs)):
                for term in terms:
                    digest = hashlib.blake2b(term.encode(), digest_size=16).digest()
                    vector[int.from_bytes(digest[:4], "big") % size] += weight if digest[4] & 1 else -weight
            length = np.sqrt(vector @ vector)
            out.append(vector / length if length else vector)
        return pd.Series(out)

    return embedded(text)
