"""URL filters: domain rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

Every url is decided in its own row, so a hot host costs nothing and there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.llm.tables import ascii_lower

#: One strict term rejects a url; soft terms only together.
STRICT_TERMS = ("bestiality", "hardcore", "hentai", "milf", "porn", "porno", "warez", "xxx")
SOFT_TERMS = (
    "adult", "bet", "casino", "cracked", "dating", "escort", "keygen", "loan", "nude", "pills", "poker",
    "sex", "sexy", "slots", "torrent", "viagra", "webcam",
)
MIN_SOFT = 2
SOFT_WEIGHT = 1


@lru_cache(maxsize=8)
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """The compiled automaton, once per worker and vocabulary."""
    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    found.make_automaton()
    return found


def _plain(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def bounded_terms(text: str, terms: tuple[str, ...]) -> list[str]:
    """Distinct terms that stand in the text with no letter or digit next to them, sorted."""
    found = set()
    for end, term in automaton(terms).iter(text):
        start = end - len(term) + 1
        if (start == 0 or not _plain(text[start - 1])) and (end + 1 == len(text) or not _plain(text[end + 1])):
            found.add(term)
    return sorted(found)


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """Array of the distinct bounded terms of an already lower-cased text."""
    vocabulary = tuple(sorted(set(terms)))

    @F.pandas_udf("array<string>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: bounded_terms(t, vocabulary) if t else [])

    return hits(text)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and all that follows the first ``://``, each empty if there is none.

    The host is lower-cased (A-Z) and keeps a port or user name; the path ends at ``?`` or ``#``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path, ascii_lower(rest)


def matching_rule(host: Column, path: Column, rules: Mapping[str, str]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict.

    A rule is ``host/path``; it fits its host and all subdomains where the url's path starts with
    the rule's.  Of equally long rules the first by name wins.  Rules are configuration.
    """
    rule = verdict = F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r), reverse=True)[::-1]:
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


def judge_urls(
    pages: DataFrame,
    rules: Mapping[str, str],
    id_col: str = "page_id",
    url_col: str = "url",
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    min_soft: int = MIN_SOFT,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, weight, strict_hits and soft_hits.

    A fitting rule decides.  Otherwise one strict term, or ``min_soft`` distinct soft terms, block
    the url; ``weight`` is 1 per soft and ``min_soft`` per strict term, so a weight of ``min_soft``
    blocks.  A null url, and one without ``://``, has no host, path or hits and is allowed.
    Repeated rows are judged one by one; other columns of the input are ignored, whatever their
    names; an empty table gives no rows.
    """
    strict_set, soft_set = sorted(set(strict)), sorted(set(soft) - set(strict))
    host, path, text = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), text.alias("text"))
    hits = parts.withColumn("hits", term_hits(F.col("text"), strict_set + soft_set))
    strict_hits = F.array_intersect("hits", F.lit(strict_set))
    soft_hits = F.array_intersect("hits", F.lit(soft_set))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    weight = (F.size("strict_hits") * min_soft + F.size("soft_hits") * SOFT_WEIGHT).cast("long")
    judged = hits.select(
        id_col, "host", "path", rule.alias("rule"), verdict.alias("by_rule"),
        strict_hits.alias("strict_hits"), soft_hits.alias("soft_hits"),
    ).withColumn("weight", weight)
    by_words = F.when(F.col("weight") >= min_soft, "block").otherwise("allow")
    return judged.select(
        id_col, "host", "path", "rule", F.coalesce("by_rule", by_words).alias("verdict"),
        "weight", "strict_hits", "soft_hits",
    )
