"""op9: every page's url under four domain rules and the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbitra.llm.registry import query
from arbitra.llm.tables import read
from arbitra.llm.urls import MIN_SOFT, SOFT_TERMS, STRICT_TERMS, judge_urls

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def _hits(terms: tuple[str, ...]) -> str:
    return " + ".join(f"regexp_matches(t, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')::BIGINT" for w in terms)


def _fits(rule: str) -> str:
    domain, _, start = rule.partition("/")
    return f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{start}')"


SQL = f"""
WITH a AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), b AS (
    SELECT page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM a
), c AS (
    SELECT *, {MIN_SOFT} * ({_hits(STRICT_TERMS)}) + {_hits(SOFT_TERMS)} AS weight,
        CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for r in sorted(RULES, key=len, reverse=True))} END AS rule
    FROM b
)
SELECT page_id, host, path, rule, weight,
    CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES.items())}
        WHEN weight >= {MIN_SOFT} THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""


@query("op9_url_vocabulary", SQL)
def op9_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), RULES).drop("strict_hits", "soft_hits")
