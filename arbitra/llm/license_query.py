"""op8: license templates in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbitra.llm.licenses import MIN_CONTAINMENT, TEMPLATES, license_matches
from arbitra.llm.registry import query
from arbitra.llm.tables import read

_WORDS = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
)
_GRAMS = "list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))"
_TEMPLATES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
SQL = f"""
WITH t AS (
    SELECT license, ws, len(ws) AS n FROM (SELECT license, {_WORDS} AS ws FROM (VALUES {_TEMPLATES}) v(license, text))
), s AS (
    SELECT license, list_distinct({_GRAMS}) AS grams,
        CASE WHEN n < 16 THEN n ELSE ceil(n / (1 << (floor(log2(n))::INT - 2)))::BIGINT * (1 << (floor(log2(n))::INT - 2)) END AS step
    FROM t
), g AS (
    SELECT license, step, len(grams) AS n, unnest(grams) AS gram FROM s
), d AS (
    SELECT doc_id, unnest({_GRAMS}) AS gram, unnest(range(0, len(ws) - 4)) AS p FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)
), m AS (
    SELECT doc_id, license, n, step, gram, p, unnest([p // step, p // step - 1]) AS k FROM d JOIN g USING (gram)
), w AS (
    SELECT doc_id, license, k * step AS start, count(DISTINCT gram) / any_value(n) AS containment
    FROM m WHERE k >= 0 AND p - k * step <= 2 * step - 5 GROUP BY doc_id, license, step, k
)
SELECT doc_id, license, max(containment) AS containment, arg_max(start, (containment, -start))::BIGINT AS start
FROM w WHERE containment >= {MIN_CONTAINMENT} GROUP BY doc_id, license
"""


@query("op8_license_templates", SQL)
def op8_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(read(spark, sf_dir, "documents"))
