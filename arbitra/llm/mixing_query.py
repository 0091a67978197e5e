"""op6: all documents mixed by source, weights 1, 2, 3 in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbitra.llm import mixing as m
from arbitra.llm.registry import query
from arbitra.llm.tables import read

WEIGHTS = (1, 2, 3)

SQL = f"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        md5('{m.SEED}|' || coalesce(doc_id::VARCHAR, '')) AS o
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
    SELECT *, {m.MAX_EPOCHS} * source_size AS most,
        [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
    FROM s
), l AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
    FROM r WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
    SELECT max(level) AS level FROM l WHERE level * weight <= most
), t AS (
    SELECT source, source_size,
        CASE WHEN f.level IS NULL THEN most ELSE least(most::DOUBLE, f.level * weight) END AS target
    FROM l, f
), n AS (
    SELECT least(greatest(coalesce(sum(size), 0)::BIGINT >> {m.SLOT_BITS}, 1), {m.MAX_BLOCK_TOKENS}) AS block FROM d
), c AS (
    SELECT t.*, block,
        (ceil(upto / block) - ceil((upto - target) / block)) * block AS stop
    FROM (SELECT *, sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM t) t, n
), p AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS start
    FROM d
)
SELECT doc_id, size, source_size, target,
    ({" + ".join(f"greatest(0, least(start + size + {e} * source_size, stop) - start - {e} * source_size)" for e in range(m.MAX_EPOCHS))})
        ::BIGINT AS taken
FROM p JOIN c ON p.source IS NOT DISTINCT FROM c.source
"""


@query("op6_source_mix", SQL)
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.mix(read(spark, sf_dir, "documents"), WEIGHTS)[0]
