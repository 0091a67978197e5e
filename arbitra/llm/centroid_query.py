"""op11: centroid clustering of the embeddings and its SQL, one block per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbitra.llm.centroids import clusters, with_inertia
from arbitra.llm.registry import query
from arbitra.llm.tables import read

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2


def _sql() -> str:
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""
near{r} AS MATERIALIZED (
  SELECT n, v, arg_min(c, d * {K} + c) AS c, min(d) AS d FROM (
    SELECT k.n, k.v, g.c, list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (k.v[i] - g.v[i]) * (k.v[i] - g.v[i])))::BIGINT AS d
    FROM kept k CROSS JOIN cent{r} g)
  GROUP BY n, v)""")
        if r < ROUNDS:
            rounds.append(f"""
cent{r + 1} AS MATERIALIZED (
  SELECT g.c, CASE WHEN m.v IS NULL THEN g.v ELSE m.v END AS v FROM cent{r} g LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
      SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
      FROM (SELECT c, unnest(v) AS x, unnest(range(1, {DIMS + 1})) AS i FROM near{r}) GROUP BY c, i)
    GROUP BY c) m ON m.c = g.c)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {DIMS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = {DIMS}),
cent0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
  FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT {K})),
{",".join(rounds)}
SELECT k.vec_id, a.c AS cluster, a.d AS distance,
  sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(g.v, ',')) AS centroid_sha256
FROM near{ROUNDS} a JOIN kept k ON k.n = a.n JOIN cent{ROUNDS} g ON g.c = a.c
"""


@query("op11_ptolemaic_clusters", _sql())
def op11_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = clusters(read(spark, sf_dir, "embeddings"), K, ROUNDS, DIMS, SCALE, SEED)
    return with_inertia(assigned, centroids)
