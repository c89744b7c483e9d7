"""op11: clusters of all embeddings."""

from gridwash.llm.clustering import ROUNDS, clustered, with_inertia
from gridwash.llm.queries import query


def sql() -> str:
    rounds = []
    for i in range(ROUNDS + 1):
        rounds.append(f"""
near{i} AS MATERIALIZED (
  SELECT vec_id, v, cluster, distance FROM (
    SELECT x.nth, x.vec_id, x.v, c.cluster, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))
             ::BIGINT AS distance,
           row_number() OVER (PARTITION BY x.nth ORDER BY distance, c.cluster) AS place
    FROM usable x CROSS JOIN centroids{i} c) WHERE place = 1)""")
        if i < ROUNDS:
            rounds.append(f"""
parts{i} AS (SELECT cluster, unnest(v) AS c, unnest(range(64)) AS j FROM near{i}),
means{i} AS (
  SELECT cluster, list(m ORDER BY j) AS v FROM (
    SELECT cluster, j, ((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM parts{i} GROUP BY cluster, j) GROUP BY cluster),
centroids{i + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.v, o.v) AS v FROM centroids{i} o LEFT JOIN means{i} m USING (cluster))""")
    return f"""
WITH usable AS MATERIALIZED (
  SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
centroids0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1)::INTEGER AS cluster, v FROM usable
  QUALIFY cluster < 16),{",".join(rounds)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM near{ROUNDS} JOIN centroids{ROUNDS} c USING (cluster)
"""


@query("op11_clustering", sql())
def op11_clustering(t):
    found, centroids = clustered(t.embeddings)
    return with_inertia(found, centroids).select("id", "cluster", "distance", "cluster_inertia", "inertia",
                                                 "centroid_sha256").withColumnRenamed("id", "vec_id")
